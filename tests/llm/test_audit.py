import random
import re
from itertools import permutations

import pytest
from made_texts import prose

from tidemark.llm import audit


def brute_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3)


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    docs = [(s or "", brute_mask(t or "") | (16 if i is not None and i > least[t or ""] else 0), i in good, i in toxic)
            for i, t, s in rows]
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        lines, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [d for d in mine if d[1] & bit and not d[1] & gone]
                redundant = sum(1 for d in mine if d[1] & bit and d[1] & gone)
                gone |= bit
                shapley[f] += len(removed)
                lines.append(("".join(order), step, f, sum(1 for d in mine if not d[1] & gone), len(removed), redundant,
                              sum(1 for d in mine if d[1] == bit), sum(d[2] for d in removed), sum(d[3] for d in removed)))
        out += [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in lines]
    return sorted(out)


def test_trie_and_masks():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(400)] + ["", "日本", "日", "a" * 5000]
    trie = audit.Trie()
    for k, text in enumerate(texts):
        trie.insert(text)[1].append(k)
    assert sorted(sorted(e[1]) for e in trie.walk()) == sorted(
        [k for k, t in enumerate(texts) if t == u] for u in set(texts))
    import pyarrow as pa
    odd = ["", " ", "Ab", "é" * 300, "w " * 250, "X" + "y" * 48, "X" + "y" * 49, " ".join(map(str, range(200))), "a|b", "a\x1cb " * 120]
    assert audit.text_masks(pa.array(odd)).tolist() == [brute_mask(t) for t in odd]


@pytest.mark.parametrize(("prefix", "share", "size"), [(16, 4096, 32 << 20), (2, 3, 200)])
def test_least_ids(spark, prefix, share, size):
    rng = random.Random(3)
    texts = ["same start " * 9 + rng.choice("abc") * rng.randrange(4) for _ in range(300)] + ["", "x"] * 5
    rows = [(t, k, None if k % 50 == 7 else rng.randrange(90)) for k, t in enumerate(texts)]
    got = audit.least_ids(spark.createDataFrame(rows, "text string, name bigint, least bigint"), prefix, share, size)
    want = {t: min((r[2] for r in rows if r[0] == t and r[2] is not None), default=None) for t in texts}
    assert sorted(map(tuple, got.collect())) == [(k, want[t]) for t, k, _ in rows]


def test_audit(spark, odd_texts):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["a", None, "b"])) for i, t in odd_texts]
    good = " ".join(prose(rng, 12) + str(k) for k in range(40))
    for i in range(50, 150):
        rows.append((i, rng.choice([good, good, good + str(i), prose(rng, 250), "word " * 220, good + " #", good.upper(), None]),
                     rng.choice(["a", "b", None])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(60, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows],
                                 "doc_id bigint, text string, source string, part string, mask int, n int, name string")
    frame = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, good string")
    got = audit.audit(docs.repartition(3), frame).collect()
    assert sorted(map(tuple, got)) == brute(rows, labels)
    assert audit.audit(docs.limit(0), frame).collect() == []
