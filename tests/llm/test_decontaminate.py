import math
import random
import re
from collections import Counter

import numpy as np
from made_texts import prose

from tidemark.llm import decontaminate as d

ITEM = "item_id bigint, text string, doc_id int"


def items_of(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in texts], ITEM)


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def test_search_equals_full_bm25(spark):
    rng = random.Random(4)
    texts = [(i, prose(rng, rng.randint(4, 60))) for i in range(90)]
    classes = next(iter(d.build_parts(items_of(spark, texts))))
    held = {i: tokens(t) for i, t in texts}
    df = Counter(w for ws in held.values() for w in set(ws))
    mean = sum(map(len, held.values())) / len(held)

    def weight(item, word):
        tf, dl = held[item].count(word), len(held[item])
        return math.log(1 + (len(held) - df[word] + .5) / (df[word] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / mean))

    passage = tokens(prose(rng, 40) + " " + " ".join(texts[7][1].split()[:30]) + " " + prose(rng, 50))
    raw = " ".join(passage).encode()
    words, owner = d._words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    for threshold in (0.2, 0.5):
        for index in classes:
            got = {(a, b, int(index.items[i])): s for _, a, b, i, s in d.search(index, words, owner, 1, threshold)}
            want = {}
            first, stop = d._passages(owner, index.stride, 1)
            for a, b in zip(first, stop):
                for item in index.items:
                    own = sum(weight(item, w) for w in set(held[item]))
                    score = sum(weight(item, w) for w in set(passage[a:b]) & set(held[item])) / own
                    if score >= threshold:
                        want[(a, b, int(item))] = score
            assert got.keys() == want.keys()
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def leaked():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([3, 12, 40, 150]))) for i in range(40)]
    docs = [(k, prose(rng, rng.randint(20, 400))) for k in range(60)]
    want = set()
    for k, i in ((2, 5), (9, 30), (33, 12), (59, 1)):
        if len(items[i][1].split()) > 3:
            words = docs[k][1].split()
            leak = items[i][1].upper().replace(" ", ", ")
            docs[k] = (k, " ".join(words[:10]) + "\n" + leak + ". " + " ".join(words[10:]))
            want.add((k, i))
    short = {i for i, t in items if len(t.split()) == 3}
    return items, docs, want, short


def test_finds_leaks_and_leaves_clean_documents(spark, make_docs, odd_texts):
    items, docs, want, short = leaked()
    got = {(r.doc_id, r.item_id) for r in d.contaminated(
        make_docs(docs + odd_texts), items_of(spark, items + [(90, None), (91, ""), (92, "?!"), (5, items[5][1])])).collect()}
    assert {g for g in got if g[1] not in short} == want


def test_parts_change_nothing_and_rows_keep_their_columns(spark, make_docs, monkeypatch):
    items, docs, want, short = leaked()
    long = [x for x in items if x[0] not in short]
    monkeypatch.setattr(d, "PART_POSTINGS", 100)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(make_docs(docs), items_of(spark, long)).collect()} == want
    left = d.clean(make_docs(docs), items_of(spark, long))
    assert left.columns == make_docs(docs).columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {k for k, _ in want}


def test_empty_tables(spark, make_docs):
    assert d.contaminated(make_docs([]), items_of(spark, [(1, "a b c")])).count() == 0
    assert d.contaminated(make_docs([(1, "a b c")]), items_of(spark, [])).count() == 0
    assert d.clean(make_docs([(1, "a b c")]), items_of(spark, [])).count() == 1


def test_large_parts_of_an_item_are_leaks(spark, make_docs):
    rng = random.Random(12)
    items = [(i, prose(rng, 60)) for i in range(30)]
    docs, want = [], set()
    for k in range(90):
        words, item = prose(rng, 200).split(), items[k % 30][1].split()
        part = {0: item[:40], 1: item[20:], 2: item[:12]}[k // 30]
        docs.append((k, " ".join(words[:50] + part + words[50:])))
        if k < 60:
            want.add((k, k % 30))
    got = d.contaminated(make_docs(docs), items_of(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_id for r in d.clean(make_docs(docs), items_of(spark, items)).collect()} == set(range(60, 90))
