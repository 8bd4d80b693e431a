import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from made_texts import prose

from tidemark.llm import langid


def brute_bits(training, text, order=langid.ORDER):
    """Code length in bits of ``text`` under the tree of ``training``."""
    tree = defaultdict(Counter)
    for t in training:
        raw = t.encode()
        for k in range(len(raw)):
            for m in range(order + 1):
                if k >= m:
                    tree[raw[k - m:k]][raw[k]] += 1
    raw, bits = text.encode(), 0.0
    for k, byte in enumerate(raw):
        for m in range(min(k, order), -1, -1):
            seen = tree.get(raw[k - m:k])
            if seen is None:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, held_out string, score int")


def collection(n=60):
    rng = random.Random(2)
    return [(k, prose(rng, rng.randint(8, 40), lang), lang, "x", 0) for k in range(n) for lang in [["de", "en", "fr"][k % 3]]]


def test_code_lengths_equal_a_plain_tree(spark):
    rows = collection(30)
    trees = langid.train(table(spark, rows))
    learned = defaultdict(list)
    for i, text, lang, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            learned[lang].append(text)
    texts = ["the ing", "", "zq", "eau que\n日本 the", rows[4][1]]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = trees.text_bits(np.frombuffer(raw, np.uint8), offsets)
    want = np.array([[brute_bits(learned[lang], t) for lang in trees.languages] for t in texts])
    assert trees.languages == ["de", "en", "fr"]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_held_out_accuracy_and_odd_texts(spark, odd_texts):
    rows = collection() + [(1000 + k, t, None, "x", 0) for k, (_, t) in enumerate(odd_texts)] + [(None, "the ing and", "en", "x", 0)]
    docs = table(spark, rows)
    got = langid.predict(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, lang, _, _ in rows:
        r = by_id[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif lang:
            assert r.lang_pred == lang
        else:
            assert r.lang_pred in ("de", "en", "fr")


def test_nothing_learned(spark):
    none = table(spark, [])
    trees = langid.train(none)
    assert langid.predict(none, trees).count() == 0
    assert [r.lang_pred for r in langid.predict(table(spark, [(1, "words", "en", "x", 0)]), trees).collect()] == ["und"]
