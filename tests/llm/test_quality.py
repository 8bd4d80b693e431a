import random
import re
from collections import Counter

import numpy as np
from made_texts import prose

from tidemark.llm import linear, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def made(n, seed=1):
    rng = random.Random(seed)
    good = [prose(rng, rng.randint(60, 200)) for _ in range(n)]
    poor = [" | ".join(prose(rng, 1) + rng.choice("$#") * 3 for _ in range(120)) for _ in range(n)]
    return good, poor


def test_counts_and_odd_texts(make_docs, odd_texts):
    rng = random.Random(2)
    line = prose(rng, 6)
    texts = odd_texts + [(20, "\n".join([line] * 12)), (21, f"{line}\n\n{line} \n{line}"), (22, "a b c a b c d")]
    model = linear.Linear(np.zeros(2 * quality.HALF), 5.0)
    got = quality.score(make_docs(texts), model).collect()
    assert len(got) == len(texts)
    want = Counter((i, *brute(t), not brute(t)[-1]) for i, t in texts)
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS), r.kept) for r in got) == want


def test_learns_and_keeps_clean_documents(spark, make_docs):
    good, poor = made(120)
    docs = make_docs(list(enumerate(good + poor)))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 240, 2)] + [(0, None, 0), (None, 1, 0), (2, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    kept = {r.doc_id for r in quality.score(docs, model).where("kept").collect()}
    assert kept == set(range(120))
    rows = quality.accepted(docs, model)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept


def test_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = make_docs([])
    model = quality.train(docs, none)
    assert quality.score(docs, model).count() == 0 and quality.accepted(docs, model).count() == 0


def test_calibration_line():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    slope, shift = linear.calibrate(z, y)
    assert abs(slope - 0.5) < 0.1 and abs(shift + 1) < 0.15
