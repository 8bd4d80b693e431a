import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import kernels as k

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té日", max_size=30)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_stay_inside_their_text(texts, limit):
    got = [[] for _ in texts]
    for first, stop, data, offsets in k.text_slices(pa.array(texts, pa.string()), limit):
        starts, stops, owner = k.word_spans(data, offsets)
        hashes = k.Rolling(data)(starts, stops)
        for a, b, o, h in zip(starts, stops, owner, hashes):
            got[first + o].append((data[a:b].tobytes(), h))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert [[w for w, _ in g] for g in got] == want
    by_word = {}
    for w, h in (x for g in got for x in g):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_do_not_cross_texts():
    words = np.arange(10, dtype=np.uint64)
    owner = np.array([0, 0, 0, 1, 1, 3, 3, 3, 3, 4])
    shingles, first = k.shingle_hashes(words, owner, 3)
    assert list(first) == [0, 5, 6] and len(set(shingles)) == 3
