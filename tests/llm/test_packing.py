import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from made_texts import prose
from tokenizers import Tokenizer

from tidemark.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "The", " the", "9", "'s", "é", "ß", "<|endoftext|>", "\t", "日本", "!", ".",
                                 ",", "\r\n", " ", "\u0085", "don't", "½"]), max_size=14))
def test_words_give_the_tokenizers_ids(parts):
    text = "".join(parts)
    words = packing._words(None)
    assert np.frombuffer(words(text), np.uint32).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50)), st.just(30))
def test_plans_are_gapless_and_complete(counts, capacity):
    plan = packing.plan(counts, capacity)
    placed = defaultdict(list)
    seen = Counter()
    for k in range(len(plan.length)):
        last = plan.first[k + 1] if k + 1 < len(plan.length) and plan.length[k + 1] == plan.length[k] else counts[plan.length[k]]
        for r in range(plan.first[k], last):
            placed[plan.base[k] + r - plan.first[k]].append((plan.offset[k], plan.length[k]))
            seen[plan.length[k]] += 1
    assert seen == Counter(counts) and len(placed) == plan.bins
    for slots in placed.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in slots) <= 2


def test_round_trip(make_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 3)
    rng = random.Random(9)
    pairs = odd_texts + [(k, prose(rng, rng.choice([1, 5, 50, 500, 2500]))) for k in range(30, 90)]
    got = packing.pack(make_docs(pairs)).collect()
    ids = {}
    for i, t in pairs:
        ids.setdefault(i, TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0])
    want = Counter()
    for i, _ in pairs:
        n = len(ids[i])
        cuts = [0, *range(n % 2048 or 2048, n + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[i][a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for slots in bins.values():
        ends = [0] + [o + n for o, n in sorted(slots)]
        assert [o for o, _ in sorted(slots)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(make_docs([])).count() == 0
