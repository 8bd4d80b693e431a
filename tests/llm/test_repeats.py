import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from made_texts import prose

from tidemark.llm import columnsort, repeats


def brute(pairs):
    raws = [(i, (t or "").encode()) for i, t in pairs]
    count = Counter(raw[k:k + 400] for _, raw in raws for k in range(len(raw) - 399))
    out = Counter()
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 399):
            if count[raw[k:k + 400]] > 1:
                gone[k:k + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[(i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def collection():
    rng = random.Random(8)
    passage, other = prose(rng, 120), prose(rng, 90, "fr")
    out = [prose(rng, rng.randint(5, 200)) for _ in range(20)]
    out += [f"{prose(rng, rng.randint(0, 60))} {passage} {prose(rng, rng.randint(0, 60))}" for _ in range(25)]
    # Shared strings of just under, exactly and just over the length, and a text that repeats itself.
    for n in (398, 399, 400, 401, 430):
        out += ["<" + other[:n] + ">" + prose(rng, 20), "[" + other[:n] + "]" + prose(rng, 30)]
    out += [passage[100:550] + "-" + passage[100:550], "ab" * 600, "z" * 399, "z" * 400, "y" * 401, prose(rng, 300)] * 1
    out += [out[0] + out[1], out[30], out[30]]
    return list(enumerate(out))


@pytest.mark.parametrize("heavy", [100_000, 1])
def test_equals_brute_force(make_docs, odd_texts, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    pairs = collection() + [(i, t) for i, t in odd_texts if t is None or len(t) < 9000] + [(50, "z" * 5000)]
    assert rows(repeats.remove_repeats(make_docs(pairs))) == brute(pairs)


def test_kept_bytes_and_empty_table(make_docs):
    rng = random.Random(1)
    a, b, shared = prose(rng, 50), prose(rng, 50), prose(rng, 150)
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(
        make_docs([(1, f"{a}<{shared}>"), (2, f"{shared}{b}")])).collect()}
    assert got == {1: f"{a}<>", 2: b}
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_long_texts_have_the_same_anchors_in_blocks(monkeypatch):
    data = np.frombuffer(prose(random.Random(2), 4000).encode(), np.uint8)
    whole = repeats.find_anchors(data, np.array([0, len(data)]))[1]
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    parts = [repeats.find_anchors(data[a:a + 3000 + repeats.LENGTH], np.array([0, min(3000 + repeats.LENGTH, len(data) - a)]))[1] + a
             for a in range(0, len(data), 3000)]
    assert set(whole) == set(np.unique(np.concatenate(parts)))


@pytest.mark.parametrize("extra", [-1, 0, 1, 399, 400, 9000])
def test_find_anchors_reads_blocks_itself(monkeypatch, extra):
    data = np.frombuffer(prose(random.Random(2), 4000).encode(), np.uint8)[:4096 + repeats.LENGTH + extra]
    whole = repeats.find_anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeats, "PLACE", 13)
    monkeypatch.setattr(repeats, "BLOCK", 1 << 12)
    text, place = repeats.find_anchors(data, np.array([0, len(data)]))
    assert list(place) == sorted(set(whole[1])) and not text.any()


def test_a_text_of_more_than_eight_mebibytes(make_docs):
    big = np.random.default_rng(4).integers(97, 123, (1 << 23) + 600_000, np.uint8).tobytes().decode()
    edge = (1 << 23) - 300
    shared = big[edge:edge + 1000]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(
        make_docs([(1, big), (2, f"<{shared}>")])).collect()}
    kept = hashlib.sha256((big[:edge] + big[edge + 1000:]).encode()).hexdigest()
    assert got == {1: (len(big), 1000, 1, kept), 2: (1002, 1000, 1, hashlib.sha256(b"<>").hexdigest())}


def test_columns_give_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 3, (200, 12))
    steps = list(columnsort.rounds((grid[:, k] for k in range(11, -1, -1)), 200, 100))
    for k, (order, common) in enumerate(steps):
        tails = [tuple(grid[i, 11 - k:]) for i in order]
        assert tails == sorted(tails)
        want = [0] + [next((x for x, (p, q) in enumerate(zip(a, b)) if p != q), k + 1) for a, b in zip(tails, tails[1:])]
        assert list(common) == want
