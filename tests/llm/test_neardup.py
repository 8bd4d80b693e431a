import random
import re
from itertools import combinations

import numpy as np
from made_texts import prose

from tidemark.llm import neardup, setsketch
from tidemark.llm.components import components


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def brute(pairs):
    named = [(i, shingles(t)) for i, t in pairs if i is not None]
    home = {i: i for i, _ in named}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for (i, a), (j, b) in combinations(named, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            home[y] = x
    return {(i, len(s), root(i), i == root(i)) for i, s in named}


def edited(rng, text, share):
    words = text.split(" ")
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = prose(rng, 1) + "z"
    return " ".join(words)


def collection(seed=3):
    rng = random.Random(seed)
    pairs = []
    for _ in range(25):
        base = prose(rng, rng.choice([30, 80, 300]))
        pairs += [base, base.upper()] + [edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06])) for _ in range(6)]
    # One large group around the limit of similarity.
    base = prose(rng, 200)
    pairs += [edited(rng, base, rng.choice([0.01, 0.03, 0.045])) for _ in range(120)]
    pairs += [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    rng.shuffle(pairs)
    return list(enumerate(pairs, 100))


def rows(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_components_equal_brute_force(make_docs, odd_texts):
    pairs = collection() + odd_texts
    got = rows(neardup.near_duplicates(make_docs(pairs)))
    assert {r for r in got if r[0] is not None} == brute(pairs)
    assert {r for r in got if r[0] is None} == {(None, 1, None, True)}


def test_small_blocks_change_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    pairs = collection(4)
    assert rows(neardup.near_duplicates(make_docs(pairs))) == brute(pairs)


def test_empty_table(make_docs):
    assert neardup.near_duplicates(make_docs([])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:]
    sets = [a, b, np.union1d(a, b)]
    owner = np.repeat(np.arange(3), [len(s) for s in sets])
    r = setsketch.registers(np.concatenate(sets), owner, 3)
    assert (setsketch.merge(r[0], r[1]) == r[2]).all()
    estimates = []
    for k in range(40):
        pool = rng.integers(0, 1 << 63, 1250).astype(np.uint64)
        both = np.concatenate([pool[:1000], pool[250:]])
        r = setsketch.registers(both, np.repeat([0, 1], 1000), 2)
        estimates.append(setsketch.joint_similarity(r[:1], r[1:], np.array([1000.0]), np.array([1000.0]))[0])
    assert abs(np.mean(estimates) - 0.6) < 0.03 and np.std(estimates) < 0.09


def test_long_chain_is_one_component(spark):
    order = list(range(300))
    random.Random(0).shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(300)}, 1000: 1000, 1001: 1000}
