import random
import re

import numpy as np
import pytest
import xxhash
from made_texts import prose

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    prints = [brute_fingerprint(t) for _, t in pairs]
    home = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and home[i] != home[j]:
                home = [home[i] if h == home[j] else h for h in home]
    least = {h: min((p[0] for p, g in zip(pairs, home) if g == h and p[0] is not None), default=None) for h in home}
    return sorted(((p[0], f"{f:016x}", least[h]) for p, f, h in zip(pairs, prints, home)), key=repr)


def test_fingerprint(odd_texts):
    texts = [t for _, t in odd_texts if t is None or len(t) < 9000] + ["A b", "a B c", "x\x1cy z w", "a b c d " * 40000, "É é A\x0b b"]
    for text in texts:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_masks_keep_every_pair_of_two_bits():
    masks = simhash.first_masks()
    assert len(masks) == 6
    for round_ in range(4):
        rng = random.Random(round_)
        for mask in masks:
            free = [k for k in range(64) if not mask >> k & 1]
            for _ in range(50):
                gone = sum(1 << k for k in rng.sample(free, min(2, len(free))))
                assert any(not m & gone for m in simhash.longer_masks(mask))
        masks = [k for m in masks[:3] for k in simhash.longer_masks(m)]
    assert all(sum(1 for k in range(64) if not m >> k & 1) <= 12 for m in masks)


def test_bucket_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    value = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 20, 12, dtype=np.uint64)) ** k for k in range(9)]))
    value = np.unique(np.concatenate([value, value ^ np.uint64(7), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    bucket = np.zeros(len(value), np.int64)
    u, v = simhash.bucket_links(bucket, value)
    assert (np.bitwise_count(u ^ v) <= 2).all() and len(u) < len(value) * 3
    home = {int(x): int(x) for x in value}

    def top(x):
        while home[x] != x:
            x = home[x]
        return x
    for a, b in zip(u.tolist(), v.tolist()):
        home[top(a)] = top(b)
    for a in value.tolist():
        for b in value.tolist():
            if (a ^ b).bit_count() <= 2:
                assert top(a) == top(b)


@pytest.mark.parametrize("together", [4096, 3])
def test_components(spark, make_docs, odd_texts, together):
    rng = random.Random(8)
    pairs = list(odd_texts)
    base = [prose(rng, n) for n in (60, 90, 400)]
    for i in range(100, 260):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(["x", "y"])
        pairs.append((i, " ".join(words)))
    pairs += [(400 + i, base[0].upper()) for i in range(40)] + [(None, base[0]), (None, None)]
    got = simhash.near_duplicates(make_docs(pairs), together=together).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(pairs)


def test_long_keys_lose_no_link(spark):
    rng = random.Random(2)
    # Fingerprints that agree in their upper 40 bits fill one bucket.
    values = sorted({(5 << 40) + rng.randrange(1 << 14) for _ in range(300)} | {rng.randrange(1 << 62) for _ in range(50)})
    nodes = spark.createDataFrame([(v,) for v in values], "node bigint")
    for together in (4096, 8):
        found = simhash.links(nodes, together=together).collect()
        home = {v: v for v in values}

        def top(x):
            while home[x] != x:
                x = home[x]
            return x
        for r in found:
            assert (r.u ^ r.v).bit_count() <= 2
            home[top(r.u)] = top(r.v)
        assert all(top(a) == top(b) for a in values for b in values if (a ^ b).bit_count() <= 2)


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
