import math

import numpy as np
import pytest

from tidemark.llm import negatives


def brute(rows):
    sound = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, l, v, *_ in rows
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, l, v in sound:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), j, l) for j, l, w in sound]
        near = sorted(s for s in scored if s[2] == label and s[1] != a)[:5]
        for p in dict.fromkeys(near):
            fits = sorted(s for s in scored if s[2] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:10]
            out += [(a, p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out)


def test_scores_equal_inner_products():
    rng = np.random.default_rng(1)
    for width, most in ((64, 300), (5, 3), (17, 1 << 28), (0, 1), (8, 0)):
        x = rng.integers(-most, most + 1, (70, width))
        y = rng.integers(-most, most + 1, (9, width))
        assert (negatives.scores(negatives.bit_planes(x), negatives.subset_sums(y)) == y @ x.T).all()


SCHEMA = "vec_id bigint, label int, embedding array<float>, slot int, rank string, positive_id string"


def made(rng, n):
    rows = []
    for i in range(n):
        centre = np.eye(12)[i % 3] * 0.8
        rows.append((int(i), int(i % 4), [float(x) for x in (centre + rng.normal(0, 0.3, 12)).astype(np.float32)], 1, "a", "b"))
    return rows


@pytest.mark.parametrize("part", [8192, 2])
def test_hard_negatives(spark, part):
    rng = np.random.default_rng(4)
    rows = made(rng, 820)
    rows += [(900, 1, [0.0] * 12, 0, "", ""), (1000, None, [0.5], 0, "", ""), (None, 1, [0.5], 0, "", ""),
             (1100, 1, None, 0, "", ""), (1200, 2, [0.1, None], 0, "", ""), (1300, 2, [float("nan")] * 12, 0, "", ""),
             (1301, 2, [float("inf")] * 12, 0, "", ""), (1400, 3, [0.5, 0.25, -1.0], 0, "", ""), (1500, 3, [], 0, "", ""),
             *rows[300:302], *rows[410:412], rows[400]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if part == 8192:
        got = negatives.mine(df)
    else:
        whole = negatives.whole_numbers(df.select("vec_id", "label", "embedding")).selectExpr(
            "vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "vector")
        got = negatives.hard_negatives(whole, whole.where("vec_id % 100 = 0"), part=part)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
