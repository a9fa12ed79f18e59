"""Exact top-k search against all scores, computed with Python's whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm.topk import Pivots, _slabs, pick, scores, top_inner_products, whole

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, k=5, scale=256):
    part = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in v):
            continue
        part.append((i, [math.floor(x * scale) if abs(x * scale) < 2**53 else int(x * scale) for x in v]))
    out = []
    for a, (i, q) in enumerate(part):
        if i is None or i % every:
            continue
        s = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j is None, j or 0, b) for b, (j, v) in enumerate(part) if b != a]
        out += [(i, n + 1, None if t[1] else t[2], -t[0]) for n, t in enumerate(sorted(s)[:k])]
    return sorted(out, key=repr)


def found(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"score": F.lit("clash"), "rank": F.lit(1), "_row": F.lit(1)})
    return sorted((tuple(r) for r in top_inner_products(df.repartition(parts), **how).collect()), key=repr)


def clusters(rng, n, dim=8, centres=6):
    at = [[rng.gauss(0, 3) for _ in range(dim)] for _ in range(centres)]
    return [[x + rng.gauss(0, 0.3) for x in rng.choice(at)] for _ in range(n)]


SMALL = {"block_bytes": 8 * 8 * 16, "cell_bytes": 8 * 8 * 64, "slab_bytes": 8 * 8 * 4, "pivots": 6}


def test_clusters_over_many_cells(spark):
    rng = random.Random(2)
    rows = list(enumerate(clusters(rng, 700)))
    assert found(spark, rows, every=10, **SMALL) == brute(rows, every=10)


def test_odd_rows_and_ties(spark):
    rng = random.Random(4)
    same = [0.5] * 8
    rows = [(i, same) for i in range(250)]
    rows += [(1000 + i, v) for i, v in enumerate(clusters(rng, 200))]
    rows += [(50, None), (100, [None] * 8), (150, [math.nan] + same[1:]), (200, [math.inf] * 8), (250, [0.0] * 8), (300, []), (350, same[:3]), (400, same + [9.0])]
    rows += [(1000, same), (1000, same), (None, same), (None, [9.0] * 8), (-50, [-0.001] * 8), (450, [1e307] + [0.0] * 7)]
    rows += [(2**60 + 24, same)]
    assert (2**60 + 24) % 50 == 0
    assert found(spark, rows, **SMALL) == brute(rows)
    assert found(spark, rows) == brute(rows)


def test_large_numbers_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, -1]) * 10.0 ** rng.randint(0, 9) + rng.random() for _ in range(4)]) for i in range(120)]
    rows += [(500, [1e200, 1.0, 0.0, 0.0]), (550, [-1e200, 2.0, 0.0, 0.0]), (600, [1e30, 1e30, 1.0, 1.0])]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows(spark, n):
    rows = [(50 * i, [float(i), 1.0]) for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_bounds_hold_and_leave_out():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(500, 8)) + 900 * rng.integers(0, 2, (500, 8)))
    pivots = pick(x, 8, math.sqrt((x * x).sum(1).max()))
    assert len(pivots.points) == 8
    to, near = pivots.distances(x, False), pivots.distances(x[:50], True)
    r, own = to.min(1), to.argmin(1)
    all_scores = scores(x[:50], x)
    kth = np.sort(all_scores, 1)[:, -5].astype(float)
    reach = pivots.reach(x[:50], kth)
    out = np.abs(near[:, own] - r) > reach[:, None]
    assert not (out & (all_scores >= kth[:, None])).any()
    assert out.any()


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.001, -0.0],), ([1e300],), ([None],), (None,), ([math.nan],), ([1.7e308],)], "e array<double>")
    assert [r[0] for r in df.select(whole(F.col("e"), 256)).collect()] == [[128.0, -1.0, 0.0], [256e300], None, None, None, None]


def test_distances_of_copies_are_near_zero():
    x = np.full((3, 4), 100.0)
    assert Pivots(x[:1], 200.0).distances(x, False).max() < 1e-3


def test_slabs_share_pivots_and_part_large_ones():
    assert _slabs({0: 3, 1: 4, 2: 25, 3: 10, 5: 1}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 5: (5, 1)}
    assert _slabs({}, 10) == {}
