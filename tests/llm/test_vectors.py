from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import vectors


def inner(a, b):
    """Left to right, as a plain loop adds; where that leaves the range of doubles, the sign of the true sum at infinity."""
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    if np.isfinite(out):
        return out
    true = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
    return float(true) if abs(true) < 2**1024 else float("inf") if true > 0 else float("-inf")


def brute(rows, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = max(ok.get(i, v), v)
    out = []
    for q in ok:
        if q % 20 == 0:
            near = sorted((-inner(ok[q], v), c) for c, v in ok.items() if c != q and len(v) == len(ok[q]))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(near)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, **how).collect())


def test_against_brute_force_with_small_tiles(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 24) for i in range(400, 700)]  # many equal vectors: ties go to the smaller id
    assert run(spark, rows, tile=(8, 64)) == brute(rows) == run(spark, rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (1, [2.0, 9.0]), (2, [1.0, 1.0, 1.0]), (120, [float("inf"), 1.0]), (140, [-1e300, 1e-300])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2000)) * 10.0 ** rng.integers(-6, 6, size=(50, 1))
    ids = np.arange(50)
    _, c, s = vectors.tile_top(ids, x, ids, x, 5)
    want = [sorted(((-(x[i] @ x[j]), j) for j in range(50) if j != i))[:5] for i in range(50)]
    assert c.reshape(50, 5).tolist() == [[j for _, j in w] for w in want] and np.allclose(s.reshape(50, 5), [[-v for v, _ in w] for w in want])


@pytest.mark.parametrize("power", [-200, -160, -100, 100, 150, 160, 200, 300])
def test_magnitudes(power):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5)) * 10.0**power
    x[60:] *= 10.0 ** rng.integers(-3, 4, size=(60, 1)) if power < 300 else 1.0
    ids = np.arange(120)
    q, c, s = vectors.tile_top(ids[::10], x[::10], ids, x, 7)
    want = [(i, j, -v) for i in ids[::10] for v, j in sorted((-inner(x[i].tolist(), x[j].tolist()), j) for j in ids if j != i)[:7]]
    assert [(a, b) for a, b in zip(q, c, strict=True)] == [w[:2] for w in want] and np.allclose(s, [w[2] for w in want], rtol=1e-12, atol=0)


def test_query_with_great_and_small_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (10.0 ** float(rng.integers(-200, 200)) * rng.normal(size=4)).tolist()) for i in range(200)] + [(300 + i, [1e160] * 4) for i in range(30)]
    assert run(spark, rows, tile=(4, 64)) == brute(rows)
