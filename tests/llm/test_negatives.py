import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import negatives

FAR = 2**63 - 1


def brute(rows, positives=5, k=5):
    """Every row against every anchor, in Python's whole numbers."""
    held = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        held[i] = max(held.get(i, (lab, v)), (lab, v))
    whole = {i: [int(np.floor(np.float64(256) * x)) if abs(x) < 1e300 else int(x) * 256 for x in v] for i, (_, v) in held.items()}
    out = []
    for a in held:
        if a % 100:
            continue
        score = lambda o, a=a: max(-FAR - 1, min(FAR, sum(x * y for x, y in zip(whole[a], whole[o], strict=True))))
        others = sorted((-score(o), o) for o in held if o != a and len(whole[o]) == len(whole[a]))
        for p, pos in [x for x in others if held[x[1]][0] == held[a][0]][:positives]:
            some = [(s, o) for s, o in others if held[o][0] != held[a][0] and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, pos, r + 1, o, -p, -s) for r, (s, o) in enumerate(some)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"score": F.lit("x"), "leaf": F.lit(1), "rank": F.lit("y")}).repartition(4)
    return sorted(tuple(r) for r in negatives.mined(df, **how).collect())


@pytest.mark.parametrize("small", [{}, {"leaf": 20, "arity": 4, "tile": (2, 16)}])
def test_against_brute_force(spark, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 12))
    rows = [(i, (centres[i % 10] + 0.4 * rng.normal(size=12)).tolist(), int(rng.integers(10)) if i % 3 else i % 10) for i in range(900)]
    rows += [(i, [0.5] * 12, i % 4) for i in range(900, 1300)]  # ties, and a leaf that cannot be parted
    got = run(spark, rows, **small)
    assert got == brute(rows) and len(got) > 100


@pytest.mark.parametrize("small", [{}, {"leaf": 2, "arity": 2}])
def test_edges(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [None, 1.0], 2), (6, [inf, 1.0], 2), (None, [1.0, 2.0], 2), (7, [1.0, 2.0], None)]
    rows += [(8, [], 2), (100, [], 1), (101, [], 1), (200, [-1.0, 0.0], 1), (201, [1.0, 0.0], 1), (2, [1.0, 1.9], 1), (300, [1.0, 2.0, 3.0], 5), (301, [1.0, 2.0, 3.0], 5), (302, [1.0, 2.0, 2.9], 6)]
    assert run(spark, rows, **small) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(100, [1.0], 1)]) == []


@pytest.mark.parametrize("power", [-150, -20, 6, 40, 300])
def test_magnitudes(spark, power):
    rng = np.random.default_rng(4)
    rows = [(i, (10.0**power * rng.normal(size=3)).tolist(), int(i % 3)) for i in range(120)]
    assert run(spark, rows, leaf=10, arity=3) == brute(rows)


def test_children_are_eliminated_and_none_that_matters():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(300, 8)) for c in rng.normal(size=(12, 8))]))
    tree = negatives.Tree(float(np.abs(x).max()), float(((x / np.abs(x).max()) ** 2).sum(1).max()))
    tree.grow(tree.lifted(x[::3]), len(x), 6, 100)
    leaf = tree.leaf_of(tree.lifted(x), note=True)
    q = x[::50]
    score = q @ x.T
    top = np.sort(score, 1)[:, -20] - 1.0
    who, where = tree.reached(tree.lifted(q, query=True), 0.8 * top / tree.scale**2, top / tree.scale**2)
    met = set(zip(who.tolist(), where.tolist(), strict=True))
    for i in range(len(q)):
        for j in np.flatnonzero((score[i] >= 0.8 * top[i]) & (score[i] <= top[i])):
            assert (i, leaf[j]) in met
    assert len(met) < 0.6 * len(q) * tree.leaves
