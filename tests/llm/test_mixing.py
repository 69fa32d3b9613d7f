import pytest

from loomwright.llm import mixing


def filled(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] for s in capped} | share
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 1, "d": 997, None: 3}, {"z": 5}, {"é": 7, "f": 100, "Z": 3, None: 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_taken_words_come_near_their_targets(frame):
    rows = [(i, "w " * (1 + i % 40)) for i in range(6000)]
    docs = frame(rows, ["a", "b", "c", None])
    out = mixing.mix_report(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_report(docs.repartition(7)).collect()))
    sums = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sums[r.target, r.source_size] = sums.get((r.target, r.source_size), 0) + r.taken
    assert len(sums) == 4 and all(abs(got - t) < 0.05 * t for (t, _), got in sums.items())
    assert mixing.mix(docs).columns == docs.columns
    from pyspark.sql import functions as F

    assert mixing.mix(docs).agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(r.taken for r in out)


def test_edges(frame):
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(frame([(1, None), (2, ""), (3, " \n")])).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    assert mixing.mix_report(frame([(1, "a")]).limit(0)).count() == 0 and mixing.mix(frame([(1, "a")]).limit(0)).count() == 0
    one = mixing.mix_report(frame([(1, "a b"), (1, "a b"), (None, "c")], None)).collect()
    assert len(one) == 3 and all(r.source_size == 5 for r in one)
