"""Connected components of a large undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import cut


def with_least(pairs: DataFrame) -> DataFrame:
    """The pairs u, v with m, the least v of their u.

    The least is an aggregate with partial sums on the map side, written out before it is joined: both sides of the
    join are then plain shuffles, which Spark splits where one u has very many rows.
    """
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.hint("merge").join(least.hint("merge"), "u")


def in_one_task(e: DataFrame) -> DataFrame:
    """Columns node, root of a few edges v < u, by union-find in one task."""

    def each(batches):
        import pyarrow as pa

        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in list(root)], kind)], names=["node", "root"])

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(e.schema["v"].dataType)
    return e.select("v", "u").coalesce(1).mapInArrow(each, T.StructType([T.StructField(n, e.schema["v"].dataType) for n in ("node", "root")]))


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 20_000) -> DataFrame:
    """Columns node, root: every node of an edge with the smallest node that it reaches.

    Edges hold two comparable columns; loops, repeats and edges with a null end are ignored, and an empty
    table gives an empty result. Each round hangs neighbours on the least neighbour, first those above a
    node and then those below, so the number of rounds grows with the logarithm of the graph. Rows stay
    spread over the cluster; only one count and one checksum come to the driver in a round. Up to `few` edges, counted,
    are joined up in one task instead, with the same result and without some dozens of small jobs.
    """
    e = cut(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is None and 0 < now[0] <= few:
            return in_one_task(e)
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        low = with_least(cut(large.distinct()))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").select("v", "u").distinct())
