"""Lineage is cut together with the plan's statistics, which otherwise double their digits with every join in a loop."""

from loomwright.llm.common import cut
from loomwright.llm.components import components


def digits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_loops_do_not_blow_up_the_drivers_statistics(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = components(path, few=0)
    assert digits(found) < 300
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(201)} | {(1000, 1000), (1001, 1000)}


def test_cut_keeps_rows_columns_and_types(spark):
    df = spark.createDataFrame([(1, "a", [1.5, None], {"k": 1}), (None, None, None, None), (1, "a", [1.5, None], {"k": 1})], "x long, `y z` string, v array<double>, m map<string,int>")
    held = cut(df.withColumn("s", df["x"] * 2))
    assert held.schema == df.withColumn("s", df["x"] * 2).schema and sorted(map(str, held.collect())) == sorted(map(str, df.withColumn("s", df["x"] * 2).collect()))
    assert cut(df.limit(0)).count() == 0 and held.join(held.select("x").distinct(), "x").count() == 2


def test_a_tables_joins_with_itself_leave_no_growing_number(spark):
    """As the near-duplicate stage does: what is known so far is joined, cut and joined again."""
    known = cut(spark.createDataFrame([(i, i // 2) for i in range(20)], "node long, root long"))
    for _ in range(6):
        up = known.selectExpr("node AS root", "root AS next")
        known = cut(known.hint("merge").join(up.hint("merge"), "root").selectExpr("node", "next AS root"))
    assert digits(known) < 300 and {tuple(r) for r in known.collect()} == {(i, 0) for i in range(20)}
