"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut, unit, word_count

#: The table of sources is broadcast up to this many counted rows; beyond, Spark joins by shuffle and splits hot sources.
BROADCAST_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Columns source, source_size, target: the words each source is to give.

    sizes has one row per source (source, source_size). Sources in code-point order, null last, take the
    weights in turn and share the total of all sizes; none gets over `most` times its size, and what is
    cut off is shared again by weight. A source is cut when the level words/weight, once all sources with
    a lower ceiling/weight are cut, would pass its own ceiling, so one pass in order of ceiling/weight
    finds the level. The table has a row per source, so one sorted window over it is small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    in_order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(in_order)).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(every).cast("double")
    s = s.withColumn("cut", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (total - F.col("cut")) / F.col("w_left")).withColumn("over", F.col("level") * F.col("w") > F.col("cap"))
    level = F.min(F.when(~F.col("over"), F.struct((F.col("cap") / F.col("w")).alias("r"), "i", "level"))).over(every)["level"]
    return s.withColumn("at", level).select("source", "source_size", F.when(F.col("over"), F.col("cap")).otherwise(F.col("at") * F.col("w")).alias("target"))


def rated(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: float, seed: str) -> DataFrame:
    """docs with _lw_size, _lw_source_size, _lw_target and _lw_copies: floor(rate) and one Bernoulli copy for the fraction."""
    sized = docs.withColumn("_lw_size", word_count(F.col(text_col)))
    per = targets(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("_lw_size").alias("source_size")), weights, most)
    per = cut(per.select(F.col("source").alias("_lw_source"), F.col("source_size").alias("_lw_source_size"), F.col("target").alias("_lw_target")))
    per = F.broadcast(per) if per.count() <= BROADCAST_ROWS else per.hint("merge")
    both = sized.join(per, sized[source_col].eqNullSafe(F.col("_lw_source")), "left").drop("_lw_source")
    rate = F.when(F.col("_lw_source_size") > 0, F.col("_lw_target") / F.col("_lw_source_size")).otherwise(0.0)
    extra = F.when(unit(F.lit(seed), id_col) < rate - F.floor(rate), 1).otherwise(0)
    return both.withColumn("_lw_copies", (F.floor(rate) + extra).cast("int"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Per document: id, size, source_size, target (its source's) and taken, the words the mix takes with repeats.

    Size is the number of words; a null text has 0. A null source is a source of its own. Rows repeating an
    id share one draw; so do rows with a null id. A source without words has target 0. Empty in, empty out.
    """
    r = rated(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, weights, most, seed)
    return r.select(id_col, F.col("_lw_size").alias("size"), F.col("_lw_source_size").alias("source_size"), F.col("_lw_target").alias("target"), (F.col("_lw_size") * F.col("_lw_copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as many times as its source's rate asks for, columns as they were."""
    r = rated(docs, id_col, text_col, source_col, weights, most, seed)
    return r.where("_lw_copies > 0").withColumn("_lw_copy", F.explode(F.sequence(F.lit(1), F.col("_lw_copies")))).select(*[docs[c] for c in docs.columns])
