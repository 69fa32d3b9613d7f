"""Validation and audit of conversations, questions and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alignment(found: DataFrame, expected: DataFrame, conv: str, key: str) -> DataFrame:
    """State of every key of a conversation: ok, mismatched (found more than once), invalid (not expected) or missing."""
    n = found.groupBy(conv, key).agg(F.count("*").alias("n"))
    e = expected.select(conv, key).distinct().withColumn("e", F.lit(True))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "invalid").when(F.col("n") != 1, "mismatched").otherwise("ok")
    return n.join(e, [conv, key], "full").select(conv, key, state.alias("state"))


def coverage(questions: DataFrame, by: list[str], types: list[str], least: int, first_stage: str, excused: list[str]) -> DataFrame:
    """Per group: too few questions, questions of unknown type, and required types that are absent (some are excused in the first stage)."""
    need = F.transform(F.array(*map(F.lit, types)), lambda x: x)
    per = questions.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("type").isin(types)).alias("unknown"), F.collect_set("type").alias("seen"))
    must = F.when(F.col(by[-1]) == first_stage, F.array_except(need, F.array(*map(F.lit, excused)))).otherwise(need)
    return per.select(*by, "n", "unknown", (F.col("n") < least).alias("few"), F.array_join(F.array_sort(F.array_except(must, "seen")), ",").alias("absent"))


def audit(turns: DataFrame, by: list[str]) -> DataFrame:
    """Words per turn (mean and range), short turns and lines that read like a policy, per group."""
    policy = F.lower("text").rlike("policy|retain|store|remember")
    return turns.groupBy(*by).agg(F.count("*").alias("turns"), F.avg("n_words").alias("mean_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"), F.count_if(F.col("n_words") < 8).alias("short_turns"), F.count_if(policy).alias("policy_lines"))


def annotations_long(wide: DataFrame, ids: list[str], columns: list[str], sep: str = ":::") -> DataFrame:
    """Long form of numeric columns named statement:::label: odd values are true; missing ones are skipped."""
    return wide.unpivot(ids, columns, "column", "raw").where("raw IS NOT NULL").select(*ids, F.split("column", sep)[0].alias("statement"), F.pmod(F.col("raw").cast("int"), F.lit(2)).alias("value"))


def majority(votes: DataFrame, item: list[str]) -> DataFrame:
    """Per item the value that more than half gave; without one the largest value given."""
    n = votes.groupBy(*item, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*item)
    t = n.withColumn("total", F.sum("n").over(w))
    return t.groupBy(*item).agg(F.coalesce(F.max(F.when(F.col("n") * 2 > F.col("total"), F.col("value"))), F.max("value")).alias("majority"), F.max("total").alias("votes"))


def alpha(votes: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Krippendorff's alpha for nominal values per group. Units with one vote do not count. Counts of values per unit are
    enough: pairs within a unit need no self-join."""
    n = votes.groupBy(*by, unit, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, unit)
    n = n.withColumn("m", F.sum("n").over(w)).where("m > 1")
    same = n.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("agree"), F.sum("n").cast("double").alias("all"))
    value = n.groupBy(*by, "value").agg(F.sum("n").cast("double").alias("nv")).groupBy(*by).agg(F.sum(F.col("nv") * (F.col("nv") - 1)).alias("chance"))
    observed = 1 - F.col("agree") / F.col("all")
    expected = 1 - F.col("chance") / (F.col("all") * (F.col("all") - 1))
    return same.join(value, by).select(*by, F.round(F.when(expected > 0, 1 - observed / expected).otherwise(1.0), 9).alias("alpha"))
