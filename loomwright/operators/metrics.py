"""Aggregations over scored items: rates, violation and utility tables, stage effects, class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.scoring import DISTRACTED, RECALLED, REFUSED

WORLDS = ["baseline", "no_store", "forget", "no_use"]
ANSWER = "predicted_answer_type"


def share(cond: Column) -> Column:
    """Share of rows for which the condition is true; unknown counts as false."""
    return F.avg(F.when(cond, 1).otherwise(0))


def rate_columns() -> list[Column]:
    known = (RECALLED, REFUSED, DISTRACTED)
    return [F.count("*").alias("n"), *[share(F.col(ANSWER) == k).alias(f"{k}_rate") for k in known], share(~F.coalesce(F.col(ANSWER).isin(*known), F.lit(False))).alias("other_rate")]


def rate_sums() -> list[Column]:
    """Numbers behind rate_columns(); those of parts of the rows add up."""
    known = (RECALLED, REFUSED, DISTRACTED)
    return [F.count("*").alias("n"), *[F.count_if(F.col(ANSWER) == k).alias(k) for k in known]]


def rates_of_sums() -> list[Column]:
    """The rates from such sums."""
    known = (RECALLED, REFUSED, DISTRACTED)
    other = F.col("n") - F.col(RECALLED) - F.col(REFUSED) - F.col(DISTRACTED)
    return [*[(F.col(k) / F.col("n")).alias(f"{k}_rate") for k in known], (other / F.col("n")).alias("other_rate")]


def rates(items: DataFrame, by: list[str]) -> DataFrame:
    """Number of questions and the share of each answer type per group; with no keys and no rows, n is 0 and rates are 0."""
    out = items.groupBy(*by).agg(*rate_columns())
    return out if by else out.na.fill(0.0)


def recall_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """Rates per family and per family and role; role is 'all' where the roles are taken together."""
    sets = [[*by, "qa_family"], [*by, "qa_family", "turn_role"]]
    out = items.groupingSets(sets, *by, "qa_family", "turn_role").agg(*rate_columns(), F.grouping("turn_role").alias("g"))
    return out.withColumn("turn_role", F.when(F.col("g") == 1, "all").otherwise(F.col("turn_role"))).drop("g")


def weighted_merge(summaries: DataFrame, by: list[str], rate_cols: list[str], n: str = "n") -> DataFrame:
    """Rates of several summaries merged by their numbers of questions; 0 where there are none."""
    total = F.sum(n)
    return summaries.groupBy(*by).agg(total.alias("n"), *[F.coalesce(F.sum(F.col(n) * F.col(r)) / F.when(total > 0, total), F.lit(0.0)).alias(r) for r in rate_cols])


def keep_world_personas(items: DataFrame, most: dict[str, int], default: int) -> DataFrame:
    """Rows of the first personas of each world: as many as the map says, else the default."""
    limit = F.coalesce(*[F.when(F.col("world") == w, n) for w, n in most.items()], F.lit(default))
    return items.where(F.col("persona") < limit)


def by_stage(items: DataFrame, stages: list[str], by: list[str], stage_col: str = "ask_stage") -> DataFrame:
    """Rates per stage, with a row of zeros for the stages that have no items."""
    spark = items.sparkSession
    every = items.select(*by).distinct().withColumn(stage_col, F.explode(F.array(*map(F.lit, stages)))) if by else spark.createDataFrame([(s,) for s in stages], f"{stage_col} string")
    return every.hint("merge").join(rates(items, [*by, stage_col]).hint("merge"), [*by, stage_col], "left").na.fill(0)


def settings_rates(items: DataFrame, settings: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """Rates per named setting (name, restrict stage, ask stage, release stage or None); settings are a few rows, sent to every task."""
    dim = items.sparkSession.createDataFrame(settings, "setting string, restrict_stage string, at_stage string, release_stage string")
    same = (F.col("forget_stage") == F.col("restrict_stage")) & (F.col("ask_stage") == F.col("at_stage"))
    return items.join(F.broadcast(dim), same).groupBy("setting").agg(*rate_columns())


def violation_utility(items: DataFrame, record: list[str], system: str = "system_id", by: list[str] | None = None) -> DataFrame:
    """Per system (and more keys): utility and violation of each world, and their change from the baseline.

    A record's utility is the mean of its families' recall shares on probe turns, its violation that on key
    turns; a system's figure is the plain mean over records. Worlds without records give nulls.
    """
    by = by or []
    keys = list(dict.fromkeys([system, *by, "world", *record]))
    family = items.groupBy(*dict.fromkeys([*keys, "qa_family"])).agg(
        F.avg(F.when(F.col("turn_role") == "probe", (F.col(ANSWER) == RECALLED).cast("int"))).alias("tpr"),
        F.avg(F.when(F.col("turn_role") == "key", (F.col(ANSWER) == RECALLED).cast("int"))).alias("fpr"),
    )
    per = family.groupBy(*keys).agg(F.avg("tpr").alias("tpr"), F.avg("fpr").alias("fpr"))
    wide = per.groupBy(system, *by).pivot("world", WORLDS).agg(F.avg("tpr").alias("utility"), F.avg("fpr").alias("violation"))
    return wide.select(
        system, *by, *[F.round(f"{w}_{m}", 9).alias(f"{w}_{m}") for w in WORLDS for m in ("utility", "violation")],
        *[F.round(F.col(f"{w}_utility") - F.col("baseline_utility"), 9).alias(f"{w}_delta") for w in WORLDS[1:]],
    )


def with_mean_row(table: DataFrame, key: str, label: str = "mean") -> DataFrame:
    """The table with its key as text and one more row holding the mean of every other column, to six places."""
    cols = [c for c in table.columns if c != key]
    mean = table.agg(*[F.round(F.avg(c), 6).alias(c) for c in cols]).select(F.lit(label).alias(key), *cols)
    return table.withColumn(key, F.col(key).cast("string")).unionByName(mean)


def tradeoff(table: DataFrame, system: str = "system_id") -> DataFrame:
    """Long form of a violation and utility table: system, world, utility, delta, violation."""
    rows = [F.struct(F.lit(w).alias("world"), F.col(f"{w}_utility").alias("utility"), (F.col(f"{w}_delta") if w != "baseline" else F.lit(0.0)).alias("delta"), F.col(f"{w}_violation").alias("violation")) for w in WORLDS]
    return table.select(system, F.inline(F.array(*rows)))


def stage_rows(items: DataFrame, kind: str) -> DataFrame:
    """Per system and stage the share recalled and, on key turns, the share refused: no_store, immediate or persistence."""
    chosen = {
        "no_store": F.col("world") == "no_store",
        "immediate": (F.col("world") == "forget") & (F.col("ask_stage") == F.col("forget_stage")),
        "persistence": (F.col("world") == "forget") & (F.col("forget_stage") == "early"),
    }[kind]
    key = F.col("turn_role") == "key"
    return items.where(chosen).groupBy("system_id", "ask_stage").agg(
        F.avg(F.when(~key, (F.col(ANSWER) == RECALLED).cast("int"))).alias("utility"),
        F.avg(F.when(key, (F.col(ANSWER) == RECALLED).cast("int"))).alias("recall_rate"),
        F.avg(F.when(key, (F.col(ANSWER) == REFUSED).cast("int"))).alias("forget_rate"),
        F.count("*").alias("n"),
    )


def slot_metric(items: DataFrame) -> DataFrame:
    """Per slot item on a key turn: recalled in the baseline, refused in the other worlds, as 1 or 0."""
    right = F.when(F.col("world") == "baseline", F.col(ANSWER) == RECALLED).otherwise(F.col(ANSWER) == REFUSED)
    return items.where((F.col("qa_family") == "slot") & (F.col("turn_role") == "key")).withColumn("metric", right.cast("int"))


def slot_matrix(items: DataFrame, slot: str = "slot_type") -> DataFrame:
    """Mean slot metric by slot type and world, with the place in order of the baseline's mean (largest first, missing last)."""
    wide = slot_metric(items).groupBy(slot).pivot("world", WORLDS).agg(F.avg("metric"))
    return wide.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("baseline"), slot)))


def completion(records: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Records got against those expected, for every system and world."""
    dim = F.explode(F.array(*[F.struct(F.lit(w).alias("world"), F.lit(n).alias("expected")) for w, n in expected.items()]))
    every = records.select("system_id").distinct().select("system_id", dim.alias("d")).select("system_id", "d.*")
    got = records.groupBy("system_id", "world").agg(F.count_distinct("persona", "ask_stage").alias("got"))
    return every.hint("merge").join(got.hint("merge"), ["system_id", "world"], "left").na.fill(0, ["got"])


def pooled(items: DataFrame, by: list[str], error: Column | None = None) -> DataFrame:
    """Recall shares pooled over items without errors: utility on probe turns, violation on key turns, null where there are none."""
    key, hit = F.col("turn_role") == "key", (F.col(ANSWER) == RECALLED).cast("int")
    rows = items.where(~error) if error is not None else items
    return rows.groupBy(*by).agg(F.avg(F.when(~key, hit)).alias("pooled_utility"), F.avg(F.when(key, hit)).alias("pooled_violation"), F.count("*").alias("n"))


def class_counts(cases: DataFrame, cls: Column, by: list[str]) -> DataFrame:
    return cases.withColumn("class", cls).groupBy(*by, "class").agg(F.count("*").alias("n"))


def class_crosstab(cases: DataFrame, cls: Column, by: list[str]) -> DataFrame:
    """Cases per class against the answer: refused, recalled or other."""
    said = F.when(F.col(ANSWER) == REFUSED, REFUSED).when(F.col(ANSWER) == RECALLED, RECALLED).otherwise("other")
    return cases.select(*by, cls.alias("class"), said.alias("said")).groupBy(*by, "class").pivot("said", [REFUSED, RECALLED, "other"]).count().na.fill(0)


def error_cells(cases: DataFrame, cls: Column, classes: list[str], by: list[str]) -> DataFrame:
    """Per cell: total, correct, failures by class and in all."""
    c = cases.withColumn("class", cls)
    return c.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("class").isNull()).alias("correct"), *[F.count_if(F.col("class") == k).alias(k.lower()) for k in classes], F.count("class").alias("failures"))


def event_counts(log: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """Store events by kind."""
    return log.groupBy(by).pivot("action", kinds).count().na.fill(0)


def token_usage(calls: DataFrame, system: str, bucket: str) -> DataFrame:
    """Calls and tokens by system and bucket, by system, and in all; null marks what is taken together."""
    return calls.rollup(system, bucket).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count_if("failed").alias("failed"))


def usage_delta(snapshots: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """Last value minus first; null if there is one snapshot only."""
    at = F.struct(*order)
    return snapshots.groupBy(by).agg(F.when(F.count("*") > 1, F.round(F.max_by(value, at) - F.min_by(value, at), 6)).alias("delta"))


def corpus_stats(turns: DataFrame) -> DataFrame:
    """Words per conversation and stage, turns by role, and the spread over conversations per stage."""
    per = turns.groupBy("conv_id", "stage").agg(F.sum("n_words").alias("words"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
    return per.groupBy("stage").agg(F.count("*").alias("conversations"), F.min("words").alias("min_words"), F.max("words").alias("max_words"), F.avg("words").alias("mean_words"), F.sum("user_turns").alias("user_turns"), F.sum("assistant_turns").alias("assistant_turns"))


def timing_profile(samples: DataFrame, by: str, value: str, floor: float, fallback_std: float) -> DataFrame:
    """Mean (not under the floor) and sample standard deviation (the fallback for one sample), to three places."""
    return samples.groupBy(by).agg(F.round(F.greatest(F.avg(value), F.lit(floor)), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(fallback_std)), 3).alias("std"), F.count(value).alias("n"))


def run_summary(items: DataFrame, error: Column) -> DataFrame:
    """Totals, errors, answered and share correct per family, and over all families under a null family."""
    ok = ~error
    return items.rollup("qa_family").agg(
        F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_if(ok).alias("answered"),
        F.round(100.0 * F.avg(F.when(ok, (F.col(ANSWER) == RECALLED).cast("int"))), 6).alias("percent_correct"),
        *[F.count_if(ok & (F.col(ANSWER) == k)).alias(k) for k in (RECALLED, REFUSED, DISTRACTED)],
    )


def suppression_cost(items: DataFrame) -> DataFrame:
    """Per system and suppressing world: mean over families of the refused share on key turns, and what recall on probe turns lost against the baseline."""
    per = items.groupBy("system_id", "world", "qa_family").agg(
        F.avg(F.when(F.col("turn_role") == "key", (F.col(ANSWER) == REFUSED).cast("int"))).alias("refused"),
        F.avg(F.when(F.col("turn_role") == "probe", (F.col(ANSWER) == RECALLED).cast("int"))).alias("recalled"),
    )
    mean = per.groupBy("system_id", "world").agg(F.avg("refused").alias("refused"), F.avg("recalled").alias("recalled"))
    base = mean.where("world = 'baseline'").select("system_id", F.col("recalled").alias("base"))
    return mean.where("world <> 'baseline'").join(base, "system_id", "left").select("system_id", "world", F.round("refused", 9).alias("key_suppression"), F.round(F.col("base") - F.col("recalled"), 9).alias("probe_cost"))


def accuracy_by(results: DataFrame, by: list[str], distance: str, width: float, buckets: int) -> DataFrame:
    """Share correct by keys and bucket of distance; distances past the last bucket fall in it."""
    b = F.least(F.floor(F.col(distance) / width), F.lit(buckets - 1)).cast("int")
    return results.groupBy(*by, b.alias("bucket")).agg(F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"))


def slot_labels(items: DataFrame, keys: list[str], cache: DataFrame, cache_keys: list[str], default: str) -> DataFrame:
    """Distinct slot keys with their cached label, the default where there is none; the expensive labelling sees each key once."""
    first = cache.groupBy(*cache_keys).agg(F.min("label").alias("label"))
    return items.select(*keys).distinct().join(first, cache_keys, "left").select(*keys, F.coalesce("label", F.lit(default)).alias("label"))
