"""Line work: blocks, pages, roles, prefixes and orders within a conversation. Windows never span conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators.matching import _cut


def flatten_stages(docs: DataFrame, stages: list[str], id_col: str = "conv_id") -> DataFrame:
    """Long form of list columns: id, stage, stage_order, pos, line."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("stage_order"), F.col(s).alias("lines")) for i, s in enumerate(stages)]))
    return docs.select(id_col, each.alias("s")).select(id_col, "s.stage", "s.stage_order", F.posexplode("s.lines").alias("pos", "line"))


def blocks(lines: DataFrame, conv: str = "conv_id", order: list[str] | None = None, line: str = "line") -> DataFrame:
    """Lines with their block: a side note opens one; block 0 is what stands before the first."""
    note = F.col(line).rlike(X.SIDE_NOTE).cast("int")
    return lines.withColumn("block", F.sum(note).over(Window.partitionBy(conv).orderBy(*(order or ["stage", "pos"]))))


def first_block_per_date(lines: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Lines without the blocks that repeat an earlier block's date; undated lines stay."""
    b = blocks(lines, conv)
    note = X.parse_side_note(F.col("line"))
    dated = b.withColumn("block_ts", F.max(note["ts_key"]).over(Window.partitionBy(conv, "block")))
    first = F.min("block").over(Window.partitionBy(conv, "block_ts"))
    return dated.withColumn("first_block", first).where(F.col("block_ts").isNull() | (F.col("block") == F.col("first_block"))).drop("first_block")


def page_pairs(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per page: a user turn opens a page, an assistant turn fills the page or, if it is filled, opens an orphan."""
    w = Window.partitionBy(conv).orderBy(order)
    t = turns.where(F.col("role").isin("user", "assistant")).withColumn("prev", F.lag("role").over(w))
    new = (F.col("role") == "user") | F.col("prev").isNull() | (F.col("prev") == "assistant")
    t = t.withColumn("page", F.sum(new.cast("int")).over(w))
    pick = lambda r: F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col(order)))
    return t.groupBy(conv, "page").agg(pick("user").alias("user_text"), pick("assistant").alias("assistant_text"))


def code_utterances(lines: DataFrame, conv: str, order: str, line: str = "line") -> DataFrame:
    """Utterances of a coding conversation: a role name opens one; a fence that opens outside a fence opens an assistant's; other lines belong to the open one."""
    w = Window.partitionBy(conv).orderBy(order)
    fence = F.col(line).startswith("```")
    before = F.coalesce(F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.pmod(before, F.lit(2)) == 1
    opens = ~inside & (fence | F.col(line).rlike("^(User|Assistant):"))
    d = lines.withColumn("utterance", F.sum(opens.cast("int")).over(w)).withColumn("_fence", fence)
    at = F.struct(order, line)
    return d.groupBy(conv, "utterance").agg(F.min_by(line, order).alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s[line]), "\n").alias("text"))


def user_positions(turns: DataFrame, conv: str = "conv_id", order: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(conv).orderBy(*(order or ["turn"]))
    return turns.where("role = 'user'").withColumn("user_index", (F.row_number().over(w) - 1))


def turn_lookup(lines: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation and date the first user line after the note and the first assistant line after it, before the next note."""
    w = Window.partitionBy(conv).orderBy("stage", "pos")
    note, msg = X.parse_side_note(F.col("line")), X.to_message(F.col("line"))
    d = lines.select(conv, "stage", "pos", note["ts_key"].alias("note"), msg["role"].alias("role"), msg["content"].alias("content"))
    d = d.withColumn("ts_key", F.last("note", ignorenulls=True).over(w)).where("note IS NULL AND ts_key IS NOT NULL")
    at = F.struct("stage", "pos")
    first = d.groupBy(conv, "ts_key").agg(F.min(F.when(F.col("role") == "user", at)).alias("u"), F.min_by("content", F.when(F.col("role") == "user", at)).alias("user_turn"))
    back = d.where("role = 'assistant'").join(first, [conv, "ts_key"]).where(at > F.col("u"))
    reply = back.groupBy(conv, "ts_key").agg(F.min_by("content", at).alias("reply"))
    return first.where("u IS NOT NULL").select(conv, "ts_key", "user_turn").join(reply, [conv, "ts_key"], "left")


def latest_date(lines: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Latest date of the side notes, by calendar."""
    return lines.select(conv, X.parse_side_note(F.col("line"))["ts_date"].alias("d")).groupBy(conv).agg(F.max("d").alias("last_date"))


def dedup_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row with the largest order; one sort within the key, of which Spark keeps the first only."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fold_side_notes(lines: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Lines without side notes, each with the dates of the notes that follow it directly appended as ' (date)'."""
    w = Window.partitionBy(conv).orderBy("stage", "pos")
    note = X.parse_side_note(F.col("line"))["ts_key"]
    d = lines.withColumn("_ts", note).withColumn("_kept", F.col("_ts").isNull().cast("int"))
    d = d.withColumn("_group", F.sum("_kept").over(w)).where("_group > 0")
    g = Window.partitionBy(conv, "_group").orderBy("stage", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_last", F.last("_ts", ignorenulls=True).over(g)).where("_kept = 1")
    return d.select(conv, "stage", "pos", F.concat(F.col("line"), F.coalesce(F.concat(F.lit(" ("), F.col("_last"), F.lit(")")), F.lit(""))).alias("line"))


def merge_roles(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """System turns go before the next other turn as '[System]: ...', then neighbours of the same role become one, joined by a line feed."""
    w = Window.partitionBy(conv).orderBy(order)
    other = (F.col("role") != "system").cast("int")
    d = turns.withColumn("_g", F.coalesce(F.sum(other).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    piece = F.when(F.col("role") == "system", F.concat(F.lit("[System]: "), "text")).otherwise(F.col("text"))
    at = F.struct(F.col(order).alias("o"), piece.alias("t"))
    one = d.groupBy(conv, "_g").agg(F.max(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["t"]), "\n").alias("text"), F.coalesce(F.max(F.when(F.col("role") != "system", F.col("role"))), F.lit("user")).alias("role"))
    fresh = F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int")
    isle = one.withColumn("_f", fresh).withColumn("_i", F.sum("_f").over(w))
    part = F.struct(F.col(order).alias("o"), F.col("text").alias("t"))
    return isle.groupBy(conv, "_i", "role").agg(F.min(order).alias("first_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "\n").alias("text")).select(conv, "first_turn", "role", "text")


def transcript(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """One text per conversation: 'Role: text' paragraphs in order."""
    at = F.struct(F.col(order).alias("o"), F.concat(F.initcap("role"), F.lit(": "), "text").alias("t"))
    return turns.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["t"]), "\n\n").alias("transcript"))


def prefix_by_stage(turns: DataFrame, stages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns from the start through each stage: a range join within the conversation."""
    upto = stages.select(conv, F.col("stage").alias("upto"))
    return turns.join(upto, conv).where(F.col("stage") <= F.col("upto"))


def insert_rows(lines: DataFrame, inserts: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Lines with the inserts after the places they name (order column of inserts: the place after which they go), numbered anew from 0."""
    both = lines.select(conv, F.col(order).cast("double").alias("_o"), F.lit(0).alias("_k"), "role", "text", F.lit(False).alias("inserted")).unionByName(
        inserts.select(conv, F.col(order).cast("double").alias("_o"), (F.col("k") + 1).alias("_k"), "role", "text", F.lit(True).alias("inserted"))
    )
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(conv).orderBy("_o", "_k")) - 1).select(conv, "pos", "role", "text", "inserted")


def insertion_gaps(placed: DataFrame, keys: DataFrame, conv: str = "conv_id") -> DataFrame:
    """For each inserted user line its position, the distance from its key's turn and to the end."""
    n = F.max("pos").over(Window.partitionBy(conv))
    return placed.withColumn("last", n).where("inserted AND role = 'user'").join(keys, conv).select(conv, "pos", (F.col("pos") - F.col("key_pos")).alias("gap_from_key"), (F.col("last") - F.col("pos")).alias("gap_to_end"))


def distances(messages: DataFrame, questions: DataFrame, conv: str = "conv_id", order: str = "turn", words: str = "n_words") -> DataFrame:
    """Blocks and words between a question's evidence and its place, and the words of the whole context."""
    w = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    m = messages.select(conv, order, F.coalesce(F.sum(words).over(w), F.lit(0)).alias("before"), F.sum(words).over(Window.partitionBy(conv)).alias("total"))
    ask = m.select(conv, F.col(order).alias("ask_turn"), F.col("before").alias("ask_before"))
    ev = m.select(conv, F.col(order).alias("evidence_turn"), F.col("before").alias("ev_before"), "total")
    out = questions.join(ask, [conv, "ask_turn"]).join(ev, [conv, "evidence_turn"])
    return out.withColumn("turn_distance", F.col("ask_turn") - F.col("evidence_turn")).withColumn("word_distance", F.col("ask_before") - F.col("ev_before"))


def fit_budget(rows: DataFrame, conv: str, topic: str, words: str, order: Column, chosen: Column, limit: int) -> DataFrame:
    """Rows without whole topics, dropped in the given order until the words fit the limit; chosen topics are never dropped."""
    per = rows.groupBy(conv, topic).agg(F.sum(words).alias("w"), F.max(chosen).alias("chosen"), F.min(order).alias("o"))
    total = F.sum("w").over(Window.partitionBy(conv))
    drop = F.sum(F.when(~F.col("chosen"), F.col("w")).otherwise(0)).over(Window.partitionBy(conv).orderBy("o", topic).rowsBetween(Window.unboundedPreceding, -1))
    kept = per.withColumn("left", total - F.coalesce(drop, F.lit(0))).where(F.col("chosen") | (F.col("left") <= limit))
    return rows.join(kept.select(conv, topic), [conv, topic], "left_semi")


def order_mapping(rows: DataFrame, keys: list[str], before: list[str], after: list[str]) -> DataFrame:
    """Index of each row in the first order and in the second, within the keys."""
    w = lambda o: Window.partitionBy(*keys).orderBy(*o)
    return rows.withColumn("old_index", F.row_number().over(w(before)) - 1).withColumn("new_index", F.row_number().over(w(after)) - 1)


def bounded_samples(rows: DataFrame, by: list[str], order: list[str], n: int = 2) -> DataFrame:
    """At most n rows of each class, the first in order: a report's examples."""
    return rows.withColumn("sample", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("sample") <= n)


def weighted_draw(rows: DataFrame, weights: DataFrame, value: str, weight: str, u: Column, bins: int | None = None) -> DataFrame:
    """Rows with a value drawn by weight from a table of distinct values: u in [0, 1) falls in the value's share of the running total.

    The running total is taken in range partitions with an offset each, and the interval join is one by equal bins: there are as
    many bins as values (or `bins`), each value stands in the bins that its share touches, a row in one. A heavy value touches many
    bins, so neither a heavy value nor a long table of them meets in one task, and nothing is broadcast. No values, values
    without weight and null weights draw nothing; rows whose u is null or outside [0, 1) are left out.
    """
    from loomwright.operators.indexing import running_total

    cum = _cut(running_total(weights.where(F.col(weight) > 0).select(value, weight), [value], weight, "_hi"))
    n, total = cum.agg(F.count("*"), F.max("_hi")).first()
    bins = max(1, bins or n)
    cum = cum.select(value, F.col("_lo") / F.lit(total or 1), F.col("_hi") / F.lit(total or 1)).toDF(value, "_lo", "_hi")
    at = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    spread = cum.withColumn("_bin", F.explode(F.sequence(at("_lo"), at("_hi"))))
    d = rows.withColumn("_u", u).where("_u >= 0 AND _u < 1").withColumn("_bin", at("_u"))
    return d.hint("merge").join(spread.hint("merge"), "_bin").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_lo", "_hi", "_u", "_bin")


def annotate_dupes(values: DataFrame, conv: str, idx: str, value: str) -> DataFrame:
    """Per candidate its values that also occur earlier or later in the conversation, and whether it is preferred as key: none of its values recurs later."""
    w = Window.partitionBy(conv, value)
    d = values.withColumn("lo", F.min(idx).over(w)).withColumn("hi", F.max(idx).over(w))
    many = F.col("lo") != F.col("hi")
    pick = lambda c: F.array_sort(F.collect_set(F.when(many & c, F.col(value))))
    out = d.groupBy(conv, idx).agg(pick(F.col(idx) != F.col("hi")).alias("recurs_later"), pick(F.col(idx) != F.col("lo")).alias("seen_before"))
    return out.withColumn("prefer_as_key", F.size("recurs_later") == 0)


def choose_keys(cands: DataFrame, conv: str, idx: str) -> DataFrame:
    """Half of a conversation's candidates (rounded down) become keys, those with the fewest conflicts, preferred ones first; the others probes, ranked by conflicts."""
    w = Window.partitionBy(conv)
    r = cands.withColumn("r", F.row_number().over(w.orderBy("conflicts", F.col("prefer_as_key").cast("int").desc(), idx)))
    r = r.withColumn("role", F.when(F.col("r") <= F.floor(F.count("*").over(w) / 2), "key").otherwise("probe"))
    place = F.row_number().over(Window.partitionBy(conv, "role").orderBy("conflicts", F.when(F.col("role") == "key", 1 - F.col("prefer_as_key").cast("int")).otherwise(0), idx))
    return r.withColumn("rank", place).drop("r")
