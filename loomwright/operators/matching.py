"""Joins and matching of items, turns, events and entries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.sources.io import shared_folder


def twin_join(items: DataFrame, keys: list[str], order: list[str], baseline: str = "baseline") -> DataFrame:
    """Items of other worlds with base_answer, what the baseline's item of the same keys was answered; null without a twin.

    The baseline side is first reduced to one row per key, the last in order, so the join adds no rows.
    """
    base = items.where(F.col("world") == baseline).groupBy(*keys).agg(F.max_by("predicted_answer_type", F.struct(*order)).alias("base_answer"))
    return items.where(F.col("world") != baseline).join(base, keys, "left")


def twin_join_by_place(items: DataFrame, file_keys: list[str], order: list[str], baseline: str = "baseline") -> DataFrame:
    """As twin_join, but pairing the k-th item of a file with the k-th of the baseline's file; an empty answer past its end."""
    numbered = items.withColumn("idx", F.row_number().over(Window.partitionBy(*file_keys, "world").orderBy(*order)) - 1)
    base = numbered.where(F.col("world") == baseline).select(*file_keys, "idx", F.col("predicted_answer_type").alias("base_answer"))
    return numbered.where(F.col("world") != baseline).join(base, [*file_keys, "idx"], "left").withColumn("base_answer", F.coalesce("base_answer", F.lit("")))


def last_value(rows: DataFrame, keys: list[str], value: Column, order: list[str], name: str = "value") -> DataFrame:
    """One row per key with the value of the last row in order."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def scorable(items: DataFrame, targets: DataFrame, keys: list[str], world: str = "forget") -> DataFrame:
    """All items of other worlds, and those of the given world whose keys are listed as targets."""
    mine = F.col("world") == world
    return items.where(mine).join(targets, keys, "left_semi").unionByName(items.where(~mine))


def forget_stage(recorded: DataFrame, declared: DataFrame, conv: str, key: str, stage: str) -> DataFrame:
    """Stage of each key: from what was recorded, and only for conversations without any record from what was declared."""
    unrecorded = declared.join(recorded.select(conv).distinct(), conv, "left_anti")
    return recorded.select(conv, key, stage).unionByName(unrecorded.select(conv, key, F.coalesce(F.col(stage).cast("string"), F.lit("all_stages")).alias(stage)))


def store_action(log: DataFrame, run: str, seq: str, directive: Column, boundary: Column) -> DataFrame:
    """Per run what the store did between the first directive and the next boundary after it."""
    first = log.groupBy(run).agg(F.min(F.when(directive, F.col(seq))).alias("at"), F.count_if(F.col("action") == "ADD").alias("facts"))
    after = log.withColumn("edge", boundary).select(run, seq, "action", "edge").join(first, run)
    stop = F.min(F.when(F.col("edge") & (F.col(seq) > F.col("at")), F.col(seq))).over(Window.partitionBy(run))
    inside = (F.col(seq) > F.col("at")) & (F.col("stop").isNull() | (F.col(seq) < F.col("stop")))
    per = after.withColumn("stop", stop).groupBy(run).agg(
        F.first("facts").alias("facts"), F.first("at").alias("at"),
        F.count_if(inside & F.col("action").isin("UPDATE", "DELETE")).alias("changed"), F.count_if(inside & (F.col("action") == "ADD")).alias("added"),
    )
    cls = F.when(F.col("facts") == 0, "NO_FACT").when(F.col("at").isNull(), "NO_DIRECTIVE").when(F.col("changed") > 0, "UPDATE_DELETE").when(F.col("added") > 0, "ADD_ONLY").otherwise("NOTHING")
    return per.select(run, cls.alias("class"))


def interaction_candidates(items: DataFrame, blocks: DataFrame, keys: list[str], order: list[str], conv: str) -> DataFrame:
    """Items in order with their rank and the lines of the block of the same keys; an empty list without a block."""
    rank = F.row_number().over(Window.partitionBy(conv).orderBy(*order))
    out = items.join(blocks, keys, "left")
    return out.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>"))).withColumn("rank", rank)


def interleave(events: DataFrame, derived: DataFrame, conv: str, event_id: str, source_id: str, order: list[str]) -> DataFrame:
    """Events in order, each followed by what was derived from it; columns conv, id, kind, place (from 1)."""
    at = events.select(conv, F.col(event_id).alias("source"), F.row_number().over(Window.partitionBy(conv).orderBy(*order)).alias("event_pos"))
    first = at.select(conv, F.col("source").alias("id"), F.lit("event").alias("kind"), "event_pos")
    second = derived.select(conv, F.col(event_id).alias("id"), F.col(source_id).alias("source")).join(at, [conv, "source"]).select(conv, "id", F.lit("interaction").alias("kind"), "event_pos")
    place = F.row_number().over(Window.partitionBy(conv).orderBy("event_pos", "kind", "id"))
    return first.unionByName(second).select(conv, "id", "kind", place.alias("place"))


def resolve_old_dates(history: DataFrame, conv: str, date: str, old_date: str, order: list[str], prefix: str = "E") -> DataFrame:
    """Event ids in order, and for each event that names an older date of the same history the id of that date's first event; subtype change or init."""
    w = Window.partitionBy(conv).orderBy(*order)
    ids = history.withColumn("event_id", F.format_string(f"{prefix}_%s_%03d", F.col(conv).cast("string"), F.row_number().over(w)))
    old = ids.groupBy(F.col(conv), F.col(date).alias(old_date)).agg(F.min("event_id").alias("source_event_id"))
    return ids.join(old, [conv, old_date], "left").withColumn("subtype", F.when(F.col("source_event_id").isNull(), "init").otherwise("change"))


def descendants(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Every (descendant, ancestor, distance) along parent edges; a child has one parent, the last in the table's order of ids.

    Works in doubling steps: the one ancestor at the greatest distance so far leads on to all that it reaches, so a
    chain of n takes about log n joins and makes each pair once. Ends when a round adds no pair, at any depth. Cycles
    end because a pair keeps its shortest distance and a node is not its own ancestor.
    """
    paths = edges.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(child))).groupBy(F.col(child).alias("descendant")).agg(F.max(parent).alias("ancestor")).withColumn("distance", F.lit(1))
    paths = _cut(paths)
    n, reach = paths.count(), 1
    while True:
        step = paths.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        longer = paths.where(F.col("distance") == reach).join(step, "ancestor").where(F.col("descendant") != F.col("further")).select("descendant", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        paths = _cut(paths.unionByName(longer).groupBy("descendant", "ancestor").agg(F.min("distance").alias("distance")))
        now = paths.count()
        if now == n:
            return paths
        n, reach = now, 2 * reach


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the folder that shared_folder() gives."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_value_conflicts(cands: DataFrame, later: DataFrame, conv: str, value: str, kind: str) -> DataFrame:
    """Pairs of a candidate and a record of a later stage of the same conversation that hold the same value: an equi-join with a range."""
    a = cands.select(conv, F.col("id").alias("cand_id"), F.col("stage_order").alias("cand_stage"), value).where(F.col(value).isNotNull())
    b = later.select(conv, F.col("id").alias("later_id"), F.col("stage_order").alias("later_stage"), value)
    return a.hint("merge").join(b.hint("merge"), [conv, value]).where("later_stage > cand_stage").select(conv, "cand_id", "later_id", F.lit(kind).alias("kind")).distinct()


def future_conflicts(cands: DataFrame, later: DataFrame, edges: DataFrame, conv: str) -> DataFrame:
    """What makes a candidate's facts come up again in a later stage of its conversation: conv, cand_id, later_id, kind.

    Both sides have id, stage_order, and the lists values, context and tokens; edges has child and parent ids. Kinds: 'value' and
    'context' for a shared entry, compared without case and outer space; 'lineage' where the later record descends from the
    candidate at any distance; 'goal' where token sets overlap as similar_goals() says. Each pair once for a kind.

    Every kind reads both sides, so give tables that are cheap to read, such as stored() ones.
    """
    norm = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    each = lambda df, c: df.select(conv, "id", "stage_order", F.explode(c).alias("x")).withColumn("x", norm("x")).where("x <> ''")
    value, context = (shared_value_conflicts(each(cands, c), each(later, c), conv, "x", kind) for c, kind in (("values", "value"), ("context", "context")))
    lineage, goal = later_descendants(cands, later, edges, conv), similar_goals(cands, later, conv)
    return value.unionByName(context).unionByName(lineage.withColumn("kind", F.lit("lineage"))).unionByName(goal.withColumn("kind", F.lit("goal")))


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: smaller than a checkpoint where rows hold lists of words."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def later_descendants(cands: DataFrame, later: DataFrame, edges: DataFrame, conv: str) -> DataFrame:
    """Pairs of a candidate and a record of a later stage of its conversation that descends from it at any distance: conv, cand_id, later_id.

    A child has one parent, as in descendants(). A node is one row all along: the candidates among the ancestors passed so far, and
    the ancestor that it has come to, whose own row doubles the distance. Rounds end when no node leads on. On cycles they
    all do; once a round has ended no node, only those on or below cycles are left, which have passed all of it
    when the distance is their number.
    """
    up = edges.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("child"))).groupBy("child").agg(F.max("parent").alias("to"))
    asked = cands.select(F.col("id").alias("to"), F.lit(True).alias("asked")).distinct()
    nodes = up.hint("merge").join(asked.hint("merge"), "to", "left").select("child", "to", F.when(F.col("asked"), F.array("to")).otherwise(F.array().cast(T.ArrayType(up.schema["to"].dataType))).alias("above"))
    nodes = _cut(nodes)
    on, reach = nodes.count(), 1
    while on:
        step = nodes.select(F.col("child").alias("to"), F.col("to").alias("further"), F.col("above").alias("more"))
        moved = nodes.where("to IS NOT NULL").hint("merge").join(step.hint("merge"), "to", "left").select("child", F.col("further").alias("to"), F.when(F.size("more") > 0, F.array_union("above", "more")).otherwise(F.col("above")).alias("above"))
        nodes = _cut(nodes.where("to IS NULL").unionByName(moved))
        still, reach = nodes.where("to IS NOT NULL").count(), 2 * reach
        if still == on and reach >= on:
            break
        on = still
    records = later.select(conv, F.col("id").alias("later_id"), F.col("stage_order").alias("later_stage"))
    pairs = nodes.where(F.size("above") > 0).withColumnRenamed("child", "later_id").hint("merge").join(records.hint("merge"), "later_id").select(conv, "later_id", "later_stage", F.explode("above").alias("cand_id")).where("cand_id <> later_id")
    a = cands.select(conv, F.col("id").alias("cand_id"), F.col("stage_order").alias("cand_stage"))
    return pairs.hint("merge").join(a.hint("merge"), [conv, "cand_id"]).where("later_stage > cand_stage").select(conv, "cand_id", "later_id")


def similar_goals(cands: DataFrame, later: DataFrame, conv: str, least: int = 4, jaccard: float = 0.5, contained: float = 0.7, often: int = 200) -> DataFrame:
    """Pairs of a candidate and a record of a later stage of its conversation whose token sets overlap as in token_pairs(): conv, cand_id, later_id.

    Sets are put in one order within a conversation, its `often` most frequent tokens last, and as in token_pairs() a prefix of
    each is exploded and joined; any order loses nothing. A prefix takes its set along, which is short, so a pair is checked where
    it meets, and only at the first token that both share. Before lists are compared, 64 bits of each set bound the overlap: a
    bit that one side lacks stands for a token that it lacks. Only candidates meet later records, so no pair is made that
    another step drops for its order or stage.
    """
    sets = lambda df: df.select(conv, "id", F.col("stage_order").alias("stage"), F.array_distinct(F.array_compact("tokens")).alias("set")).where(F.size("set") >= least)
    df = sets(later).select(conv, F.explode("set").alias("tok")).groupBy(conv, "tok").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc("df"), "tok"))
    last = _cut(df.withColumn("place", place).where(F.col("place") <= often).groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("place", "tok")), asc=False)["tok"].alias("last")))

    def heads(df: DataFrame, who: str) -> DataFrame:
        # array_except() and array_intersect() keep the order of their first list.
        ordered = sets(df).hint("merge").join(last.hint("merge"), conv).withColumn("set", F.concat(F.array_sort(F.array_except("set", "last")), F.array_intersect("last", "set")))
        bits = F.aggregate("set", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
        return ordered.withColumn("bits", bits).select(conv, F.explode(F.slice("set", F.lit(1), F.size("set") - (least - 1))).alias("tok"), *[F.col(c).alias(f"{who}_{c}") for c in ("id", "stage", "set", "bits")])

    x, y, p, q = F.size("cand_set"), F.size("later_set"), F.col("cand_bits"), F.col("later_bits")
    near = lambda n: (n >= least) & ((n / (x + y - n) >= jaccard) | (n / F.least(x, y) >= contained))
    most = F.least(x - F.bit_count(p.bitwiseAND(F.bitwise_not(q))), y - F.bit_count(q.bitwiseAND(F.bitwise_not(p))))
    # The shared tokens are bound to a lambda's variable, as they would else be sought anew for every use.
    alike = F.exists(F.array(F.array_intersect("cand_set", "later_set")), lambda s: (s[0] == F.col("tok")) & near(F.size(s)))
    return heads(cands, "cand").hint("merge").join(heads(later, "later").hint("merge"), [conv, "tok"]).where("later_stage > cand_stage").where(near(most)).where(alike).select(conv, "cand_id", "later_id")


def token_pairs(rows: DataFrame, conv: str, key: str, tokens: str, least: int = 4, jaccard: float = 0.5, contained: float = 0.7) -> DataFrame:
    """Pairs of rows of one conversation whose token sets overlap in at least `least` and by Jaccard or containment.

    A pair that meets either bound shares one of the rarest tokens of both sides, so only a prefix of each
    set, rarest first, is exploded and joined; every candidate is then checked on the whole sets.
    """
    sets = rows.select(conv, key, F.array_distinct(tokens).alias("set")).where(F.size("set") >= least)
    one = sets.select(conv, key, F.size("set").alias("size"), F.explode("set").alias("tok"))
    df = one.withColumn("df", F.count("*").over(Window.partitionBy(conv, "tok")))
    w = Window.partitionBy(conv, key).orderBy("df", "tok")
    # Overlap is at least `least`, so leaving out the last least - 1 tokens of each ordered set loses no pair.
    head = df.withColumn("i", F.row_number().over(w)).where(F.col("i") <= F.col("size") - (least - 1)).select(conv, key, "tok")
    pairs = head.hint("merge").join(head.select(conv, "tok", F.col(key).alias("other")).hint("merge"), [conv, "tok"]).where(F.col(key) < F.col("other")).select(conv, key, "other").distinct()
    both = pairs.hint("merge").join(sets.hint("merge"), [conv, key]).hint("merge").join(sets.select(conv, F.col(key).alias("other"), F.col("set").alias("other_set")).hint("merge"), [conv, "other"])
    n = F.size(F.array_intersect("set", "other_set"))
    a, b = F.size("set"), F.size("other_set")
    return both.withColumn("overlap", n).where((n >= least) & ((n / (a + b - n) >= jaccard) | (n / F.least(a, b) >= contained))).select(conv, key, "other", "overlap")


def best_match(targets: DataFrame, cands: DataFrame, target_id: str, cand_id: str, block: list[str]) -> DataFrame:
    """For each target the candidate of its block with the largest token overlap, the smallest id on ties; none if nothing overlaps.

    A target's tokens are taken rarest first. Its rarest quarter finds a good candidate, whose whole overlap, n, is then known.
    One as good misses at most size - n of the target's tokens, so it shares several of the first ones: only these are joined
    with all that hold them, and what they find is counted out on the other, frequent tokens by lookups of (token, candidate).
    Tokens that no target has are never joined, and frequent ones only where a target's best overlap is small.
    """
    word = [*block, "tok"]
    t = targets.select(*block, target_id, F.explode(F.array_distinct("tokens")).alias("tok"))
    asked = t.select(*word).distinct()
    held = _cut(cands.select(*block, cand_id, F.explode(F.array_distinct("tokens")).alias("tok")).hint("merge").join(asked.hint("merge"), word, "left_semi"))
    df = held.groupBy(*word).agg(F.count("*").alias("df"))
    w = Window.partitionBy(*block, target_id)
    t = _cut(t.hint("merge").join(df.hint("merge"), word).withColumns({"i": F.row_number().over(w.orderBy("df", "tok")), "size": F.count("*").over(w)}).drop("df"))
    who, pair = [*block, target_id], [*block, target_id, cand_id]

    def shared(heads: DataFrame) -> DataFrame:
        return heads.hint("merge").join(held.hint("merge"), word).groupBy(*pair).agg(F.count("*").alias("n"))

    def counted(pairs: DataFrame, rest: DataFrame) -> DataFrame:
        """Pairs with the whole overlap: n so far and what the other tokens of the target add."""
        more = pairs.select(*pair).hint("merge").join(rest.hint("merge"), who).select(*pair, "tok").hint("merge").join(held.hint("merge"), [*block, cand_id, "tok"]).groupBy(*pair).agg(F.count("*").alias("more"))
        return pairs.hint("merge").join(more.hint("merge"), pair, "left").select(*pair, (F.col("n") + F.coalesce("more", F.lit(0))).alias("overlap"))

    quarter = F.ceil(F.col("size") / 4)
    good = shared(t.where(F.col("i") <= quarter)).groupBy(*who).agg(F.max(F.struct("n", -F.col(cand_id))).alias("b")).select(*who, (-F.col("b.col2")).alias(cand_id), F.col("b.n").alias("n"))
    known = _cut(counted(good, t.where(F.col("i") > quarter)).select(*who, F.col("overlap").alias("least"), F.floor(F.col("overlap") / 4 + 1).alias("of")))
    # With the first size - least + of tokens a candidate that is as good shares at least `of` of them.
    cut_at = t.hint("merge").join(known.hint("merge"), who).withColumn("head", F.col("i") <= F.col("size") - F.col("least") + F.col("of"))
    some = _cut(shared(cut_at.where("head").drop("least", "of")).hint("merge").join(known.hint("merge"), who).where("n >= of").select(*pair, "n"))
    full = counted(some, cut_at.where("NOT head").select(*who, "tok"))
    return full.withColumn("r", F.row_number().over(Window.partitionBy(*who).orderBy(F.desc("overlap"), cand_id))).where("r = 1").drop("r")


def each_gram(text: Column, q: int, count: Column) -> Column:
    """The first `count` substrings of q characters. The characters are bound to a lambda's variable, as they would else be cut anew
    for every one of them."""
    signs = F.array(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)))
    return F.element_at(F.transform(signs, lambda s: F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(s, i, F.lit(q)), ""))), 1)


def windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """Of the windows of s characters of `text`, for each s in `sizes`, the places that stand for them: columns keep, s, h, at, start.

    A window of s >= 4 is s // 2 + 1 grams of about half its length, and stands at the first of those with the least hash h; at is
    that place and start the first window that stands there. Neighbours mostly stand at the same place, so there is about one in
    s / 4 characters, and a text that holds a window has its place among its own. A shorter window is a gram itself, and of each
    gram one place is given.
    """
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, t) for c, t in (("s", T.IntegerType()), ("h", T.LongType()), ("at", T.IntegerType()), ("start", T.IntegerType()))]])

    def each(batches):
        import numpy as np
        import pyarrow as pa

        def table(b, rows):
            i = np.concatenate([np.full(len(r[2]), r[0]) for r in rows])
            s = np.concatenate([np.full(len(r[2]), r[1], "int32") for r in rows])
            rest = [np.concatenate([r[k] for r in rows]) for k in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(i)) for c in keep], *map(pa.array, (s, *rest))], names=schema.names)

        for b in batches:
            rows, n = [], 0
            for i, (text, sizes) in enumerate(zip(b.column("text").to_pylist(), b.column("sizes").to_pylist(), strict=True)):
                signs = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64")
                for s in sizes:
                    if len(signs) >= s:
                        rows.append((i, s, *window_places(signs, s)))
                        n += len(rows[-1][2])
                if n > 200_000:
                    yield table(b, rows)
                    rows, n = [], 0
            if rows:
                yield table(b, rows)

    return df.select(*keep, "text", "sizes").mapInArrow(each, schema)


def window_places(signs, s: int):
    """h, at and start as windows() says, of one text's code points."""
    import numpy as np

    q = s if s < 4 else s // 2
    w, n = s - q + 1, len(signs) - q + 1
    h = np.zeros(n, "uint64")
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + signs[j : j + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    if w == 1:
        at = start = np.unique(h, return_index=True)[1]
    else:
        at, start = np.unique(np.lib.stride_tricks.sliding_window_view(h, w).argmin(1) + np.arange(n - w + 1), return_index=True)
    return h[at].view("int64"), at.astype("int32"), start.astype("int32")


def holding(needles: DataFrame, hays: DataFrame, block: list[str], per: str, sizes: tuple[int, ...] = (1, 2, 4, 8, 16, 24, 32)) -> DataFrame:
    """block, text and first: which texts of the same block hold which, by exact substring.

    Both sides have block, text, pos. Per 'needle': every needle that some hay holds, with the least pos of those hays; per
    'hay': every hay that holds some needle, with the least pos of those needles. Copies within a block count once.

    A needle is sought by windows of the largest of `sizes` that is no longer than itself, and windows by the places that stand for
    them (windows()). All places of a needle must stand in the block's hays, or it is held nowhere; the rarest leads to the hays with
    that window. A needle of just that size is then found; a longer one is sought in those hays' texts. No needle meets a
    hay that lacks the window, and texts are joined by number, so no place carries one.
    """
    by, place = [*block, "text"], [*block, "s", "h"]
    n, h = (df.where(F.col("text").isNotNull()).groupBy(*by).agg(F.min("pos").alias("pos")).withColumns({"len": F.length("text"), "no": F.monotonically_increasing_id()}) for df in (needles, hays))
    h = _cut(h)
    # A needle longer than every hay of its block is held nowhere.
    most = h.groupBy(*block).agg(F.max("len").alias("most"))
    n = n.hint("merge").join(most.hint("merge"), block).where("len <= most").drop("most")
    n = _cut(n.withColumn("s", F.array_max(F.array(*[F.when(F.col("len") >= q, q).otherwise(0) for q in sizes]))))
    # An empty needle is held by every text of its block.
    if per == "needle":
        found = h.groupBy(*block).agg(F.min("pos").alias("first")).hint("merge").join(n.where("len = 0").select(*by).hint("merge"), block).select(*by, "first")
    else:
        found = n.where("len = 0").select(*block, F.col("pos").alias("first")).hint("merge").join(h.select(*by).hint("merge"), block).select(*by, "first")
    sought = n.where("s > 0")
    used = sought.groupBy(*block).agg(F.collect_set("s").alias("sizes"))  # as many as there are sizes, at most
    held = windows(h.hint("merge").join(used.hint("merge"), block), [*block, "no"]).select(*place, F.col("no").alias("hay"), "at")
    asked = _cut(windows(sought.withColumn("sizes", F.array("s")), [*block, "no"]))
    held = _cut(held.hint("merge").join(asked.select(*place).distinct().hint("merge"), place, "left_semi"))
    df = held.groupBy(*place).agg(F.count("*").alias("df"))
    lead = asked.hint("merge").join(df.hint("merge"), place, "left").groupBy("no").agg(F.min(F.struct("df", "h", "at", "start")).alias("lead"), F.count_if(F.col("df").isNull()).alias("absent")).where("absent = 0")
    lead = _cut(lead.hint("merge").join(sought.hint("merge"), "no").select(*place[:-1], "lead.h", (F.col("lead.at") - F.col("lead.start")).alias("back"), "no", "text", "pos", "len", F.substring("text", F.col("lead.start") + 1, F.col("s")).alias("gram")))

    def leading(leads: DataFrame) -> DataFrame:
        """The windows of hays that stand where the leads' windows do."""
        at = held.hint("merge").join(leads.select(*place, "back").distinct().hint("merge"), place).select("hay", "s", (F.col("at") - F.col("back")).alias("start")).where("start >= 0").distinct()
        hay = h.select(F.col("no").alias("hay"), *block, F.col("text").alias("hay_text"), F.col("pos").alias("hay_pos"), F.col("len").alias("hay_len"))
        return at.hint("merge").join(hay.hint("merge"), "hay").where("start + s <= hay_len").withColumn("gram", F.substring("hay_text", F.col("start") + 1, F.col("s")))

    whole, longer = lead.where("len = s"), lead.where("len > s")
    if per == "needle":
        first = leading(whole).groupBy(*block, "gram").agg(F.min("hay_pos").alias("first"))
        found = found.unionByName(whole.select(*by).hint("merge").join(first.withColumnRenamed("gram", "text").hint("merge"), by).select(*by, "first"))
    else:
        found = found.unionByName(leading(whole).hint("merge").join(whole.select(*block, "gram", "pos").hint("merge"), [*block, "gram"]).select(*block, F.col("hay_text").alias("text"), F.col("pos").alias("first")))
    pairs = leading(longer).select(*block, "gram", "hay").distinct().hint("merge").join(longer.select(*block, "gram", "text", "pos").hint("merge"), [*block, "gram"]).select("hay", "text", "pos")
    both = pairs.hint("merge").join(h.select(F.col("no").alias("hay"), *block, F.col("text").alias("hay_text"), F.col("pos").alias("hay_pos")).hint("merge"), "hay").where(F.contains("hay_text", "text"))
    found = found.unionByName(both.select(*by, F.col("hay_pos").alias("first")) if per == "needle" else both.select(*block, F.col("hay_text").alias("text"), F.col("pos").alias("first")))
    return found.groupBy(*by).agg(F.min("first").alias("first"))


def locate_turn(wanted: DataFrame, turns: DataFrame, conv: str, key: str, text: str, pos: str) -> DataFrame:
    """Position of each wanted text: the first turn of its conversation with the same text, else the first where one text contains the other.

    Containment is a substring join by rare windows (holding()), in both directions, of the texts that have no equal turn.
    """
    t = turns.select(conv, F.col(pos).alias("pos"), F.col(text).alias("text"))
    want = wanted.select(conv, key, F.col(text).alias("text"))
    same = want.hint("merge").join(t.groupBy(conv, "text").agg(F.min("pos").alias("pos")).hint("merge"), [conv, "text"]).select(conv, key, "pos", F.lit("exact").alias("how"))
    rest = _cut(want.hint("merge").join(t.select(conv, "text").distinct().hint("merge"), [conv, "text"], "left_anti"))
    asked = rest.select(conv, "text").distinct().withColumn("pos", F.lit(0))
    at = holding(asked, t, [conv], "needle").unionByName(holding(t, asked, [conv], "hay")).groupBy(conv, "text").agg(F.min("first").alias("pos"))
    near = rest.hint("merge").join(at.hint("merge"), [conv, "text"]).select(conv, key, "pos", F.lit("contained").alias("how"))
    return same.unionByName(near)


def later_occurrence(rows: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """more_update: Yes if the same keys come up again in a later stage, else No."""
    last = F.max(stage).over(Window.partitionBy(*keys))
    return rows.withColumn("more_update", F.when(last > F.col(stage), "Yes").otherwise("No"))


def allocate(ids: DataFrame, pool: DataFrame, mapping: DataFrame, seed: int = 1) -> DataFrame:
    """Pool rows for ids: mapped ones keep theirs, the others take unused rows in a hashed order; columns id, row."""
    from loomwright.operators.indexing import global_index

    drawn = lambda df, col: df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(f"{col[0]}{seed}"), col)))
    new = global_index(drawn(ids.join(mapping, "id", "left_anti"), "id"), ["_h", "id"]).drop("_h")
    free = global_index(drawn(pool.join(mapping, "row", "left_anti"), "row"), ["_h", "row"]).drop("_h")
    return mapping.join(ids, "id", "left_semi").select("id", "row").unionByName(new.join(free, "k").select("id", "row"))


def zip_by_rank(a: DataFrame, b: DataFrame, conv: str, a_key: str, b_key: str, a_order: list[str], b_order: list[str]) -> DataFrame:
    """The k-th row of a with the k-th of b within each conversation."""
    left = a.select(conv, a_key, F.row_number().over(Window.partitionBy(conv).orderBy(*a_order)).alias("k"))
    right = b.select(conv, b_key, F.row_number().over(Window.partitionBy(conv).orderBy(*b_order)).alias("k"))
    return left.join(right, [conv, "k"])


def attach_context(questions: DataFrame, contexts: DataFrame, key: str, end: str) -> DataFrame:
    """Questions with the first `end` messages of their context."""
    return questions.join(contexts, key).withColumn("messages", F.slice("messages", F.lit(1), F.col(end)))


def label_unique(rows: DataFrame, sample: str, label: str) -> DataFrame:
    return rows.withColumn("is_unique", F.count("*").over(Window.partitionBy(sample, label)) == 1)


def target_in_store(items: DataFrame, entries: DataFrame, run: str, item: str, needle_len: int = 24) -> DataFrame:
    """Whether an entry of the item's run holds the first characters of the expected text, and the first entry that does.

    The needle itself is a window by which entries are indexed, so a run's items never meet its entries; shorter needles
    are sought by the smaller windows of holding().
    """
    needle = F.substring(F.lower(F.trim("expected_text")), 1, needle_len)
    asked = items.select(run, item, needle.alias("text"))
    sizes = (*[q for q in (1, 2, 4, 8, 16, 32) if q < needle_len], needle_len)
    e = entries.select(run, F.lower("text").alias("text"), F.col("entry_id").alias("pos"))
    at = holding(asked.where("text <> ''").select(run, "text", F.lit(0).alias("pos")), e, [run], "needle", sizes)
    found = asked.hint("merge").join(at.hint("merge"), [run, "text"], "left")
    return found.groupBy(run, item).agg(F.max(F.col("first").isNotNull()).alias("in_store"), F.min("first").alias("first_entry"))


def directive_batch(calls: DataFrame, run: str, seq: str, is_directive: Column, is_extract: Column, is_update: Column) -> DataFrame:
    """Per run the first extraction that holds a directive, and the first update after it that comes before the next extraction."""
    c = calls.select(run, seq, is_directive.alias("d"), is_extract.alias("x"), is_update.alias("u"))
    first = c.groupBy(run).agg(F.min(F.when(F.col("d") & F.col("x"), F.col(seq))).alias("extract_seq")).where("extract_seq IS NOT NULL")
    after = c.join(first, run).where(F.col(seq) > F.col("extract_seq"))
    edge = after.groupBy(run).agg(F.min(F.when(F.col("x"), F.col(seq))).alias("edge"), F.min(F.when(F.col("u"), F.col(seq))).alias("up"))
    return first.join(edge, run, "left").select(run, "extract_seq", F.when(F.col("edge").isNull() | (F.col("up") < F.col("edge")), F.col("up")).alias("update_seq"))


def surfaced(entries: DataFrame, retrieved: DataFrame, run: str, is_directive: Column) -> DataFrame:
    """Directive entries of each run with whether they were among those retrieved."""
    got = retrieved.select(run, "entry_id").distinct().withColumn("got", F.lit(True))
    return entries.where(is_directive).join(got, [run, "entry_id"], "left").select(run, "entry_id", F.coalesce("got", F.lit(False)).alias("surfaced"))


def reuse_profile(ids: DataFrame, docs: DataFrame, key: str, path: str, complete: Column, fields: list[str]) -> DataFrame:
    """The fields of the first complete document, by path, that has the same key."""
    first = docs.where(complete).groupBy(key).agg(F.min_by(F.struct(path, *fields), path).alias("f"))
    return ids.join(first, key, "left").select(*ids.columns, "f.*")
