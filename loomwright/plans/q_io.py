"""Queries of sources, sinks, streams and user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.functions.udf import answer_with, method_config, rewrite_with
from loomwright.plans.catalog import query
from loomwright.sources import io
from loomwright.streaming import streams

P = "predicted_answer_type"


def scratch(t, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{io.shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_01_json_tree", "SELECT conv_id, count(*)::INT AS n_lines, arg_min(text, turn) AS first_line FROM conversations GROUP BY 1")
def src_01(t):
    docs = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("lines"))
    path = scratch(t, "tree")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    back = io.read_eval_tree(t.spark, [path], "conv_id BIGINT, lines ARRAY<STRUCT<turn: BIGINT, role: STRING, text: STRING>>")
    return back.select("conv_id", F.size("lines").alias("n_lines"), F.col("lines")[0]["text"].alias("first_line"))


RAW = "CASE WHEN event_id % 10 = 3 THEN concat('bad ', props) WHEN event_id % 10 = 4 THEN '[1, 2]' ELSE props END"
query("src_02_trace_lines", f"SELECT event_id, (raw->>'$.k')::BIGINT AS k, false AS bad FROM (SELECT event_id, {RAW} AS raw FROM events WHERE event_id % 10 NOT IN (3, 4)) UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 10 IN (3, 4)")(
    lambda t: (lambda good, bad: good.select("event_id", "k", F.lit(False).alias("bad")).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("bad"))))(*io.split_json(t.events.select("event_id", F.expr(RAW).alias("raw")), "raw", "k BIGINT"))
)


@query("src_03_csv_questions", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def src_03(t):
    path = scratch(t, "csv")
    t.user_turns.select("conv_id", "turn", "text").write.option("header", True).option("escape", '"').csv(path)
    return io.read_questions(t.spark, path, {"conv_id": "bigint", "turn": "bigint", "text": "string"})


@query("src_04_tsv_annotations", "SELECT doc_id, quality, toxic FROM labels")
def src_04(t):
    path = scratch(t, "tsv")
    t.labels.write.option("header", True).option("sep", "\t").csv(path)
    return io.read_annotations(t.spark, path, "doc_id BIGINT, quality INT, toxic INT")


query("src_05_text_archive", "SELECT doc_id, (i - 1)::INT AS n, trim(list_extract(p, i)) AS record FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: 'Subject: ' || x) AS p FROM documents WHERE text IS NOT NULL))")(
    lambda t: io.split_archive(t.documents.where("text IS NOT NULL").select("doc_id", F.concat(F.lit("head Subject: "), F.regexp_replace("text", "\n", "-" * 40 + "\nfrom x\nSubject: ")).alias("text")), "doc_id", "text", "mail")
)
query("src_06_line_corpus", "SELECT line, min(doc_id) AS first_doc FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY line")(
    lambda t: io.line_corpus(t.documents, ["doc_id"], "text").select("line", F.col("first.doc_id").alias("first_doc"))
)
query("src_07_draw_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('draw:' || doc_id), doc_id) AS r FROM documents) WHERE r = 1")(lambda t: io.draw_source(t.documents, "source", "doc_id").select("source", "doc_id"))
query("sink_01_export", """SELECT 'conversations' AS "table", count(*) AS "rows" FROM conversations UNION ALL SELECT 'whole_recall_mcq', count(*) FROM {user_turns} UNION ALL SELECT 'slot_recall_mcq', sum(least(len(string_split(text, ' ')), 3))::BIGINT FROM {user_turns}""")(
    lambda t: io.export_dataset({"conversations": t.conversations, "whole_recall_mcq": t.user_turns, "slot_recall_mcq": t.user_turns.select("conv_id", F.posexplode(F.slice(F.split("text", " "), 1, 3)).alias("item_index", "slot"))}, scratch(t, "export"))
)
query("sink_02_question_rows", "SELECT event_id, printf('%.2f%%', CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 100.0::DOUBLE * (event_id % 7) / (event_id % 5) END) AS distance_share FROM events")(
    lambda t: io.question_rows(t.events.select("event_id", (F.col("event_id") % 7).alias("distance"), (F.col("event_id") % 5).alias("context"))).select("event_id", "distance_share")
)
query("sink_03_context_store", "SELECT ctx_id, count(*) AS uses FROM (SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS ctx_id FROM conversations GROUP BY 1) GROUP BY 1")(lambda t: io.context_store(t.conversations, "conv_id", "turn", "text")[0].select("ctx_id", "uses"))
query("sink_04_rescore_changes", f"SELECT conv_id, count(*) FILTER (CASE WHEN system_id = 3 THEN 'not_remember' ELSE {P} END IS DISTINCT FROM {P}) AS items_changed FROM {{eval_items}} GROUP BY 1")(
    lambda t: io.rescore(t.eval_items, "conv_id", F.when(F.col("system_id") == 3, "not_remember").otherwise(F.col(P)), P)[1]
)
query("sink_05_upsert", "WITH b AS (SELECT user_id, event_type AS s, value AS v, event_id FROM events), l AS (SELECT user_id, s, arg_max(v, event_id) AS v FROM b GROUP BY ALL) SELECT user_id, string_agg(s || '=' || v, ';' ORDER BY s) AS sections FROM (SELECT user_id, s, printf('%.2f', v) AS v FROM l) GROUP BY 1")(
    lambda t: io.upsert_sections(*[t.events.where(c).select("user_id", F.col("event_type").alias("section"), F.format_string("%.2f", "value").alias("value"), F.col("event_id").alias("version")) for c in ("event_id % 3 <> 0", "event_id % 3 = 0")], "user_id")
    .select("user_id", F.array_join(F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("sections"))
)
query(
    "sink_06_report_table",
    f"""WITH s AS (SELECT DISTINCT system_id::VARCHAR AS system, CASE WHEN system_id < 10 THEN 0 ELSE 1 END AS group_pos, system_id AS pos, CASE WHEN system_id < 10 THEN 'plain' ELSE 'memory' END AS g FROM {{eval_big}}),
v AS (SELECT system_id::VARCHAR AS system, round(avg(CASE WHEN {P} = 'remember_correct' THEN 1 ELSE 0 END), 6) AS v, round(avg(CASE WHEN {P} = 'not_remember' THEN 1 ELSE 0 END) - 0.3, 6) AS d FROM {{eval_big}} WHERE system_id <> 7 GROUP BY 1)
SELECT group_pos, pos, s.system, CASE WHEN v.v IS NULL THEN '-' ELSE printf('%.2f (%+.2f)', round(v.v, 2) + 0.0, round(v.d, 2) + 0.0) END AS cell FROM s LEFT JOIN v ON v.system = s.system UNION ALL SELECT group_pos, -1, min(g), '' FROM s GROUP BY 1 UNION ALL SELECT 999, 0, 'mean', printf('%.2f (%+.2f)', round(avg(v), 2) + 0.0, round(avg(d), 2) + 0.0) FROM v""",
)(
    lambda t: io.format_table(
        t.eval_big.where("system_id <> 7").groupBy(F.col("system_id").cast("string").alias("system")).agg(F.round(F.avg((F.col(P) == "remember_correct").cast("int")), 6).alias("v"), F.round(F.avg((F.col(P) == "not_remember").cast("int")) - 0.3, 6).alias("d")),
        t.eval_big.select(F.col("system_id").cast("string").alias("system"), F.when(F.col("system_id") < 10, 0).otherwise(1).alias("group_pos"), F.col("system_id").alias("pos"), F.when(F.col("system_id") < 10, "plain").otherwise("memory").alias("group")).distinct(),
        "v", "d",
    )
)

# Streams and their batch twins ----------------------------------------------------------------------------------------


def as_stream(t, df, name: str, batches: int = 3):
    """The rows as a stream of about as many micro-batches, in order of the first column. As many files are written as the rows
    have partitions, and a micro-batch takes several of them, so work is spread at any size of the table."""
    path, parts = scratch(t, name), max(batches, df.rdd.getNumPartitions())
    df.repartitionByRange(parts, df.columns[0]).write.parquet(path)
    return streams.read_files(t.spark, path, df.schema, per_batch=-(-parts // batches))


def as_ordered_stream(t, df, name: str, run: str, batches: int = 3):
    """As as_stream, for readers that need each run's rows in order of the first column: spans of it are written one after another,
    each with a run's rows in one file, as a file source takes older files first."""
    path, seq, parts = scratch(t, name), df.columns[0], max(1, df.rdd.getNumPartitions())
    cuts = df.agg(F.percentile_approx(seq, [(k + 1) / batches for k in range(batches - 1)], 10_000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        span = (F.lit(True) if low is None else F.col(seq) > low) & (F.lit(True) if high is None else F.col(seq) <= high)
        df.where(span).repartition(parts, run).write.mode("append").parquet(path)
    return streams.read_files(t.spark, path, df.schema, per_batch=parts)


@query("str_01_stage_stream", f"SELECT world, count(*) AS n, avg(CASE WHEN {P} = 'remember_correct' THEN 1 ELSE 0 END) AS remember_correct_rate FROM {{eval_items}} GROUP BY 1")
def str_01(t):
    """Rates after the last micro-batch; by then everything has come in, so they are those of the whole table."""
    out = scratch(t, "stages")
    streams.stage_stream(as_stream(t, t.eval_items.select("conv_id", "world", P), "str01"), out, f"{out}/checkpoint")
    steps = t.spark.read.parquet(f"{out}/rates")
    last = steps.agg(F.max("step").alias("last"))
    return steps.join(F.broadcast(last), F.col("step") == F.col("last")).select("world", "n", "remember_correct_rate")


query("str_02_dedup_trace", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 20 <> 0 GROUP BY ALL")(
    lambda t: streams.dedup_batch(t.events.where("event_id % 20 <> 0"), ["user_id", "event_type"], ["event_id"])
)


@query("str_02b_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def str_02b(t):
    path = scratch(t, "dedup")
    s = streams.dedup_trace(as_stream(t, t.events.select("event_id", "ts", "user_id", "event_type"), "str02"), ["user_id", "event_type"], "ts", "365 days")
    return streams.run_to_files(s.select("user_id", "event_type"), f"{path}/rows", f"{path}/checkpoint")


@query("str_02c_restarted_stream", "SELECT DISTINCT user_id, event_type FROM events")
def str_02c(t):
    """The same stream stopped after its first micro-batch and started again from its checkpoint."""
    path = scratch(t, "restart")
    s = streams.dedup_trace(as_stream(t, t.events.select("event_id", "ts", "user_id", "event_type"), "str02c"), ["user_id", "event_type"], "ts", "365 days").select("user_id", "event_type")
    streams.run_some(s, f"{path}/rows", f"{path}/checkpoint")
    return streams.run_to_files(s, f"{path}/rows", f"{path}/checkpoint")


FOLD = "WITH l AS (SELECT user_id, mem_id, arg_max(action, seq) AS a, arg_max(value, seq) AS value, max(seq) AS last_seq FROM {store_log} WHERE action <> 'NONE' GROUP BY ALL) SELECT user_id, mem_id, value, last_seq FROM l WHERE a <> 'DELETE'"
query("str_03_fold_actions", FOLD)(lambda t: streams.fold_batch(t.store_log, "user_id", "mem_id", "seq", "value"))


def with_state(t, stream, name: str, keys: list[str]):
    """The last say of a stateful stream about every key. State processors need the RocksDB store, which is set for this run and
    then set back."""
    key, path = "spark.sql.streaming.stateStore.providerClass", scratch(t, name)
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return streams.latest_step(streams.run_steps(stream(), f"{path}/steps", "update", f"{path}/checkpoint"), keys).where("live").drop("live")
    finally:
        t.spark.conf.set(key, before)


def actions(t):
    return t.store_log.select("seq", "user_id", "mem_id", "action", "value")


@query("str_03b_fold_stream", FOLD)
def str_03b(t):
    """The fold by state over several micro-batches: of each entry what the last batch that changed it says."""
    return with_state(t, lambda: streams.fold_stream(as_stream(t, actions(t), "str03"), "user_id", "mem_id", "seq", "value"), "fold", ["user_id", "mem_id"])


@query("str_03c_fresh_ids")
def str_03c(t):
    """The fold whose unknown updates get fresh numbers, over several micro-batches in order of seq."""
    return with_state(t, lambda: streams.rename_stream(as_ordered_stream(t, actions(t), "str03c", "user_id"), "user_id", "mem_id", "seq", "value"), "rename", ["user_id", "entry"])


query("str_03d_fresh_ids_batch")(lambda t: streams.rename_batch(actions(t), "user_id", "mem_id", "seq", "value"))


query("str_04_tumbling_rates", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, avg((value > 20)::INT) AS rate FROM events GROUP BY ALL")(lambda t: streams.windowed_rates(t.events, "ts", F.col("value") > 20, "1 day", by=["event_type"]))
query("str_04b_sliding_rates", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS start, count(*) AS n, avg((value > 20)::INT) AS rate FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")(lambda t: streams.windowed_rates(t.events, "ts", F.col("value") > 20, "1 day", "6 hours"))
query("str_04c_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")(
    lambda t: streams.session_rates(t.events, "ts", "user_id", "6 hours")
)


@query("str_04d_tumbling_stream", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, avg((value > 20)::INT) AS rate FROM events GROUP BY ALL")
def str_04d(t):
    path = scratch(t, "tumble")
    s = streams.windowed_rates(as_stream(t, t.events.select("event_id", "ts", "value"), "str04"), "ts", F.col("value") > 20, "1 day", late="365 days")
    return streams.latest_step(streams.run_steps(s, f"{path}/steps", "update", f"{path}/checkpoint"), ["start"])


# User functions --------------------------------------------------------------------------------------------------------
query("udf_01_answer_method", "SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN 'A' ELSE 'B' END AS answer FROM {user_turns}")(
    lambda t: answer_with(t.user_turns.select("conv_id", "turn", "text"), lambda p: p["text"].str.len().mod(2).map({0: "A", 1: "B"})).drop("text")
)
query("udf_01b_stateful_method", "SELECT conv_id, turn, chr((65 + user_idx % 3)::INT) AS answer FROM {user_turns}")(
    lambda t: answer_with(t.user_turns.select("conv_id", "turn"), lambda p: p["turn"].rank().astype(int).sub(1).mod(3).map({0: "A", 1: "B", 2: "C"}), by="conv_id")
)
query("udf_02_rewrite_step", "SELECT conv_id, turn, CASE WHEN starts_with(text, 'A') OR length(text) < 30 THEN role ELSE replace(text, ' ', '_') END AS rewritten FROM conversations")(
    lambda t: rewrite_with(t.conversations, lambda x: None if x.startswith("A") else x.replace(" ", "_") if x[29] else "", "text", F.col("role")).select("conv_id", "turn", "rewritten")
)
query("udf_03_method_config", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'k=9' ELSE 'k=5' END || ',model=m' AS config, CASE WHEN user_id % 3 = 0 THEN 'typo' ELSE '' END AS unknown FROM (SELECT DISTINCT user_id FROM events)")(
    lambda t: t.events.select("user_id").distinct().select(
        "user_id",
        method_config(
            F.create_map(*map(F.lit, ("k", "5", "model", "m"))),
            F.map_concat(F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("9"))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("typo"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))),
        ).alias("c"),
    ).select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("c.config")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("config"), F.array_join("c.unknown", ",").alias("unknown"))
)
