"""Readers and writers of the evaluation data: explicit schemas, bad rows kept apart, appends and changed-only rewrites."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions.text import content_id, share_text

#: Schema of an evaluation result: header and items.
ITEM = "timestamp STRING, turn_role STRING, identifier_label STRING, question STRING, choices MAP<STRING,STRING>, choice_to_answer_type MAP<STRING,STRING>, model_response STRING, predicted_choice STRING, predicted_answer_type STRING"
EVAL = f"method STRING, model STRING, world STRING, ask_period STRING, whole_recall_results ARRAY<STRUCT<{ITEM}>>, slot_recall_results ARRAY<STRUCT<{ITEM}>>"
TRACE = "event_type STRING, phase_label STRING, turn_index INT, user_input STRING, assistant_output STRING, user_input_sent BOOLEAN, qa_family STRING, timestamp STRING, predicted_choice STRING, memory_triggered BOOLEAN, error STRING"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a new local one where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def read_eval_tree(spark: SparkSession, roots: list[str], schema: str = EVAL) -> DataFrame:
    """Every JSON file under the roots, each path once, with its path."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(roots)
    return df.select("*", F.col("_metadata.file_path").alias("path")).dropDuplicates(["path"])


def read_trace(spark: SparkSession, path: str, schema: str = TRACE) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSON-lines trace and the lines that are no object; blank lines are neither."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return split_json(lines, "value", schema)


def split_json(lines: DataFrame, col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose column holds a JSON object, parsed, and the others as they are."""
    d = lines.withColumn("_v", F.try_parse_json(col)).withColumn("_ok", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    keep = [c for c in lines.columns if c != col]
    return d.where("_ok").select(*keep, F.from_json(col, schema, {"mode": "PERMISSIVE"}).alias("_j")).select(*keep, "_j.*"), d.where("NOT _ok").select(*lines.columns)


def read_questions(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a header and quoted fields over several lines; read as text, then cast; what cannot be cast is null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated annotations; malformed rows are dropped."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def split_archive(texts: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """Records of a text archive: mails parted by rules of 35 dashes or more (from 'Subject:' on), or files under 'File:' headers with a rule of 50 '='."""
    if kind == "mail":
        parts = texts.select(key, F.posexplode(F.split(text, "-{35,}")).alias("n", "part"))
        return parts.select(key, "n", F.trim(F.regexp_extract("part", r"(?s)(Subject:.*)", 1)).alias("record")).where("record <> ''")
    parts = texts.select(key, F.posexplode(F.split(text, r"(?m)^File: ")).alias("n", "part")).where("n > 0")
    return parts.select(key, "n", F.regexp_extract("part", r"^([^\n]*)", 1).alias("name"), F.regexp_extract("part", r"(?s)={50}\n(.*)$", 1).alias("record"))


def line_corpus(texts: DataFrame, order: list[str], text: str) -> DataFrame:
    """Distinct trimmed non-blank lines with the place of their first occurrence, files in order."""
    lines = texts.select(*order, F.posexplode(F.split(text, "\n")).alias("_pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.min(F.struct(*order, "_pos")).alias("first"))


def draw_source(records: DataFrame, topic: str, key: str, seed: str = "draw") -> DataFrame:
    """One record per topic, drawn by hash."""
    w = Window.partitionBy(topic).orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key)
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def export_dataset(tables: dict[str, DataFrame], out: str, fmt: str = "parquet") -> DataFrame:
    """Writes the tables under out and returns a manifest of row counts, read back from what was written."""
    spark, manifest = next(iter(tables.values())).sparkSession, None
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{out}/{name}")
        n = spark.read.schema(df.schema).format(fmt).load(f"{out}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        manifest = n if manifest is None else manifest.unionByName(n)
    return manifest


def question_rows(rows: DataFrame) -> DataFrame:
    """Rows for the question table: the distance as a share of the context, with two places."""
    return rows.withColumn("distance_share", share_text(F.col("distance"), F.col("context")))


def append_questions(rows: DataFrame, path: str) -> None:
    question_rows(rows).write.mode("append").option("header", True).option("escape", '"').csv(path)


def context_store(messages: DataFrame, key: str, order: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Contexts, one row per distinct content under its SHA-256, and the id that each key has."""
    per = messages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("messages"))
    per = per.withColumn("ctx_id", content_id(F.col("messages")))
    return per.groupBy("ctx_id").agg(F.min("messages").alias("messages"), F.count("*").alias("uses")), per.select(key, "ctx_id")


def rescore(items: DataFrame, path: str, new: Column, old: str) -> tuple[DataFrame, DataFrame]:
    """Items with the new value and whether it changed, and per path the number of changes."""
    d = items.withColumn("new_value", new).withColumn("changed", ~F.col("new_value").eqNullSafe(F.col(old)))
    return d, d.groupBy(path).agg(F.count_if("changed").alias("items_changed"))


def rewrite_changed(items: DataFrame, path: str, out: str) -> None:
    """Overwrites only the partitions of paths with a change, by dynamic partition overwrite."""
    changed = items.groupBy(path).agg(F.max("changed").alias("any")).where("any").select(path)
    items.join(changed, path, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(path).parquet(out)


def upsert_sections(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Documents as section, value pairs: each section's value from its newest version, others kept; a map per document."""
    both = current.select(key, "section", "value", "version").unionByName(updates.select(key, "section", "value", "version"))
    last = both.groupBy(key, "section").agg(F.max_by("value", F.struct("version", "value")).alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "value")))).alias("sections"))


def format_table(values: DataFrame, systems: DataFrame, value: str, delta: str) -> DataFrame:
    """Report rows: a header row per group, systems in their fixed order with 'v (+d)' or a dash, and a mean row at the end."""
    two = lambda v, d: F.format_string("%.2f (%+.2f)", F.round(v, 2) + F.lit(0.0), F.round(d, 2) + F.lit(0.0))
    cell = F.when(F.col(value).isNotNull(), two(value, delta)).otherwise("-")
    body = systems.join(values, "system", "left").select("group_pos", "pos", "system", cell.alias("cell"))
    head = systems.groupBy("group_pos").agg(F.first("group").alias("system")).select("group_pos", F.lit(-1).alias("pos"), "system", F.lit("").alias("cell"))
    mean = values.agg(F.avg(value).alias("v"), F.avg(delta).alias("d")).select(F.lit(999).alias("group_pos"), F.lit(0).alias("pos"), F.lit("mean").alias("system"), two("v", "d").alias("cell"))
    return body.unionByName(head).unionByName(mean)
