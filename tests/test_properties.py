"""Properties of what SQL cannot express, and of edge cases."""

import subprocess
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwright.functions import scoring, text
import loomwright.plans.q_joins
import loomwright.plans.q_lines
import loomwright.plans.q_metrics  # noqa: F401
from loomwright.operators import lines, longctx, matching, similarity
from loomwright.plans.catalog import QUERIES
from loomwright.plans.views import Tables
from loomwright.sources import io
from loomwright.streaming import streams

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    files = [p for p in (ROOT / "loomwright").rglob("*.py") if "llm" not in p.parts]
    assert files and not [p for p in files if "loomwright.llm" in p.read_text()]


def test_placements_come_later_and_keep_gaps_where_they_can(spark, small):
    t = Tables(spark, small)
    turns = t.user_turns.select("conv_id", "user_idx", "n_user", (F.col("user_idx") < F.col("n_user") / 2).alias("is_key"))
    rows = longctx.place_directives(turns, "conv_id").collect()
    n = {r.conv_id: r.n_user for r in turns.select("conv_id", "n_user").distinct().collect()}
    assert rows
    for r in rows:
        assert r.key_idx < r.placed_before < n[r.conv_id]
        if n[r.conv_id] - (r.key_idx + 1) - 1 >= 5:
            assert n[r.conv_id] - r.placed_before - 1 >= 5
    assert rows == longctx.place_directives(turns.repartition(5), "conv_id").collect() or sorted(rows) == sorted(longctx.place_directives(turns.repartition(5), "conv_id").collect())


def test_sampled_blocks_respect_stages(spark, small):
    t = Tables(spark, small)
    drawn = longctx.sample_blocks(t.history.select("user_id", F.col("event_type").alias("file"), "stage").distinct(), "user_id", 6).collect()
    seen = {}
    for r in sorted(drawn, key=lambda r: (r.user_id, r.place)):
        assert seen.get((r.user_id, r.file), -1) < r.stage
        seen[r.user_id, r.file] = r.stage


def test_budget_is_kept_or_only_chosen_topics_are_left(spark):
    rows = spark.createDataFrame([("c", f"t{i}", 10) for i in range(6)] + [("d", "t0", 500)], "conv string, topic string, w int")
    out = lines.fit_budget(rows, "conv", "topic", "w", F.col("topic"), F.col("topic") == "t0", 25).groupBy("conv").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    got = {r.conv: (r.w, r.n) for r in out}
    assert got["c"][0] <= 25 and got["d"] == (500, 1)


def test_merged_roles_never_repeat(spark, small):
    out = lines.merge_roles(Tables(spark, small).conversations).orderBy("conv_id", "first_turn").collect()
    for a, b in zip(out, out[1:], strict=False):
        assert a.conv_id != b.conv_id or a.role != b.role


def test_orphan_pages(spark):
    t = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "user", "u"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "v")], "conv_id int, turn int, role string, text string")
    got = [(r.user_text, r.assistant_text) for r in lines.page_pairs(t).orderBy("page").collect()]
    assert got == [(None, "a"), ("u", "b"), (None, "c"), ("v", None)]


def test_descendants_end_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (6, 5), (7, None), (8, 8)], "c int, p int")
    got = {(r.descendant, r.ancestor) for r in matching.descendants(e, "c", "p").collect()}
    assert got == {(1, 2), (2, 3), (3, 1), (1, 3), (2, 1), (3, 2), (5, 4), (6, 5), (6, 4)}


def test_similar_pairs_lose_none(spark):
    import random

    rng = random.Random(0)
    sets = {i: [f"w{rng.randrange(14)}" for _ in range(rng.randrange(3, 12))] for i in range(40)}
    df = spark.createDataFrame([("c", i, s) for i, s in sets.items()], "conv string, k int, tokens array<string>")
    got = {(r.k, r.other) for r in matching.token_pairs(df, "conv", "k", "tokens").collect()}
    want = set()
    for i in sets:
        for j in range(i + 1, 40):
            a, b = set(sets[i]), set(sets[j])
            n = len(a & b)
            if n >= 4 and (n / len(a | b) >= 0.5 or n / min(len(a), len(b)) >= 0.7):
                want.add((i, j))
    assert got == want


def test_ratio_is_that_of_insertions_and_deletions():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in [("", ""), ("abc", ""), ("kitten", "sitting"), ("aaaa", "aa"), ("abcdef" * 30, "abcxef" * 29), ("héß", "heß")]:
        want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
        assert similarity.ratio(a, b) == pytest.approx(want)


@pytest.mark.parametrize(
    ("said", "choice"),
    [("<final_answer>(b)</final_answer>", "B"), ("<final_answer>: c", "C"), ("maybe (a) or (c)", "C"), ("Option B", "B"), ("cab", ""), ("", ""), ("(z) then A", "A"), ("<final_answer>(z)</final_answer> (b)", "B")],
)
def test_choice_cascade(spark, said, choice):
    df = spark.createDataFrame([(said,)], "t string").select(scoring.extract_choice(F.col("t"), ["a", "b", "c"]).alias("c"))
    assert df.first().c == choice


def test_blank_needles_are_found_nowhere(spark):
    df = spark.createDataFrame([("abc 123 x", "", False), (None, "abc", False), ("ABC  def", "abc def", True), ("tel 5551234", "call 5551234 now", True), ("xyz", "xyz", False)], "h string, n string, want boolean")
    assert df.where(~text.contains_expected(F.col("h"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0


def test_loose_json_and_bad_lines(spark):
    df = spark.createDataFrame([("```json\n{'k': 5}\n```",), ('{"k": 7}',), ("no",)], "t string")
    assert [r.k for r in df.select(text.parse_loose_json(F.col("t"), "k INT")["k"].alias("k")).collect()] == [5, 7, None]
    good, bad = io.split_json(spark.createDataFrame([('{"k": 1}',), ("x",), ("[1]",)], "v string"), "v", "k INT")
    assert good.count() == 1 and bad.count() == 2


def test_reference_shapes(spark, tmp_path):
    """Nested results as files: parsed with their maps, one row per path however often a root is named."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.json").write_text('{"method": "m", "world": "forget", "whole_recall_results": [{"timestamp": "01/02/2024", "choices": {"A": "x"}, "choice_to_answer_type": {"A": "not_remember"}}], "slot_recall_results": []}')
    df = io.read_eval_tree(spark, [str(tmp_path), str(tmp_path / "a")])
    assert df.count() == 1
    item = df.select(F.explode("whole_recall_results").alias("i")).first().i
    assert item.choice_to_answer_type == {"A": "not_remember"} and df.first().slot_recall_results == []


def test_fold_stream_equals_batch(spark, small, tmp_path):
    log = Tables(spark, small).store_log.where("user_id < 20").select("seq", "user_id", "mem_id", "action", "value")
    try:
        src = str(tmp_path / "log")
        log.repartition(5, "seq").write.parquet(src)  # files in no order of seq
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        out = streams.fold_stream(streams.read_files(spark, src, log.schema), "user_id", "mem_id", "seq", "value")
        steps = streams.run_steps(out, str(tmp_path / "steps"), "update", str(tmp_path / "cp"))
        assert steps.select("step").distinct().count() > 1
        got = streams.latest_step(steps, ["user_id", "mem_id"]).where("live").drop("live").collect()
        assert steps.count() < 2 * log.where("action <> 'NONE'").count()
    except Exception as e:  # the state server needs packages that an installation may lack
        if "protobuf" in str(e).lower() or "grpc" in str(e).lower():
            pytest.skip(str(e)[:100])
        raise
    want = streams.fold_batch(log, "user_id", "mem_id", "seq", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_changed_paths_alone_are_rewritten(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1, "a"), ("p1", 2, "b"), ("p2", 3, "c")], "path string, i int, v string")
    out = str(tmp_path / "t")
    df.write.partitionBy("path").parquet(out)
    before = {p.name for p in (tmp_path / "t" / "path=p2").iterdir()}
    d, n = io.rescore(df, "path", F.when(F.col("i") == 2, "z").otherwise(F.col("v")), "v")
    io.rewrite_changed(d.select("i", F.col("new_value").alias("v"), "changed", "path"), "path", out)
    assert {r.path: r.items_changed for r in n.collect()} == {"p1": 1, "p2": 0}
    assert {p.name for p in (tmp_path / "t" / "path=p2").iterdir()} == before
    assert {r.v for r in spark.read.parquet(out).where("path = 'p1'").collect()} == {"a", "z"}


@pytest.mark.parametrize("name", ["agg_11_violation_utility", "prj_13_merge_roles", "jon_14_best_match", "win_09_choose_keys"])
def test_same_under_any_number_of_partitions(name, spark, small):
    seen = []
    for n in ("1", "4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(repr, QUERIES[name](spark, small).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] == seen[2]


def test_global_index(spark):
    from loomwright.operators.indexing import global_index

    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(9)
    got = {r.x: r.k for r in global_index(df, ["x"]).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(got))} and len(got) == 1000
    assert global_index(df.limit(0), ["x"]).count() == 0


def test_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert lines.merge_roles(turns).count() == lines.page_pairs(turns).count() == lines.transcript(turns).count() == 0


def test_pandas_is_only_where_no_expression_is():
    out = subprocess.run(["grep", "-rlE", "applyInPandas|mapInPandas|pandas_udf|InPandas", str(ROOT / "loomwright"), "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert {Path(p).name for p in out if "/llm/" not in p} == {"longctx.py", "similarity.py", "text.py", "udf.py", "streams.py"}
    assert pd is not None


def test_descendants_have_no_greatest_depth(spark):
    parent = {i: i - 1 for i in range(1, 1100)} | {2000 + i: 2000 + (i + 1) % 7 for i in range(7)} | {2100: 2003, 2101: 2100}
    want = {}
    for d in parent:
        a, k = d, 0
        while (a := parent.get(a)) is not None and a != d and (d, a) not in want:
            want[d, a] = k = k + 1
    df = spark.createDataFrame(list(parent.items()), "c long, p long")
    assert {(r.descendant, r.ancestor): r.distance for r in matching.descendants(df, "c", "p").collect()} == want


def test_lineage_closure_of_the_whole_history(spark, small):
    from loomwright.plans.catalog import QUERIES
    from loomwright.plans.views import Tables

    parent = {r.event_id: r.parent_id for r in Tables(spark, small).history.select("event_id", "parent_id").collect() if r.parent_id is not None}
    want = set()
    for d in parent:
        a, k = d, 0
        while (a := parent.get(a)) is not None:
            k += 1
            want.add((d, a, k))
    assert {(r.descendant, r.ancestor, r.distance) for r in QUERIES["jon_11b_lineage_closure_all"](spark, small).collect()} == want


def test_worlds_draw_several_wordings(spark, small):
    from loomwright.operators import worlds

    t = Tables(spark, small)
    keys = t.user_turns.select("conv_id", "turn", F.lit("it").alias("ref"))
    for placement in ("suffix", "prefix"):
        texts = [r.text for r in worlds.no_store(t.conversations, keys, placement=placement).where("role = 'user'").collect()]
        used = {w for w in worlds.TEMPLATES[f"no_store_{placement}"] for x in texts if (x.endswith(w) if placement == "suffix" else x.startswith(w))}
        assert len(used) == len(worlds.TEMPLATES[f"no_store_{placement}"])
    told = worlds.detect_directive(worlds.forget(t.conversations, keys, "ref")).collect()
    assert len({r.directive for r in told}) == len(worlds.TEMPLATES["forget_user"]) and {r.pre for r in told} == {""}
    whole = worlds.detect_directive(spark.createDataFrame([("Hi. " + w + " Now go on.",) for w in worlds.TEMPLATES["release_user"]], "text string")).collect()
    assert sorted(r.directive for r in whole) == sorted(worlds.TEMPLATES["release_user"]) and {(r.pre, r.post) for r in whole} == {("Hi.", "Now go on.")}
