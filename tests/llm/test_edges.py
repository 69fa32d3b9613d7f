"""Nulls, repeats, clashing columns and empty tables of operators and stages, where their own tests leave them out."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import html, mixing, packing, pii, quality, simhash, tokens

NAMES = "_lw_t _lw_w _lw_text _lw_hash _lw_place _lw_group _lw_key key node ids tokens piece length start offset host path n rep root word fp taken target n_words failed_rule kept".split()


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in NAMES if c not in df.columns})


def rows_of(df):
    return sorted(map(repr, df.collect()))


ROWS = [(1, "one two three mail me at a.b@example.org now"), (1, "one two three mail me at a.b@example.org now"), (2, None), (2, None), (3, ""), (None, "no id"), (None, None), (4, "word " * 3000), (5, "1" * 50_000), (6, "tel +1 (555) 123-4567 and 10.0.0.1")]


@pytest.mark.parametrize(
    "run",
    [mixing.mix_report, pii.personal_data, quality.report, quality.verdicts, packing.pieces, tokens.counts],
    ids=["op2", "op5", "op6", "verdicts", "op7", "op10"],
)
def test_clashes_repeats_and_none(frame, run):
    df = frame(ROWS)
    if run is quality.verdicts:
        got = run(clashing(df)).select("doc_id", "n_repeat_words", "base_failed", "failed_rule")
        assert rows_of(got) == rows_of(run(df).select(*got.columns)) and got.count() == len(ROWS)
    elif run is packing.pieces:
        keep = lambda x: rows_of(x.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
        whole = lambda x: {tuple(r) for r in x.groupBy("doc_id").agg(F.sum("length")).collect()}
        assert len(keep(run(clashing(df)))) >= len(ROWS) and whole(run(clashing(df))) == whole(run(df))
    else:
        assert rows_of(run(clashing(df))) == rows_of(run(df)) and run(df).count() == len(ROWS)
    assert run(clashing(df).limit(0)).count() == 0


def test_main_text_clashes_and_repeats(spark):
    page = "<html><body><div class='nav'>menu</div><article><p>The text.</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://h/a", page), (1, "http://h/a", page), (2, None, page), (None, "x", None)], "page_id long, url string, html string")
    clash = df.withColumns({c: F.lit("clash") for c in ("text", "n_chars", "host", "path", "_lw_html", "_lw_host", "_lw_h", "_lw_paths", "best", "place")})
    assert rows_of(html.main_text(clash)) == rows_of(html.main_text(df)) and html.main_text(df).where("text = 'The text.'").count() == 3
    assert html.main_text(clash.limit(0)).count() == 0


def test_rejected_texts_skip_what_is_behind(frame):
    """Where a cheap rule rejects, the windows of a text are not worked out; where none does, the verdict is that of all rules."""
    rows = [(i, "a b c") for i in range(60)] + [(100 + i, "some good and plain words that nobody has to look at twice here") for i in range(40)] + [(200, "on and on it goes " * 40)]
    d = quality.cascade(frame(rows), sample_rows=1000)
    got = {r.doc_id: (r.failed_rule, r.n_repeat_words) for r in d.collect()}
    assert all(got[i] == ("few_words", None) for i in range(60)) and all(got[100 + i] == (None, 0) for i in range(40)) and got[200] == ("repeated_windows", 200)
    whole = {r.doc_id: r.failed_rule is None for r in quality.verdicts(frame(rows)).collect()}
    assert whole == {k: v[0] is None for k, v in got.items()}


def test_costs_are_what_is_left_to_pay(frame):
    docs = frame([(i, "a b c d e f g " * 3 + f"w{i}") for i in range(50)])
    rules = {"one": "n_words < 100", "two": "n_words < 90", "other": "n_repeat_words > 1000"}
    lazy, paid = (quality.cascade_order(docs, rules, sample_rows=500, paid=p) for p in ((), quality.MEASURES))
    assert [k for k, _, _ in lazy] == ["one", "two", "other"] and lazy[0][1] > 30 and lazy[1][1] == 1.0
    assert {c for _, c, _ in paid} == {1.0}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, frame, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = frame(ROWS).withColumn("size_col", F.lit("x")).withColumn("_lw_extra", F.lit("y"))
    got = stage(spark, df, small)
    if name != "pack":
        assert got.columns == df.columns
    if name == "near_dedup":
        assert got.count() == len({(t or "").strip() for _, t in ROWS})
    elif name in ("toxicity", "pii"):
        assert got.count() == len(ROWS)
    elif name == "mix":
        assert {r.doc_id for r in got.collect()} <= {i for i, _ in ROWS}
    else:
        assert got.select(F.sum("length")).first()[0] > 3000
    assert stage(spark, df.limit(0), small).count() == 0


def test_near_duplicates_with_clashes(frame):
    df = frame(ROWS)
    assert rows_of(simhash.near_duplicates(clashing(df))) == rows_of(simhash.near_duplicates(df))
