"""Queries of the aggregations and the scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import scoring as S
from loomwright.operators import metrics as M
from loomwright.plans.catalog import query

P = "predicted_answer_type"
RC = f"avg(CASE WHEN {P} = 'remember_correct' THEN 1 ELSE 0 END)"
RATES = (
    f"count(*) AS n, {RC} AS remember_correct_rate, avg(CASE WHEN {P} = 'not_remember' THEN 1 ELSE 0 END) AS not_remember_rate, "
    f"avg(CASE WHEN {P} = 'distractor_irrelevant' THEN 1 ELSE 0 END) AS distractor_irrelevant_rate, "
    f"avg(CASE WHEN {P} IN ('remember_correct', 'not_remember', 'distractor_irrelevant') THEN 0 ELSE 1 END) AS other_rate"
)
NAMES = ["remember_correct_rate", "not_remember_rate", "distractor_irrelevant_rate", "other_rate"]
MERGE = "sum(n)::BIGINT AS n, " + ", ".join(f"coalesce(sum(n * {r}) / nullif(sum(n), 0), 0.0) AS {r}" for r in NAMES)
STAGES = ["early", "intermediate", "late"]
TPR = f"avg(CASE WHEN turn_role = 'probe' THEN ({P} = 'remember_correct')::INT END)"
FPR = f"avg(CASE WHEN turn_role = 'key' THEN ({P} = 'remember_correct')::INT END)"
TNR = f"avg(CASE WHEN turn_role = 'key' THEN ({P} = 'not_remember')::INT END)"


def vu_sql(view: str, system: str, record: str, by: str = "") -> str:
    """SQL of the violation and utility table; record and by are column lists that end with a comma or are empty."""
    per = f"SELECT {system}, {by} world, {record} qa_family, {TPR} AS t, {FPR} AS f FROM {{{view}}} GROUP BY ALL"
    cols = ", ".join(f"round(avg(CASE WHEN world = '{w}' THEN t END), 9) AS {w}_utility, round(avg(CASE WHEN world = '{w}' THEN f END), 9) AS {w}_violation" for w in M.WORLDS)
    delta = ", ".join(f"round(avg(CASE WHEN world = '{w}' THEN t END) - avg(CASE WHEN world = 'baseline' THEN t END), 9) AS {w}_delta" for w in M.WORLDS[1:])
    inner = f"SELECT {system}, {by} world, {record} avg(t) AS t, avg(f) AS f FROM ({per}) GROUP BY ALL"
    return f"SELECT {system}, {by} {cols}, {delta} FROM ({inner}) GROUP BY {system}{', ' + by.rstrip(', ') if by else ''}"


VU = vu_sql("eval_big", "system_id", "persona, ask_stage,")


@query(
    "flagship",
    """WITH r AS (SELECT *, upper(trim(model_response)) AS u FROM {responses}),
x AS (SELECT *, coalesce(nullif(regexp_extract(u, '<FINAL_ANSWER>\\s*[\\(\\[]?\\s*([A-C])\\s*[\\)\\]]?', 1), ''),
  list_extract(list_filter(regexp_extract_all(u, '\\(([A-Z])\\)', 1), lambda x: x IN ('A', 'B', 'C')), -1),
  CASE WHEN regexp_matches(u, '\\bA\\b') THEN 'A' END, CASE WHEN regexp_matches(u, '\\bB\\b') THEN 'B' END, CASE WHEN regexp_matches(u, '\\bC\\b') THEN 'C' END, '') AS choice FROM r),
d AS (SELECT system_id, world, conv_id % 4 AS persona, qa_family, turn_role, CASE choice WHEN 'A' THEN 'not_remember' WHEN 'B' THEN 'remember_correct' WHEN 'C' THEN 'distractor_irrelevant' ELSE '' END AS predicted_answer_type FROM x)
"""
    + vu_sql("d", "system_id", "persona,").replace("{d}", "d"),
)
def flagship(t):
    types = F.create_map(*[F.lit(x) for x in ("A", S.REFUSED, "B", S.RECALLED, "C", S.DISTRACTED)])
    choice = S.extract_choice(F.col("model_response"), ["a", "b", "c"])
    items = t.responses.withColumn(P, S.decode(choice, types)).withColumn("persona", F.col("conv_id") % 4)
    return M.violation_utility(items, ["persona"])


query("agg_01_answer_type_rates", f"SELECT system_id, world, {RATES} FROM {{eval_big}} GROUP BY ALL")(lambda t: M.rates(t.eval_big, ["system_id", "world"]))

query(
    "agg_02_recall_summary",
    f"SELECT world, qa_family, coalesce(turn_role, 'all') AS turn_role, {RATES} FROM {{eval_big}} GROUP BY GROUPING SETS ((world, qa_family), (world, qa_family, turn_role))",
)(lambda t: M.recall_summary(t.eval_big, ["world"]))

query(
    "agg_03_weighted_merge",
    f"SELECT system_id, world, n, {', '.join(f'round({r}, 9) AS {r}' for r in NAMES)} FROM (SELECT system_id, world, {MERGE} FROM (SELECT system_id, world, persona, {RATES} FROM {{eval_big}} GROUP BY ALL) GROUP BY ALL)",
)(lambda t: M.weighted_merge(M.rates(t.eval_big, ["system_id", "world", "persona"]), ["system_id", "world"], NAMES).select("system_id", "world", "n", *[F.round(r, 9).alias(r) for r in NAMES]))

query(
    "agg_04_world_difficulty",
    f"SELECT system_id, world, n, {', '.join(f'round({r}, 9) AS {r}' for r in NAMES)} FROM (SELECT system_id, world, {MERGE} FROM (SELECT system_id, world, persona, {RATES} FROM {{eval_big}} WHERE persona < CASE WHEN world = 'forget' THEN 10 ELSE 4 END GROUP BY ALL) GROUP BY ALL)",
)(lambda t: M.weighted_merge(M.rates(M.keep_world_personas(t.eval_big, {"forget": 10}, 4), ["system_id", "world", "persona"]), ["system_id", "world"], NAMES).select("system_id", "world", "n", *[F.round(r, 9).alias(r) for r in NAMES]))

STAGED = "SELECT s.system_id, s.ask_stage, coalesce(n, 0) AS n, {} FROM (SELECT DISTINCT system_id, unnest(['early', 'intermediate', 'late']) AS ask_stage FROM {{{{eval_big}}}} WHERE {{0}}) s LEFT JOIN (SELECT system_id, ask_stage, {} FROM {{{{eval_big}}}} WHERE {{0}} GROUP BY ALL) r ON s.system_id = r.system_id AND s.ask_stage = r.ask_stage".format(", ".join(f"coalesce({r}, 0) AS {r}" for r in NAMES), RATES)

query("agg_05_no_store_by_stage", STAGED.format("world = 'no_store'"))(lambda t: M.by_stage(t.eval_big.where("world = 'no_store'"), STAGES, ["system_id"]))
query("agg_06_forget_immediate", f"SELECT system_id, {RATES} FROM {{eval_big}} WHERE world = 'forget' AND turn_role = 'key' AND forget_stage = ask_stage GROUP BY ALL")(
    lambda t: M.rates(t.eval_big.where("world = 'forget' AND turn_role = 'key' AND forget_stage = ask_stage"), ["system_id"])
)
query("agg_07_forget_persistence", STAGED.format("world = 'forget' AND forget_stage = 'early'"))(lambda t: M.by_stage(t.eval_big.where("world = 'forget' AND forget_stage = 'early'"), STAGES, ["system_id"]))
query("agg_08_forget_timing", f"SELECT forget_stage, turn_role, {RATES} FROM {{eval_big}} WHERE world = 'forget' AND forget_stage = ask_stage GROUP BY ALL")(
    lambda t: M.rates(t.eval_big.where("world = 'forget' AND forget_stage = ask_stage"), ["forget_stage", "turn_role"])
)

#: The settings of the restricting world by name, restricting stage and asking stage.
SETTINGS = [
    ("suppression_early", "early", "early", None), ("suppression_intermediate", "intermediate", "intermediate", None), ("suppression_late", "late", "late", None),
    ("persistence_intermediate", "early", "intermediate", None), ("persistence_late", "early", "late", None),
    ("recovery_early", "late", "early", "early"), ("recovery_intermediate", "intermediate", "early", "early"), ("recovery_late", "late", "intermediate", "intermediate"),
]
query(
    "agg_09_no_use_settings",
    f"WITH s AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, {r!r}, {a!r})' for n, r, a, _ in SETTINGS)}) AS v(setting, r, a)) SELECT setting, {RATES} FROM {{eval_big}} JOIN s ON forget_stage = r AND ask_stage = a WHERE world = 'no_use' GROUP BY ALL",
)(lambda t: M.settings_rates(t.eval_big.where("world = 'no_use'"), SETTINGS))

SLOTS = "SELECT e.*, p.p_type AS slot_type FROM {eval_big} e JOIN part p ON e.l_partkey = p.p_partkey"


def slots(t):
    return t.eval_big.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("slot_type")), "l_partkey")


query("agg_10_slot_type_effects", f"SELECT world, slot_type, turn_role, grouping(world, slot_type, turn_role)::BIGINT AS level, {RATES} FROM ({SLOTS}) GROUP BY CUBE (world, slot_type, turn_role)")(
    lambda t: slots(t).cube("world", "slot_type", "turn_role").agg(F.grouping_id().alias("level"), *M.rate_columns())
)
query("agg_11_violation_utility", VU)(lambda t: M.violation_utility(t.eval_big, ["persona", "ask_stage"]))
VALS = [f"{w}_{m}" for w in M.WORLDS for m in ("utility", "violation")] + [f"{w}_delta" for w in M.WORLDS[1:]]
query(
    "agg_11b_violation_utility_mean_row",
    f"WITH v AS ({VU}) SELECT system_id::VARCHAR AS system_id, {', '.join(VALS)} FROM v UNION ALL SELECT 'mean', {', '.join(f'round(avg({c}), 6)' for c in VALS)} FROM v",
)(lambda t: M.with_mean_row(M.violation_utility(t.eval_big, ["persona", "ask_stage"]), "system_id"))
query("agg_12_violation_utility_split", vu_sql("eval_big", "system_id", "persona, ask_stage,", "qa_family,").replace("ask_stage, qa_family, avg(CASE", "ask_stage, avg(CASE").replace("persona, ask_stage, qa_family, avg(CASE", "persona, ask_stage, avg(CASE"))(
    lambda t: M.violation_utility(t.eval_big, ["persona", "ask_stage"], by=["qa_family"])
)
query(
    "agg_13_tradeoff",
    f"WITH v AS ({VU}) " + " UNION ALL ".join(f"SELECT system_id, '{w}' AS world, {w}_utility AS utility, {'0.0::DOUBLE' if w == 'baseline' else w + '_delta'} AS delta, {w}_violation AS violation FROM v" for w in M.WORLDS),
)(lambda t: M.tradeoff(M.violation_utility(t.eval_big, ["persona", "ask_stage"])))

for kind, cond in (("no_store", "world = 'no_store'"), ("immediate", "world = 'forget' AND ask_stage = forget_stage"), ("persistence", "world = 'forget' AND forget_stage = 'early'")):
    query(f"agg_14_stage_rows_{kind}", f"SELECT system_id, ask_stage, {TPR} AS utility, {FPR} AS recall_rate, {TNR} AS forget_rate, count(*) AS n FROM {{eval_big}} WHERE {cond} GROUP BY ALL")(
        lambda t, kind=kind: M.stage_rows(t.eval_big, kind)
    )

METRIC = f"CASE WHEN world = 'baseline' THEN ({P} = 'remember_correct')::INT ELSE ({P} = 'not_remember')::INT END"
query("agg_15_slot_metric_rows", f"SELECT l_orderkey, l_linenumber, system_id, world, slot_type, {METRIC} AS metric FROM ({SLOTS}) WHERE qa_family = 'slot' AND turn_role = 'key'")(
    lambda t: M.slot_metric(slots(t)).select("l_orderkey", "l_linenumber", "system_id", "world", "slot_type", "metric")
)
query(
    "agg_16_slot_matrix",
    f"WITH m AS (SELECT slot_type, {', '.join(f'''avg(CASE WHEN world = '{w}' THEN {METRIC} END) AS {w}''' for w in M.WORLDS)} FROM ({SLOTS}) WHERE qa_family = 'slot' AND turn_role = 'key' GROUP BY 1) SELECT *, row_number() OVER (ORDER BY baseline DESC NULLS LAST, slot_type)::INT AS place FROM m",
)(lambda t: M.slot_matrix(slots(t)))
#: Runs expected per system in each world.
EXPECTED = {"baseline": 12, "no_store": 12, "forget": 30, "no_use": 32}
query(
    "agg_17_completion",
    f"WITH e AS (SELECT * FROM (VALUES {', '.join(f'({w!r}, {n})' for w, n in EXPECTED.items())}) AS v(world, expected)), g AS (SELECT system_id, world, count(DISTINCT (persona, ask_stage)) AS got FROM {{eval_big}} GROUP BY ALL) "
    "SELECT s.system_id, e.world, e.expected::INT AS expected, coalesce(g.got, 0) AS got FROM (SELECT DISTINCT system_id FROM {eval_big}) s CROSS JOIN e LEFT JOIN g ON g.system_id = s.system_id AND g.world = e.world",
)(lambda t: M.completion(t.eval_big, EXPECTED))
query("agg_18_pooled_metrics", f"SELECT system_id, world, qa_family, {TPR} AS pooled_utility, {FPR} AS pooled_violation, count(*) AS n FROM {{eval_big}} WHERE NOT l_partkey % 17 = 0 GROUP BY ALL")(
    lambda t: M.pooled(t.eval_big, ["system_id", "world", "qa_family"], F.col("l_partkey") % 17 == 0)
)


# Scoring ------------------------------------------------------------------------------------------------------------
def facts(retrieved="retrieved"):
    """Columns of the cases view by the names of the scoring facts; kind 0 can act on entries, kind 2 has no log."""
    c = {k: F.col(k) for k in ("in_store", "directive_text", "directive_intent", "acted_on", "signal", "retrieved")}
    c |= {"answer": F.col(P), "can_act": F.col("kind") == 0, "has_store": F.col("kind") < 2, "log": F.col("kind") == 0, "related": F.col("directive_text")}
    c["action"] = F.when(~F.col("directive_text"), "NO_DIRECTIVE").when(F.col("acted_on"), "UPDATE_DELETE").when(F.col("signal"), "NOTHING").otherwise("ADD_ONLY")
    return c


FLAGS_SQL = """CASE WHEN directive_intent THEN 'green' WHEN directive_text THEN 'blue' ELSE 'red' END AS stage_1,
  CASE WHEN NOT in_store OR CASE WHEN kind = 0 THEN acted_on ELSE directive_intent END THEN 'green' ELSE 'red' END AS stage_2,
  CASE WHEN NOT retrieved OR signal THEN 'green' ELSE 'red' END AS stage_3, CASE WHEN predicted_answer_type = 'not_remember' THEN 'green' ELSE 'red' END AS stage_4"""
BUCKET_SQL = """CASE WHEN predicted_answer_type NOT IN ('remember_correct', 'not_remember') THEN 'VIOLATION_S1'
  WHEN predicted_answer_type = 'remember_correct' THEN CASE WHEN stage_1 = 'red' THEN 'VIOLATION_S1' WHEN stage_2 = 'red' THEN 'VIOLATION_S2' WHEN stage_3 = 'red' THEN 'VIOLATION_S3' ELSE 'VIOLATION_S4' END
  ELSE CASE WHEN stage_1 = 'red' THEN 'ACCIDENTAL_S1' WHEN stage_2 = 'red' THEN 'ACCIDENTAL_S2' WHEN stage_3 = 'red' THEN 'ACCIDENTAL_S3' ELSE 'GENUINE' END END"""
MECH_SQL = "CASE WHEN retrieved THEN 'TARGET_RETRIEVED_LLM_REFUSED' WHEN in_store THEN 'TARGET_IN_STORE_NOT_RETRIEVED' WHEN kind = 0 AND NOT directive_text THEN 'TARGET_NOT_EXTRACT_ANYTHING' ELSE 'TARGET_EXTRACT_WRONG' END"
SAID_SQL = "CASE predicted_answer_type WHEN 'not_remember' THEN 'NR' WHEN 'remember_correct' THEN 'LEAK' ELSE 'OTHER' END"
KNOWN_SQL = "CASE WHEN kind = 0 THEN directive_text AND (acted_on OR NOT signal) ELSE directive_intent OR directive_text END"
LEAF_SQL = f"concat(CASE WHEN NOT in_store THEN 'Q1_NO' WHEN NOT ({KNOWN_SQL}) THEN CASE WHEN retrieved THEN 'A_FACT_YES' ELSE 'A_FACT_NO' END WHEN NOT retrieved THEN 'B_FACT_NO' WHEN signal THEN 'B_BOTH' ELSE 'B_FACT_ONLY' END, '_', {SAID_SQL})"
CONTROL_SQL = "CASE WHEN predicted_answer_type = 'not_remember' THEN 'MC_CORRECT' WHEN kind = 0 AND acted_on THEN CASE WHEN retrieved THEN 'MC_UPDATED_RETRIEVED_WRONG' ELSE 'MC_UPDATED_RETRIEVE_FAIL' END WHEN directive_text THEN CASE WHEN retrieved THEN 'MC_NO_UPDATE' ELSE 'MC_ANSWER_FAIL' END ELSE 'MC_INSTR_NOT_EXTRACTED' END"
FAIL_SQL = "CASE WHEN predicted_answer_type = 'remember_correct' THEN NULL WHEN kind >= 2 THEN CASE WHEN predicted_answer_type = 'distractor_irrelevant' THEN 'API_DISTRACTOR' ELSE 'API_NOT_REMEMBER' END WHEN retrieved THEN 'ANSWER_FAIL' WHEN kind <> 0 THEN 'WRITE_RETRIEVE_UNCLEAR' WHEN in_store THEN 'RETRIEVE_FAIL' WHEN directive_text THEN 'EXTRACT_WRONG' ELSE 'NOT_EXTRACTED' END"
IDS = "conv_id, turn, world, system_id"
ID = IDS.split(", ")

CHOICE_SQL = r"""coalesce(nullif(regexp_extract(u, '<FINAL_ANSWER>\s*[\(\[]?\s*([A-C])\s*[\)\]]?', 1), ''),
  list_extract(list_filter(regexp_extract_all(u, '\(([A-Z])\)', 1), lambda x: x IN ('A', 'B', 'C')), -1),
  CASE WHEN regexp_matches(u, '\bA\b') THEN 'A' END, CASE WHEN regexp_matches(u, '\bB\b') THEN 'B' END, CASE WHEN regexp_matches(u, '\bC\b') THEN 'C' END, '')"""
query("scr_01_extract_choice", f"SELECT {IDS}, {CHOICE_SQL} AS choice FROM (SELECT *, upper(trim(model_response)) AS u FROM {{responses}})")(lambda t: t.responses.select(*ID, S.extract_choice(F.col("model_response"), ["a", "b", "c"]).alias("choice")))
query(
    "scr_02_extract_choice_web",
    f"SELECT {IDS}, CASE WHEN contains(u, '(C)') THEN 'C' WHEN contains(u, '(B)') THEN 'B' WHEN contains(u, '(A)') THEN 'A' WHEN regexp_matches(u, '\\bC\\b') THEN 'C' WHEN regexp_matches(u, '\\bB\\b') THEN 'B' WHEN regexp_matches(u, '\\bA\\b') THEN 'A' ELSE '' END AS choice FROM (SELECT *, upper(model_response) AS u FROM {{responses}})",
)(lambda t: t.responses.select(*ID, S.extract_choice_web(F.col("model_response"), ["a", "b", "c"]).alias("choice")))
SET_SQL = r"list_sort(CASE WHEN len(regexp_extract_all({0}, '\(([a-d])\)', 1)) > 0 THEN list_distinct(regexp_extract_all({0}, '\(([a-d])\)', 1)) ELSE list_distinct(regexp_extract_all({0}, '\b([a-d])\b', 1)) END)"
query(
    "scr_03_option_set",
    f"WITH r AS (SELECT {IDS}, c, lower(model_response) AS whole, lower(regexp_replace(list_extract(string_split(trim(model_response), '<final_answer>'), -1), '</final_answer>$', '')) AS tagged FROM {{responses}}) SELECT {IDS}, {SET_SQL.format('tagged')} = [c] OR {SET_SQL.format('whole')} = [c] AS correct FROM r",
)(lambda t: t.responses.select(*ID, S.score_option_set(F.col("model_response"), F.concat(F.lit("("), F.upper("c"), F.lit(")"))).alias("correct")))


@query(
    "scr_04_decode",
    f"WITH d AS (SELECT *, CASE {CHOICE_SQL} WHEN 'A' THEN 'not_remember' WHEN 'B' THEN 'remember_correct' WHEN 'C' THEN 'distractor_irrelevant' ELSE '' END AS decoded, CASE WHEN turn_role = 'key' AND world <> 'baseline' THEN 'not_remember' ELSE 'remember_correct' END AS expected FROM (SELECT *, upper(trim(model_response)) AS u FROM {{responses}})) SELECT {IDS}, decoded, expected, decoded = expected AS is_expected FROM d",
)
def scr_04(t):
    types = F.create_map(*[F.lit(x) for x in ("A", S.REFUSED, "B", S.RECALLED, "C", S.DISTRACTED)])
    decoded = S.decode(S.extract_choice(F.col("model_response"), ["a", "b", "c"]), types)
    out = t.responses.select(*ID, decoded.alias("decoded"), S.expected_type(F.col("world"), F.col("turn_role")).alias("expected"))
    return out.withColumn("is_expected", F.col("decoded") == F.col("expected"))


query("scr_05_stage_flags", f"SELECT {IDS}, {FLAGS_SQL} FROM {{cases}}")(lambda t: t.cases.select(*ID, *[v.alias(k) for k, v in S.stage_flags(facts()).items()]))
query("scr_06_cascade_bucket", f"SELECT {IDS}, {BUCKET_SQL} AS bucket FROM (SELECT *, {FLAGS_SQL} FROM {{cases}})")(lambda t: t.cases.select(*ID, S.cascade_bucket(S.stage_flags(facts()), F.col(P)).alias("bucket")))
query("scr_07_mechanism", f"SELECT {IDS}, {MECH_SQL} AS mechanism, CASE WHEN NOT in_store THEN 'TARGET_NEVER_STORED' WHEN NOT retrieved THEN 'TARGET_STORED_NOT_RETRIEVED' ELSE 'TARGET_RETRIEVED_LLM_REFUSED' END AS stage_1_mechanism FROM {{cases}}")(
    lambda t: t.cases.select(*ID, S.mechanism(facts()).alias("mechanism"), S.mechanism_stage_1(facts()).alias("stage_1_mechanism"))
)
PAIR_SQL = "CASE WHEN b AND w THEN 'NS_RECALLED_ANYWAY' WHEN b THEN 'NS_SUPPRESSED' WHEN w THEN 'NS_NEW_RECALL' ELSE 'NS_BOTH_FAILED' END"
TWIN = "SELECT i.conv_id, i.turn, i.world, i.system_id, i.turn_role, i.qa_family, i.predicted_answer_type, b.predicted_answer_type AS base_answer FROM {eval_items} i LEFT JOIN {eval_items} b ON b.world = 'baseline' AND b.conv_id = i.conv_id AND b.turn = i.turn AND b.system_id = i.system_id AND b.qa_family = i.qa_family WHERE i.world <> 'baseline'"


def twins(t):
    from loomwright.operators.matching import twin_join

    return twin_join(t.eval_items, ["conv_id", "turn", "system_id", "qa_family"], ["world_id"])


query("scr_08_pair_class", f"SELECT {IDS}, {PAIR_SQL} AS class FROM (SELECT *, base_answer = 'remember_correct' AS b, predicted_answer_type = 'remember_correct' AS w FROM ({TWIN})) WHERE world = 'no_store' AND turn_role = 'key'")(
    lambda t: twins(t).where("world = 'no_store' AND turn_role = 'key'").select(*ID, S.pair_class(F.col("base_answer"), F.col(P)).alias("class"))
)
query("scr_09_outcome_leaf", f"SELECT {IDS}, {LEAF_SQL} AS leaf FROM {{cases}} WHERE world = 'forget'")(lambda t: t.cases.where("world = 'forget'").select(*ID, S.outcome_leaf(facts()).alias("leaf")))


@query(
    "scr_10_store_action",
    """WITH d AS (SELECT user_id, min(seq) AS at FROM {store_log} WHERE action = 'NONE' AND mem_id = 3 GROUP BY ALL),
b AS (SELECT d.user_id, d.at, min(l.seq) AS stop FROM d LEFT JOIN {store_log} l ON l.user_id = d.user_id AND l.seq > d.at AND l.action = 'NONE' GROUP BY ALL),
k AS (SELECT b.user_id, b.at, count(*) FILTER (l.action IN ('UPDATE', 'DELETE')) AS changed, count(*) FILTER (l.action = 'ADD') AS added FROM b LEFT JOIN {store_log} l ON l.user_id = b.user_id AND l.seq > b.at AND (b.stop IS NULL OR l.seq < b.stop) GROUP BY ALL),
u AS (SELECT user_id, count(*) FILTER (action = 'ADD') AS facts FROM {store_log} GROUP BY ALL)
SELECT u.user_id, CASE WHEN facts = 0 THEN 'NO_FACT' WHEN k.at IS NULL THEN 'NO_DIRECTIVE' WHEN changed > 0 THEN 'UPDATE_DELETE' WHEN added > 0 THEN 'ADD_ONLY' ELSE 'NOTHING' END AS class FROM u LEFT JOIN k ON u.user_id = k.user_id""",
)
def scr_10(t):
    from loomwright.operators.matching import store_action

    return store_action(t.store_log, "user_id", "seq", (F.col("action") == "NONE") & (F.col("mem_id") == 3), F.col("action") == "NONE")


query(
    "scr_11_questions",
    f"""SELECT {IDS}, directive_intent OR directive_text AS q1_directive, CASE WHEN NOT (directive_intent OR directive_text) THEN 'n/a' WHEN kind <> 0 THEN 'unknown' WHEN acted_on THEN 'update_delete' WHEN directive_text THEN 'add_only' ELSE 'nothing' END AS q2_action,
  CASE WHEN retrieved THEN 'retrieved' WHEN signal THEN 'absent_with_signal' ELSE 'absent_no_signal' END AS q3_retrieval, predicted_answer_type = 'not_remember' AS q4_refused, in_store AS target_stored, NOT retrieved OR signal AS q3_fit FROM {{cases}}""",
)(lambda t: t.cases.select(*ID, *[v.alias(k) for k, v in (S.no_store_questions(facts()) | S.forget_questions(facts())).items()]))
query("scr_12_control_class", f"SELECT {IDS}, {CONTROL_SQL} AS class FROM {{cases}}")(lambda t: t.cases.select(*ID, S.control_class(facts()).alias("class")))
query("scr_13_failure_class", f"SELECT {IDS}, {FAIL_SQL} AS class FROM {{cases}}")(lambda t: t.cases.select(*ID, S.failure_class(facts()).alias("class")))

for name, cls, sql in (
    ("bucket", lambda: S.cascade_bucket(S.stage_flags(facts()), F.col(P)), BUCKET_SQL),
    ("leaf", lambda: S.outcome_leaf(facts()), LEAF_SQL),
    ("mechanism", lambda: S.mechanism(facts()), MECH_SQL),
    ("control", lambda: S.control_class(facts()), CONTROL_SQL),
):
    query(f"agg_19_class_counts_{name}", f"SELECT system_id, class, count(*) AS n FROM (SELECT *, {sql} AS class FROM (SELECT *, {FLAGS_SQL} FROM {{cases}}) WHERE turn_role = 'key') GROUP BY ALL")(
        lambda t, cls=cls: M.class_counts(t.cases.where("turn_role = 'key'"), cls(), ["system_id"])
    )
query(
    "agg_20_class_crosstab",
    f"SELECT world, class, count(*) FILTER (predicted_answer_type = 'not_remember') AS not_remember, count(*) FILTER (predicted_answer_type = 'remember_correct') AS remember_correct, count(*) FILTER (predicted_answer_type = 'distractor_irrelevant') AS other FROM (SELECT *, {CONTROL_SQL} AS class FROM {{cases}}) GROUP BY ALL",
)(lambda t: M.class_crosstab(t.cases, S.control_class(facts()), ["world"]))
query(
    "agg_21_conditional_classes",
    f"""WITH b AS (SELECT DISTINCT conv_id, turn, system_id FROM {{eval_items}} WHERE world = 'baseline' AND predicted_answer_type = 'remember_correct')
SELECT c.system_id, CASE WHEN retrieved THEN 'retrieved' WHEN signal THEN 'absent_with_signal' ELSE 'absent_no_signal' END AS class, count(*) AS n FROM {{cases}} c JOIN b ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.system_id = c.system_id WHERE world = 'forget' GROUP BY ALL""",
)(
    lambda t: M.class_counts(
        t.cases.where("world = 'forget'").join(t.eval_items.where(f"world = 'baseline' AND {P} = 'remember_correct'").select("conv_id", "turn", "system_id"), ["conv_id", "turn", "system_id"], "left_semi"),
        S.forget_questions(facts())["q3_retrieval"], ["system_id"],
    )
)
query(
    "agg_22_baseline_absent",
    f"SELECT system_id, count(*) AS absent, count(*) FILTER (base_answer IS DISTINCT FROM 'remember_correct') AS absent_in_baseline FROM ({TWIN}) WHERE predicted_answer_type <> 'remember_correct' GROUP BY ALL",
)(lambda t: twins(t).where(f"{P} <> 'remember_correct'").groupBy("system_id").agg(F.count("*").alias("absent"), F.count_if(~S.is_("base_answer", S.RECALLED)).alias("absent_in_baseline")))
FAILS = ["ANSWER_FAIL", "RETRIEVE_FAIL", "EXTRACT_WRONG", "NOT_EXTRACTED", "WRITE_RETRIEVE_UNCLEAR", "API_DISTRACTOR", "API_NOT_REMEMBER"]
query(
    "agg_23_error_cells",
    f"SELECT system_id, world, qa_family, turn_role, count(*) AS total, count(*) FILTER (class IS NULL) AS correct, {', '.join(f'''count(*) FILTER (class = '{k}') AS {k.lower()}''' for k in FAILS)}, count(class) AS failures FROM (SELECT *, {FAIL_SQL} AS class FROM {{cases}}) GROUP BY ALL",
)(lambda t: M.error_cells(t.cases, S.failure_class(facts()), FAILS, ["system_id", "world", "qa_family", "turn_role"]))
query("agg_24_key_slot_errors", f"SELECT system_id, world, {FAIL_SQL} AS class, count(*) AS n FROM {{cases}} WHERE turn_role = 'key' AND qa_family = 'slot' AND predicted_answer_type <> 'remember_correct' GROUP BY ALL")(
    lambda t: M.class_counts(t.cases.where(f"turn_role = 'key' AND qa_family = 'slot' AND {P} <> 'remember_correct'"), S.failure_class(facts()), ["system_id", "world"])
)
KINDS = ["ADD", "UPDATE", "DELETE", "NONE"]
query("agg_25_store_events", 'SELECT user_id, ' + ", ".join(f"""count(*) FILTER (action = '{k}') AS "{k}\"""" for k in KINDS) + " FROM {store_log} GROUP BY ALL")(lambda t: M.event_counts(t.store_log, "user_id", KINDS))
query(
    "agg_26_token_usage",
    "SELECT CAST(l_suppkey % 5 AS INT) AS system, l_returnflag AS bucket, count(*) AS calls, sum(CAST(l_quantity AS BIGINT))::BIGINT AS prompt_tokens, sum(CAST(l_linenumber AS BIGINT))::BIGINT AS completion_tokens, sum(CAST(l_quantity AS BIGINT) + l_linenumber)::BIGINT AS total_tokens, count(*) FILTER (l_linestatus = 'F') AS failed FROM lineitem GROUP BY ROLLUP (CAST(l_suppkey % 5 AS INT), l_returnflag)",
)(
    lambda t: M.token_usage(
        t.lineitem.select((F.col("l_suppkey") % 5).cast("int").alias("system"), F.col("l_returnflag").alias("bucket"), F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens"), (F.col("l_linestatus") == "F").alias("failed")),
        "system", "bucket",
    )
)
query("agg_27_usage_delta", "SELECT user_id, CASE WHEN count(*) > 1 THEN round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) END AS delta FROM events GROUP BY ALL")(lambda t: M.usage_delta(t.events, "user_id", "value", ["ts", "event_id"]))
query(
    "agg_28_corpus_stats",
    """WITH w AS (SELECT conv_id, CAST(floor(turn / 8) AS INT) AS stage, role, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM conversations),
p AS (SELECT conv_id, stage, sum(n)::BIGINT AS words, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM w GROUP BY ALL)
SELECT stage, count(*) AS conversations, min(words) AS min_words, max(words) AS max_words, avg(words) AS mean_words, sum(u)::BIGINT AS user_turns, sum(a)::BIGINT AS assistant_turns FROM p GROUP BY ALL""",
)(
    lambda t: M.corpus_stats(t.conversations.select("conv_id", "role", F.floor(F.col("turn") / 8).cast("int").alias("stage"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words")))
)
query("agg_29_timing_profile", "SELECT event_type, round(greatest(avg(value), 1.0::DOUBLE), 3) AS mean, round(coalesce(stddev_samp(value), 0.25::DOUBLE), 3) AS std, count(value) AS n FROM events GROUP BY ALL")(
    lambda t: M.timing_profile(t.events, "event_type", "value", 1.0, 0.25)
)
query(
    "agg_33_run_summary",
    f"SELECT qa_family, count(*) AS total, count(*) FILTER (e) AS errors, count(*) FILTER (NOT e) AS answered, round(100.0::DOUBLE * avg(CASE WHEN NOT e THEN ({P} = 'remember_correct')::INT END), 6) AS percent_correct, "
    + ", ".join(f"count(*) FILTER (NOT e AND {P} = '{k}') AS {k}" for k in (S.RECALLED, S.REFUSED, S.DISTRACTED))
    + " FROM (SELECT *, l_partkey % 19 = 0 AS e FROM {eval_big}) GROUP BY ROLLUP (qa_family)",
)(lambda t: M.run_summary(t.eval_big, F.col("l_partkey") % 19 == 0))
query(
    "agg_34_suppression_cost",
    f"WITH p AS (SELECT system_id, world, qa_family, {TNR} AS r, {TPR} AS c FROM {{eval_big}} GROUP BY ALL), m AS (SELECT system_id, world, avg(r) AS r, avg(c) AS c FROM p GROUP BY ALL) SELECT m.system_id, m.world, round(m.r, 9) AS key_suppression, round(b.c - m.c, 9) AS probe_cost FROM m LEFT JOIN m b ON b.system_id = m.system_id AND b.world = 'baseline' WHERE m.world <> 'baseline'",
)(lambda t: M.suppression_cost(t.eval_big))
query(
    "agg_36_accuracy_by_distance",
    f"SELECT qa_family, least(floor(l_partkey / 300.0)::INT, 4) AS bucket, count(*) AS n, {RC} AS accuracy FROM {{eval_big}} GROUP BY ALL",
)(lambda t: M.accuracy_by(t.eval_big.withColumn("correct", F.col(P) == S.RECALLED), ["qa_family"], "l_partkey", 300.0, 5))
