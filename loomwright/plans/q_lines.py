"""Queries of projections, filters and line work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import lines as L
from loomwright.plans.catalog import query

NOTE = r"^Side_Note:\s*\[(.*)\]\s+(\d{2}/\d{2}/\d{4}(?:-I\d{2})?)\s*$"
WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT"
NA = r"lower(regexp_replace(trim({0}), '\s+', ' ', 'g'))"


def words(c="text"):
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


query("prj_01_role_line", "SELECT conv_id, pos, CASE WHEN instr(line, ': ') > 0 THEN replace(lower(trim(left(line, instr(line, ': ') - 1))), '_', ' ') ELSE 'unknown' END AS role, trim(CASE WHEN instr(line, ': ') > 0 THEN substr(line, instr(line, ': ') + 2) ELSE line END) AS content FROM {lines}")(
    lambda t: t.lines.select("conv_id", "pos", X.parse_role_line(F.col("line")).alias("m")).select("conv_id", "pos", "m.role", "m.content")
)
query("prj_02_messages", "SELECT conv_id, pos, CASE WHEN starts_with(l, 'Assistant:') THEN 'assistant' ELSE 'user' END AS role, CASE WHEN starts_with(l, 'User:') THEN trim(substr(l, 6)) WHEN starts_with(l, 'Assistant:') THEN trim(substr(l, 11)) ELSE l END AS content FROM (SELECT *, trim(line) AS l FROM {lines}) WHERE length(l) > 0")(
    lambda t: t.lines.select("conv_id", "pos", X.to_message(F.col("line")).alias("m")).where("m IS NOT NULL").select("conv_id", "pos", "m.role", "m.content")
)
query("prj_03_side_note", f"SELECT conv_id, pos, regexp_extract(line, '{NOTE}', 1) AS event_text, regexp_extract(line, '{NOTE}', 2) AS ts_key, try_strptime(left(regexp_extract(line, '{NOTE}', 2), 10), '%m/%d/%Y')::DATE AS ts_date FROM {{lines}} WHERE regexp_matches(line, '{NOTE}')")(
    lambda t: t.lines.select("conv_id", "pos", X.parse_side_note(F.col("line")).alias("n")).where("n IS NOT NULL").select("conv_id", "pos", "n.*")
)
STAGE = "CASE event_id % 4 WHEN 0 THEN concat('Conversation Stage ', stage + 1) WHEN 1 THEN 'Conversation Early Stage' WHEN 2 THEN 'all_stages' ELSE '' END"
query("prj_04_stage_tag", f"SELECT event_id, CASE WHEN length(n) > 0 THEN 'stage_' || lpad(n, 2, '0') WHEN s = 'all_stages' THEN s ELSE coalesce(nullif(replace(lower(trim(replace(replace(s, 'Conversation ', ''), ' Stage', ''))), ' ', '_'), ''), 'late') END AS tag, 'Conversation Stage ' || lpad((stage + 1)::VARCHAR, 2, '0') AS back FROM (SELECT *, regexp_extract(s, '^Conversation Stage (\\d+)$', 1) AS n FROM (SELECT *, {STAGE} AS s FROM {{history}}))")(
    lambda t: t.history.select("event_id", X.stage_tag(F.expr(STAGE)).alias("tag"), X.stage_id_to_name(F.concat(F.lit("stage_"), F.lpad((F.col("stage") + 1).cast("string"), 2, "0"))).alias("back"))
)
query("prj_05_flatten_stages", "SELECT conv_id, s AS stage, o::INT AS stage_order, (u - 1)::INT AS pos, list_extract(l, u) AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS u FROM (SELECT conv_id, 'early' AS s, 0 AS o, list(text ORDER BY turn) FILTER (turn < 4) AS l FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 'late', 1, list(text ORDER BY turn) FILTER (turn >= 4) FROM conversations GROUP BY conv_id) WHERE l IS NOT NULL)")(
    lambda t: L.flatten_stages(
        t.conversations.groupBy("conv_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda s: s["text"]).alias(n) for n, c in (("early", F.col("turn") < 4), ("late", F.col("turn") >= 4))]),
        ["early", "late"],
    )
)
query("prj_06_path_meta", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/(\d+)[^/]*/?$', 1) AS num FROM pages")(
    lambda t: t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("lang"), F.regexp_extract("url", r"/(\d+)[^/]*/?$", 1).alias("num"))
)
P6 = "concat('data/', source, '/x_persona', doc_id % 7, '_sample', doc_id % 3, '.json')"
query("prj_06b_result_file_meta", "SELECT doc_id, source AS topic, (doc_id % 7)::INT AS persona, (doc_id % 3)::INT AS sample FROM documents")(lambda t: t.documents.select("doc_id", X.path_meta(F.expr(P6)).alias("m")).select("doc_id", "m.*"))
query("prj_07_result_path", r"SELECT doc_id, concat(source, '/forget/', 'early.', regexp_replace(lang || ' v', '[^0-9A-Za-z]+', '_', 'g'), '.', regexp_replace('m-' || lang, '[^0-9A-Za-z]+', '_', 'g'), '.json') AS path FROM documents")(
    lambda t: t.documents.select("doc_id", X.result_path(F.col("source"), F.lit("forget"), F.lit("Conversation Early Stage"), F.concat("lang", F.lit(" v")), F.concat(F.lit("m-"), "lang")).alias("path"))
)
query("prj_08_conversation_table", "SELECT conv_id, count(*) AS n_lines, count(*) FILTER (role = 'user') AS n_user, arg_min(text, turn) AS first_line, max(turn) AS last_turn FROM conversations GROUP BY conv_id")(
    lambda t: t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select("conv_id", F.size("m").cast("long").alias("n_lines"), F.size(F.filter("m", lambda x: x["role"] == "user")).cast("long").alias("n_user"), F.col("m")[0]["text"].alias("first_line"), F.element_at("m", -1)["turn"].alias("last_turn"))
)
def choices():
    return F.create_map(F.lit("A"), F.concat(F.lit("no "), "conv_id"), F.lit("B"), F.concat(F.lit("yes "), "turn"), F.lit("C"), F.lit("other"))


query("prj_09_whole_recall", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS item_index, text AS question, concat('no ', conv_id) AS choice_a, concat('yes ', turn) AS choice_b, 'other' AS choice_c FROM conversations WHERE role = 'user'")(
    lambda t: t.user_turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items")).select("conv_id", F.posexplode("items").alias("item_index", "i")).select("conv_id", F.col("i.turn").alias("turn"), "item_index", F.col("i.text").alias("question")).withColumn("choices", choices())
    .select("conv_id", "item_index", "question", *[F.try_element_at("choices", F.lit(k)).alias(f"choice_{k.lower()}") for k in "ABC"])
)
query("prj_10_slot_recall", "SELECT conv_id, user_idx AS parent_item_index, (k - 1)::INT AS item_index, list_extract(string_split(text, ' '), k) AS sensitive_value FROM (SELECT *, unnest(range(1, least(len(string_split(text, ' ')), 3) + 1)) AS k FROM {user_turns})")(
    lambda t: t.user_turns.select("conv_id", F.col("user_idx").alias("parent_item_index"), F.posexplode(F.slice(F.split("text", " "), 1, 3)).alias("item_index", "sensitive_value"))
)
query("prj_11_strip_notes", r"SELECT conv_id, pos, CASE WHEN starts_with(line, 'Assistant') THEN 'assistant' ELSE 'user' END AS role, trim(regexp_replace(line, '\(?\d{2}/\d{2}/\d{4}\)?', '', 'g')) AS content FROM {lines} WHERE NOT starts_with(line, 'Side_Note')")(
    lambda t: t.lines.where(~F.col("line").startswith("Side_Note")).select("conv_id", "pos", F.when(F.col("line").startswith("Assistant"), "assistant").otherwise("user").alias("role"), F.trim(F.regexp_replace("line", r"\(?\d{2}/\d{2}/\d{4}\)?", "")).alias("content"))
)
query(
    "prj_12_fold_side_notes",
    f"""WITH d AS (SELECT *, nullif(regexp_extract(line, '{NOTE}', 2), '') AS ts FROM {{lines}}),
g AS (SELECT *, sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY stage, pos) AS g FROM d),
l AS (SELECT conv_id, g, arg_max(ts, pos) FILTER (ts IS NOT NULL) AS last FROM g GROUP BY ALL)
SELECT g.conv_id, g.stage, g.pos, g.line || coalesce(' (' || l.last || ')', '') AS line FROM g JOIN l ON l.conv_id = g.conv_id AND l.g = g.g WHERE g.ts IS NULL AND g.g > 0""",
)(lambda t: L.fold_side_notes(t.lines))
query(
    "prj_13_merge_roles",
    """WITH d AS (SELECT *, coalesce(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM conversations),
o AS (SELECT conv_id, g, max(turn) AS turn, string_agg(CASE WHEN role = 'system' THEN '[System]: ' || text ELSE text END, chr(10) ORDER BY turn) AS text, coalesce(max(CASE WHEN role <> 'system' THEN role END), 'user') AS role FROM d GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS f FROM o),
i AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM f)
SELECT conv_id, min(turn) AS first_turn, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, i, role""",
)(lambda t: L.merge_roles(t.conversations))
query("prj_14_loose_json", r"""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")(
    lambda t: t.events.select("event_id", X.parse_loose_json(F.concat(F.lit("```json\n"), F.translate("props", '"', "'"), F.lit("\n```")), "k BIGINT")["k"].alias("k"))
)
PII_TEXT = "concat('Name: n\nEmail: u', doc_id, '@x.org\nPhone: +1 ', doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('\nID: ', doc_id) END, '\nAddress: ', source, ' street')"
query("prj_15_pii_block", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN concat('u', doc_id, '@x.org') END AS email, CASE WHEN doc_id % 3 <> 0 THEN concat('+1 ', doc_id) END AS phone, CASE WHEN doc_id % 3 <> 0 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 3 <> 0 THEN source || ' street' END AS address FROM documents")(
    lambda t: t.documents.select("doc_id", X.extract_pii(F.expr(PII_TEXT.replace("\n", "\\n"))).alias("p")).select("doc_id", "p.email", "p.phone", "p.id", "p.address")
)
query("prj_16_clean_prose", "SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(text, '<newline>', ''), '`', ''), '''''', ''), ' ,', ','), ' .', '.'), ' ?', '?'), ' !', '!'), ' ''', '''')) AS h FROM documents")(
    lambda t: t.documents.select("doc_id", F.md5(X.clean_prose(F.col("text"))).alias("h"))
)
query("prj_17_normal_forms", f"SELECT conv_id, turn, {NA.format('text')} AS a, {NA.format(chr(39) + 'x_' + chr(39) + ' || replace(text, chr(95), chr(32))').replace(chr(39) + 'x_' + chr(39), chr(39) + 'x ' + chr(39))} AS b FROM conversations")(
    lambda t: t.conversations.select("conv_id", "turn", X.norm_a(F.col("text")).alias("a"), X.norm_b(F.concat(F.lit("x_"), "text")).alias("b"))
)
query("prj_17c_folded_form")(lambda t: t.conversations.select("conv_id", "turn", X.norm_c(F.col("text")).alias("c")))
GENERAL = ", ".join(f"'{w}'" for w in X.GENERAL_WORDS)
STOPS = ", ".join(f"'{w}'" for w in X.STOP_TOKENS)
CT = rf"list_filter(list_transform(regexp_extract_all({{0}}, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda x: regexp_replace(lower(x), '''+$', '')), lambda x: length(x) >= 3 AND x NOT IN ({GENERAL}))"
AT = rf"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[a-z][a-z0-9@._/-]{{{{3,}}}}')), lambda x: x NOT IN ({STOPS}))"
query("prj_18_tokens", f"SELECT conv_id, turn, array_to_string({CT.format('text')}, ' ') AS content, array_to_string(list_sort({AT.format('text').replace('{{', '{').replace('}}', '}')}), ' ') AS anchors FROM conversations")(
    lambda t: t.conversations.select("conv_id", "turn", F.array_join(X.content_tokens(F.col("text")), " ").alias("content"), F.array_join(F.array_sort(X.anchor_tokens(F.col("text"))), " ").alias("anchors"))
)
DC = "list_filter(string_split_regex(lower({0}), '[^a-zA-Z0-9@._:+/-]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '[0-9]'))"
query("prj_19_digit_chunks", f"SELECT doc_id, array_to_string({DC.format('text')}, ' ') AS chunks FROM documents")(lambda t: t.documents.select("doc_id", F.array_join(X.digit_chunks(F.col("text")), " ").alias("chunks")))
query("prj_20_reference_phrase", r"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'the ' || lower(left(trim(text), 1)) || substr(trim(text), 2) ELSE coalesce(nullif(lower(left(b, 1)) || substr(b, 2), ''), 'what I shared earlier') END AS phrase FROM (SELECT *, regexp_replace(regexp_replace(trim('Can you help me to ' || text), '(?i)^(please )?((can|could) you )?(help me (to )?|i (want|need|would like) (to )?|get help (with )?)', ''), '[.!?]+$', '') AS b FROM conversations)")(
    lambda t: t.conversations.select("conv_id", "turn", X.reference_phrase(F.when(F.col("turn") % 2 == 0, F.col("text")), F.concat(F.lit("Can you help me to "), "text")).alias("phrase"))
)
query("prj_20b_join_phrases", "SELECT conv_id, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] END AS phrases FROM (SELECT conv_id, list_slice(list(DISTINCT text ORDER BY text), 1, 3) AS p FROM conversations GROUP BY conv_id)")(
    lambda t: t.conversations.groupBy("conv_id").agg(X.join_phrases(F.array_sort(F.collect_set("text"))).alias("phrases"))
)
query("prj_21_accept_phrase", r"SELECT conv_id, turn, CASE WHEN length(trim(text)) > 0 AND len(string_split_regex(trim(text), '\s+')) <= 18 AND NOT regexp_matches(text, '(?i)forget|remember|memory|as an ai') AND NOT (starts_with(lower(trim(text)), 'that ') AND len(string_split_regex(trim(text), '\s+')) < 4) THEN trim(text) ELSE role END AS phrase FROM conversations")(
    lambda t: t.conversations.select("conv_id", "turn", X.accept_phrase(F.col("text"), F.col("role")).alias("phrase"))
)
query("prj_22_truncate_mid", "SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(left(text, 39)) || '…' || ltrim(right(text, 39)) ELSE text END AS short FROM documents")(lambda t: t.documents.select("doc_id", X.truncate_mid(F.col("text"), 80).alias("short")))
query("prj_23_stringify_retrieved", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ctx ' || event_id WHEN 1 THEN 'm' || event_id || chr(10) || 'n' WHEN 2 THEN 'a' || chr(10) || event_id ELSE 'plain ' || event_id END AS text FROM events")(
    lambda t: t.events.select("event_id", X.stringify_retrieved(F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"context": "ctx ', event_id, '"}') WHEN 1 THEN concat('{"results": [{"memory": "m', event_id, '"}, {"content": "n"}]}') WHEN 2 THEN concat('["a", "', event_id, '"]') ELSE concat('"plain ', event_id, '"') END""")).alias("text"))
)


@query("prj_24_store_entries", "SELECT user_id, event_id AS entry_id, CASE event_id % 3 WHEN 0 THEN 'item ' || event_type WHEN 1 THEN 'note ' || event_type ELSE event_type || ' x' END AS text FROM events WHERE event_id % 4 <> 3")
def prj_24(t):
    """Each back end's own layout, as JSON text, to one table; an unknown back end (kind 3) gives no rows."""
    e = t.events.withColumn("kind", F.col("event_id") % 4).withColumn(
        "raw", F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"memory": "item ', event_type, '"}') WHEN 1 THEN concat('{"content": "note ', event_type, '"}') ELSE concat('{"user_input": "', event_type, '", "agent_response": "x"}') END""")
    )
    v = F.try_parse_json("raw")
    get = lambda p: F.try_variant_get(v, p, "string")
    return e.where("kind <> 3").select("user_id", F.col("event_id").alias("entry_id"), F.coalesce(get("$.memory"), get("$.content"), F.concat_ws(" ", get("$.user_input"), get("$.agent_response"))).alias("text"))


query("prj_25_prompts", "SELECT conv_id, turn, text || chr(10) || chr(10) || '(A) no ' || conv_id || chr(10) || '(B) yes ' || turn || chr(10) || '(C) other' || chr(10) || chr(10) || 'Answer with <final_answer>(letter)</final_answer>.' AS prompt, 'Memories:' || chr(10) || CASE WHEN turn % 2 = 0 THEN '- ' || role ELSE '(none)' END || chr(10) || chr(10) || text || chr(10) || chr(10) || '(A) no ' || conv_id || chr(10) || '(B) yes ' || turn || chr(10) || '(C) other' || chr(10) || chr(10) || 'Answer with <final_answer>(letter)</final_answer>.' AS with_memories FROM conversations")(
    lambda t: t.conversations.select("conv_id", "turn", X.build_prompt(F.col("text"), choices()).alias("prompt"), X.build_prompt(F.col("text"), choices(), F.when(F.col("turn") % 2 == 0, F.array("role")).otherwise(F.array().cast("array<string>"))).alias("with_memories"))
)


@query("prj_26_system_label", "SELECT l_orderkey, l_linenumber, CASE WHEN system_id < 4 THEN 'model-' || system_id || ' (high)' ELSE 'model-' || (system_id % 4) || ' + store' || (system_id // 4) END AS label FROM {eval_big}")
def prj_26(t):
    """Labels come from a dimension of one row per system, sent to every task."""
    dim = t.eval_big.select("system_id").distinct().select("system_id", F.when(F.col("system_id") < 4, F.concat(F.lit("model-"), "system_id", F.lit(" (high)"))).otherwise(F.concat(F.lit("model-"), F.col("system_id") % 4, F.lit(" + store"), F.floor(F.col("system_id") / 4))).alias("label"))
    return t.eval_big.join(dim, "system_id").select("l_orderkey", "l_linenumber", "label")


TYPES = list(X.TYPE_NAMES)
TYPE_OF = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(TYPES)) + " ELSE 'unknown' END"
query("prj_27_rename_type", "SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(X.TYPE_NAMES.values())) + " END AS type FROM events")(lambda t: t.events.select("event_id", X.rename_type(F.expr(TYPE_OF)).alias("type")))
query("prj_28_transcript", "SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")(lambda t: L.transcript(t.conversations))
query("prj_29_flatten_values", "SELECT user_id, array_to_string(list(event_type ORDER BY event_type), ' ') AS vals FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'view') GROUP BY user_id")(
    lambda t: t.events.groupBy("user_id", "event_type").agg(F.first(F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))).alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.array("v")))).alias("m")).select("user_id", F.array_join(X.flatten_values(F.col("m")), " ").alias("vals"))
    .where("vals <> ''")
)
query("prj_30_provider_messages", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, text FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0")(
    lambda t: t.conversations.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0)).select("conv_id", "turn", F.when(F.col("role") == "assistant", "model").otherwise("user").alias("role"), "text")
)

# Filters ------------------------------------------------------------------------------------------------------------
query("flt_01_valid_dates", "SELECT user_id, count(*) AS n_valid FROM (SELECT DISTINCT user_id, strftime(ts, '%m/%d/%Y') AS d, event_id % 5 = 0 AS bad FROM events) WHERE NOT bad GROUP BY user_id")(
    lambda t: t.events.select("user_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.date_format("ts", "MM/dd/yyyy"))).otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("k")).distinct()
    .groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.lit(1)))).alias("m")).select("user_id", F.size(F.map_filter("m", lambda k, v: k.rlike(r"^\d{2}/\d{2}/\d{4}$"))).cast("long").alias("n_valid")).where("n_valid > 0")
)
query("flt_02_contains_expected", f"SELECT conv_id, turn, (length(n) >= 4 AND contains(h, n)) OR len(list_filter({DC.format('n')}, lambda x: contains(h, x))) > 0 AS found FROM (SELECT conv_id, turn, {NA.format('text')} AS h, {NA.format('nx')} AS n FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN substr(text, 5, 20) ELSE 'zq 12' || turn END AS nx FROM conversations)) WHERE length(h) > 0 AND length(n) > 0")(
    lambda t: t.conversations.select("conv_id", "turn", X.contains_expected(F.col("text"), F.expr("CASE WHEN turn % 3 = 0 THEN substr(text, 5, 20) ELSE concat('zq 12', turn) END")).alias("found"), F.length(X.norm_a(F.col("text"))).alias("n"), F.length(X.norm_a(F.expr("CASE WHEN turn % 3 = 0 THEN substr(text, 5, 20) ELSE 'zq' END"))).alias("m")).where("n > 0 AND m > 0").drop("n", "m")
)
SAY = "CASE conv_id % 4 WHEN 0 THEN concat('Please FORGET ', text) WHEN 1 THEN concat('User asked to clear it. ', text) WHEN 2 THEN concat('It is now superseded ', text) ELSE text END"
ALT = lambda ps: "(" + "|".join(p.replace("'", "''") for p in ps) + ")"
query("flt_03_directive_keywords", f"SELECT conv_id, turn, regexp_matches(lower(s), '{ALT(X.DIRECTIVE_PHRASES)}') AS surface, regexp_matches(lower(s), '{ALT(X.INTENT_PHRASES)}') AS intent FROM (SELECT *, {SAY} AS s FROM conversations)")(
    lambda t: t.conversations.select("conv_id", "turn", X.mentions(F.expr(SAY), X.DIRECTIVE_PHRASES).alias("surface"), X.mentions(F.expr(SAY), X.INTENT_PHRASES).alias("intent"))
)
query("flt_04_concrete_values", "SELECT doc_id, regexp_matches(lower(text), '@|[0-9]|street|avenue|road|suite|apartment|boulevard|drive|lane') AS concrete FROM documents")(lambda t: t.documents.select("doc_id", X.is_concrete(F.col("text")).alias("concrete")))
query("flt_05_sensitive_projection", "SELECT doc_id, CASE WHEN contains(lower(text), '+1') THEN '+1' ELSE '' END AS phone FROM documents")(
    lambda t: t.documents.select("doc_id", F.coalesce(F.array_join(F.try_element_at(X.project_sensitive(F.col("text"), F.create_map(F.lit("phone"), F.array(F.lit("+1"), F.lit("nowhere")), F.lit("name"), F.array(F.lit("the")))), F.lit("phone")), " "), F.lit("")).alias("phone"))
)
query("flt_06_question_filters", f"SELECT event_id, user_id FROM (SELECT *, {TYPE_OF} AS type FROM events) WHERE type NOT IN ('{TYPES[1]}', '{TYPES[3]}') AND user_id BETWEEN 5 AND 90")(
    lambda t: t.events.where(~F.expr(TYPE_OF).isin(TYPES[1], TYPES[3]) & F.col("user_id").between(5, 90)).select("event_id", "user_id")
)
query("flt_07_valid_question", "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0")(
    lambda t: t.conversations.withColumn("choices", F.when(F.col("turn") % 3 != 0, choices()).otherwise(F.create_map().cast("map<string,string>"))).where(F.size("choices") > 0).select("conv_id", "turn")
)
query(
    "flt_08_question_eligibility",
    f"WITH q AS (SELECT event_id, user_id, {TYPE_OF} AS type, (event_id * 37) % 11 AS h, value FROM events WHERE value > 1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY h, event_id) AS r FROM q) SELECT event_id FROM r WHERE r <= 2 AND (event_id * 7919) % 2 = 0",
)(
    lambda t: t.events.where("value > 1").withColumn("type", F.expr(TYPE_OF)).withColumn("r", F.row_number().over(Window.partitionBy("user_id", "type").orderBy((F.col("event_id") * 37) % 11, "event_id"))).where("r <= 2 AND (event_id * 7919) % 2 = 0").select("event_id")
)
query("flt_09_drop_blind", "SELECT conv_id, turn, world, system_id FROM {eval_items} i WHERE NOT EXISTS (SELECT 1 FROM {eval_items} b WHERE b.conv_id = i.conv_id AND b.turn = i.turn AND b.world = 'baseline' GROUP BY b.conv_id, b.turn HAVING count(*) FILTER (b.predicted_answer_type = 'remember_correct') >= 3)")(
    lambda t: t.eval_items.join(t.eval_items.where("world = 'baseline'").groupBy("conv_id", "turn").agg(F.count_if(F.col("predicted_answer_type") == "remember_correct").alias("ok")).where("ok >= 3"), ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "world", "system_id")
)
query("flt_10_completeness", "SELECT user_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'signup' END, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'purchase' END, CASE WHEN count(*) FILTER (stage = 3 AND value > 60) = 0 THEN 'late' END], lambda x: x IS NOT NULL), ',') AS missing FROM {history} GROUP BY user_id")(
    lambda t: t.history.groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "signup", 1)).alias("signup"), F.collect_list(F.when(F.col("event_type") == "purchase", 1)).alias("purchase"), F.collect_list(F.when((F.col("stage") == 3) & (F.col("value") > 60), 1)).alias("late"))
    .select("user_id", F.array_join(F.filter(F.array(*[F.when(F.size(c) == 0, F.lit(c)) for c in ("signup", "purchase", "late")]), lambda x: x.isNotNull()), ",").alias("missing"))
)
query(
    "flt_11_alignment",
    f"""WITH a AS (SELECT conv_id, regexp_extract(line, '{NOTE}', 2) AS ts, count(*) AS n FROM {{lines}} WHERE regexp_matches(line, '{NOTE}') GROUP BY ALL),
b AS (SELECT DISTINCT conv_id, lpad((turn % 12 + 1)::VARCHAR, 2, '0') || '/' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || '/2024' AS ts FROM conversations WHERE turn % 4 = 2 OR turn % 8 = 0)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.ts, b.ts) AS ts, CASE WHEN a.ts IS NULL THEN 'missing' WHEN b.ts IS NULL THEN 'invalid' WHEN a.n <> 1 THEN 'mismatched' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.ts = b.ts""",
)(
    lambda t: __import__("loomwright.operators.quality", fromlist=["x"]).alignment(
        t.lines.select("conv_id", X.parse_side_note(F.col("line"))["ts_key"].alias("ts")).where("ts IS NOT NULL"),
        t.conversations.where("turn % 4 = 2 OR turn % 8 = 0").select("conv_id", F.concat_ws("/", F.lpad((F.col("turn") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("2024")).alias("ts")).distinct(),
        "conv_id", "ts",
    )
)

# Windows ------------------------------------------------------------------------------------------------------------
query("win_01_blocks", f"SELECT conv_id, pos, sum(CASE WHEN regexp_matches(line, '{NOTE}') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY stage, pos)::BIGINT AS block FROM {{lines}}")(lambda t: L.blocks(t.lines).select("conv_id", "pos", "block"))
query(
    "win_02_pages",
    "WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role IN ('user', 'assistant')), g AS (SELECT *, sum(CASE WHEN role = 'user' OR prev IS NULL OR prev = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS page FROM p) SELECT conv_id, page, arg_min(text, turn) FILTER (role = 'user') AS user_text, arg_min(text, turn) FILTER (role = 'assistant') AS assistant_text FROM g GROUP BY ALL",
)(lambda t: L.page_pairs(t.conversations))
CODE = "CASE WHEN turn % 5 = 1 THEN '```' WHEN turn % 5 = 3 THEN '```py' WHEN role = 'user' THEN concat('User: ', text) ELSE text END"
query(
    "win_03_code_utterances",
    f"""WITH l AS (SELECT conv_id, turn, {CODE} AS line FROM conversations), f AS (SELECT *, starts_with(line, '```') AS fence FROM l),
b AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
u AS (SELECT *, sum(CASE WHEN NOT inside AND (fence OR regexp_matches(line, '^(User|Assistant):')) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS utterance FROM b)
SELECT conv_id, utterance, arg_min(line, turn) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY turn) AS text FROM u GROUP BY ALL""",
)(lambda t: L.code_utterances(t.conversations.select("conv_id", "turn", F.expr(CODE).alias("line")), "conv_id", "turn"))
query("win_04_user_index", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS user_index FROM conversations WHERE role = 'user'")(lambda t: L.user_positions(t.conversations).select("conv_id", "turn", "user_index"))
query(
    "win_05_turn_lookup",
    f"""WITH d AS (SELECT conv_id, stage, pos, nullif(regexp_extract(line, '{NOTE}', 2), '') AS note, CASE WHEN starts_with(line, 'Assistant:') THEN 'assistant' ELSE 'user' END AS role,
 CASE WHEN starts_with(line, 'User:') THEN trim(substr(line, 6)) WHEN starts_with(line, 'Assistant:') THEN trim(substr(line, 11)) ELSE trim(line) END AS content FROM {{lines}}),
f AS (SELECT *, last_value(note IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY stage, pos) AS ts_key FROM d),
u AS (SELECT conv_id, ts_key, min((stage, pos)) AS at, arg_min(content, (stage, pos)) AS user_turn FROM f WHERE note IS NULL AND role = 'user' AND ts_key IS NOT NULL GROUP BY ALL),
r AS (SELECT f.conv_id, f.ts_key, arg_min(f.content, (f.stage, f.pos)) AS reply FROM f JOIN u ON f.conv_id = u.conv_id AND f.ts_key = u.ts_key WHERE f.note IS NULL AND f.role = 'assistant' AND (f.stage, f.pos) > u.at GROUP BY ALL)
SELECT u.conv_id, u.ts_key, u.user_turn, r.reply FROM u LEFT JOIN r ON r.conv_id = u.conv_id AND r.ts_key = u.ts_key""",
)(lambda t: L.turn_lookup(t.lines))
query("win_06_latest_date", f"SELECT conv_id, max(try_strptime(nullif(left(regexp_extract(line, '{NOTE}', 2), 10), ''), '%m/%d/%Y')::DATE) AS last_date FROM {{lines}} GROUP BY conv_id")(lambda t: L.latest_date(t.lines))
query("win_07_latest_record", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")(
    lambda t: L.dedup_latest(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")
)
VALS = "SELECT user_id, event_id AS idx, (value * 100)::BIGINT % 40 AS v FROM events"


def vals(t):
    return t.events.select("user_id", F.col("event_id").alias("idx"), (F.round(F.col("value") * 100).cast("long") % 40).alias("v"))


query(
    "win_08_duplicate_values",
    f"WITH v AS ({VALS}), d AS (SELECT *, min(idx) OVER w AS lo, max(idx) OVER w AS hi FROM v WINDOW w AS (PARTITION BY user_id, v)) SELECT user_id, idx, coalesce(array_to_string(list_sort(list(v) FILTER (lo <> hi AND idx <> hi)), ','), '') AS recurs_later, coalesce(array_to_string(list_sort(list(v) FILTER (lo <> hi AND idx <> lo)), ','), '') AS seen_before FROM d GROUP BY ALL",
)(lambda t: L.annotate_dupes(vals(t), "user_id", "idx", "v").select("user_id", "idx", F.array_join(F.col("recurs_later").cast("array<string>"), ",").alias("recurs_later"), F.array_join(F.col("seen_before").cast("array<string>"), ",").alias("seen_before")))
query(
    "win_09_choose_keys",
    """WITH c AS (SELECT user_id, event_id AS idx, event_id % 4 AS conflicts, event_id % 3 = 0 AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conflicts, p DESC, idx) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM c),
k AS (SELECT *, CASE WHEN r <= n // 2 THEN 'key' ELSE 'probe' END AS role FROM r) SELECT user_id, idx, role, row_number() OVER (PARTITION BY user_id, role ORDER BY conflicts, CASE WHEN role = 'key' AND NOT p THEN 1 ELSE 0 END, idx)::INT AS rank FROM k""",
)(lambda t: L.choose_keys(t.events.select("user_id", F.col("event_id").alias("idx"), (F.col("event_id") % 4).alias("conflicts"), (F.col("event_id") % 3 == 0).alias("prefer_as_key")), "user_id", "idx").select("user_id", "idx", "role", "rank"))
query(
    "win_10_first_block_per_date",
    f"""WITH b AS (SELECT conv_id, stage, pos, nullif(regexp_extract(line, '{NOTE}', 2), '') AS ts, sum(CASE WHEN regexp_matches(line, '{NOTE}') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY stage, pos) AS block FROM (SELECT conv_id, stage, pos, regexp_replace(line, '\\] \\d\\d/', '] 01/') AS line FROM {{lines}})),
d AS (SELECT *, max(ts) OVER (PARTITION BY conv_id, block) AS bts FROM b), f AS (SELECT *, min(block) OVER (PARTITION BY conv_id, bts) AS fb FROM d) SELECT conv_id, pos FROM f WHERE bts IS NULL OR block = fb""",
)(lambda t: L.first_block_per_date(t.lines.withColumn("line", F.regexp_replace("line", r"\] \d\d/", "] 01/"))).select("conv_id", "pos"))
query(
    "win_11_distances",
    f"""WITH m AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(w) OVER (PARTITION BY conv_id) AS total FROM m),
q AS (SELECT conv_id, turn AS ask_turn, turn // 2 AS evidence_turn FROM conversations WHERE role = 'user')
SELECT q.conv_id, ask_turn, evidence_turn, ask_turn - evidence_turn AS turn_distance, (a.b - e.b)::BIGINT AS word_distance, e.total::BIGINT AS total FROM q JOIN c a ON a.conv_id = q.conv_id AND a.turn = ask_turn JOIN c e ON e.conv_id = q.conv_id AND e.turn = evidence_turn""",
)(
    lambda t: L.distances(t.conversations.select("conv_id", "turn", words().alias("n_words")), t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("ask_turn"), F.floor(F.col("turn") / 2).cast("long").alias("evidence_turn")))
    .select("conv_id", "ask_turn", "evidence_turn", "turn_distance", "word_distance", "total")
)
query("win_12_first_records", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")(
    lambda t: t.events.join(F.broadcast(t.spark.createDataFrame([("view",), ("click",)], "event_type string")), "event_type").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
)
INS = "SELECT conv_id, turn, 'user' AS role, concat('Please forget turn ', turn) AS text, 0 AS k FROM {user_turns} WHERE user_idx = 0 UNION ALL SELECT conv_id, turn, 'assistant', 'Understood.', 1 FROM {user_turns} WHERE user_idx = 0"


def inserts(t):
    u = t.user_turns.where("user_idx = 0")
    return u.select("conv_id", "turn", F.lit("user").alias("role"), F.concat(F.lit("Please forget turn "), "turn").alias("text"), F.lit(0).alias("k")).unionByName(u.select("conv_id", "turn", F.lit("assistant").alias("role"), F.lit("Understood.").alias("text"), F.lit(1).alias("k")))


PLACED = f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INT AS pos, role, text, inserted FROM (SELECT conv_id, turn, 0 AS k, role, text, false AS inserted FROM conversations UNION ALL SELECT conv_id, turn, k + 1, role, text, true FROM ({INS}))"
query("win_14_insertion", PLACED)(lambda t: L.insert_rows(t.conversations, inserts(t)))
query(
    "win_14b_insertion_gaps",
    f"WITH p AS ({PLACED}), l AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM p), k AS (SELECT conv_id, turn::INT AS key_pos FROM {{user_turns}} WHERE user_idx = 0) SELECT l.conv_id, pos, pos - key_pos AS gap_from_key, last - pos AS gap_to_end FROM l JOIN k ON l.conv_id = k.conv_id WHERE inserted AND role = 'user'",
)(lambda t: L.insertion_gaps(L.insert_rows(t.conversations, inserts(t)), t.user_turns.where("user_idx = 0").select("conv_id", F.col("turn").cast("int").alias("key_pos"))))
query("win_17_order_mapping", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS old_index, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1)::INT AS new_index FROM events")(
    lambda t: L.order_mapping(t.events, ["user_id"], ["event_id"], [F.col("value").desc(), "event_id"]).select("user_id", "event_id", "old_index", "new_index")
)
query(
    "win_18_fit_budget",
    f"""WITH r AS (SELECT lang, source, doc_id, {WORDS} AS w FROM documents), p AS (SELECT lang, source, sum(w) AS w, max(source = 'src3') AS chosen, min(doc_id % 13) AS o FROM r GROUP BY ALL),
d AS (SELECT *, sum(w) OVER (PARTITION BY lang) - coalesce(sum(CASE WHEN NOT chosen THEN w ELSE 0 END) OVER (PARTITION BY lang ORDER BY o, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p)
SELECT r.lang, r.source, count(*) AS n FROM r JOIN d ON d.lang = r.lang AND d.source = r.source WHERE chosen OR rest <= 40000 GROUP BY ALL""",
)(lambda t: L.fit_budget(t.documents.select("lang", "source", "doc_id", words().alias("w")), "lang", "source", "w", F.col("doc_id") % 13, F.col("source") == "src3", 40000).groupBy("lang", "source").agg(F.count("*").alias("n")))
query("win_20_bounded_samples", "SELECT user_id, event_type, event_id, sample::INT AS sample FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS sample FROM events) WHERE sample <= 2")(
    lambda t: L.bounded_samples(t.events, ["event_type", "user_id"], [F.col("value").desc(), "event_id"]).select("user_id", "event_type", "event_id", "sample")
)
query("win_21_stage_prefix", "SELECT u.user_id, s.stage AS upto, count(*) AS n FROM {history} u JOIN (SELECT DISTINCT user_id, stage FROM {history}) s ON s.user_id = u.user_id AND u.stage <= s.stage GROUP BY ALL")(
    lambda t: L.prefix_by_stage(t.history, t.history.select("user_id", "stage").distinct(), "user_id").groupBy("user_id", "upto").agg(F.count("*").alias("n"))
)


@query(
    "win_22_session_plan",
    """WITH k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {eval_items} WHERE world_id = 0 AND system_id = 0 AND turn_role = 'key'),
p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {eval_items} WHERE world_id = 0 AND system_id = 0 AND turn_role = 'probe')
SELECT conv_id, 'baseline' AS world, 0 AS phase, NULL::BIGINT AS key_turn, NULL::BIGINT AS probe_turn FROM (SELECT DISTINCT conv_id FROM k)
UNION ALL SELECT conv_id, 'no_store', unnest([0, 1, 2]), NULL, NULL FROM (SELECT DISTINCT conv_id FROM k)
UNION ALL SELECT conv_id, 'forget', 0, NULL, NULL FROM (SELECT DISTINCT conv_id FROM k)
UNION ALL SELECT k.conv_id, 'forget', k.r::INT, k.turn, p.turn FROM k LEFT JOIN p ON p.conv_id = k.conv_id AND p.r = k.r""",
)
def win_22(t):
    from loomwright.operators.worlds import session_plan

    return session_plan(t.eval_items.where("world_id = 0 AND system_id = 0"), "conv_id", "turn")


@query(
    "win_23_weighted_draw",
    """WITH w AS (SELECT DISTINCT p_size AS v, p_size::DOUBLE AS w FROM part), c AS (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS hi FROM w), d AS (SELECT v, coalesce(lag(hi) OVER (ORDER BY v), 0.0) AS lo, hi FROM c)
SELECT event_id, d.v AS drawn FROM events JOIN d ON ((event_id * 7919) % 10007) / 10007.0::DOUBLE >= lo AND ((event_id * 7919) % 10007) / 10007.0::DOUBLE < hi""",
)
def win_23(t):
    weights = t.part.select(F.col("p_size").alias("v"), F.col("p_size").cast("double").alias("w")).distinct()
    return L.weighted_draw(t.events.select("event_id"), weights, "v", "w", ((F.col("event_id") * 7919) % 10007) / F.lit(10007.0)).select("event_id", F.col("v").alias("drawn"))


query("win_24_annotation_tasks", "SELECT source, doc_id, printf('%s_%d_q%d', source, doc_id % 7, r) AS task_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('t' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")(
    lambda t: t.documents.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("t"), "doc_id")), "doc_id")).alias("r")).where("r <= 5").select("source", "doc_id", F.format_string("%s_%d_q%d", "source", F.col("doc_id") % 7, "r").alias("task_id"))
)
