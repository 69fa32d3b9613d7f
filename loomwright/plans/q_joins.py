"""Queries of joins, matching, worlds, question building, set operations, agreement and long contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.functions.scoring import choice_for, expected_type
from loomwright.operators import longctx, matching as J, metrics, quality as Q, similarity as SIM, worlds as W
from loomwright.plans.catalog import query
from loomwright.plans.q_lines import CT, AT, TYPES, TYPE_OF, WORDS, words

P = "predicted_answer_type"
KEYS = ["conv_id", "turn", "system_id", "qa_family"]

query("jon_01_choice_lookup", "SELECT conv_id, turn, world, system_id, CASE WHEN turn_role = 'key' AND world <> 'baseline' THEN CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END ELSE CASE WHEN conv_id % 2 = 0 THEN 'B' ELSE 'A' END END AS choice FROM {eval_items}")(
    lambda t: t.eval_items.withColumn("types", F.when(F.col("conv_id") % 2 == 0, F.create_map(*map(F.lit, ("A", "not_remember", "B", "remember_correct", "C", "distractor_irrelevant")))).otherwise(F.create_map(*map(F.lit, ("B", "not_remember", "A", "remember_correct", "C", "distractor_irrelevant")))))
    .select("conv_id", "turn", "world", "system_id", choice_for(F.col("types"), expected_type(F.col("world"), F.col("turn_role"))).alias("choice"))
)
query("jon_02_label_map", "WITH l AS (SELECT user_id, stage, arg_max(event_type, (ts, event_id)) AS label FROM {history} GROUP BY ALL) SELECT h.event_id, coalesce(l.label, 'none') AS label FROM {history} h LEFT JOIN l ON l.user_id = h.user_id AND l.stage = h.stage + 1")(
    lambda t: t.history.select("event_id", "user_id", (F.col("stage") + 1).alias("stage")).join(J.last_value(t.history, ["user_id", "stage"], F.col("event_type"), ["ts", "event_id"], "label"), ["user_id", "stage"], "left").select("event_id", F.coalesce("label", F.lit("none")).alias("label"))
)
query("jon_03_scorable", "SELECT conv_id, turn, world, system_id FROM {eval_items} i WHERE world <> 'forget' OR EXISTS (SELECT 1 FROM {user_turns} u WHERE u.conv_id = i.conv_id AND u.turn = i.turn AND u.user_idx < 2)")(
    lambda t: J.scorable(t.eval_items, t.user_turns.where("user_idx < 2").select("conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", "turn", "world", "system_id")
)
REC = "SELECT user_id, event_id AS k, concat('s', stage) AS stage FROM {history} WHERE event_type = 'signup' AND user_id % 2 = 0"
DECL = "SELECT user_id, event_id AS k, CASE WHEN stage > 0 THEN concat('d', stage) END AS stage FROM {history} WHERE event_type = 'error'"
query("jon_04_forget_stage", f"WITH r AS ({REC}), d AS ({DECL}) SELECT user_id, k, stage FROM r UNION ALL SELECT user_id, k, coalesce(stage, 'all_stages') FROM d WHERE user_id NOT IN (SELECT user_id FROM r)")(
    lambda t: J.forget_stage(
        t.history.where("event_type = 'signup' AND user_id % 2 = 0").select("user_id", F.col("event_id").alias("k"), F.concat(F.lit("s"), "stage").alias("stage")),
        t.history.where("event_type = 'error'").select("user_id", F.col("event_id").alias("k"), F.when(F.col("stage") > 0, F.concat(F.lit("d"), "stage")).alias("stage")),
        "user_id", "k", "stage",
    )
)
query("jon_05_twin_join", f"SELECT i.conv_id, i.turn, i.world, i.system_id, b.{P} AS base_answer FROM {{eval_items}} i LEFT JOIN {{eval_items}} b ON b.world = 'baseline' AND b.conv_id = i.conv_id AND b.turn = i.turn AND b.system_id = i.system_id AND b.qa_family = i.qa_family WHERE i.world <> 'baseline'")(
    lambda t: J.twin_join(t.eval_items, KEYS, ["world_id"]).select("conv_id", "turn", "world", "system_id", "base_answer")
)
query(
    "jon_06_twin_by_place",
    f"WITH n AS (SELECT conv_id, system_id, world, turn, {P}, row_number() OVER (PARTITION BY conv_id, system_id, world ORDER BY turn) - 1 AS idx FROM {{eval_items}} WHERE world = 'forget' OR turn % 3 <> 1) SELECT i.conv_id, i.turn, i.world, i.system_id, coalesce(b.{P}, '') AS base_answer FROM n i LEFT JOIN n b ON b.world = 'baseline' AND b.conv_id = i.conv_id AND b.system_id = i.system_id AND b.idx = i.idx WHERE i.world <> 'baseline'",
)(lambda t: J.twin_join_by_place(t.eval_items.where("world = 'forget' OR turn % 3 <> 1"), ["conv_id", "system_id"], ["turn"]).select("conv_id", "turn", "world", "system_id", "base_answer"))
query("jon_07_baseline_retrieval", "SELECT conv_id, system_id, qa_family, left(arg_max(text, i.turn), 1200) AS retrieved FROM {eval_items} i JOIN (SELECT conv_id AS c, turn AS tn, text FROM {user_turns}) u ON c = conv_id AND tn = i.turn WHERE world = 'baseline' GROUP BY ALL")(
    lambda t: J.last_value(t.eval_items.where("world = 'baseline'").join(t.user_turns.select("conv_id", "turn", "text"), ["conv_id", "turn"]), ["conv_id", "system_id", "qa_family"], F.left("text", F.lit(1200)), ["turn"], "retrieved")
)
query(
    "jon_08_interaction_candidates",
    "WITH b AS (SELECT conv_id, stage, count(*) AS n, arg_min(line, pos) AS first FROM {lines} WHERE pos % 2 = 1 GROUP BY ALL) SELECT u.conv_id, u.turn, (row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn))::INT AS rank, coalesce(b.n, 0)::INT AS n_lines, b.first AS first_line FROM {user_turns} u LEFT JOIN b ON b.conv_id = u.conv_id AND b.stage = CAST(floor(u.turn / 8) AS INT)",
)(
    lambda t: J.interaction_candidates(
        t.user_turns.select("conv_id", "turn", F.floor(F.col("turn") / 8).cast("int").alias("stage")),
        t.lines.where("pos % 2 = 1").groupBy("conv_id", "stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]).alias("lines")),
        ["conv_id", "stage"], ["turn"], "conv_id",
    ).select("conv_id", "turn", "rank", F.size("lines").alias("n_lines"), F.try_element_at("lines", F.lit(1)).alias("first_line"))
)
query(
    "jon_09_interleave",
    "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type <> 'click'), u AS (SELECT user_id, event_id AS id, 'event' AS kind, p FROM e UNION ALL SELECT user_id, event_id + 1000000, 'interaction', p FROM e WHERE event_id % 3 = 0) SELECT user_id, id, kind, row_number() OVER (PARTITION BY user_id ORDER BY p, kind, id)::INT AS place FROM u",
)(
    lambda t: J.interleave(t.events.where("event_type <> 'click'"), t.events.where("event_type <> 'click' AND event_id % 3 = 0").select("user_id", (F.col("event_id") + 1000000).alias("event_id"), F.col("event_id").alias("src")), "user_id", "event_id", "src", ["ts", "event_id"])
)
query(
    "jon_10_old_dates",
    """WITH h AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE - INTERVAL 30 DAY AS od, printf('E_%d_%03d', o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS id FROM orders),
f AS (SELECT o_custkey, d, min(id) AS id FROM h GROUP BY ALL) SELECT h.o_orderkey, h.id AS event_id, f.id AS source_event_id, CASE WHEN f.id IS NULL THEN 'init' ELSE 'change' END AS subtype FROM h LEFT JOIN f ON f.o_custkey = h.o_custkey AND f.d = h.od::DATE""",
)(
    lambda t: J.resolve_old_dates(t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.date_sub(F.col("o_orderdate").cast("date"), 30).alias("od"), "o_orderdate"), "o_custkey", "d", "od", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "event_id", "source_event_id", "subtype")
)
query(
    "jon_11_lineage_closure",
    "WITH RECURSIVE e AS (SELECT event_id AS c, parent_id AS p FROM {history} WHERE parent_id IS NOT NULL AND stage < 2), r AS (SELECT c AS descendant, p AS ancestor, 1 AS distance FROM e UNION ALL SELECT r.descendant, e.p, r.distance + 1 FROM r JOIN e ON e.c = r.ancestor) SELECT descendant, ancestor, distance FROM r",
)(lambda t: J.descendants(t.history.where("stage < 2").select("event_id", "parent_id"), "event_id", "parent_id"))
query("jon_11b_lineage_closure_all")(lambda t: J.descendants(t.history.select("event_id", "parent_id"), "event_id", "parent_id"))
K = "(props->>'$.k')::BIGINT"
GOAL = f"['t' || event_type, 'h' || (hour(ts) // 6), 'd' || (event_id % 4), 'm' || ({K} % 5), 'n' || ({K} % 3), 'w' || (event_id % 3)]"


def records(t):
    """Records of the history with the lists that conflicts are sought in."""
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    word = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    lists = {
        "values": F.array(F.round(F.col("value") * 100).cast("long") % 500),
        "context": F.array(word(" K", k % 40), word("c", i % 60)),
        "tokens": F.array(word("t", F.col("event_type")), word("h", F.floor(F.hour("ts") / 6)), word("d", i % 4), word("m", k % 5), word("n", k % 3), word("w", i % 3)),
    }
    return t.history.select("user_id", i.alias("id"), F.col("stage").alias("stage_order"), "parent_id", *[c.alias(n) for n, c in lists.items()])


query(
    "jon_12_future_conflicts",
    f"""WITH h AS (SELECT user_id, event_id AS id, stage AS o, event_type, ts, (value * 100)::BIGINT % 500 AS v, ['k' || ({K} % 40), 'c' || (event_id % 60)] AS c, {GOAL} AS g FROM {{history}}),
p AS (SELECT a.user_id, a.id AS cand_id, b.id AS later_id, a.v = b.v AS value, list_has_any(a.c, b.c) AS context,
  a.event_type = b.event_type AND (b.ts > a.ts OR b.ts = a.ts AND b.id > a.id) AS lineage, len(list_intersect(a.g, b.g)) AS n, len(list_distinct(a.g)) AS x, len(list_distinct(b.g)) AS y
  FROM h a JOIN h b ON a.user_id = b.user_id AND b.o > a.o WHERE a.o = 0)
SELECT user_id, cand_id, later_id, 'value' AS kind FROM p WHERE value UNION ALL SELECT user_id, cand_id, later_id, 'context' FROM p WHERE context
UNION ALL SELECT user_id, cand_id, later_id, 'lineage' FROM p WHERE lineage UNION ALL SELECT user_id, cand_id, later_id, 'goal' FROM p WHERE n >= 4 AND (n / (x + y - n) >= 0.5 OR n / least(x, y) >= 0.7)""",
)(lambda t: (lambda r: J.future_conflicts(r.where("stage_order = 0"), r, r.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")), "user_id"))(J.stored(records(t))))
query(
    "jon_13_similar_goals",
    f"WITH s AS (SELECT conv_id, turn, list_distinct({CT.format('text')}) AS s FROM conversations), p AS (SELECT a.conv_id, a.turn, b.turn AS other, len(list_intersect(a.s, b.s)) AS n, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.s) >= 4 AND len(b.s) >= 4) SELECT conv_id, turn, other, n::INT AS overlap FROM p WHERE n >= 4 AND (n / (x + y - n) >= 0.2 OR n / least(x, y) >= 0.4)",
)(lambda t: J.token_pairs(t.conversations.select("conv_id", "turn", X.content_tokens(F.col("text")).alias("tokens")), "conv_id", "turn", "tokens", 4, 0.2, 0.4))
query(
    "jon_14_best_match",
    f"WITH b AS (SELECT item_id, {AT.format('text').replace('{{', '{').replace('}}', '}')} AS s FROM benchmark), d AS (SELECT doc_id, {AT.format('text').replace('{{', '{').replace('}}', '}')} AS s FROM documents), x AS (SELECT item_id, unnest(s) AS tok FROM b), y AS (SELECT doc_id, unnest(s) AS tok FROM d), n AS (SELECT item_id, doc_id, count(*) AS overlap FROM x JOIN y USING (tok) GROUP BY ALL) SELECT item_id, doc_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS r FROM n) WHERE r = 1",
)(
    lambda t: J.best_match(t.benchmark.select("item_id", X.anchor_tokens(F.col("text")).alias("tokens")), t.documents.select("doc_id", X.anchor_tokens(F.col("text")).alias("tokens")), "item_id", "doc_id", [])
)
query(
    "jon_15_locate_turn",
    "WITH w AS (SELECT conv_id, turn AS k, CASE WHEN turn % 4 = 0 THEN text ELSE left(text, 25) END AS s FROM {user_turns}), e AS (SELECT w.conv_id, k, min(c.turn) AS pos FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.text = w.s GROUP BY ALL), n AS (SELECT w.conv_id, w.k, min(c.turn) AS pos FROM w JOIN conversations c ON c.conv_id = w.conv_id AND (contains(c.text, w.s) OR contains(w.s, c.text)) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = w.conv_id AND e.k = w.k) GROUP BY ALL) SELECT conv_id, k, pos, 'exact' AS how FROM e UNION ALL SELECT conv_id, k, pos, 'contained' FROM n",
)(lambda t: J.locate_turn(t.user_turns.select("conv_id", F.col("turn").alias("k"), F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(F.left("text", F.lit(25))).alias("s")), t.conversations.select("conv_id", "turn", F.col("text").alias("s")), "conv_id", "k", "s", "turn"))
query(
    "jon_16_vector_topk",
    "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 9) AS sim FROM v q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS r FROM p) WHERE r <= 5",
)(lambda t: SIM.topk_cosine(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 5, block="label"))

query(
    "jon_16b_closest_of_date",
    "WITH v AS (SELECT vec_id, label, vec_id // 7 % 30 AS day, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 9) AS sim FROM v q JOIN v c ON q.label = c.label AND q.day = c.day AND q.vec_id <> c.vec_id) SELECT query_id, arg_min(vec_id, (-sim, vec_id)) AS vec_id, max(sim) AS sim FROM p GROUP BY query_id",
)(lambda t: (lambda v: SIM.closest_of(v, v, "vec_id", "embedding", ["label", "day"]))(t.embeddings.withColumn("day", F.expr("vec_id div 7 % 30"))))
query("jon_16c_vector_lists")(lambda t: SIM.topk_lists(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 5))


def preferences(t):
    """Texts of user turns with a side, and a list of the same texts without their first word, some on the other side."""
    side = lambda c: F.when(c % 2 == 0, "likes").otherwise("dislikes")
    said = t.user_turns.select("conv_id", "turn", side(F.col("conv_id")).alias("label"), "text")
    listed = t.user_turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry"), side(F.col("conv_id") + (F.col("turn") % 3 == 2).cast("int")).alias("label"), F.regexp_replace("text", r"^\S+\s+", "").alias("text"))
    return said, listed


query("jon_17_fuzzy_join")(lambda t: SIM.fuzzy_match(*preferences(t), 90.0, ["label"], "entry").select("conv_id", "turn", "label", "matched", "n_entries", "first_entry", "ratio"))


@query(
    "jon_17b_fuzzy_blocking",
    rf"""WITH s AS (SELECT DISTINCT 'l' AS side, CASE WHEN conv_id % 2 = 0 THEN 'likes' ELSE 'dislikes' END AS label, text FROM {{user_turns}}
UNION ALL SELECT DISTINCT 'r', CASE WHEN (conv_id + CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) % 2 = 0 THEN 'likes' ELSE 'dislikes' END, regexp_replace(text, '^\S+\s+', '') FROM {{user_turns}}),
g AS (SELECT side, label, text, length(text) AS n, i - 1 AS spot, substr(repeat(chr(1), 2) || text || repeat(chr(2), 2), i, 3) AS gram FROM (SELECT *, unnest(range(1, length(text) + 3)) AS i FROM s)),
d AS (SELECT gram, count(*) AS df FROM g GROUP BY gram), f AS (SELECT gram, df FROM d WHERE df * {SIM.FREQUENT} > (SELECT sum(df) FROM d)),
h AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY side, label, text ORDER BY coalesce(df, 0), g.gram, spot) AS r FROM g LEFT JOIN f ON f.gram = g.gram) WHERE r <= floor(n * {SIM._lost(3, 1 - 90.0 / 100)!r}::DOUBLE + 1e-6) + 1),
p AS (SELECT DISTINCT a.label, a.text, b.text AS other FROM h a JOIN h b ON a.side = 'l' AND b.side = 'r' AND a.label = b.label AND a.gram = b.gram
  AND floor((a.n + b.n) * {1 - 90.0 / 100!r}::DOUBLE + 1e-6) >= abs(a.n - b.n) AND 2 * (a.spot - b.spot) <= floor((a.n + b.n) * {1 - 90.0 / 100!r}::DOUBLE + 1e-6) + a.n - b.n AND 2 * (b.spot - a.spot) <= floor((a.n + b.n) * {1 - 90.0 / 100!r}::DOUBLE + 1e-6) - a.n + b.n)
SELECT label, md5(text) AS text_md5, count(*) AS candidates FROM p GROUP BY ALL""",
)
def jon_17b(t):
    """How many entries of the list each text is compared with."""
    left, right = (df.select("label", "text").distinct().withColumn("no", F.xxhash64("label", "text")) for df in preferences(t))
    counts = SIM.fuzzy_candidates(left, right, 90.0, ["label"])
    return counts.hint("merge").join(left.hint("merge"), F.col("left_no") == F.col("no")).select("label", F.md5("text").alias("text_md5"), "candidates")


query("jon_18_later_occurrence", "SELECT event_id, CASE WHEN max(stage) OVER (PARTITION BY user_id, event_type) > stage THEN 'Yes' ELSE 'No' END AS more_update FROM {history}")(lambda t: J.later_occurrence(t.history, ["user_id", "event_type"], "stage").select("event_id", "more_update"))
query(
    "jon_19_allocate",
    "WITH m AS (SELECT c_custkey AS id, c_custkey * 2 AS row FROM customer WHERE c_custkey % 5 = 0 AND c_custkey * 2 < (SELECT count(*) FROM orders)), i AS (SELECT c_custkey AS id FROM customer), p AS (SELECT o_orderkey AS row FROM orders), n AS (SELECT id, row_number() OVER (ORDER BY md5('i1:' || id), id) AS k FROM i WHERE id NOT IN (SELECT id FROM m)), f AS (SELECT row, row_number() OVER (ORDER BY md5('r1:' || row), row) AS k FROM p WHERE row NOT IN (SELECT row FROM m)) SELECT id, row FROM m UNION ALL SELECT n.id, f.row FROM n JOIN f USING (k)",
)(
    lambda t: J.allocate(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_orderkey").alias("row")), t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 2).alias("row")).where(F.col("row") < F.lit(t.orders.count())))
)
query("jon_20_zip_by_rank", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {user_turns}), b AS (SELECT conv_id, turn AS at, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'assistant') SELECT a.conv_id, a.k::INT AS k, a.turn, b.at FROM a JOIN b ON a.conv_id = b.conv_id AND a.k = b.k")(
    lambda t: J.zip_by_rank(t.user_turns, t.conversations.where("role = 'assistant'").withColumn("at", F.col("turn")), "conv_id", "turn", "at", ["turn"], [F.col("at").desc()])
)
query("jon_21_attach_context", "SELECT q.conv_id, q.turn, count(*) AS n, arg_max(c.text, c.turn) AS last_text FROM {user_turns} q JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) c ON c.conv_id = q.conv_id AND c.r <= q.user_idx + 1 GROUP BY ALL")(
    lambda t: J.attach_context(
        t.user_turns.select("conv_id", "turn", (F.col("user_idx") + 1).alias("end")),
        t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("messages")), "conv_id", "end",
    ).select("conv_id", "turn", F.size("messages").cast("long").alias("n"), F.try_element_at("messages", F.lit(-1)).alias("last_text"))
)
query("jon_22_label_unique", "SELECT event_id, count(*) OVER (PARTITION BY user_id, round(value)) = 1 AS is_unique FROM events")(lambda t: J.label_unique(t.events.withColumn("label", F.round("value")), "user_id", "label").select("event_id", "is_unique"))
query(
    "jon_23_target_in_store",
    "WITH i AS (SELECT conv_id, turn, substr(lower(trim(text)), 1, 24) AS n FROM {user_turns}), e AS (SELECT conv_id, turn AS entry_id, lower(text) AS s FROM conversations WHERE turn % 3 <> 2) SELECT i.conv_id, i.turn, coalesce(max(length(n) > 0 AND contains(s, n)), false) AS in_store, min(CASE WHEN length(n) > 0 AND contains(s, n) THEN entry_id END) AS first_entry FROM i LEFT JOIN e ON e.conv_id = i.conv_id GROUP BY ALL",
)(lambda t: J.target_in_store(t.user_turns.select("conv_id", "turn", F.col("text").alias("expected_text")), t.conversations.where("turn % 3 <> 2").select("conv_id", F.col("turn").alias("entry_id"), "text"), "conv_id", "turn"))
query(
    "jon_24_directive_batch",
    "WITH f AS (SELECT user_id, min(seq) AS x FROM {store_log} WHERE mem_id = 3 AND action = 'ADD' GROUP BY ALL), e AS (SELECT f.user_id, min(CASE WHEN l.action = 'ADD' THEN l.seq END) AS edge, min(CASE WHEN l.action = 'UPDATE' THEN l.seq END) AS up FROM f JOIN {store_log} l ON l.user_id = f.user_id AND l.seq > f.x GROUP BY ALL) SELECT f.user_id, f.x AS extract_seq, CASE WHEN edge IS NULL OR up < edge THEN up END AS update_seq FROM f LEFT JOIN e ON e.user_id = f.user_id",
)(lambda t: J.directive_batch(t.store_log, "user_id", "seq", F.col("mem_id") == 3, F.col("action") == "ADD", F.col("action") == "UPDATE"))
query(
    "jon_25_surfaced",
    "SELECT s.user_id, s.seq AS entry_id, r.seq IS NOT NULL AS surfaced FROM {store_log} s LEFT JOIN (SELECT DISTINCT user_id, seq FROM {store_log} WHERE value > 20) r ON r.user_id = s.user_id AND r.seq = s.seq WHERE s.mem_id = 3",
)(lambda t: J.surfaced(t.store_log.withColumnRenamed("seq", "entry_id"), t.store_log.where("value > 20").select("user_id", F.col("seq").alias("entry_id")), "user_id", F.col("mem_id") == 3))
query("jon_26_reuse_profile", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) o ON o.o_custkey = c.c_custkey")(
    lambda t: J.reuse_profile(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey", F.col("o_orderstatus") == "F", ["o_totalprice"])
)

# Worlds and questions ------------------------------------------------------------------------------------------------
def said(name: str, *keys: str) -> str:
    """SQL of the wording that the same hash draws."""
    t = W.TEMPLATES[name]
    key = " || ':' || ".join([f"'{name}'", *[f"{k}::VARCHAR" for k in keys]])
    return f"list_extract([{', '.join(repr(x) for x in t)}], ((('0x' || substr(md5({key}), 1, 8))::BIGINT % {len(t)}) + 1)::INT)"


KEYED = "SELECT conv_id AS c, turn AS k FROM {user_turns} WHERE user_idx = 0"


def no_store_sql(whole: str) -> str:
    return f"""SELECT conv_id, turn, role, CASE WHEN k IS NOT NULL THEN {whole}
WHEN lag(k) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AND role = 'assistant' THEN {said("no_store_ack", "conv_id", "turn")} || ' ' || text ELSE text END AS text
FROM conversations LEFT JOIN ({KEYED}) ON c = conv_id AND k = turn"""


NO_STORE = no_store_sql(f"rtrim(text) || ' ' || {said('no_store_suffix', 'conv_id', 'turn')}")
NO_STORE_PREFIX = no_store_sql(f"{said('no_store_prefix', 'conv_id', 'turn')} || ' ' || ltrim(text)")
LAST = "(SELECT conv_id AS lc, max(turn) AS last FROM conversations GROUP BY 1)"
REFK = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, left(text, 20) AS ref FROM {user_turns} WHERE user_idx = 0"
FU, FA = (f"replace({said(f'forget_{w}', 'conv_id', 'k')}, chr(123) || 'target_reference' || chr(125), ref)" for w in ("user", "assistant"))
FORGET = f"""SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, last + 2 * k + 1, 'user', {FU} FROM ({REFK}) JOIN {LAST} ON lc = conv_id
UNION ALL SELECT conv_id, last + 2 * k + 2, 'assistant', {FA} FROM ({REFK}) JOIN {LAST} ON lc = conv_id"""


def pair(name: str, i: int, cond: str = "true") -> str:
    rows = [f"SELECT lc, last + {2 * i + step}, '{role}', {said(f'{name}_{role}', 'lc')} FROM {LAST} WHERE {cond}" for step, role in ((1, "user"), (2, "assistant"))]
    return " UNION ALL " + " UNION ALL ".join(rows)


NO_USE = "SELECT conv_id, turn, role, text FROM conversations" + pair("restrict", 0)


def keys(t):
    return t.user_turns.where("user_idx = 0").select("conv_id", "turn", F.left("text", F.lit(20)).alias("ref"))


query("wld_01_no_store", NO_STORE)(lambda t: W.no_store(t.conversations, keys(t)).select("conv_id", "turn", "role", "text"))
query("wld_01b_no_store_prefix", NO_STORE_PREFIX)(lambda t: W.no_store(t.conversations, keys(t), placement="prefix").select("conv_id", "turn", "role", "text"))
query("wld_02_forget", FORGET)(lambda t: W.forget(t.conversations, keys(t), "ref"))
query("wld_03_no_use", NO_USE + pair("release", 1, "lc % 2 = 0"))(lambda t: W.no_use(t.conversations, F.col("conv_id") % 2 == 0))
ALL = " UNION ALL ".join(f"SELECT *, '{w}' AS world FROM ({q})" for w, q in (("baseline", "SELECT conv_id, turn, role, text FROM conversations"), ("no_store", NO_STORE), ("forget", FORGET), ("no_use", NO_USE)))
query("wld_04_all_worlds", f"SELECT world, conv_id, turn, role, md5(text) AS h FROM ({ALL})")(lambda t: W.all_worlds(t.conversations, keys(t), "ref").select("world", "conv_id", "turn", "role", F.md5("text").alias("h")))
query(
    "wld_05_detect_directive",
    f"SELECT world, conv_id, turn, {' OR '.join(f'instr(text, {h!r}) > 0' for h in W.heads(of='forget'))} AS is_forget FROM ({ALL}) WHERE {' OR '.join(f'contains(text, {h!r})' for h in W.heads())}",
)(
    lambda t: W.detect_directive(W.all_worlds(t.conversations, keys(t), "ref")).select(
        "world", "conv_id", "turn", reduce(lambda a, b: a | b, [F.startswith("directive", F.lit(h)) for h in W.heads(of="forget")]).alias("is_forget")
    )
)
query("wld_06_expected_type", "SELECT conv_id, turn, world, system_id, CASE WHEN turn_role = 'key' AND world IN ('no_store', 'forget', 'no_use') THEN 'not_remember' ELSE 'remember_correct' END AS expected FROM {eval_items}")(
    lambda t: t.eval_items.select("conv_id", "turn", "world", "system_id", expected_type(F.col("world"), F.col("turn_role")).alias("expected"))
)
query(
    "wld_07_task_table",
    "SELECT conv_id, turn, 'whole' AS qa_family, 0 AS item_index, text AS question FROM {user_turns} UNION ALL SELECT conv_id, turn, 'slot', (k - 1)::INT, list_extract(string_split(text, ' '), k) FROM (SELECT *, unnest(range(1, least(len(string_split(text, ' ')), 2) + 1)) AS k FROM {user_turns})",
)(lambda t: longctx.task_table(t.user_turns.select("conv_id", "turn", F.col("text").alias("question"), F.slice(F.split("text", " "), 1, 2).alias("slots"))))


@query(
    "wld_08_shuffle_options",
    """WITH o AS (SELECT event_id, event_type AS c, unnest([event_type, 'w1', 'w2', 'w3']) AS o FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sha256(event_id || ':' || o)) AS r FROM o)
SELECT event_id, string_agg('(' || chr(64 + r::INT) || ') ' || o, chr(10) ORDER BY r) AS lettered, max(CASE WHEN o = c THEN chr(64 + r::INT) END) AS correct_letter FROM r GROUP BY event_id""",
)
def wld_08(t):
    e = t.events.withColumn("wrong", F.array(*[F.lit(f"w{i}") for i in (1, 2, 3, 4)]))
    return W.shuffle_options(e, ["event_id"], "event_type", "wrong").select("event_id", "lettered", "correct_letter")


query("wld_09_groundtruth", "SELECT event_id, coalesce('now likes ' || CASE WHEN event_id % 4 = 0 THEN event_type END, 'now dislikes ' || CASE WHEN event_id % 4 = 1 THEN event_type END, 'likes ' || CASE WHEN event_id % 4 = 2 THEN event_type END, 'dislikes ' || event_type) || CASE WHEN event_id % 3 = 0 THEN ' because ' || props ELSE '' END AS fact FROM events")(
    lambda t: t.events.select("event_id", W.groundtruth(*[F.when(F.col("event_id") % 4 == i, F.col("event_type")) for i in range(3)], F.col("event_type"), F.col("props"), F.col("event_id") % 3 == 0).alias("fact"))
)
query(
    "wld_10_sensitive_pool",
    "WITH b AS (SELECT DISTINCT user_id, event_type AS kind, (event_id % 5)::VARCHAR AS v FROM events), l AS (SELECT user_id, kind, array_to_string(list(v ORDER BY v), ',') AS vs FROM b GROUP BY ALL) SELECT user_id, string_agg(kind || '=' || vs, ';' ORDER BY kind) AS pool, upper(left(md5(user_id::VARCHAR), 6)) AS pool_id FROM l GROUP BY user_id",
)(
    lambda t: W.sensitive_pool(*[t.events.where(c).select("user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 5).cast("string").alias("value")) for c in ("event_id % 2 = 0", "event_id % 2 = 1 OR event_id % 3 = 0")], "user_id")
    .select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("pool")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("pool"), "pool_id")
)

# Set operations ------------------------------------------------------------------------------------------------------
query("set_01_union_families", "SELECT conv_id, turn, 'whole' AS qa_family, NULL::VARCHAR AS slot FROM {user_turns} UNION ALL SELECT conv_id, turn, 'slot', text FROM {user_turns}")(
    lambda t: t.user_turns.select("conv_id", "turn", F.lit("whole").alias("qa_family")).unionByName(t.user_turns.select("conv_id", "turn", F.lit("slot").alias("qa_family"), F.col("text").alias("slot")), allowMissingColumns=True)
)
query("set_02_shared_values", "SELECT a.user_id, string_agg(a.v, ',' ORDER BY a.v) AS shared FROM (SELECT DISTINCT user_id, event_type AS v FROM {history} WHERE stage = 0 INTERSECT SELECT DISTINCT user_id, event_type FROM {history} WHERE stage = 3) a GROUP BY a.user_id")(
    lambda t: t.history.where("stage = 0").select("user_id", "event_type").intersect(t.history.where("stage = 3").select("user_id", "event_type")).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("shared"))
)
query("set_03_rejected", "SELECT conv_id, turn FROM conversations EXCEPT ALL SELECT conv_id, turn FROM {user_turns} WHERE user_idx < 2")(lambda t: t.conversations.select("conv_id", "turn").exceptAll(t.user_turns.where("user_idx < 2").select("conv_id", "turn")))
query("set_04_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL) GROUP BY user_id")(
    lambda t: t.events.groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"])), ",").alias("kinds"))
)

# Validation, audit and agreement -------------------------------------------------------------------------------------
EXC = [TYPES[i] for i in (1, 3, 4, 6)]
query(
    "flt_12_coverage",
    f"WITH q AS (SELECT user_id, concat('s', stage) AS stage, {TYPE_OF} AS type FROM {{history}}), g AS (SELECT user_id, stage, count(*) AS n, count(*) FILTER (type = 'unknown') AS unknown, list(DISTINCT type) AS seen FROM q GROUP BY ALL) SELECT user_id, stage, n, unknown, n < 10 AS few, coalesce(array_to_string(list_sort(list_filter([{', '.join(repr(x) for x in TYPES)}], lambda x: NOT list_contains(seen, x) AND NOT (stage = 's0' AND x IN ({', '.join(repr(x) for x in EXC)})))), ','), '') AS absent FROM g",
)(lambda t: Q.coverage(t.history.select("user_id", F.concat(F.lit("s"), "stage").alias("stage"), F.expr(TYPE_OF).alias("type")), ["user_id", "stage"], TYPES, 10, "s0", EXC))
query("flt_13_freshness", "SELECT c.conv_id, c.n = k.n AND c.conv_id % 3 <> 0 AS fresh FROM (SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS n FROM conversations GROUP BY 1) c JOIN (SELECT conv_id, count(*) AS n FROM {user_turns} GROUP BY 1) k ON c.conv_id = k.conv_id")(
    lambda t: longctx.fresh(t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("turn"))).alias("insertions")).withColumn("version", F.when(F.col("conv_id") % 3 == 0, "v1").otherwise("v2")), t.user_turns.select("conv_id", "turn"), "conv_id", "v2")
)
query("flt_14_audit", f"SELECT role, count(*) AS turns, avg(w) AS mean_words, min(w) AS min_words, max(w) AS max_words, count(*) FILTER (w < 8) AS short_turns, count(*) FILTER (regexp_matches(lower(text), 'policy|retain|store|remember')) AS policy_lines FROM (SELECT *, {WORDS} AS w FROM conversations) GROUP BY role")(
    lambda t: Q.audit(t.conversations.withColumn("n_words", words()), ["role"])
)
SAY2 = "CASE WHEN conv_id % 4 = 0 THEN concat('Please forget it. ', text) ELSE text END"
ALT = "(" + "|".join(p.replace("'", "''") for p in X.DIRECTIVE_PHRASES) + ")"
query("flt_15_directive_reactions", f"WITH d AS (SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, {SAY2} AS s FROM conversations) SELECT conv_id, turn, reply FROM d WHERE role = 'user' AND regexp_matches(lower(s), '{ALT}')")(
    lambda t: t.conversations.select("conv_id", "turn", "role", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("reply"), F.expr(SAY2).alias("s")).where((F.col("role") == "user") & X.mentions(F.col("s"), X.DIRECTIVE_PHRASES)).select("conv_id", "turn", "reply")
)
query("flt_16_failures_and_violations", f"SELECT conv_id, turn, world, system_id, CASE WHEN turn_role = 'key' THEN 'violation' ELSE 'utility_failure' END AS kind FROM {{eval_items}} WHERE qa_family = 'whole' AND ((turn_role = 'key' AND {P} = 'remember_correct' AND world <> 'baseline') OR (turn_role = 'probe' AND {P} <> 'remember_correct'))")(
    lambda t: t.eval_items.where(f"qa_family = 'whole' AND ((turn_role = 'key' AND {P} = 'remember_correct' AND world <> 'baseline') OR (turn_role = 'probe' AND {P} <> 'remember_correct'))").select("conv_id", "turn", "world", "system_id", F.when(F.col("turn_role") == "key", "violation").otherwise("utility_failure").alias("kind"))
)
WIDE = "SELECT doc_id, quality + 2 AS x, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE toxic END AS y FROM labels"
query("agg_30_annotations_long", f"SELECT doc_id, 's1' AS statement, x % 2 AS value FROM ({WIDE}) WHERE x IS NOT NULL UNION ALL SELECT doc_id, 's2', y % 2 FROM ({WIDE}) WHERE y IS NOT NULL")(
    lambda t: Q.annotations_long(t.labels.select("doc_id", (F.col("quality") + 2).alias("s1:::good"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("toxic")).alias("s2:::toxic")), ["doc_id"], ["s1:::good", "s2:::toxic"])
)
LONG = "SELECT doc_id, annotator, 's1' AS statement, s1 AS value FROM {annotations} UNION ALL SELECT doc_id, annotator, 's2', s2 FROM {annotations}"


def votes(t):
    return t.annotations.unpivot(["doc_id", "annotator"], ["s1", "s2"], "statement", "value").where("value IS NOT NULL")


query("agg_31_majority", f"WITH v AS ({LONG}), n AS (SELECT doc_id, statement, value, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, statement)::BIGINT AS total FROM n) SELECT doc_id, statement, coalesce(max(CASE WHEN 2 * n > total THEN value END), max(value)) AS majority, max(total) AS votes FROM t GROUP BY ALL")(lambda t: Q.majority(votes(t), ["doc_id", "statement"]))
query(
    "agg_32_alpha",
    f"WITH v AS ({LONG}), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, statement) AS m FROM v), w AS (SELECT * FROM m WHERE m > 1), o AS (SELECT a.statement, sum(CASE WHEN a.value <> b.value THEN 1.0::DOUBLE / (a.m - 1) ELSE 0 END) AS d FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.statement = b.statement AND a.annotator <> b.annotator GROUP BY 1), c AS (SELECT statement, value, count(*)::DOUBLE AS n FROM w GROUP BY ALL), e AS (SELECT statement, sum(n) AS total, sum(n * (n - 1)) AS chance FROM c GROUP BY 1) SELECT o.statement, round(1 - (o.d / e.total) / (1 - e.chance / (e.total * (e.total - 1))), 9) AS alpha FROM o JOIN e ON o.statement = e.statement",
)(lambda t: Q.alpha(votes(t), "doc_id", ["statement"]))
query(
    "agg_35_distinct_cover",
    "WITH d AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem), c AS (SELECT p_partkey, arg_min(p_type, p_partkey) AS label FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL) SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, coalesce(label, 'other_detail') AS label FROM d LEFT JOIN c ON p_partkey = l_partkey",
)(lambda t: metrics.slot_labels(t.lineitem, ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("label")), ["l_partkey"], "other_detail"))

# Long contexts -------------------------------------------------------------------------------------------------------
query("win_13_place_directives")(lambda t: longctx.place_directives(t.user_turns.select("conv_id", "user_idx", "n_user", (F.col("user_idx") < F.col("n_user") / 2).alias("is_key")), "conv_id"))
query("win_13b_placement_invariants", "SELECT count(*) AS n, 0::BIGINT AS early FROM {user_turns} WHERE user_idx < n_user / 2 AND user_idx + 1 < n_user")(
    lambda t: longctx.place_directives(t.user_turns.select("conv_id", "user_idx", "n_user", (F.col("user_idx") < F.col("n_user") / 2).alias("is_key")), "conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("placed_before") <= F.col("key_idx")).alias("early"))
)
query("win_15_sample_blocks")(lambda t: longctx.sample_blocks(t.history.select("user_id", F.col("event_type").alias("file"), "stage").distinct(), "user_id", 8))
query("win_15b_sample_sizes", "SELECT user_id, least(8, count(*)) AS n, 0::BIGINT AS locked FROM (SELECT DISTINCT user_id, event_type, stage FROM {history}) GROUP BY user_id")(
    lambda t: longctx.sample_check(longctx.sample_blocks(t.history.select("user_id", F.col("event_type").alias("file"), "stage").distinct(), "user_id", 8), "user_id")
)


def ordered(mode: str) -> str:
    """SQL of the places of blocks around the chosen topic."""
    part = "coalesce(min(CASE WHEN own AND stage = 2 THEN i END) OVER w, min(CASE WHEN own AND stage = 3 THEN i END) OVER w, n_own - 1) + 1" if mode == "A" else "n_own"
    allowed, enough = ("floor(0.1::DOUBLE * part)", "part > 1") if mode == "A" else ("floor(0.1::DOUBLE * n)", "part > 1 AND n - n_own >= floor(0.1::DOUBLE * n)")
    h = "('0x' || substr(md5('order:' || who || ':' || event_id), 1, 12))::BIGINT"
    return f"""WITH b AS (SELECT user_id % 20 AS who, event_id, event_type AS topic, stage FROM {{history}}),
c AS (SELECT who, arg_min(topic, (CASE WHEN stage = 3 THEN 0 ELSE 1 END, -stage, {h}, event_id)) AS chosen FROM b GROUP BY who),
o AS (SELECT b.*, topic = chosen AS own FROM b JOIN c ON b.who = c.who),
i AS (SELECT *, row_number() OVER (PARTITION BY who, own ORDER BY stage, CASE WHEN own THEN 0 ELSE {h} END, event_id) - 1 AS i, count(*) FILTER (own) OVER (PARTITION BY who) AS n_own, count(*) OVER (PARTITION BY who) AS n FROM o),
p AS (SELECT *, {part} AS part FROM i WINDOW w AS (PARTITION BY who)),
m AS (SELECT *, CASE WHEN {enough} THEN least({allowed}, n - n_own) ELSE 0 END AS m FROM p),
s AS (SELECT *, NOT own AND i < m AS spread FROM m)
SELECT who, event_id, topic, stage, own AS chosen, row_number() OVER (PARTITION BY who ORDER BY CASE WHEN own THEN CASE WHEN i < part THEN 0 ELSE 2 END WHEN spread THEN 0 ELSE 1 END,
  CASE WHEN spread THEN round_even(part / (m + 1) * (i + 1), 0) ELSE i END, own, i)::INT AS place FROM s"""


def sessions(t):
    return t.history.select((F.col("user_id") % 20).alias("who"), "event_id", F.col("event_type").alias("topic"), "stage")


query("win_16_order_blocks", ordered("A"))(lambda t: longctx.order_blocks(sessions(t), "who", "event_id", "topic", "stage", "A"))
query("win_16b_order_rows", ordered("B"))(lambda t: longctx.order_blocks(sessions(t), "who", "event_id", "topic", "stage", "B"))

#: Personas of few, some and many blocks, at any size of the tables.
PERSONAS = "concat('a', conv_id % 2)", "concat('b', conv_id % 25)", "concat('c', conv_id % 400)"
MIX_U = "('0x' || substr(md5('mix:' || who || ':' || block), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE"
MIX_SOME = ", ".join(f"CASE WHEN u < {w[0]!r}::DOUBLE THEN 0 WHEN u < {w[0] + w[1]!r}::DOUBLE THEN 1 ELSE {2 if w[2] else 1 if w[1] else 0} END" for w in longctx.WEIGHTS)
MIX_MANY = ", ".join(f"floor(u * {m + 1})::BIGINT" for m in longctx.MOST)


@query(
    "win_19_mix_distractors",
    f"""WITH b AS (SELECT who, block, n_words FROM ({" UNION ALL ".join(f"SELECT {p} AS who, conv_id * 1000 + turn AS block, {WORDS} AS n_words FROM conversations" for p in PERSONAS)})),
s AS (SELECT *, CASE WHEN n >= {longctx.MANY} THEN 'many' WHEN n >= {longctx.SOME} THEN 'some' ELSE 'none' END AS kind, {MIX_U} AS u FROM (SELECT *, count(*) OVER (PARTITION BY who) AS n FROM b)),
c AS (SELECT *, CASE kind WHEN 'many' THEN [{MIX_MANY}] WHEN 'some' THEN [{MIX_SOME}] ELSE [0] END AS counts FROM s),
t AS (SELECT who, block, n_words, kind, k - 1 AS try, least(counts[k], (SELECT count(*) FROM documents)) AS k FROM (SELECT *, unnest(range(1, len(counts) + 1)) AS k FROM c)),
d AS (SELECT doc_id, {WORDS} AS words, row_number() OVER (ORDER BY md5('mix:' || doc_id), doc_id) AS no FROM documents),
g AS (SELECT t.who, t.block, t.try, t.kind, x.slot, d.doc_id, coalesce(d.words, 0) AS words FROM t, unnest(range(0, t.k)) AS x(slot) JOIN d ON d.no = (('0x' || substr(md5('mix:at:' || t.who || ':' || t.block), 1, 12))::BIGINT + x.slot) % (SELECT count(*) FROM documents) + 1),
o AS (SELECT who, try, kind, sum(n_words) AS own FROM t GROUP BY ALL), f AS (SELECT who, try, sum(words) AS more FROM g GROUP BY ALL),
q AS (SELECT o.who, coalesce(min(CASE WHEN own + coalesce(more, 0) < CASE kind WHEN 'many' THEN 30000 WHEN 'some' THEN 4000 ELSE 3000 END THEN o.try END), max(o.try)) AS try FROM o LEFT JOIN f ON f.who = o.who AND f.try = o.try GROUP BY o.who)
SELECT g.who, g.block, g.slot::INT AS slot, g.doc_id, g.words, g.try::INT AS try FROM g JOIN q ON q.who = g.who AND q.try = g.try""",
)
def win_19(t):
    """Budgets are scaled to the short texts of these tables, so that some personas fit at once, some after tries and some never."""
    turns = t.conversations.withColumn("n_words", words())
    blocks = reduce(lambda a, b: a.unionByName(b), [turns.select(F.expr(p).alias("who"), (F.col("conv_id") * 1000 + F.col("turn")).alias("block"), "n_words") for p in PERSONAS])
    return longctx.mix_distractors(blocks, t.documents.select("doc_id", words().alias("n_words")), "who", "block", "doc_id", budgets={"none": 3000, "some": 4000, "many": 30_000})
