"""Views over the base tables that stand for the evaluation data; the same text runs on Spark and on the SQL oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomwright.plans.shipping import ship

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "worlds": "SELECT * FROM (VALUES (0,'baseline'),(1,'no_store'),(2,'forget'),(3,'no_use')) AS t(world_id, world)",
    "eval_big": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_suppkey % 20 AS INT) AS system_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'no_store' WHEN 2 THEN 'forget' ELSE 'no_use' END AS world,
  CAST(l_orderkey % 10 AS INT) AS persona,
  CASE l_partkey % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'intermediate' ELSE 'late' END AS ask_stage,
  CASE (l_partkey + l_suppkey) % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'intermediate' ELSE 'late' END AS forget_stage,
  CASE WHEN l_quantity < 12 THEN 'whole' ELSE 'slot' END AS qa_family,
  CASE l_linestatus WHEN 'O' THEN 'key' ELSE 'probe' END AS turn_role,
  CASE l_returnflag WHEN 'A' THEN 'remember_correct' WHEN 'R' THEN 'not_remember' ELSE 'distractor_irrelevant' END AS predicted_answer_type,
  l_shipdate AS mtime
FROM {lineitem}""",
    "user_turns": """SELECT conv_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS user_idx,
  CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS n_user FROM {conversations} WHERE role = 'user'""",
    "eval_items": """SELECT u.conv_id, u.turn, u.user_idx, w.world, w.world_id, CAST(s.system_id AS INT) AS system_id,
  CASE WHEN u.user_idx < u.n_user / 2 THEN 'key' ELSE 'probe' END AS turn_role,
  CASE WHEN (u.conv_id + u.turn) % 2 = 0 THEN 'whole' ELSE 'slot' END AS qa_family,
  CASE (u.conv_id * u.conv_id + 13 * u.turn + 7 * w.world_id + 5 * s.system_id + u.conv_id * u.turn * w.world_id) % 3
    WHEN 0 THEN 'remember_correct' WHEN 1 THEN 'not_remember' ELSE 'distractor_irrelevant' END AS predicted_answer_type
FROM {user_turns} u CROSS JOIN {worlds} w CROSS JOIN (SELECT DISTINCT l_suppkey % 8 AS system_id FROM {lineitem}) s""",
    "responses": """SELECT *, CASE (conv_id + turn + world_id) % 5
   WHEN 0 THEN concat('Rationale: x. <final_answer>(', c, ')</final_answer>')
   WHEN 1 THEN concat('Maybe (a) but I pick (', c, ')')
   WHEN 2 THEN concat('Option ', upper(c))
   WHEN 3 THEN 'No idea.' ELSE concat('<final_answer>', upper(c)) END AS model_response
FROM (SELECT *, CASE predicted_answer_type WHEN 'remember_correct' THEN 'b' WHEN 'not_remember' THEN 'a' ELSE 'c' END AS c FROM {eval_items}) q""",
    "history": """SELECT user_id, event_id, ts, event_type, value, props,
  lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS parent_id,
  CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS stage FROM {events}""",
    "store_log": """SELECT event_id AS seq, user_id, CAST(event_id % 7 AS INT) AS mem_id, ts,
  CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'NONE' ELSE 'ADD' END AS action, value FROM {events}""",
    "annotations": """SELECT doc_id, 'a1' AS annotator, quality AS s1, toxic AS s2 FROM {labels}
UNION ALL SELECT doc_id, 'a2', CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END, toxic FROM {labels}
UNION ALL SELECT doc_id, 'a3', quality, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END FROM {labels} WHERE doc_id % 3 <> 0""",
    # Lines of a conversation: a dated side note before every fourth turn, then the turn under its role's name.
    "lines": """SELECT conv_id, CAST(floor(turn / 8) AS INT) AS stage, turn * 2 AS pos,
  concat('Side_Note: [event ', CAST(turn AS VARCHAR(9)), '] ', lpad(CAST(turn % 12 + 1 AS VARCHAR(9)), 2, '0'), '/', lpad(CAST(conv_id % 28 + 1 AS VARCHAR(9)), 2, '0'), '/2024') AS line
FROM {conversations} WHERE turn % 4 = 0
UNION ALL SELECT conv_id, CAST(floor(turn / 8) AS INT), turn * 2 + 1, concat(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END, ': ', text) FROM {conversations}""",
    # Per item: what the store and the retrieval held, for the attribution of failures.
    "cases": """SELECT i.conv_id, i.turn, i.world, i.world_id, i.system_id, i.turn_role, i.qa_family, i.predicted_answer_type, u.text AS expected_text,
  (i.conv_id + i.turn + i.system_id) % 3 <> 0 AS in_store, (i.conv_id * 3 + i.turn) % 4 < 2 AS directive_text, (i.conv_id + 2 * i.turn) % 5 = 0 AS directive_intent,
  (i.conv_id + i.turn) % 3 = 0 AS acted_on, (i.conv_id + i.turn + i.world_id) % 2 = 0 AS retrieved, (i.conv_id + 3 * i.turn) % 4 = 1 AS signal,
  i.system_id % 3 AS kind
FROM {eval_items} i JOIN {user_turns} u ON i.conv_id = u.conv_id AND i.turn = u.turn""",
}


def needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in VIEWS or n in BASE]


class Tables:
    """Base tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name].replace("VARCHAR(9)", "STRING")
        return self.spark.sql(text, **{n: getattr(self, n) for n in needs(text)})


def oracle(body: str) -> str:
    """One statement for the oracle: the views that the body names in braces become common table expressions before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needs(text):
            if n in VIEWS:
                visit(VIEWS[n])
                if n not in order:
                    order.append(n)

    visit(body)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in VIEWS or m[1] in BASE else m[0], s)
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(body).strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        ctes.append(body[len("WITH RECURSIVE ") if recursive else len("WITH ") :])
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
