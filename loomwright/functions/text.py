"""Text, line and map expressions. Everything here runs inside the JVM unless it says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in goals and labels.
GENERAL_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in", "into", "is", "it", "me", "my", "of", "on", "or", "our", "that", "the", "their", "them", "they", "this", "to", "use", "using", "was", "we", "with", "you", "your",
]
#: Words that do not anchor a turn.
STOP_TOKENS = [
    "about", "again", "also", "been", "being", "between", "could", "does", "dont", "from", "have", "into", "just", "know", "like", "made", "main", "need", "near", "night", "over", "plan", "said", "same", "that", "them", "then", "there", "they", "this", "trip", "turn", "want", "what", "when", "which", "with", "would", "your",
]
#: Phrases by which a stored text shows the directive itself.
DIRECTIVE_PHRASES = [
    "forget", "do not retain", "don't retain", "want you to retain", "want you to keep", "want to retain", "do not use it", "not use it again", "not use again",
    "do not keep", "don't keep", "want to keep", "do not store", "don't store", "clear anything", "clear what", "not remember", "do not remember", "do not remember it",
    "no longer want", "no longer plan", "no longer interested", "no longer needs", "no longer relevant", "asked to clear", "asked to delete", "asked to forget",
    "request to forget", "request to clear", "request to delete", "wants to clear", "wants to delete", "wants to forget", "does not want", "doesn't want",
    "disregard", "deprecated", "superseded", "should not be used", "should not be retained", "is no longer",
]
#: Phrases by which a stored text shows that the directive was understood as one.
INTENT_PHRASES = [
    "wants to delete", "wants to clear", "asked to delete", "asked to clear", "no longer want", "no longer plan", "does not want to keep", "doesn't want to keep",
    "does not want to retain", "doesn't want to retain", "does not want to store", "doesn't want to store", "should be disregarded", "is now superseded",
    "deprecated", "request to forget", "asked to forget", "user requested",
]
#: Old and new names of question types.
TYPE_NAMES = {
    "recalling_facts_mentioned_by_the_user": "recall_user_shared_facts",
    "identifying_new_things_not_mentioned_by_the_user": "suggest_new_ideas",
    "recalling_the_latest_user_preferences": "acknowledge_latest_preferences",
    "tracking_the_full_sequence_of_preference_updates": "track_full_preference_evolution",
    "recalling_the_reasons_behind_previous_updates": "revisit_reasons_behind_preference_updates",
    "recommendation_aligned_with_users_latest_preferences": "provide_preference_aligned_recommendations",
    "generalizing_past_reasons_in_memory_to_new_scenarios": "generalize_to_new_scenarios",
}
SIDE_NOTE = r"^Side_Note:\s*\[(.*)\]\s+(\d{2}/\d{2}/\d{4}(?:-I\d{2})?)\s*$"


def parse_role_line(line: Column) -> Column:
    """Struct role, content: cut at the first ': '; the role in lower case with _ as space, 'unknown' without a cut."""
    at = F.instr(line, ": ")
    role = F.when(at > 0, F.replace(F.lower(F.trim(F.left(line, at - 1))), F.lit("_"), F.lit(" "))).otherwise("unknown")
    return F.struct(role.alias("role"), F.trim(F.when(at > 0, F.substr(line, at + 2)).otherwise(line)).alias("content"))


def to_message(line: Column) -> Column:
    """Struct role, content of an evaluation line: assistant after its name, user otherwise; null for a blank line."""
    text = F.trim(line)
    named = lambda n: F.startswith(text, F.lit(f"{n}:"))
    content = F.when(named("User"), F.trim(F.substr(text, F.lit(6)))).when(named("Assistant"), F.trim(F.substr(text, F.lit(11)))).otherwise(text)
    return F.when(F.length(text) > 0, F.struct(F.when(named("Assistant"), "assistant").otherwise("user").alias("role"), content.alias("content")))


def parse_side_note(line: Column) -> Column:
    """Struct event_text, ts_key, ts_date of a side note; null for other lines."""
    key = F.regexp_extract(line, SIDE_NOTE, 2)
    date = F.try_to_timestamp(F.left(key, F.lit(10)), F.lit("MM/dd/yyyy")).cast("date")
    return F.when(line.rlike(SIDE_NOTE), F.struct(F.regexp_extract(line, SIDE_NOTE, 1).alias("event_text"), key.alias("ts_key"), date.alias("ts_date")))


def stage_tag(name: Column) -> Column:
    """Tag of a stage name: stage_NN for numbered ones, the words between 'Conversation' and 'Stage' otherwise, 'late' for none."""
    n = F.regexp_extract(name, r"^Conversation Stage (\d+)$", 1)
    words = F.replace(F.lower(F.trim(F.replace(F.replace(F.coalesce(name, F.lit("")), F.lit("Conversation ")), F.lit(" Stage")))), F.lit(" "), F.lit("_"))
    return F.when(F.length(n) > 0, F.concat(F.lit("stage_"), F.lpad(n, 2, "0"))).when(name == "all_stages", name).otherwise(F.coalesce(F.nullif(words, F.lit("")), F.lit("late")))


def stage_id_to_name(stage_id: Column) -> Column:
    n = F.regexp_extract(stage_id, r"^stage_(\d+)", 1)
    return F.when(F.length(n) > 0, F.concat(F.lit("Conversation Stage "), F.lpad(n, 2, "0"))).otherwise("")


def norm_a(text: Column) -> Column:
    """Trimmed, white space runs as one space, lower case."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def norm_b(text: Column) -> Column:
    return norm_a(F.replace(text, F.lit("_"), F.lit(" ")))


def norm_c(text: Column) -> Column:
    """Compatibility form, lower case, en and em dash as -, and only a-z, 0-9, @ $ . + - kept. Folding has no builtin and runs in Arrow batches."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKD")

    return F.regexp_replace(F.regexp_replace(F.lower(fold(text)), "[–—]", "-"), "[^a-z0-9@$.+-]+", "")


def content_tokens(text: Column) -> Column:
    """Tokens of letters, digits, ' and -, lower case, three characters or more, general words left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9][A-Za-z0-9'-]*)"), 1), lambda x: F.rtrim(F.lower(x)))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "'+$", "")), lambda x: (F.length(x) >= 3) & ~x.isin(GENERAL_WORDS))


def anchor_tokens(text: Column) -> Column:
    """Distinct tokens that begin with a letter and have four characters or more, stop tokens left out."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z0-9@._/-]{3,})"), 1))
    return F.filter(found, lambda x: ~x.isin(STOP_TOKENS))


def digit_chunks(text: Column) -> Column:
    """Chunks of three characters or more that hold a digit."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9@._:+/-]+"), lambda x: (F.length(x) >= 3) & x.rlike("[0-9]"))


def contains_expected(hay: Column, needle: Column) -> Column:
    """The needle in its normal form (four characters or more), or any of its chunks with a digit, lies in the hay."""
    h, n = norm_a(F.coalesce(hay, F.lit(""))), norm_a(F.coalesce(needle, F.lit("")))
    return (F.length(h) > 0) & (F.length(n) > 0) & (((F.length(n) >= 4) & F.contains(h, n)) | F.exists(digit_chunks(n), lambda x: F.contains(h, x)))


def mentions(text: Column, phrases: list[str]) -> Column:
    """Any of the phrases lies in the lower-cased text; one alternation, so the text is read once."""
    import re

    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(map(re.escape, phrases)).replace("\\ ", " "))


def is_concrete(value: Column) -> Column:
    """A value that names someone or somewhere: an at sign, a digit or a word of an address."""
    return F.lower(value).rlike(r"@|[0-9]|street|avenue|road|suite|apartment|boulevard|drive|lane")


def project_sensitive(event: Column, pool: Column, most: int = 2) -> Column:
    """Of each key of the pool the first concrete values that the event's text holds; keys without any left out."""
    low = F.lower(event)
    kept = F.transform_values(pool, lambda k, v: F.slice(F.filter(v, lambda x: is_concrete(x) & F.contains(low, F.lower(x))), 1, most))
    return F.map_filter(kept, lambda k, v: F.size(v) > 0)


def truncate_mid(text: Column, n: int) -> Column:
    """The text, or its head and tail around an ellipsis if it has more than n characters."""
    half = (n - 1) // 2
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(half))), F.lit("…"), F.ltrim(F.right(text, F.lit(half))))).otherwise(text)


def clean_prose(text: Column) -> Column:
    """Newline markers, backticks and doubled quotes gone, and no space before punctuation."""
    out = text
    for old in ("<newline>", "`", "''"):
        out = F.replace(out, F.lit(old), F.lit(""))
    for mark in ",.?!'":
        out = F.replace(out, F.lit(f" {mark}"), F.lit(mark))
    return out


def extract_pii(text: Column) -> Column:
    """Struct email, phone, id, address from labelled lines; null unless all four are there."""
    got = {k: F.trim(F.regexp_extract(text, rf"(?m)^\s*{k}:[ \t]*(.+)$", 1)) for k in ("Email", "Phone", "ID", "Address")}
    whole = F.lit(True)
    for v in got.values():
        whole = whole & (F.length(v) > 0)
    return F.when(whole, F.struct(*[v.alias(k.lower()) for k, v in got.items()]))


def parse_loose_json(text: Column, schema: str) -> Column:
    """A struct from JSON in code fences or single quotes; null where it cannot be read. Fences are cut exactly."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    quoted = F.regexp_replace(F.regexp_replace(bare, r"(?<=[{\[,:\s])'", '"'), r"'(?=\s*[}\],:])", '"')
    return F.coalesce(F.from_json(bare, schema, {"mode": "PERMISSIVE"}), F.from_json(quoted, schema, {"mode": "PERMISSIVE"}))


def reference_phrase(label: Column, goal: Column) -> Column:
    """'the <label>' with a small first letter; else the goal without its opening request; else a fixed phrase."""
    small = lambda c: F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    bare = F.regexp_replace(F.trim(goal), r"(?i)^(please )?((can|could) you )?(help me (to )?|i (want|need|would like) (to )?|get help (with )?)", "")
    bare = F.regexp_replace(bare, r"[.!?]+$", "")
    return F.coalesce(F.when(F.length(F.trim(label)) > 0, F.concat(F.lit("the "), small(F.trim(label)))), F.when(F.length(bare) > 0, small(bare)), F.lit("what I shared earlier"))


def join_phrases(phrases: Column, most: int = 3) -> Column:
    """Distinct phrases joined by commas, the last by 'and'."""
    p = F.slice(F.array_distinct(phrases), 1, most)
    n = F.size(p)
    return F.when(n == 0, "").when(n == 1, F.try_element_at(p, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(p, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(p, -1)))


def accept_phrase(raw: Column, fallback: Column, most_words: int = 18, banned: str = r"(?i)forget|remember|memory|as an ai") -> Column:
    """The generated phrase if it is short, holds no banned words and is no bare that-clause; else the fallback."""
    words = F.size(F.split(F.trim(raw), r"\s+"))
    ok = (F.length(F.trim(raw)) > 0) & (words <= most_words) & ~raw.rlike(banned) & ~(F.lower(F.trim(raw)).startswith("that ") & (words < 4))
    return F.when(F.coalesce(ok, F.lit(False)), F.trim(raw)).otherwise(fallback)


def rename_type(col: Column, names: dict[str, str] | None = None) -> Column:
    names = names or TYPE_NAMES
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), col)


def flatten_values(m: Column) -> Column:
    """All non-blank values of a map of lists, keys in order."""
    in_order = F.flatten(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.coalesce(F.try_element_at(m, k), F.array().cast("array<string>"))))
    return F.filter(in_order, lambda v: F.length(F.trim(v)) > 0)


def build_prompt(question: Column, options: Column, memories: Column | None = None) -> Column:
    """Question, lettered options in order of letters, and how to answer; with the memories, or a note that there are none."""
    lines = F.array_join(F.transform(F.array_sort(F.map_keys(options)), lambda k: F.concat(F.lit("("), k, F.lit(") "), F.try_element_at(options, k))), "\n")
    body = F.concat_ws("\n\n", question, lines, F.lit("Answer with <final_answer>(letter)</final_answer>."))
    if memories is None:
        return body
    return F.concat(F.lit("Memories:\n"), F.when(F.size(memories) > 0, F.array_join(F.transform(memories, lambda m: F.concat(F.lit("- "), m)), "\n")).otherwise("(none)"), F.lit("\n\n"), body)


def stringify_retrieved(payload: Column, most: int = 8) -> Column:
    """Text of a retrieval payload given as JSON text: a string, an object with a context, a list of results, or a list of values."""
    v = F.try_parse_json(payload)
    as_list = lambda path: F.try_variant_get(v, path, "array<variant>")
    text = lambda x: F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string") for k in ("memory", "content", "text")], F.try_variant_get(x, "$", "string"))
    listed = F.coalesce(as_list("$.results"), as_list("$.memories"), as_list("$"))
    return F.coalesce(F.try_variant_get(v, "$.context", "string"), F.array_join(F.transform(F.slice(listed, 1, most), text), "\n"), F.try_variant_get(v, "$", "string"), payload)


def result_path(topic: Column, world: Column, stage: Column, method: Column, model: Column) -> Column:
    """Path of a result: topic, world, then stage, method and model as safe tags."""
    tag = lambda c: F.regexp_replace(c, "[^0-9A-Za-z]+", "_")
    return F.concat_ws("/", topic, world, F.concat(F.concat_ws(".", stage_tag(stage), tag(method), tag(model)), F.lit(".json")))


def path_meta(path: Column) -> Column:
    """Struct topic, persona, sample of a path such as .../<topic>/..._persona3_sample1.json; null where it does not fit."""
    p = r"([^/]+)/[^/]*persona(\d+)_sample(\d+)[^/]*$"
    return F.when(path.rlike(p), F.struct(F.regexp_extract(path, p, 1).alias("topic"), F.regexp_extract(path, p, 2).cast("int").alias("persona"), F.regexp_extract(path, p, 3).cast("int").alias("sample")))


def share_text(part: Column, whole: Column) -> Column:
    """A share as text with two places, 0 where the whole is 0."""
    return F.format_string("%.2f%%", F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0)))


def content_id(texts: Column) -> Column:
    """SHA-256 of the texts joined by spaces."""
    return F.sha2(F.array_join(texts, " "), 256)


def url_safe_id(text: Column) -> Column:
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_")
