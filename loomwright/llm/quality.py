"""Quality rules as a short-circuit cascade, with DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import SPACE

SYMBOLS = "#*$%&|<>"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = MEASURES, unless: str | None = None) -> DataFrame:
    """docs with the measures: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text counts as empty.

    n_repeat_words counts the words inside 5-word windows that occur twice or more in the text. Windows are
    compared by a 64-bit hash of their words' 64-bit hashes. Only texts in which some hash repeats are sorted.
    Columns of docs with the name of a measure are replaced; those that begin with _lw_ are for the work and are dropped.
    """
    d = docs.drop(*[c for c in docs.columns if c.startswith("_lw_")])
    for name in names:
        d = added(d, name, text_col, unless)
    return d.drop(*[c for c in d.columns if c.startswith("_lw_")])


def added(d: DataFrame, name: str, text_col: str, unless: str | None = None) -> DataFrame:
    """d with one measure and the working columns that it needs and d lacks. With `unless`, rows in which that column is set get
    null, and nothing is worked out for them."""
    guard = (lambda c: c) if unless is None else (lambda c: F.when(F.col(unless).isNull(), c))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def put(d: DataFrame, column: str, value: Column) -> DataFrame:
        return d.withColumn(column, guard(value))

    if name in ("n_words", "word_chars", "n_repeat_words") and "_lw_w" not in d.columns:
        d = put(d, "_lw_t", F.btrim(text, F.lit(" \t\n\x0b\x0c\r")))
        d = put(d, "_lw_w", F.when(F.col("_lw_t") != "", F.split("_lw_t", SPACE + "+")).otherwise(F.array().cast("array<string>")))
    if name == "n_words":
        return put(d, name, F.size("_lw_w").cast("long"))
    if name == "word_chars":
        return put(d, name, F.length(F.array_join("_lw_w", "")).cast("long"))
    if name == "n_symbols":
        return put(d, name, F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
    if name == "n_dup_lines":
        d = put(d, "_lw_l", F.when(text.contains("\n"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
        return put(d, name, F.coalesce(F.size("_lw_l") - F.size(F.array_distinct("_lw_l")), F.lit(0)).cast("long"))
    d = put(d, "_lw_h", F.transform("_lw_w", lambda x: F.xxhash64(x)))
    d = put(d, "_lw_g", F.when(F.size("_lw_w") > 5, F.transform(F.sequence(F.lit(0), F.size("_lw_h") - 5), lambda i: F.xxhash64(*[F.get(F.col("_lw_h"), i + k) for k in range(5)]))))
    d = put(d, "_lw_r", F.size(F.array_distinct("_lw_g")) < F.size("_lw_g"))
    # In order of hash and place, a window repeats if its neighbour before or after has its hash.
    d = put(d, "_lw_s", F.when(F.col("_lw_r"), F.sort_array(F.transform("_lw_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_lw_s", lambda x, j: (F.get(F.col("_lw_s"), j - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("_lw_s"), j + 1)["h"].eqNullSafe(x["h"])))
    d = put(d, "_lw_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("_lw_p", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    return put(d, name, F.coalesce(covered, F.lit(0)).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Name -> condition under which a document is rejected. Conditions use the measures above and the text's own characters.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines > 0 AND 2 * n_dup_lines >= size(split({text}, '\\n'))",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "few_letters": "2 * length(regexp_replace({text}, '[^\\\\p{{L}}]+', '')) < word_chars",
    "shouting": "2 * length(regexp_replace({text}, '[^\\\\p{{Lu}}]+', '')) > word_chars",
}


def conditions(rules: dict[str, str], text_col: str) -> dict[str, Column]:
    return {k: F.coalesce(F.expr(v.format(text=f"coalesce(`{text_col}`, '')")), F.lit(False)) for k, v in rules.items()}


#: What each thing that a condition names costs the first time, in characters or array elements: the measures, and the text itself.
TOUCHES = {
    "n_words": "n_chars", "word_chars": "n_chars + n_words", "n_symbols": "n_chars", "n_dup_lines": "n_chars + n_lines",
    "n_repeat_words": "n_chars + 12 * n_words", "text": "2 * n_chars",
}


def needs(rule: str) -> list[str]:
    return [t for t in TOUCHES if re.search(rf"\b{t}\b", rule)]


def cascade_order(docs: DataFrame, rules: dict[str, str], text_col: str = "text", sample_rows: int = 512, paid: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """Rules as (name, cost, share rejected), the next one always that with the largest share rejected per cost; ties by name.

    A rule costs what it still has to touch: measures in `paid`, which are worked out in any case, and those that a rule before it
    has worked out cost nothing more. Shares and costs are taken on a sample of about sample_rows rows, those with the least
    hash of the text, in one pass that stays in Spark; they do not depend on a clock, so every rerun gives the same order. The
    sample only sets the order in which rules run, never a verdict.
    """
    n = docs.count()
    if not n:
        return [(k, 0.0, 0.0) for k in sorted(rules)]
    some = docs.select(F.col(text_col)).where(F.pmod(F.xxhash64(F.lit("cascade"), text_col), F.lit(1 << 30)) <= int(min(1.0, sample_rows / n) * (1 << 30)))
    sample = measured(some, text_col).withColumn("n_chars", F.length(F.coalesce(text_col, F.lit("")))).withColumn("n_lines", F.size(F.split(F.coalesce(text_col, F.lit("")), "\n")))
    names, things = list(rules), list(TOUCHES)
    cost = [F.avg(F.expr(TOUCHES[t])).alias(f"cost{i}") for i, t in enumerate(things)]
    hit = [F.count_if(c).alias(f"hit{i}") for i, c in enumerate(conditions(rules, text_col).values())]
    got = sample.agg(F.count("*").alias("rows"), *cost, *hit).first()
    price = {t: got[f"cost{i}"] or 0.0 for i, t in enumerate(things)}
    share = {k: got[f"hit{i}"] / max(1, got["rows"]) for i, k in enumerate(names)}
    done, out = {*paid}, []
    while names:
        left = {k: 1.0 + sum(price[t] for t in needs(rules[k]) if t not in done) for k in names}
        k = min(names, key=lambda k: (-share[k] / left[k], k))
        out.append((k, round(left[k], 6), share[k]))
        done |= {t for t in needs(rules[k]) if t != "text"}
        names.remove(k)
    return out


def verdicts(docs: DataFrame, text_col: str = "text", rules: dict[str, str] | None = None, sample_rows: int = 512) -> DataFrame:
    """docs with all measures, base_failed, failed_rule (the first rule of the cascade that rejects, or null) and kept.

    The measures are part of the result and so cost no rule anything; what is left runs as one conditional expression in cascade
    order. A document is kept if no rule rejects it. A null text counts as empty and fails few_words.
    """
    rules = rules or RULES
    order = [k for k, _, _ in cascade_order(docs, rules, text_col, sample_rows, MEASURES)]
    on = conditions(rules, text_col)
    first = reduce(lambda w, k: w.when(on[k], F.lit(k)), order[1:], F.when(on[order[0]], F.lit(order[0])))
    d = measured(docs, text_col).withColumn("failed_rule", first)
    return d.withColumn("base_failed", base_failed()).withColumn("kept", F.col("failed_rule").isNull() & ~F.col("base_failed"))


def cascade(docs: DataFrame, text_col: str = "text", rules: dict[str, str] | None = None, sample_rows: int = 512) -> DataFrame:
    """docs with failed_rule, and the measures as far as they were needed: a document that a rule rejects skips the rules behind
    it and their measures, which are then null. For filtering; `verdicts` reports every measure."""
    rules = rules or RULES
    on, d = conditions(rules, text_col), docs.drop(*MEASURES, "failed_rule", *[c for c in docs.columns if c.startswith("_lw_")]).withColumn("_lw_failed", F.lit(None).cast("string"))
    for k, _, _ in cascade_order(docs, rules, text_col, sample_rows):
        for m in needs(rules[k]):
            if m in MEASURES and m not in d.columns:
                d = added(d, m, text_col, "_lw_failed")
        d = d.withColumn("_lw_failed", F.when(F.col("_lw_failed").isNotNull(), F.col("_lw_failed")).when(on[k], F.lit(k)))
    d = d.withColumn("failed_rule", F.col("_lw_failed"))
    return d.drop(*[c for c in d.columns if c.startswith("_lw_")])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and the verdict per document, by id; repeated rows repeat, an empty table gives none."""
    v = verdicts(docs.select(id_col, text_col), text_col)
    return v.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
