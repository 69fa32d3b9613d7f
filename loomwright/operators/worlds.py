"""Rewriting conversations for the memory-control worlds, and building questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wordings of the directives, {target_reference} standing for what is meant.
TEMPLATES = {
    "no_store_prefix": [
        "Before I get into it, please use everything I share in this round only for this request and do not remember it afterward.",
        "Quick note before I explain the situation: I do not want you to retain anything I share in this round after helping me.",
        "Please keep everything from this round just for the current reply and do not store it for later.",
        "Before I share the specifics, please do not remember them once this request is done.",
        "I am okay sharing everything relevant in this round for this request, but I do not want it kept afterward.",
        "Before I go into the details, please do not keep them in memory after this reply.",
    ],
    "no_store_suffix": [
        "By the way, please use everything I just shared in this round only for this request and do not remember it afterward.",
        "One more thing: I do not want you to retain what I just shared in this round after this reply.",
        "Please help with this now, but do not store anything I just gave you in this round for later.",
        "Just to be clear, I only want what I shared in this round used for this answer and not remembered after.",
        "After you respond, please do not keep what I just shared in this round.",
        "I only wanted to share that so you could help right now, not so it gets remembered later.",
        "Please treat those details as temporary for this answer.",
        "Use those details for this request, but please do not keep them afterward.",
        "I would rather not have those details saved after we finish this.",
        "Please do not add the details from this message to memory.",
        "Once you answer, please drop the details I just gave you.",
        "This is just for the current help request, not something I want remembered.",
    ],
    "no_store_ack": [
        "Understood. I will use what you shared in this round only for this request and will not retain it afterward.",
        "Got it. I can use what you shared in this round for this reply, but I will not remember it after this.",
        "Understood. I will answer using what you shared now and will not keep it for later.",
        "Okay. I will treat what you shared in this round as temporary for this request only.",
        "Understood. I will use that information just for this reply and not store it beyond that.",
        "Of course. I will keep what you shared in this round scoped to this request and not retain it afterward.",
        "Got it. I will use those details only to answer this request.",
        "Understood. I will treat those details as temporary and not save them.",
        "Okay. I will not add those details to memory after this reply.",
        "Understood. I will help with this and then drop those details.",
        "Got it. I will keep those details limited to the current answer.",
    ],
    "forget_user": [
        "Please forget anything I shared earlier about {target_reference}.",
        "I want you to delete anything I shared earlier about {target_reference} from memory.",
        "Please remove from memory anything I shared earlier about {target_reference} going forward.",
        "Forget anything I told you earlier about {target_reference}.",
        "Please clear anything I shared about {target_reference} and do not keep it anymore.",
        "I do not want you to keep anything I shared about {target_reference} in memory anymore.",
    ],
    "forget_assistant": [
        "Understood. I will not retain or use anything you shared earlier about {target_reference} from now on.",
        "Got it. I will treat anything you shared earlier about {target_reference} as deleted and will not rely on it later.",
        "Understood. Anything you shared earlier about {target_reference} is removed from what I will use going forward.",
        "Okay. I will forget anything you shared about {target_reference} and stop carrying it forward.",
        "Understood. I will drop anything you shared about {target_reference} from memory for future replies.",
        "Of course. I will clear anything you shared earlier about {target_reference} and not use it again.",
    ],
    "restrict_user": [
        "From now on, please do not use anything I shared earlier in this conversation unless I say otherwise.",
        "For now, answer without relying on what I told you earlier in the conversation.",
        "Temporarily, do not use the memory of what I shared earlier unless I bring it back up.",
        "For the next part of this conversation, do not draw on what I told you earlier.",
        "Please leave what I shared earlier out of your replies until I tell you it is okay to use again.",
        "From this point on, do not use the earlier conversation history unless I explicitly allow it.",
    ],
    "restrict_assistant": [
        "Understood. For now, I will avoid using what you shared earlier in the conversation.",
        "Got it. I will not rely on the earlier conversation history until you allow it again.",
        "Understood. I will treat what you shared earlier as temporarily unavailable for later replies.",
        "Okay. I will avoid drawing on the earlier conversation until you say it is fine again.",
        "Understood. I will leave the earlier conversation history unused for now.",
        "Of course. I will keep what you shared earlier out of my replies until you lift the restriction.",
    ],
    "release_user": [
        "You can use what I shared earlier in the conversation again now.",
        "The temporary restriction is over. You may rely on the earlier conversation again.",
        "It is okay to use what I shared earlier again from this point on.",
        "You may start using the earlier conversation history again now.",
        "You can go back to using what I told you earlier if it is relevant.",
        "What I shared earlier is available again now if it helps.",
    ],
    "release_assistant": [
        "Understood. I can use what you shared earlier in the conversation again now.",
        "Got it. I will rely on the earlier conversation again when it is relevant.",
        "Understood. The temporary restriction is lifted and I can use what you shared earlier again.",
        "Okay. I can bring the earlier conversation back in when it helps.",
        "Understood. I can resume using what you shared earlier now.",
        "Of course. I will treat what you shared earlier as available again.",
    ],
}


def template(name: str, *keys: str) -> Column:
    """One of the wordings, drawn by a hash of the slot's name and the row's keys, so that reruns and other engines draw the same."""
    t = TEMPLATES[name]
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, t)), (F.pmod(drawn, F.lit(len(t))) + 1).cast("int"))


def no_store(turns: DataFrame, keys: DataFrame, conv: str = "conv_id", order: str = "turn", placement: str = "suffix") -> DataFrame:
    """Turns with the directive put behind each key turn's text, or before it, and the acknowledgement before the reply that follows."""
    if placement not in ("suffix", "prefix"):
        raise ValueError(f"placement is suffix or prefix, not {placement}")
    k = keys.select(conv, F.col(order).alias("key_turn")).distinct()
    marked = turns.join(k, (turns[conv] == k[conv]) & (turns[order] == k["key_turn"]), "left").select(turns["*"], "key_turn")
    w = Window.partitionBy(conv).orderBy(order)
    after = F.lag("key_turn").over(w).isNotNull() & (F.col("role") == "assistant")
    said = template(f"no_store_{placement}", conv, order)
    whole = F.concat_ws(" ", F.rtrim("text"), said) if placement == "suffix" else F.concat_ws(" ", said, F.ltrim("text"))
    text = F.when(F.col("key_turn").isNotNull(), whole).when(after, F.concat_ws(" ", template("no_store_ack", conv, order), "text")).otherwise(F.col("text"))
    return marked.withColumn("text", text).drop("key_turn")


def _at_end(turns: DataFrame, pairs: DataFrame, conv: str, order: str) -> DataFrame:
    """Turns and, after each conversation's last, the pairs (conv, k, user, assistant) in order of k."""
    last = turns.groupBy(conv).agg(F.max(order).alias("last"))
    p = pairs.join(last, conv)
    row = lambda role, col, step: p.select(conv, (F.col("last") + 2 * F.col("k") + step).alias(order), F.lit(role).alias("role"), F.col(col).alias("text"))
    return turns.select(conv, order, "role", "text").unionByName(row("user", "user", 1)).unionByName(row("assistant", "assistant", 2))


def forget(turns: DataFrame, keys: DataFrame, reference: str, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns and at their end a directive with its acknowledgement for each key turn, naming the key's reference."""
    n = F.row_number().over(Window.partitionBy(conv).orderBy(order)) - 1
    say = lambda name: F.replace(template(name, conv, "k"), F.lit("{target_reference}"), F.col(reference))
    pairs = keys.withColumn("k", n).select(conv, "k", say("forget_user").alias("user"), say("forget_assistant").alias("assistant"))
    return _at_end(turns, pairs, conv, order)


def no_use(turns: DataFrame, release: Column | None = None, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns and at their end the restricting pair, and where the condition on the conversation holds the releasing pair."""
    convs = turns.select(conv).distinct()
    pair = lambda df, name, k: df.select(conv, F.lit(k).alias("k"), template(f"{name}_user", conv).alias("user"), template(f"{name}_assistant", conv).alias("assistant"))
    pairs = pair(convs, "restrict", 0)
    if release is not None:
        pairs = pairs.unionByName(pair(convs.where(release), "release", 1))
    return _at_end(turns, pairs, conv, order)


def all_worlds(turns: DataFrame, keys: DataFrame, reference: str, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Every conversation in each of the four worlds."""
    plain = turns.select(conv, order, "role", "text")
    worlds = {"baseline": plain, "no_store": no_store(plain, keys, conv, order), "forget": forget(plain, keys, reference, conv, order), "no_use": no_use(plain, None, conv, order)}
    out = None
    for name, df in worlds.items():
        df = df.withColumn("world", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def is_user(slot: str) -> bool:
    """Whether a slot's wordings are said by the user."""
    return not slot.endswith(("ack", "assistant"))


def heads(length: int = 60, of: str = "") -> list[str]:
    """Beginnings by which the user's wordings are known, of all slots or of those whose name begins so."""
    return list(dict.fromkeys(w.split("{target_reference}")[0][:length] for k, ws in TEMPLATES.items() if is_user(k) and k.startswith(of) for w in ws))


def detect_directive(lines: DataFrame, text: str = "text", length: int = 60) -> DataFrame:
    """Lines that hold the beginning of a directive's wording, cut into what stands before it, the directive, and what follows.

    The wordings are a few fixed rows, so they are columns of the expression and no join is needed.
    """
    at = F.array_min(F.filter(F.array(*[F.instr(F.col(text), h) for h in heads(length)]), lambda i: i > 0))
    rest = F.substr(F.col(text), F.col("_at"))
    # A wording without a placeholder ends where it ends; one with it ends with its sentence.
    plain = [w for k, ws in TEMPLATES.items() if is_user(k) for w in ws if "{target_reference}" not in w]
    stop = F.coalesce(*[F.when(F.startswith(rest, F.lit(w)), len(w)) for w in plain], F.regexp_instr(rest, F.lit(r"[.!?](\s|$)")))
    d = lines.withColumn("_at", at).where("_at IS NOT NULL")
    return d.withColumn("pre", F.rtrim(F.left(F.col(text), F.col("_at") - 1))).withColumn("directive", F.when(stop > 0, F.left(rest, stop)).otherwise(rest)).withColumn("post", F.when(stop > 0, F.ltrim(F.substr(rest, stop + 1))).otherwise("")).drop("_at")


def shuffle_options(items: DataFrame, keys: list[str], correct: str, wrong: str, most_wrong: int = 3) -> DataFrame:
    """Options in an order drawn by hash, lettered from A, with the letter of the correct one."""
    options = F.concat(F.array(F.col(correct)), F.slice(F.col(wrong), 1, most_wrong))
    drawn = F.array_sort(F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], o), 256).alias("h"), o.alias("o"))))
    out = items.withColumn("options", F.transform(drawn, lambda s: s["o"]))
    letter = F.element_at(F.array(*[F.lit(c) for c in "ABCDEFGH"]), F.array_position("options", F.col(correct)).cast("int"))
    return out.withColumn("lettered", F.array_join(F.transform("options", lambda o, i: F.concat(F.lit("("), F.element_at(F.array(*[F.lit(c) for c in "ABCDEFGH"]), i + 1), F.lit(") "), o)), "\n")).withColumn("correct_letter", letter)


def groundtruth(updated_like: Column, updated_dislike: Column, like: Column, dislike: Column, reason: Column, with_reason: Column) -> Column:
    """The first fact that is there, newest first, with the reason where the type asks for it."""
    fact = F.coalesce(F.concat(F.lit("now likes "), updated_like), F.concat(F.lit("now dislikes "), updated_dislike), F.concat(F.lit("likes "), like), F.concat(F.lit("dislikes "), dislike))
    return F.concat(fact, F.when(with_reason & reason.isNotNull(), F.concat(F.lit(" because "), reason)).otherwise(""))


def sensitive_pool(profile: DataFrame, hints: DataFrame, by: str) -> DataFrame:
    """Per key of by a map from kind to its distinct values, from the profile and the hints, with an id from md5."""
    both = profile.select(by, "kind", "value").unionByName(hints.select(by, "kind", "value")).distinct()
    lists = both.groupBy(by, "kind").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return lists.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values")))).alias("pool")).withColumn("pool_id", F.upper(F.substring(F.md5(F.col(by).cast("string")), 1, 6)))


def session_plan(items: DataFrame, conv: str, order: str) -> DataFrame:
    """Phases to run per world: one in the baseline, three prefixes in no_store, and in forget a first one and one per key with the probe of the same rank."""
    rank = F.row_number().over(Window.partitionBy(conv).orderBy(order))
    key = items.where("turn_role = 'key'").select(conv, F.col(order).alias("key_turn"), rank.alias("phase"))
    probe = items.where("turn_role = 'probe'").select(conv, F.col(order).alias("probe_turn"), rank.alias("phase"))
    convs = key.select(conv).distinct()
    fixed = convs.select(conv, F.explode(F.array(*[F.struct(F.lit(w).alias("world"), F.lit(i).alias("phase")) for w, n in (("baseline", 1), ("no_store", 3), ("forget", 1)) for i in range(n)])).alias("p")).select(conv, "p.world", "p.phase")
    return fixed.unionByName(key.join(probe, [conv, "phase"], "left").withColumn("world", F.lit("forget")), allowMissingColumns=True)
