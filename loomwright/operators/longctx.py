"""Long contexts: task tables, placement of directives, sampling and ordering of blocks.

Placement and sampling are sequential within one conversation or persona (each choice depends on the ones
before), so they run as one pandas group per conversation; groups are as large as a conversation.
"""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.indexing import global_index
from loomwright.operators.matching import _cut


def task_table(items: DataFrame) -> DataFrame:
    """One row per question: whole items as they are, slot items from each element of slots."""
    whole = items.select("conv_id", "turn", F.lit("whole").alias("qa_family"), F.lit(0).alias("item_index"), "question")
    slot = items.select("conv_id", "turn", F.lit("slot").alias("qa_family"), F.posexplode("slots").alias("item_index", "question"))
    return whole.unionByName(slot)


def fresh(cached: DataFrame, keys: DataFrame, conv: str, version: str) -> DataFrame:
    """Whether a cached rewrite has the right version and as many insertions as there are key turns."""
    n = keys.groupBy(conv).agg(F.count("*").alias("n_keys"))
    return cached.join(n, conv).select(conv, ((F.size("insertions") == F.col("n_keys")) & (F.col("version") == version)).alias("fresh"))


def seeded(*parts: object) -> random.Random:
    return random.Random(int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:15], 16))


def place_directives(turns: DataFrame, conv: str, spacing: int = 6, tail: int = 5, seed: str = "place") -> DataFrame:
    """For each key turn that has a later user turn, the user turn before which its directive goes.

    Later turns are preferred that keep the spacing to earlier directives and the gap to the end, then the gap
    alone, then the spacing alone, then any. Of the preferred ones the k-th of n keys takes the quantile
    (k + 1/2) / n with a seeded jitter, held between 0.05 and 0.95.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        who, n = g[conv].iloc[0], int(g["n_user"].iloc[0])
        later = sorted(g["user_idx"])
        keyed = [k for k in sorted(g.loc[g["is_key"], "user_idx"]) if k < later[-1]]
        rng, placed, out = seeded(seed, who), [], []
        for i, key in enumerate(keyed):
            pool = [p for p in later if p > key]
            gap = lambda p: n - p - 1 >= tail
            far = lambda p: all(abs(p - q) >= spacing for q in placed)
            for keep in (lambda p: gap(p) and far(p), gap, far):
                if kept := [p for p in pool if keep(p)]:
                    pool = kept
                    break
            at = (i + 0.5) / len(keyed) + rng.uniform(-0.35, 0.35) / len(keyed)
            spot = pool[round(min(0.95, max(0.05, at)) * (len(pool) - 1))]
            placed.append(spot)
            out.append((who, key, spot))
        return pd.DataFrame(out, columns=[conv, "key_idx", "placed_before"])

    kind = turns.schema[conv].dataType.simpleString()
    return turns.groupBy(conv).applyInPandas(one, f"{conv} {kind}, key_idx int, placed_before int")


def sample_blocks(blocks: DataFrame, who: str, n: int, seed: str = "blocks") -> DataFrame:
    """n blocks per persona in the order drawn: a file's later stage can be drawn only after its earlier one, and the later
    the draw, the more weight later stages have."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        key = g[who].iloc[0]
        rng = seeded(seed, key)
        waiting = {f: sorted(s) for f, s in g.sort_values(["file", "stage"]).groupby("file")["stage"]}
        out = []
        for i in range(min(n, len(g))):
            files = sorted(f for f, s in waiting.items() if s)
            quarter = 4 * i // max(1, n)
            f = rng.choices(files, [1 + quarter * waiting[x][0] for x in files])[0]
            out.append((key, i, f, waiting[f].pop(0)))
        return pd.DataFrame(out, columns=[who, "place", "file", "stage"])

    kind = blocks.schema[who].dataType.simpleString()
    return blocks.groupBy(who).applyInPandas(one, f"{who} {kind}, place int, file string, stage int")


def sample_check(drawn: DataFrame, who: str) -> DataFrame:
    """Blocks drawn per persona, and how many came before an earlier stage of their file."""
    w = Window.partitionBy(who, "file").orderBy("place")
    d = drawn.withColumn("prev", F.lag("stage").over(w))
    return d.groupBy(who).agg(F.count("*").alias("n"), F.count_if(F.col("prev") > F.col("stage")).alias("locked"))


def draw(*parts: str | Column) -> Column:
    """Twelve hexadecimal digits of the md5 of the parts, joined by ':', as a number below 16**12; DuckDB gives the same."""
    key = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def order_blocks(blocks: DataFrame, who: str, key: str, topic: str, stage: str, mode: str = "A", split_stage: int = 2, late_stage: int = 3, share: float = 0.1, seed: str = "order") -> DataFrame:
    """Blocks of a persona with their place (from 1) around one chosen topic, that of a late block drawn by hash; where there is no
    late block, of one of the latest stage there is.

    The topic's blocks go by stage. Blocks of other topics go by stage, within it in hashed order. Mode A: the topic's blocks up to
    the first of split_stage (else the first of late_stage, else all) with at most `share` as many others spread evenly
    between them, then all the other topics' blocks, then the rest of the topic: a long gap before its last session. Mode B: the
    whole topic, with others of at most `share` of all the persona's blocks spread between them, then all that is left: a long
    tail behind its last session. Others are spread only if the part has two blocks or more, and in mode B only if there
    are that many; they then follow with the others, so no block is lost. The i-th of m spread blocks comes after
    round(n / (m + 1) * i) of the part's n blocks; halves go to the even number.
    """
    mine = Window.partitionBy(who)
    latest = F.min(F.struct((F.col(stage) != late_stage).alias("a"), (-F.col(stage)).alias("b"), draw(F.lit(seed), who, key).alias("c"), F.col(key).alias("d"), F.col(topic).alias("topic"))).over(mine)
    b = blocks.select(who, key, topic, stage).withColumn("chosen", latest["topic"]).withColumn("own", F.col(topic).eqNullSafe(F.col("chosen")))
    order = Window.partitionBy(who, "own").orderBy(stage, F.when(F.col("own"), 0).otherwise(draw(F.lit(seed), who, key)), key)
    b = b.withColumns({"i": F.row_number().over(order) - 1, "n_own": F.count_if("own").over(mine), "n": F.count("*").over(mine)})
    at = lambda s: F.min(F.when(F.col("own") & (F.col(stage) == s), F.col("i"))).over(mine)
    b = b.withColumn("part", F.coalesce(at(split_stage), at(late_stage), F.col("n_own") - 1) + 1 if mode == "A" else F.col("n_own"))
    allowed = F.floor(F.lit(share) * F.col("part" if mode == "A" else "n"))
    enough = (F.col("part") > 1) & ((F.col("n") - F.col("n_own") >= allowed) if mode == "B" else F.lit(True))
    b = b.withColumn("m", F.when(enough, F.least(allowed, F.col("n") - F.col("n_own"))).otherwise(0))
    spread = ~F.col("own") & (F.col("i") < F.col("m"))
    # Parts in order: the topic with what is spread in it, the others, the rest of the topic. A spread block stands before the block with its slot.
    section = F.when(F.col("own"), F.when(F.col("i") < F.col("part"), 0).otherwise(2)).otherwise(F.when(spread, 0).otherwise(1))
    slot = F.when(spread, F.bround(F.col("part") / (F.col("m") + 1) * (F.col("i") + 1), 0)).otherwise(F.col("i"))
    place = F.row_number().over(mine.orderBy(section, slot, F.col("own"), "i"))
    return b.withColumn("place", place).select(who, key, topic, stage, F.col("own").alias("chosen"), "place")


#: From how many blocks on a persona gets distractors, and from how many on many; word budgets; and per try the
#: weights of none, one and two sessions before a block, or the greatest number of them.
SOME, MANY = 16, 30
BUDGETS = {"none": 28_800, "some": 115_200, "many": 115_200}
WEIGHTS = [(0.7, 0.2, 0.1), (0.9, 0.1, 0.0), *[(1.0, 0.0, 0.0)] * 8]
MOST = [18, 16, 15, 14, 13, 12, 11, 10, 9, 8]


def mix_distractors(blocks: DataFrame, pool: DataFrame, who: str, block: str, session: str, words: str = "n_words", seed: str = "mix", budgets: dict[str, int] | None = None) -> DataFrame:
    """Unrelated sessions before each block: who, block, slot (from 0), session, words, try (from 0) of the persona.

    How many go before a block depends on how many blocks a persona has, by the tables above, and on one hashed number for the
    block. A persona takes the first try whose words, its blocks' and its sessions', stay below the budget, and the last one if none
    does. Later tries only take sessions away from the end of a block's draw, so each session is given the last try that still
    holds it, and sums over these few numbers tell every try's words at once, in place of drawing anew.

    A block draws neighbours from a pool that is numbered once in hashed order, so its sessions differ. A draw is a number, and
    sessions come by an equi-join on it. An empty pool gives no rows.
    """
    budgets = budgets or BUDGETS
    n = pool.count()
    numbered = global_index(pool.select(session, words).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(session).cast("string")))), ["_h", session], "no").select(session, F.col(words).alias("session_words"), "no")
    mine = Window.partitionBy(who)
    b = blocks.select(who, block, F.col(words).alias("block_words")).withColumn("n", F.count("*").over(mine))
    kind = F.when(F.col("n") >= MANY, "many").when(F.col("n") >= SOME, "some").otherwise("none")
    u = draw(F.lit(seed), who, block) / F.lit(float(16**12))
    some = F.array(*[F.when(u < w[0], 0).when(u < w[0] + w[1], 1).otherwise(2 if w[2] else 1 if w[1] else 0) for w in WEIGHTS])
    many = F.array(*[F.floor(u * (m + 1)).cast("int") for m in MOST])
    # Of each try how many sessions go before the block: falling from try to try.
    b = b.withColumns({"kind": kind, "counts": F.transform(F.when(kind == "many", many).when(kind == "some", some).otherwise(F.array(F.lit(0))), lambda c: F.least(c, F.lit(n)))})
    b = _cut(b)
    slots = b.select(who, block, "kind", "counts", F.explode(F.expr("CASE WHEN counts[0] > 0 THEN sequence(0, counts[0] - 1) ELSE array() END")).alias("slot"))
    # A session is there in as many tries as have more than its slot; as counts fall, these are the first ones.
    drawn = slots.withColumn("last", F.size(F.filter("counts", lambda c: c > F.col("slot"))) - 1)
    drawn = drawn.withColumn("no", (draw(F.lit(f"{seed}:at"), who, block) + F.col("slot")) % F.lit(max(n, 1)) + 1)
    got = _cut(drawn.hint("merge").join(numbered.hint("merge"), "no").select(who, block, "slot", session, "session_words", "last"))
    tries = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "none", 0).otherwise(len(MOST) - 1))).alias("try")
    own = b.groupBy(who).agg(F.first("kind").alias("kind"), F.sum("block_words").alias("own")).select(who, "kind", "own", tries)
    later = got.groupBy(who, F.col("last").alias("try")).agg(F.sum("session_words").alias("more"))
    down = Window.partitionBy(who).orderBy(F.desc("try"))
    total = own.hint("merge").join(later.hint("merge"), [who, "try"], "left").withColumn("total", F.col("own") + F.coalesce(F.sum("more").over(down), F.lit(0)))
    limit = F.when(F.col("kind") == "many", budgets["many"]).when(F.col("kind") == "some", budgets["some"]).otherwise(budgets["none"])
    taken = total.groupBy(who).agg(F.coalesce(F.min(F.when(F.col("total") < limit, F.col("try"))), F.max("try")).alias("try"))
    return got.hint("merge").join(taken.hint("merge"), who).where(F.col("last") >= F.col("try")).select(who, block, "slot", session, F.col("session_words").alias("words"), "try")
