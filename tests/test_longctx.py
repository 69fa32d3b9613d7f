"""Orders, distractors and draws against plain loops."""

import hashlib
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import lines, longctx


def drawn(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def plain_order(blocks, who, mode):
    """Lists built step by step: the topic, what is spread in it, the others."""
    late = [b for b in blocks if b[2] == 3] or [b for b in blocks if b[2] == max(x[2] for x in blocks)]
    topic = min(late, key=lambda b: (drawn("order", who, b[0]), b[0]))[1]
    own = sorted((b for b in blocks if b[1] == topic), key=lambda b: (b[2], b[0]))
    others = sorted((b for b in blocks if b[1] != topic), key=lambda b: (b[2], drawn("order", who, b[0]), b[0]))
    head = own
    if mode == "A":
        stages = [b[2] for b in own]
        end = stages.index(2) if 2 in stages else stages.index(3) if 3 in stages else len(own) - 1
        head = own[: end + 1]
    m = int(0.1 * (len(head) if mode == "A" else len(blocks)))
    m = 0 if len(head) < 2 or (mode == "B" and len(others) < m) else min(m, len(others))
    out = list(head)
    for i in reversed(range(m)):  # from the back, so places in front stay
        out.insert(round(len(head) / (m + 1) * (i + 1)), others[i])
    return [b[0] for b in out + others[m:] + own[len(head) :]]


@pytest.mark.parametrize("mode", ["A", "B"])
def test_block_order(spark, mode):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for who in range(14):
        for _ in range(int(rng.integers(1, 90))):
            n += 1
            rows.append((who, n, f"t{rng.integers(1, 2 + who)}", int(rng.integers(0, 3 if who % 5 == 4 else 4))))
    df = spark.createDataFrame(rows, "who int, k int, topic string, stage int").repartition(7)
    got = longctx.order_blocks(df, "who", "k", "topic", "stage", mode).orderBy("who", "place").collect()
    gaps = 0
    for who in range(14):
        mine = [r for r in got if r.who == who]
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert [r.k for r in mine] == plain_order([b[1:] for b in rows if b[0] == who], who, mode)
        inside = [r.chosen for r in mine]
        gaps += any(a and not b for a, b in zip(inside, inside[1:], strict=False))
    assert gaps > 5 and longctx.order_blocks(df.limit(0), "who", "k", "topic", "stage", mode).count() == 0


def test_distractors_against_tries_one_by_one(spark):
    rng = np.random.default_rng(3)
    blocks = [(f"p{p}", b, int(rng.integers(10, 200))) for p, n in enumerate([3, 15, 16, 20, 29, 30, 45, 80]) for b in range(n)]
    pool = [(d, int(rng.integers(1, 120))) for d in range(50)]
    budgets = {"none": 500, "some": 2800, "many": 15_000}
    numbered = [d for d, _ in sorted(pool, key=lambda x: (hashlib.md5(f"mix:{x[0]}".encode()).hexdigest(), x[0]))]
    size, want, tries = dict(pool), [], set()
    for who in sorted({b[0] for b in blocks}):
        mine = [b for b in blocks if b[0] == who]
        kind = "many" if len(mine) >= 30 else "some" if len(mine) >= 16 else "none"
        for t in range(1 if kind == "none" else 10):
            rows = []
            for _, b, _ in mine:
                u = drawn("mix", who, b) / 16**12
                w = longctx.WEIGHTS[t]
                k = 0 if kind == "none" else int(u * (longctx.MOST[t] + 1)) if kind == "many" else 0 if u < w[0] else 1 if u < w[0] + w[1] else max(i for i in range(3) if w[i])
                start = drawn("mix:at", who, b)
                rows += [(who, b, s, numbered[(start + s) % len(pool)], size[numbered[(start + s) % len(pool)]], t) for s in range(k)]
            if sum(r[4] for r in rows) + sum(b[2] for b in mine) < budgets[kind]:
                break
        want += rows
        tries.add((kind, t))
    a, b = spark.createDataFrame(blocks, "who string, block int, n_words int"), spark.createDataFrame(pool, "doc int, n_words int")
    got = longctx.mix_distractors(a, b, "who", "block", "doc", budgets=budgets)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({t for _, t in tries}) >= 3
    assert longctx.mix_distractors(a, b.limit(0), "who", "block", "doc").count() == longctx.mix_distractors(a.limit(0), b, "who", "block", "doc").count() == 0


def test_draw_from_a_million_classes(spark):
    n = 1_000_000
    weights = spark.range(n).select(F.col("id").alias("v"), (F.when(F.col("id") == 777, n * 3).otherwise(F.col("id") % 5)).alias("w"))
    rows = spark.range(20_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u"))
    got = {r.id: r.v for r in lines.weighted_draw(rows, weights, "v", "w", F.col("u")).collect()}
    w = np.arange(n) % 5
    w[777] = n * 3
    hi = np.cumsum(w) / w.sum()
    want = {r.id: int(np.searchsorted(hi, r.u, side="right")) for r in rows.collect()}
    assert got == want and 0.3 < sum(v == 777 for v in got.values()) / 20_000 < 0.7


def test_draw_edges(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.999999), (3, None), (4, 1.0), (5, -0.1)], "id int, u double")
    weights = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", None), ("d", 1.0)], "v string, w double")
    assert sorted((r.id, r.v) for r in lines.weighted_draw(rows, weights, "v", "w", F.col("u")).collect()) == [(1, "b"), (2, "d")]
    assert lines.weighted_draw(rows, weights.limit(0), "v", "w", F.col("u")).count() == 0


def test_folded_form_of_every_code_point(spark):
    """Signs that folding changes, each between letters, against a plain reading of the rule."""
    dashes = {0x2013, 0x2014}

    def plain(s):
        flat = "".join("-" if ord(c) in dashes else c for c in unicodedata.normalize("NFKD", s)).lower()
        return "".join(c for c in flat if c in "abcdefghijklmnopqrstuvwxyz0123456789@$.+-")

    signs = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFKD", chr(c)) != chr(c) or chr(c).lower() != chr(c) or 0x2010 <= c <= 0x2015 or c < 0x250)]
    df = spark.createDataFrame([(i, f"a{c}Z9") for i, c in enumerate(signs)], "i int, t string").repartition(8)
    got = {r.i: r.f for r in df.select("i", X.norm_c(F.col("t")).alias("f")).collect()}
    wrong = [(hex(ord(c)), got[i], plain(f"a{c}Z9")) for i, c in enumerate(signs) if got[i] != plain(f"a{c}Z9")]
    assert len(signs) > 15_000 and not wrong, wrong[:10]
