"""Joins by likeness and containment against brute force."""

import random

import pytest

from loomwright.operators import matching, similarity
from loomwright.plans.catalog import QUERIES
from loomwright.plans.q_joins import preferences
from loomwright.plans.views import Tables


def edited(text, n, rng):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice("abcé ") + text[i:] if rng.random() < 0.5 else text[:i] + text[i + 1 :]
    return text


def listing():
    """Texts and near ones: edits at the front alone, behind character 60 alone, and anywhere; of lengths from 0 on."""
    rng = random.Random(5)
    left = [("likes" if i % 2 else "dislikes", i, "".join(rng.choice("abcdefgh ié") for _ in range(rng.choice([0, 1, 4, 5, 9, 12, 30, 80, 150])))) for i in range(90)]
    right = []
    for j, (label, _, text) in enumerate(left):
        other = {"likes": "dislikes", "dislikes": "likes"}[label] if j % 7 == 0 else label
        n = rng.randrange(0, len(text) // 4 + 2)
        near = edited(text[:20], n, rng) + text[20:] if j % 3 == 0 else text[:61] + edited(text[61:], n, rng) if j % 3 == 1 else edited(text, n, rng)
        right.append((other, 1000 + j, near))
    return left + left[:5], right + right[:5]


@pytest.mark.parametrize("least", [90.0, 80.0, 66.0])
def test_fuzzy_match_loses_no_pair(spark, least):
    left, right = listing()
    schema = "label string, k int, text string"
    a, b = spark.createDataFrame([*left, ("likes", 500, None)], schema), spark.createDataFrame([*right, ("likes", 2000, None)], schema)
    got = sorted((r.k, r.matched, r.n_entries, r.first_entry, r.ratio) for r in similarity.fuzzy_match(a, b, least, ["label"], "k").collect())
    want = [(500, "No", 0, None, None)]
    for label, k, text in left:
        hits = [(j, similarity.ratio(text, x)) for other, j, x in right if other == label and similarity.ratio(text, x) >= least]
        want.append((k, "Yes", len(hits), min(h[0] for h in hits), round(max(h[1] for h in hits), 6)) if hits else (k, "No", 0, None, None))
    assert got == sorted(want) and 20 < sum(w[1] == "Yes" for w in want) < len(want)
    assert similarity.fuzzy_match(a.limit(0), b, least, ["label"], "k").count() == 0 and similarity.fuzzy_match(a, b.limit(0), least, ["label"], "k").where("matched = 'Yes'").count() == 0


def test_fuzzy_query_over_whole_texts(spark, small):
    said, listed = (df.collect() for df in preferences(Tables(spark, small)))
    got = {(r.conv_id, r.turn): (r.matched, r.n_entries, r.first_entry) for r in QUERIES["jon_17_fuzzy_join"](spark, small).collect()}
    for r in said:
        hits = [x.entry for x in listed if x.label == r.label and similarity.ratio(r.text, x.text) >= 90]
        assert got[r.conv_id, r.turn] == (("Yes", len(hits), min(hits)) if hits else ("No", 0, None))
    assert {"Yes", "No"} == {g[0] for g in got.values()}


def test_low_ratios_are_refused():
    assert [similarity.gram_size(x) for x in (99.0, 90.0, 70.0, 50.0)] == [3, 3, 2, 1]
    with pytest.raises(ValueError):
        similarity.gram_size(0.0)


@pytest.mark.parametrize("seed", [0, 1])
def test_best_match_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 400)}"  # noqa: E731  some tokens are in nearly every row
    targets = [(b, i, [word() for _ in range(rng.randrange(0, 25))]) for b in ("x", "y") for i in range(25)]
    cands = [(b, j, [word() for _ in range(rng.randrange(0, 60))]) for b in ("x", "y", "z") for j in range(120)]
    cands += [(b, 500 + i, t[: rng.randrange(len(t) + 1)] + ["w1"]) for b, i, t in targets[::4]]
    schema = "block string, {} int, tokens array<string>"
    a, b = spark.createDataFrame(targets, schema.format("t")), spark.createDataFrame(cands, schema.format("c"))
    got = {(r.block, r.t): (r.c, r.overlap) for r in matching.best_match(a, b, "t", "c", ["block"]).collect()}
    want = {}
    for k, i, t in targets:
        best = min(((-len(set(t) & set(c)), j) for x, j, c in cands if x == k), default=(0, 0))
        if best[0]:
            want[k, i] = (best[1], -best[0])
    assert got == want and max(v[1] for v in want.values()) > 8
    assert matching.best_match(a, b.limit(0), "t", "c", ["block"]).count() == 0


def pieces(rng, n):
    base = "".join(rng.choice("ab cé") for _ in range(300))
    return [base[(i := rng.randrange(260)) : i + rng.choice([0, 1, 2, 3, 5, 8, 13, 24, 25, 40])] for _ in range(n)]


@pytest.mark.parametrize("sizes", [(1, 2, 4, 8, 16, 32), (1, 24), (3,)])
def test_holding_against_all_pairs(spark, sizes):
    rng = random.Random(7)
    needles = [(b, t, i) for b in (1, 2) for i, t in enumerate(pieces(rng, 60))]
    needles = [n for n in needles if len(n[1]) >= min(sizes) or not n[1]]
    hays = [(b, "".join(pieces(rng, 3)), 100 + i) for b in (1, 2, 3) for i in range(40)] + [(1, n[1], 7) for n in needles[:5]] + [(2, None, 0)]
    n, h = (spark.createDataFrame(x, "block int, text string, pos int") for x in (needles, hays))
    for per, x, y, inside in (("needle", needles, hays, lambda a, b: a in b), ("hay", hays, needles, lambda a, b: b in a)):
        want = {}
        for b, t, _ in x:
            if t is not None and (hits := [p for c, u, p in y if c == b and u is not None and inside(t, u)]):
                want[b, t] = min(hits)
        assert {(r.block, r.text): r["first"] for r in matching.holding(n, h, ["block"], per, sizes).collect()} == want


def test_turns_are_located_either_way(spark):
    turns = spark.createDataFrame([(1, 0, "the whole of it"), (1, 1, "whole"), (1, 2, "the whole of it"), (2, 0, "other"), (3, 5, "")], "c int, p int, s string")
    want = spark.createDataFrame([(1, 10, "the whole of it"), (1, 11, "hole of"), (1, 12, "see the whole of it now"), (1, 13, "nowhere"), (2, 14, "whole"), (3, 15, "x"), (1, 16, None)], "c int, k int, s string")
    got = sorted((r.k, r.pos, r.how) for r in matching.locate_turn(want, turns, "c", "k", "s", "p").collect())
    assert got == [(10, 0, "exact"), (11, 0, "contained"), (12, 0, "contained"), (15, 5, "contained")]


def test_targets_in_a_store(spark):
    items = spark.createDataFrame([(1, 1, " The Long Expected Text Of It And More"), (1, 2, "short"), (1, 3, " "), (1, 4, None), (2, 5, "short"), (2, 6, "the long expected text of it")], "run int, item int, expected_text string")
    entries = spark.createDataFrame([(1, 9, "xx the long expected text of xx"), (1, 4, "a SHORT one"), (1, 3, "THE LONG EXPECTED TEXT O"), (2, 1, "the long expected text"), (2, 2, None)], "run int, entry_id int, text string")
    got = {r.item: (r.in_store, r.first_entry) for r in matching.target_in_store(items, entries, "run", "item").collect()}
    assert got == {1: (True, 3), 2: (True, 4), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None)}



def test_few_places_stand_for_the_windows_of_a_text(spark):
    """Far fewer rows than characters are dealt out, and none of them with a text; any part of a text has its places among the text's own."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh é😀") for _ in range(3000)) for _ in range(20)]
    rows = [(i, t, [24]) for i, t in enumerate(texts)] + [(100 + i, t[(k := rng.randrange(2000)) : k + 24 + i], [24]) for i, t in enumerate(texts)]
    got = matching.windows(spark.createDataFrame(rows, "no int, text string, sizes array<int>"), ["no"])
    assert got.columns == ["no", "s", "h", "at", "start"]
    held = {}
    for r in got.collect():
        held.setdefault(r.no, set()).add(r.h)
    assert sum(len(held[i]) for i in range(20)) < 20 * 3000 / 5 and all(held[100 + i] and held[100 + i] <= held[i] for i in range(20))


def test_holding_where_needles_share_their_beginnings(spark):
    start = "please do remember that I "
    needles = [(1, start + f"like number {i}", i) for i in range(300)]
    hays = [(1, f"{i} well, " + start + f"like number {i} and no other, " + start, 1000 + i) for i in range(0, 600, 2)]
    n, h = (spark.createDataFrame(x, "block int, text string, pos int") for x in (needles, hays))
    want = {t: min(p for _, u, p in hays if t in u) for _, t, _ in needles if any(t in u for _, u, _ in hays)}
    assert {r.text: r["first"] for r in matching.holding(n, h, ["block"], "needle").collect()} == want and len(want) > 150


def test_vector_lists_find_what_the_exact_search_finds(spark, small):
    t = Tables(spark, small)
    q = t.embeddings.where("vec_id % 10 = 0")
    exact = {(r.query_id, r.vec_id) for r in similarity.topk_cosine(q, t.embeddings, "vec_id", "embedding", 5, rows_each=100).collect()}
    index = similarity.Lists(t.embeddings, "vec_id", "embedding")
    probes = index.probes(q, t.embeddings, 5, 0.97)
    found = {(r.query_id, r.vec_id) for r in similarity.topk_lists(q, t.embeddings, "vec_id", "embedding", 5, index, rows_each=100).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) == 5 * q.count() and 1 <= probes <= len(index.centres)
    every = {(r.query_id, r.vec_id) for r in similarity.topk_lists(q, t.embeddings, "vec_id", "embedding", 5, index, probes=len(index.centres)).collect()}
    assert every == exact
    assert similarity.topk_lists(q, t.embeddings.limit(0), "vec_id", "embedding", 5).count() == 0


def test_clustered_vectors_need_few_lists(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, (c + 0.1 * rng.normal(size=8)).tolist()) for c in 5 * rng.normal(size=(12, 8)) for i in range(60)]
    rows = [(k, v) for k, (_, v) in enumerate(rows)] + [(9001, [0.0] * 8), (9002, None), (9003, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    index = similarity.Lists(df, "vec_id", "embedding")
    assert len(index.centres) == 26 and index.probes(df.where("vec_id < 700"), df, 5, 0.97) <= 6


def test_candidates_are_counted_without_dealing_out_pairs(spark):
    """Each text of the left, with the number of those on the right that share a gram of the heads; in one tile or in many."""
    left, right = (spark.createDataFrame([(b, i, t) for i, (b, t) in enumerate(sorted({(r[0], r[2]) for r in side}))], "label string, no long, text string") for side in listing())
    one = {tuple(r) for r in similarity.fuzzy_candidates(left, right, 80.0, ["label"]).collect()}
    tiles = similarity._fuzzy_tiles(left, right, 80.0, ["label"], lambda x, y, k: __import__("pandas").DataFrame([(x["no"].iat[i], y["no"].iat[j]) for i, found in (similarity._partners(x, y, k) if len(x) and len(y) else []) for j in found], columns=["a", "b"]), "a long, b long", rows_each=5)
    pairs = [tuple(r) for r in tiles.collect()]
    assert len(set(pairs)) == len(pairs) and one == {(a, sum(p[0] == a for p in pairs)) for a, _ in pairs} and len(one) > 20


def test_tiles_keep_ties_by_key_and_leave_odd_vectors_out(spark):
    """Copies in tiles of few rows: the smaller keys come first; null, zero and shorter vectors are like none. One tile adds k rows for a query."""
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(60)] + [(100, [0.0] * 3), (101, None), (102, [1.0, None, 0.5]), (103, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = {}
    for r in sorted(similarity.topk_cosine(df, df, "vec_id", "embedding", 4, rows_each=7).collect(), key=lambda r: (r.query_id, -r.sim, r.vec_id)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: [j for j in range(i % 3, 60, 3) if j != i][:4] for i in range(60)}
    assert {r.query_id: r.vec_id for r in similarity.closest_of(df, df, "vec_id", "embedding", []).collect()} == {i: j[0] for i, j in got.items()}
    assert similarity._nearest(df, df, "vec_id", "embedding", [], 4, 1000).count() == 4 * 60


def conflicts_by_loops(cands, later, edges):
    parent = {}
    for child, up in edges:
        if up is not None and up != child:
            parent[child] = max(up, parent.get(child, up))

    def above(node):
        seen, at = [], parent.get(node)
        while at is not None and at != node and at not in seen:
            seen.append(at)
            at = parent.get(at)
        return seen

    norm = lambda xs: {str(x).strip().lower() for x in xs if x is not None} - {""}
    want = []
    for conv, cand, stage, values, context, tokens in cands:
        for conv_, rec, stage_, values_, context_, tokens_ in later:
            if conv == conv_ and stage_ > stage:
                a, b = ({x for x in t if x is not None} for t in (tokens, tokens_))
                n = len(a & b)
                found = {"value": norm(values) & norm(values_), "context": norm(context) & norm(context_), "lineage": cand in above(rec), "goal": n >= 4 and (n / len(a | b) >= 0.5 or n / min(len(a), len(b)) >= 0.7)}
                want += [(conv, cand, rec, kind) for kind, is_so in found.items() if is_so]
    return sorted(want)


def test_future_conflicts_equal_loops(spark):
    """Cycles, forks, ancestors in other conversations, several shared entries, missing tokens, and more frequent tokens than are put in order."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        tokens = [None if x == 3 else f"t{int(x)}" for x in (rng.paretovariate(0.4) for _ in range(rng.randrange(0, 9)))] if i % 3 else [rng.choice([*"abcdef", None]) for _ in range(rng.randrange(0, 9))]
        if i % 5 == 0:
            tokens = [*"abc", None]
        rows.append((i % 4, i, rng.randrange(4), [rng.choice([" A", "a", "b", "", None, *map(str, range(40))]) for _ in range(rng.randrange(3))], [rng.choice(["k1", "K1 ", "k2", *map(str, range(60))]) for _ in range(rng.randrange(3))], tokens))
    # Most nodes hang below an earlier one; 20 to 39 lie on or below cycles, and some have two parents, none, or themselves.
    edges = [(i, i - rng.choice([1, 2, 4, 4, 4, 4])) for i in range(240) if i >= 4 and i % 17] + [(i, i + 4) for i in range(20, 36, 4)] + [(36, 36), (40, None), (41, 33)]
    cands, later = [r for r in rows if r[2] < 2], rows
    schema = "conv long, id long, stage_order int, values array<string>, context array<string>, tokens array<string>"
    a, b, e = (spark.createDataFrame(x, y) for x, y in ((cands, schema), (later, schema), (edges, "child long, parent long")))
    want = conflicts_by_loops(cands, later, edges)
    assert {w[3] for w in want} == {"value", "context", "lineage", "goal"}
    assert sorted(map(tuple, matching.future_conflicts(a, b, e, "conv").select("conv", "cand_id", "later_id", "kind").collect())) == want
    goals = sorted(w[:3] for w in want if w[3] == "goal")
    assert sorted(map(tuple, matching.similar_goals(a, b, "conv", often=2).collect())) == goals


def test_lineage_makes_a_row_for_a_record(spark, monkeypatch):
    """A chain of 300 below one candidate has 44,850 pairs of ancestors; only those that end in a candidate are made."""
    cut, made = matching._cut, []
    monkeypatch.setattr(matching, "_cut", lambda df: (lambda out: (made.append(out.count()), out)[1])(cut(df)))
    rows = [(0, i, int(i > 0), [], [], []) for i in range(300)]
    schema = "conv long, id long, stage_order int, values array<string>, context array<string>, tokens array<string>"
    later = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 300)], "child long, parent long")
    got = matching.future_conflicts(later.where("stage_order = 0"), later, edges, "conv").collect()
    assert sorted(map(tuple, got)) == [(0, 0, i, "lineage") for i in range(1, 300)]
    assert max(made) <= 300
