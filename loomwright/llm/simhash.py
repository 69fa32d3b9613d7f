"""Near-duplicates by SimHash with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import cut, few_or_merge, slices, stash, word_runs
from loomwright.llm.components import components
from loomwright.operators.indexing import global_index

BITS = 64


def fingerprint(data: bytes | None, size: int = 4, seed: int = 42) -> int:
    """SimHash of one UTF-8 text over its shingles of words, A-Z lower-cased: a bit is 1 if set in over half of the shingles' XXH64."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_runs(data or b"", 1 << 20):
        words = tail + words
        if len(words) >= size:
            line = b" ".join(words).lower()
            length = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(length + 1) - 1
            view = memoryview(line)
            h = [xxh(view[a:b], seed) for a, b in zip((end - length)[: len(words) - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)]
            n += len(h)
            ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        tail = words[-(size - 1) :] if size > 1 else []
    if not n and tail:
        n, ones = 1, np.unpackbits(np.array([xxh(b" ".join(tail).lower(), seed)], ">u8").view(np.uint8)).astype(np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0]) if n else 0


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", size: int = 4) -> DataFrame:
    """The key columns and fp, the fingerprint as a signed long, of each row. A null or blank text has fingerprint 0."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            fp = np.array([fingerprint(t, size) for t in b.column(len(keys)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(fp)], names=[*keys, "fp"])

    schema = T.StructType([*[T.StructField(k, docs.schema[k].dataType) for k in keys], T.StructField("fp", T.LongType())])
    return docs.select(*keys, F.col(text_col).cast("binary").alias("_lw_text")).mapInArrow(each, schema)


def segments(words: DataFrame, bits: int, wildcard: bool) -> DataFrame:
    """Columns key and those of words but word and fp, where words has word (a number) and fp: one row for each segment of fp,
    or with wildcard for each one-wildcard variant of a segment.

    bits // 2 + 1 segments: of at most `bits` differing bits some segment holds at most one, and two
    segments that differ in at most one bit share the variant that leaves this bit out.
    """
    parts = bits // 2 + 1
    starts = [BITS * i // parts for i in range(parts + 1)]
    lo = "CASE " + " ".join(f"WHEN bit < {b} THEN {a}" for a, b in zip(starts, starts[1:], strict=False)) + " END"
    mask = "CASE " + " ".join(f"WHEN bit < {b} THEN {(1 << (b - a)) - 1}L" for a, b in zip(starts, starts[1:], strict=False)) + " END"
    rest = [c for c in words.columns if c not in ("word", "fp")]
    at = F.sequence(F.lit(0), F.lit(BITS - 1)) if wildcard else F.array(*map(F.lit, starts[:-1]))
    left = f"& ~shiftleft(1L, bit - {lo})" if wildcard else ""
    every = words.select(*rest, "word", "fp", F.explode(at).alias("bit"))
    return every.select(F.expr(f"((shiftrightunsigned(fp, {lo}) & {mask} {left}) * 1024) + word * {BITS} + bit").alias("key"), *rest)


def once(a: Column, b: Column, bits: int) -> Column:
    """Of the variants that two fingerprints share, whether the one in the column key is the first: that of the first
    segment in which they differ in at most one bit, without this bit, or without the segment's first bit where they are equal."""
    parts = bits // 2 + 1
    starts = [BITS * i // parts for i in range(parts + 1)]
    apart, bit = a.bitwiseXOR(b), F.pmod("key", F.lit(BITS)).cast("int")
    first, before = F.lit(False), F.lit(True)
    for lo, hi in zip(starts, starts[1:], strict=False):
        part = F.shiftrightunsigned(apart, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        mine = (bit >= lo) & (bit < hi) & F.when(part == 0, bit == lo).otherwise(part == F.expr(f"shiftleft(1L, CAST(pmod(key, {BITS}) AS INT) - {lo})"))
        first, before = first | (before & mine), before & (F.bit_count(part) > 1)
    return first


def linked(words: DataFrame, bits: int, near: Callable[[Column, Column], Column], confirm: Callable[[DataFrame], DataFrame], back: int = 4, dense: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Columns node, root: components over all pairs of nodes that share a variant, are near and are kept by confirm.

    words has node, word and fp; near compares two nodes, which are longs. Exact, with no cap, and without writing all
    pairs of a variant. First the nodes of each whole segment are chained: for each of its segments a node meets the least and
    the greatest of those that stand before it or first, which joins dense groups at little cost. Then variants are
    made, with each node's component so far, and only those whose nodes lie in several components are looked at: a node
    meets the first and the `back` before it, which is all there is to compare where back + 1 or fewer hold the variant.
    Of larger ones that still lie in several components, each node outside the commonest is compared with those of others; two
    nodes that share many variants of a word meet in the first of them only. Where a quarter of a variant's nodes or
    more were near one that they met, and the commonest component holds several, dense may take over: it gets spots (node, root, main, the commonest), the components and the links so far, and
    returns the components with all links between a spot outside its main and others of that main.
    """
    col, w = F.col, Window.partitionBy("key")
    words = words.withColumn("own", col("fp"))
    ties = ["least", *[f"back{i}" for i in range(1, back + 1)]]
    apart = lambda t: (col(t) != col("node")) & near(col(t), col("node"))

    def met(rows: DataFrame) -> DataFrame:
        both = F.struct("node", "own", "root")
        return rows.withColumn("least", F.min(both).over(w)).withColumns({f"back{i}": F.lag(both, i).over(w.orderBy("node")) for i in range(1, back + 1)})

    def ends(rows: DataFrame, *by: str) -> DataFrame:
        """node and t, the least and the greatest of the array ts in each group of by."""
        most = rows.groupBy(*by).agg(F.min(F.array_min("ts")).alias("x"), F.max(F.array_max("ts")).alias("y")).where("x IS NOT NULL")
        return most.select("node", F.explode(F.array("x", "y")).alias("t"))

    def near_ones(when: Callable[[str], Column]) -> Column:
        """Of the ties of a row with met() the nodes of other components that it is to be compared with."""
        return F.array_compact(F.array(*[F.when((col(f"{t}.root") != col("root")) & apart(f"{t}.node") & when(t), col(f"{t}.node")) for t in ties]))

    pair = lambda df, t: df.select(F.least("node", t).alias("a"), F.greatest("node", t).alias("b"))
    first = met(segments(words.withColumn("root", col("node")), bits, False)).select("node", (col("key") % 1024).alias("place"), near_ones(lambda t: F.lit(True)).alias("ts"))
    links = cut(confirm(pair(ends(first, "node", "place"), "t").distinct()))
    known = cut(components(links))

    placed = words.hint("merge").join(known.hint("merge"), "node", "left").select("word", "fp", "node", F.coalesce("root", "node").alias("root"), "own")
    open_ones = segments(placed, bits, True).withColumns({"k": F.count("*").over(w), "lo": F.min("root").over(w), "hi": F.max("root").over(w)}).where("lo <> hi").select("key", "node", "root", "own", "k")
    # Where few hold a variant all are compared, but two nodes only in the first variant that they share.
    new = lambda t: once(col("own"), col(f"{t}.own"), bits)
    few, many = col("k") <= back + 1, col("k") > back + 1
    held = met(open_ones).select("key", "node", "own", "k", reduce(lambda x, y: x | y, [F.coalesce(apart(f"{t}.node"), F.lit(False)) for t in ties]).alias("tied"), near_ones(lambda t: many | new(t)).alias("ts"))
    held = stash(held.where(many | (F.size("ts") > 0)))
    some = held.where(few).select("node", F.explode("ts").alias("t"))
    more = cut(confirm(pair(some, "t").union(pair(ends(held.where(many), "node"), "t")).distinct()))
    known = cut(components(known.select(col("node").alias("a"), col("root").alias("b")).union(more)))

    marked = held.where(many).select("key", "node", "own", "k", "tied").hint("merge").join(known.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = marked.withColumns({"lo": F.min("root").over(w), "hi": F.max("root").over(w), "ties": F.count_if("tied").over(w)}).where("lo <> hi")
    marked = marked.withColumn("n", F.count("*").over(Window.partitionBy("key", "root"))).withColumn("main", F.max(F.struct("n", "root")).over(w))
    mixed = stash(marked.select("key", "node", "own", "root", col("main.root").alias("main"), ((col("main.n") > 1) & (4 * col("ties") >= col("k"))).alias("dense")))
    if mixed.isEmpty():
        return known
    if dense is not None:
        known = dense(cut(mixed.where("dense").select("node", "root", "main").distinct()), known, links.union(more))
        mixed = mixed.where("NOT dense").drop("root").hint("merge").join(known.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = mixed.where("root <> main").select("key", col("node").alias("t"), col("root").alias("other"), col("own").alias("t_own"))
    last = mixed.hint("merge").join(rest.hint("merge"), "key").where((col("root") != col("other")) & once(col("own"), col("t_own"), bits) & apart("t"))
    last = cut(confirm(pair(last, "t").distinct()))
    # New links together with those so far, which stand as components.
    return known if last.isEmpty() else components(known.select(col("node").alias("a"), col("root").alias("b")).union(last))


def through_hubs(spots: DataFrame, known: DataFrame, links: DataFrame, confirm: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame], bounds: DataFrame, tenths: int, salts: int = 16) -> DataFrame:
    """Columns node, root: the components known joined by all links of a similarity of tenths / 10 or more between a node outside
    a main component and any other node, where both are spots (node, root, main) of that main.

    Each node outside is first compared with four hubs of the main, the nodes with most links so far. For those that stay
    outside, an order of shingles that puts the rare ones first gives a prefix: two sets of na and nb shingles that are alike
    share at least c = tenths * (na + nb) / (10 + tenths), so one that they share stands in both among the first na - c + 1 and
    nb - c + 1. A set that is not alike with a hub has more shingles that the hub lacks than that, if the other is not smaller
    than the hub, so a node outside mostly meets only those with which it shares something that sets both apart from the main. No
    link is lost. whole gives node, n and set of the nodes in the column node; bounds has node and BOUNDS.
    """
    col = F.col
    seen = links.select(col("a").alias("node")).union(links.select(col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    best = seen.hint("merge").join(known.hint("merge"), "node").groupBy(col("root").alias("main"), F.pmod(F.xxhash64("node"), F.lit(4)).alias("part")).agg(F.max(F.struct("links", "node")).alias("best"))
    mains = spots.select("main").distinct()
    hubs = cut(mains.hint("merge").join(best.hint("merge"), "main", "left").select("main", F.coalesce("best.node", "main").alias("hub"), F.coalesce("best.links", F.lit(0)).alias("links")))
    tried = spots.where("root <> main").select("node", "main").join(few_or_merge(hubs.select("main", "hub")), "main").where("node <> hub")
    new = cut(confirm(tried.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()))
    known = cut(components(known.select(col("node").alias("a"), col("root").alias("b")).union(new)))

    hub = cut(hubs.groupBy("main").agg(F.max(F.struct("links", "hub")).alias("hub")).select("main", col("hub.hub").alias("hub")))
    roots = known.select("node", col("root").alias("now"))
    held = hub.hint("merge").join(roots.select(col("node").alias("main"), col("now").alias("home")).hint("merge"), "main", "left").select("main", "hub", F.coalesce("home", "main").alias("home"))
    at = spots.select("node", "main").hint("merge").join(roots.hint("merge"), "node", "left").select("node", "main", F.coalesce("now", "node").alias("root"))
    at = stash(at.join(few_or_merge(cut(held)), "main").withColumn("out", col("root") != col("home")))
    busy = cut(at.where("out").select("main").distinct())
    if busy.isEmpty():
        return known
    at = stash(at.join(few_or_merge(busy), "main", "left_semi"))
    sets = whole(at.select("node").distinct())
    # How common shingles are among the nodes of a main is learned from at most 16 of them; any order loses nothing.
    some = at.groupBy("main", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(16)).alias("part")).agg(F.min("node").alias("node")).select("main", "node")
    common = some.hint("merge").join(sets.hint("merge"), "node").select("main", F.explode("set").alias("shingle")).groupBy("main", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = common.groupBy("main").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    common = cut(common.select("main", F.transform("common", lambda x: x["shingle"]).alias("common")))
    sets = sets.hint("merge").join(bounds.hint("merge"), "node")
    # The nodes of one main are parted over several tasks, each with this list.
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = at.hint("merge").join(sets.hint("merge"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    both = mine.hint("merge").join(salted.hint("merge"), ["main", "salt"], "left")
    common = F.coalesce("common", F.array().cast("array<bigint>"))
    order = F.concat(F.array_sort(F.array_except("set", common)), F.array_intersect(common, "set"))
    firsts = F.slice(order, 1, F.floor(col("n") * (10 - tenths) / 10).cast("int") + 1)
    rows = both.select("node", "root", "main", "out", "n", *BOUNDS, F.posexplode(firsts).alias("rank", "shingle"))
    # The size of the largest set that may still be alike with one of n shingles, if the first that both hold has this rank (from 0).
    rows = rows.withColumn("most", F.floor((10 + tenths) * (col("n") - col("rank")) / tenths).cast("long") - col("n"))
    least = cut(at.select("node", "main").hint("merge").join(sets.select("node", "n").hint("merge"), "node").groupBy("main").agg(F.min("n").alias("least")))
    rows = stash(rows.join(few_or_merge(least), "main").where("most >= least").drop("least"))
    a = rows.where("out").select("main", "shingle", col("node").alias("a"), col("root").alias("a_root"), col("n").alias("an"), col("most").alias("a_most"), *[col(p).alias(f"a_{p}") for p in BOUNDS])
    b = rows.select("main", "shingle", col("node").alias("b"), col("root").alias("b_root"), col("n").alias("bn"), col("most").alias("b_most"), "out", *[col(p).alias(f"b_{p}") for p in BOUNDS])
    met = a.hint("merge").join(b.hint("merge"), ["main", "shingle"]).where((col("a_root") != col("b_root")) & (col("bn") <= col("a_most")) & (col("an") <= col("b_most")) & (~col("out") | (col("a") < col("b"))) & may_be_alike("a", "b", tenths))
    last = cut(alike(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets.select("node", "n", "set"), tenths))
    return known if last.isEmpty() else cut(components(known.select(col("node").alias("a"), col("root").alias("b")).union(last)))


def classes(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Columns fp, root for the fingerprints linked to another at `bits` or fewer differing bits: exact, with no cap."""
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits
    words = fps.select(F.col("fp").alias("node"), F.lit(0).alias("word"), "fp").distinct()
    return linked(words, bits, near, lambda pairs: pairs).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Nulls: a null or blank text has the zero fingerprint and links like any other; a null id never names a
    component unless all its ids are null. Repeated rows give repeated results; an empty table gives none.
    """
    fp = cut(fingerprints(docs, [id_col], text_col, size))
    ids = fp.groupBy("fp").agg(F.min(id_col).alias("rep"))
    root = cut(classes(ids, bits))
    reps = cut(ids.join(root.hint("merge"), "fp", "left").select("fp", "rep", "root"))
    # Fingerprints without links name themselves; for the others the least id of a component is found first and then joined,
    # so that both sides of the join are plain shuffles, which Spark splits where a component is large.
    least = cut(reps.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least")))
    named = reps.join(least.hint("merge"), "root", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return fp.join(named.hint("merge"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(data: bytes | None, size: int = 5, seed: int = 42):
    """The distinct XXH64 of one UTF-8 text's shingles of words, A-Z lower-cased, in ascending order; a shorter text is one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    out, tail, n = [], [], 0
    for words in word_runs(data or b"", 1 << 20):
        words = tail + words
        if len(words) >= size:
            line = b" ".join(words).lower()
            length = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(length + 1) - 1
            view = memoryview(line)
            out.append(np.unique(np.array([xxh(view[a:b], seed) for a, b in zip((end - length)[: len(words) - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)], np.uint64)))
            n += 1
        tail = words[-(size - 1) :] if size > 1 else []
    if not n:
        return np.array([xxh(b" ".join(tail).lower(), seed)], np.uint64)
    return out[0] if n == 1 else np.unique(np.concatenate(out))


def mixed_hashes(h, k: int):
    """Hashes for the k-th fingerprint word: those of word 0 are the shingles' own, others are these multiplied and folded."""
    import numpy as np

    if k:
        h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def set_words(hashes, count: int):
    """SimHash words of a set of 64-bit hashes: a bit of a word is 1 if set in over half of that word's hashes."""
    import numpy as np

    out = np.zeros(count, np.uint64)
    for k in range(count):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = mixed_hashes(hashes[at : at + (1 << 16)], k)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return out


#: Columns of a set that bound what it can share with another: its size, and 256 bits that each of its hashes flips one of.
BOUNDS = ["size", "p0", "p1", "p2", "p3"]


def parity(hashes):
    """256 bits as four longs, of which each hash flips the one that its own lowest bits name."""
    import numpy as np

    return np.packbits((np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def may_be_alike(a: str, b: str, tenths: int) -> Column:
    """Whether BOUNDS, prefixed a and b, allow a Jaccard similarity of tenths / 10: where bits differ hashes do, and sets that are
    alike differ in few. True for all that are alike."""
    c = lambda side, name: F.col(f"{side}_{name}")
    total = c(a, "size") + c(b, "size")
    differ = reduce(lambda x, y: x + y, [F.bit_count(c(a, p).bitwiseXOR(c(b, p))) for p in BOUNDS[1:]])
    return (10 * F.least(c(a, "size"), c(b, "size")) >= tenths * F.greatest(c(a, "size"), c(b, "size"))) & ((10 + tenths) * differ <= (10 - tenths) * total)


def marked_sets(docs: DataFrame, keys: list[str], text_col: str, size: int, count: int) -> DataFrame:
    """The key columns, set_hash of the text's set of shingles, f0, f1, ..., the SimHash words of this set, and BOUNDS."""
    names = [f"f{k}" for k in range(count)]

    def each(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as xxh

        for b in slices(batches):
            sets = [shingles(t, size) for t in b.column(len(keys)).to_pylist()]
            whole = np.array([xxh(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            words = np.array([set_words(x, count) for x in sets], np.uint64).reshape(-1, count).view(np.int64)
            bounds = np.array([[len(x), *parity(x)] for x in sets], np.int64).reshape(-1, len(BOUNDS))
            columns = [*[words[:, k] for k in range(count)], *[bounds[:, k] for k in range(len(BOUNDS))]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(whole), *[pa.array(c.copy()) for c in columns]], names=[*keys, "set_hash", *names, *BOUNDS])

    schema = T.StructType([*[T.StructField(k, docs.schema[k].dataType) for k in keys], *[T.StructField(k, T.LongType()) for k in ("set_hash", *names, *BOUNDS)]])
    return docs.select(*keys, F.col(text_col).cast("binary").alias("_lw_text")).mapInArrow(each, schema)


def shingle_sets(docs: DataFrame, key: str, text_col: str = "text", size: int = 5) -> DataFrame:
    """The key, n, the size of the text's set of shingles, and set, its hashes as signed longs."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches, 100):
            sets = [shingles(t, size) for t in b.column(1).to_pylist()]
            n = np.fromiter(map(len, sets), np.int32, len(sets))
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), held], names=[key, "n", "set"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.IntegerType()), T.StructField("set", T.ArrayType(T.LongType()))])
    return docs.select(key, F.col(text_col).cast("binary").alias("_lw_text")).mapInArrow(each, schema)


def alike(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Of the distinct pairs a, b those whose sets have a Jaccard similarity of tenths / 10 or more."""
    one = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("set").alias("a_set")).hint("merge"), "a")
    both = one.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("set").alias("b_set")).hint("merge"), "b")
    both = both.where(10 * F.least("an", "bn") >= tenths * F.greatest("an", "bn"))
    shared = both.select("a", "b", (F.col("an") + F.col("bn")).alias("sum"), F.size(F.array_intersect("a_set", "b_set")).alias("shared"))
    return shared.where(10 * F.col("shared") >= tenths * (F.col("sum") - F.col("shared"))).select("a", "b")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, tenths: int = 8, count: int = 6) -> DataFrame:
    """The documents, one of each group of near-duplicates: the smallest id (null last), then the smallest text hash.

    Near-duplicates are texts whose sets of shingles of `size` words have a Jaccard similarity of tenths / 10 or more.
    Candidates come from `count` SimHash words of the set, each indexed by deletion variants as for classes(): a pair is one
    if some segment of some word differs in at most one bit. Candidates that also differ in under a quarter of all bits,
    and whose BOUNDS do not exclude the similarity, are then compared on their whole sets, so no pair below the similarity is linked. At 0.8 a bit differs with probability
    0.151, and 6 words find a link with probability 0.94 (0.99 at 0.85, over 0.999 at 0.9); copies of one set are always found.
    Null and blank texts are alike. Of rows repeating both id and text one stays. Columns stay as they were; an empty
    table gives none.
    """
    keyed = docs.withColumn("_lw_hash", F.xxhash64(text_col))
    names = [f"f{k}" for k in range(count + 1)]
    rows = cut(marked_sets(keyed, [id_col, "_lw_hash"], text_col, size, count + 1).groupBy(id_col, "_lw_hash", "set_hash", *names, *BOUNDS).agg(F.count("*").alias("n")))
    me = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_lw_hash").alias("h"), "n")
    # A set's name is its number and, behind that, 28 bits of the word that is not indexed: most chance meetings show there.
    sign = F.col(names[-1]).bitwiseAND(F.lit((1 << 28) - 1))
    sets = global_index(rows.groupBy("set_hash", *names, *BOUNDS).agg(F.min(me).alias("rep")), ["set_hash", *names, *BOUNDS], "number")
    sets = cut(sets.withColumn("node", F.shiftleft("number", 28) + sign).drop("number"))
    words = reduce(DataFrame.union, [sets.select("node", F.lit(k).alias("word"), F.col(f"f{k}").alias("fp")) for k in range(count)])
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit((1 << 28) - 1))) <= 9
    made: list[DataFrame] = []

    def shingled(numbers: DataFrame) -> DataFrame:
        """Whole shingle sets of the sets with these numbers; each is made once."""
        new = numbers
        for old in made:
            new = new.hint("merge").join(old.select("node").hint("merge"), "node", "left_anti")
        wanted = cut(sets.hint("merge").join(new.hint("merge"), "node").select("node", F.col("rep.id").alias("_lw_id"), F.col("rep.h").alias("_lw_h")))
        if not made or not wanted.isEmpty():
            texts = keyed.join(few_or_merge(wanted), keyed[id_col].eqNullSafe(F.col("_lw_id")) & (F.col("_lw_hash") == F.col("_lw_h"))).select("node", keyed[text_col].alias("_lw_whole"))
            held = shingle_sets(texts, "node", "_lw_whole", size)
            made.append(stash(held.dropDuplicates(["node"]) if repeated else held))
        return reduce(DataFrame.union, made)

    def confirm(pairs):
        fp = lambda side: sets.select(F.col("node").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in names + BOUNDS])
        both = pairs.hint("merge").join(fp("a").hint("merge"), "a").hint("merge").join(fp("b").hint("merge"), "b")
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in names])
        close = stash(both.where((4 * apart < BITS * len(names)) & may_be_alike("a", "b", tenths)).select("a", "b"))
        return alike(close, shingled(close.select(F.col("a").alias("node")).union(close.select("b")).distinct()), tenths)

    repeated = not sets.where("rep.n > 1").isEmpty()
    root = cut(linked(words, 4, near, confirm, dense=lambda spots, known, links: through_hubs(spots, known, links, confirm, shingled, sets.select("node", *BOUNDS), tenths)))
    grouped = sets.hint("merge").join(root.hint("merge"), "node", "left").select("set_hash", "rep", F.coalesce("root", "node").alias("root"))
    first = cut(grouped.groupBy("root").agg(F.min("rep").alias("first")))
    named = cut(grouped.hint("merge").join(first.hint("merge"), "root").select("set_hash", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h")))
    gone = rows.hint("merge").join(named.hint("merge"), "set_hash").where(~(F.col(id_col).eqNullSafe(F.col("first_id")) & (F.col("_lw_hash") == F.col("first_h"))))
    gone = cut(gone.select(F.col(id_col).alias("_lw_id"), F.col("_lw_hash").alias("_lw_h")))
    out = keyed.join(few_or_merge(gone), keyed[id_col].eqNullSafe(F.col("_lw_id")) & (F.col("_lw_hash") == F.col("_lw_h")), "left_anti")
    if repeated:
        out = out.dropDuplicates([id_col, "_lw_hash"])
    return out.drop("_lw_hash")
