"""Hard negatives by a multiway hyperplane tree whose split points know how far their siblings' rows lie from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import bounded_sample, stash

FAR = 2**63 - 1


def whole(lists, width: int):
    """floor(256 * x) of Arrow lists of numbers, as doubles (which hold it exactly), filled up with zeros to one width."""
    import numpy as np

    lists = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    with np.errstate(over="ignore"):
        out[np.arange(width)[None, :] < n[:, None]] = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    return np.clip(out, -1.7e308, 1.7e308), n


def products(a, b):
    """Whole inner products of all rows of a with all of b; what a long cannot hold is held at its ends."""
    import numpy as np

    reach = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(1, a.shape[1])
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    if reach < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
    return np.array([[max(-FAR - 1, min(FAR, x)) for x in r] for r in exact], np.int64).reshape(len(a), len(b))


class Tree:
    """Split points of a multiway tree in Euclidean space, fitted on a sample; rows belong to the nearest split point of a node.

    Rows are scaled and get one more component that brings all to one length, as queries get a zero there: then the
    distance of a query and a row falls exactly as their inner product rises. `ranges` holds for split point i and child j
    of a node the least and greatest distance from i to the rows of j.
    """

    def __init__(self, scale: float, top: float):
        self.scale, self.top, self.nodes, self.leaves = scale, top, [], 0

    def lifted(self, x, query: bool = False):
        import numpy as np

        y = x / self.scale
        rest = np.zeros(len(y)) if query else np.sqrt(np.maximum(0.0, self.top - (y * y).sum(1)))
        return np.column_stack([y, rest])

    def grow(self, x, rows: float, arity: int, leaf: int) -> int:
        """Fits the tree on lifted sample rows that stand for a number of rows; gives the number of the node, or of the leaf as -1 - n."""
        import numpy as np

        if rows <= leaf or len(x) < 2 * arity:
            return self._leaf()
        picked, near = [0], np.full(len(x), np.inf)
        while len(picked) < arity:  # farthest first, so split points stand apart
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
            if near.max() <= 1e-12 * self.top:
                break
            picked.append(int(near.argmax()))
        if len(picked) == 1:
            return self._leaf()
        me = len(self.nodes)
        self.nodes.append(None)
        points = x[picked]
        child = self.distances(x, points).argmin(1)
        kids = [self.grow(x[child == j], rows * (child == j).mean(), arity, leaf) for j in range(len(picked))]
        self.nodes[me] = [points, kids, np.full((len(picked),) * 2, np.inf), np.full((len(picked),) * 2, -np.inf)]
        return me

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    @staticmethod
    def distances(x, points):
        import numpy as np

        sq = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * x @ points.T
        return np.sqrt(np.maximum(0.0, sq))

    def leaf_of(self, x, note: bool = False):
        """The leaf of each lifted row; with note the ranges are widened to hold these rows."""
        import numpy as np

        out = np.zeros(len(x), np.int32)
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            points, kids, low, high = self.nodes[node]
            d = self.distances(x[rows], points)
            child = d.argmin(1)
            for j in range(len(kids)):
                mine = child == j
                if mine.any():
                    if note:
                        low[:, j] = np.minimum(low[:, j], d[mine].min(0))
                        high[:, j] = np.maximum(high[:, j], d[mine].max(0))
                    todo.append((kids[j], rows[mine]))
        return out

    def reached(self, q, least, most):
        """Pairs of a query and a leaf that the query's annulus may meet; q are lifted queries, least and most scaled inner products.

        A child is eliminated where for some split point the range of its rows and the annulus cannot meet: by the triangle
        inequality a row at distance r from the point lies between |d - r| and d + r from the query, d being the query's own.
        """
        import numpy as np

        length = (q * q).sum(1)
        slack = 1e-9 * (self.top + length)
        inner = np.sqrt(np.maximum(0.0, self.top + length - 2 * most - slack))
        outer = np.sqrt(np.maximum(0.0, self.top + length - 2 * least + slack))
        edge = np.sqrt(slack)
        out_q, out_leaf = [], []
        todo = [(0 if self.nodes else -1, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out_q.append(rows)
                out_leaf.append(np.full(len(rows), -1 - node, np.int32))
                continue
            points, kids, low, high = self.nodes[node]
            d = self.distances(q[rows], points)
            for j in range(len(kids)):
                nearest = np.maximum(d - high[:, j], low[:, j] - d).max(1)
                farthest = (d + high[:, j]).min(1)
                meet = (nearest <= outer[rows] + edge[rows]) & (farthest >= inner[rows] - edge[rows])
                if meet.any():
                    todo.append((kids[j], rows[meet]))
        return np.concatenate([np.zeros(0, np.int64), *out_q]), np.concatenate([np.zeros(0, np.int32), *out_leaf])


def fitted(rows: DataFrame, arity: int, leaf: int, sample: int, most_leaves: int, seed: int = 12):
    """A tree over rows with columns id and v, with exact ranges over all of them, and the rows' longest vector.

    Split points come from at most `sample` rows, those with the least seeded hash of the id. The ranges are minima and maxima
    over every row, taken per task and then merged; their number is that of the tree's split points, not of the rows.
    """
    import numpy as np

    n, width, scale = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    # A component is 1 + 256 * x at most; its square is taken after scaling, so that great magnitudes do not overflow.
    width, scale = width or 0, min(256.0 * min(float(scale or 0), 6e305) + 1, 1.7e308)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow((F.abs(x) * (256 / scale)) + F.lit(1 / scale), 2))
    top = (rows.agg(F.max(square)).first()[0] or 0.0) * (1 + 1e-9)
    tree = Tree(scale, top)
    leaf = max(leaf, math.ceil(n / most_leaves))
    if n > leaf:
        held = bounded_sample(rows.select("id", "v"), sample, "id", seed).toArrow()
        tree.grow(tree.lifted(whole(held.column("v"), width)[0]), n, arity, leaf)
    return tree, n, width


def with_leaf(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("leaf", T.IntegerType())])


def merge_ranges(tree: Tree, found) -> None:
    for r in found:
        _, _, low, high = tree.nodes[r.node]
        low[r.i, r.j], high[r.i, r.j] = r.low, r.high


def hung(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """rows with the column leaf, written once; the tree's ranges are set to hold all of them."""
    share = rows.sparkSession.sparkContext.broadcast(tree)

    def each(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                at_leaf = share.value.leaf_of(share.value.lifted(whole(part.column("v"), width)[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at_leaf)], names=[*part.schema.names, "leaf"])

    def ranges(batches):
        import copy

        import numpy as np
        import pyarrow as pa

        mine, out = copy.deepcopy(share.value), []
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                mine.leaf_of(mine.lifted(whole(b.slice(at, 2000).column("v"), width)[0]), note=True)
        for k, (_, _, low, high) in enumerate(mine.nodes):
            out += [(k, int(i), int(j), low[i, j], high[i, j]) for i, j in zip(*np.nonzero(np.isfinite(low)), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["node", "i", "j", "low", "high"])

    out = stash(rows.mapInArrow(each, with_leaf(rows)))
    if tree.nodes:
        found = out.select("v").mapInArrow(ranges, "node int, i int, j int, low double, high double")
        merge_ranges(tree, found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    return out


def visits(anchors: DataFrame, tree: Tree, width: int, home: bool, most: int = 20_000) -> DataFrame:
    """id of each of the anchors (with v, least and most, scores that matter) and the leaves to visit: the own one with home, else every one that
    the annulus of these scores may meet. A null bound is none. A visit carries no vector, and at most `most` of them leave a task at once:
    where ranges exclude little, an anchor visits every leaf."""
    share = anchors.sparkSession.sparkContext.broadcast(tree)

    def each(batches):
        import numpy as np
        import pyarrow as pa

        t = share.value
        bound = lambda c, none: np.array([none if x is None else float(x) for x in c.to_pylist()]) / t.scale / t.scale
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                x, ids = whole(part.column("v"), width)[0], part.column("id").to_numpy()
                if home:
                    q, leaf = np.arange(len(x)), t.leaf_of(t.lifted(x))
                else:
                    q, leaf = t.reached(t.lifted(x, query=True), bound(part.column("least"), -np.inf), bound(part.column("most"), np.inf))
                for i in range(0, len(q), most):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[i : i + most]]), pa.array(leaf[i : i + most])], names=["id", "leaf"])

    return anchors.select("id", "v", *([] if home else ["least", "most"])).mapInArrow(each, "id long, leaf int")


def tiles(seen: DataFrame, asked: DataFrame, rows: DataFrame, sizes: dict[int, int], tile: tuple[int, int]) -> DataFrame:
    """Visits, with the anchors asked that they name, and the rows of their leaves in one table, dealt into tiles of at most about tile[0] visits and
    tile[1] rows: a leaf of any size, or one that every anchor visits, is many tiles and no task holds more than one at a time."""
    spark = rows.sparkSession
    counts = {r.leaf: r.n for r in seen.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    parts = [(k, math.ceil(n / tile[0]), max(1, math.ceil(sizes[k] / tile[1]))) for k, n in counts.items() if k in sizes]
    dealt = F.broadcast(spark.createDataFrame(parts, "leaf int, qs int, rs int"))  # a row for each leaf, at most
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    names = [c for c in asked.columns if c not in ("v", "id", "label")]
    place = seen.join(dealt, "leaf").select("id", "leaf", F.pmod(F.xxhash64("id"), "qs").alias("qb"), upto("rs").alias("rb"))
    a = place.hint("merge").join(asked.hint("merge"), "id").select("leaf", "qb", "rb", F.lit(True).alias("query"), "id", "label", "v", *names)
    b = rows.join(dealt, "leaf").select("leaf", F.pmod(F.xxhash64("id", F.lit(1)), "rs").alias("rb"), upto("qs").alias("qb"), F.lit(False).alias("query"), "id", "label", "v", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in names])
    return a.unionByName(b)


def scored(tiled: DataFrame, width: int, k: int, kind: str) -> DataFrame:
    """The k best rows of each anchor in each tile, ties to the smaller id: kind 'same' takes other rows of the anchor's label with
    at least the score `least` (null: any); kind 'other' takes rows of other labels for each of the anchor's windows
    (arrays floors and tops, with both ends) and adds the window's number."""

    def job(t):
        import numpy as np
        import pyarrow as pa

        is_q = t.column("query").to_numpy()
        q, r = t.filter(pa.array(is_q)), t.filter(pa.array(~is_q))
        rows: list[tuple] = []
        if q.num_rows and r.num_rows:
            (qx, qn), (rx, rn) = whole(q.column("v"), width), whole(r.column("v"), width)
            q_id, r_id, q_label, r_label = q.column("id").to_numpy(), r.column("id").to_numpy(), q.column("label").to_numpy(), r.column("label").to_numpy()
            least = q.column("least").to_pylist()
            windows = [[(-FAR - 1 if x is None else x, FAR)] for x in least] if kind == "same" else [list(zip(f, p, strict=True)) for f, p in zip(q.column("floors").to_pylist(), q.column("tops").to_pylist(), strict=True)]
            for at in range(0, len(qx), 256):
                score = products(qx[at : at + 256], rx)
                for i in range(len(score)):
                    a, s = at + i, score[i]
                    fit = (rn == qn[a]) & (r_id != q_id[a]) & ((r_label == q_label[a]) == (kind == "same")) & (s >= min(w[0] for w in windows[a])) & (s <= max(w[1] for w in windows[a]))
                    held = np.flatnonzero(fit)
                    held = held[np.lexsort((r_id[held], ~s[held]))]
                    down = ~s[held]  # ascends, without the overflow that a minus has at the end of a long
                    for number, (low, top) in enumerate(windows[a]):
                        first = np.searchsorted(down, ~top)
                        some = held[first : min(first + k, np.searchsorted(down, ~low, side="right"))]
                        rows += [(int(q_id[a]), number, int(r_id[j]), int(s[j])) for j in some]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({"anchor_id": pa.array(cols[0], pa.int64()), "number": pa.array(cols[1], pa.int32()), "other_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return tiled.groupBy("leaf", "qb", "rb").applyInArrow(job, "anchor_id long, number int, other_id long, score long")


def best(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | str = "label", id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, share: int = 80,
    arity: int = 16, leaf: int = 2048, sample: int = 20_000, most_leaves: int = 4096, tile: tuple[int, int] = (1024, 8192),
) -> DataFrame:
    """Per anchor and positive the first `negatives` rows of another label whose score lies between `share` hundredths of the
    positive's score and that score: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row's score is the inner product of its components, each floor(256 * x), with the anchor's, in whole numbers; higher ones
    come first, ties by the smaller id. An anchor's positives are its first `positives` other rows of its label. Exact.

    Rows with a null id or label, a null vector or one with null or non-finite components take no part; of rows repeating an id
    the one with the greatest label, then vector, counts. Rows meet only rows with as many components. Scores beyond a long are
    held at its ends. Extra columns are not read. No rows, anchors or fitting negatives: no rows.

    A tree fitted on a bounded sample takes in every row; its ranges cover all rows. Each anchor first looks into its own leaf,
    which bounds the scores that still matter, and then into the leaves that the annulus of these scores may meet; positives
    come first, as their scores are the negatives' windows. Leaves are searched exactly, in tiles.
    """
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = stash(rows.where(sound).groupBy("id").agg(F.max(F.struct("label", "v", "anchor")).alias("x")).select("id", "x.*"))
    tree, _, width = fitted(rows, arity, leaf, sample, most_leaves)
    rows = hung(rows, tree, width)
    sizes = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    anchors = rows.where("anchor").select("id", "label", "v")
    none = F.lit(None).cast("long")

    def search(asked: DataFrame, home: bool, k: int, kind: str, by: list[str]) -> DataFrame:
        asked = stash(asked)
        seen = stash(visits(asked, tree, width, home))
        return stash(best(scored(tiles(seen, asked, rows, sizes, tile), width, k, kind), k, by))

    # Positives: the own leaf says what the last of them scores at least.
    first = search(anchors.select("*", none.alias("least"), none.alias("most")), True, positives, "same", ["anchor_id"])
    bound = first.groupBy(F.col("anchor_id").alias("id")).agg(F.max(F.when(F.col("rank") == positives, F.col("score"))).alias("least"))
    asked = anchors.hint("merge").join(bound.hint("merge"), "id", "left").select("id", "label", "v", "least", none.alias("most"))
    good = search(asked, False, positives, "same", ["anchor_id"])
    # Negatives: a window for each positive; windows that cannot hold a score are left out.
    floor = F.expr(f"CAST(ceil(CAST(score AS DECIMAL(28, 0)) * {share} / 100) AS LONG)")
    window = good.withColumn("floor", floor).where("floor <= score")
    window = window.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "floor", "score"))).alias("w"))
    window = window.select("id", F.col("w.other_id").alias("positive_ids"), F.col("w.floor").alias("floors"), F.col("w.score").alias("tops"))
    asked = stash(anchors.hint("merge").join(window.hint("merge"), "id"))
    near = search(asked.select("id", "label", "v", "floors", "tops", F.array_min("floors").alias("least"), F.array_max("tops").alias("most")), True, negatives, "other", ["anchor_id", "number"])
    # A window that the own leaf fills needs no score below its last; the annulus ends at the least that any window needs.
    full = near.where(F.col("rank") == negatives).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("filled"))
    tight = asked.hint("merge").join(full.hint("merge"), "id", "left").withColumn("floors", F.when(F.col("filled").isNull(), F.col("floors")).otherwise(F.transform("floors", lambda x, i: F.greatest(x, F.col("filled")[i]))))
    last = search(tight.select("id", "label", "v", "floors", "tops", F.array_min("floors").alias("least"), F.array_max("tops").alias("most")), False, negatives, "other", ["anchor_id", "number"])
    named = asked.select(F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("positive_ids", "tops")).alias("number", "p"))
    out = last.hint("merge").join(named.hint("merge"), ["anchor_id", "number"])
    return out.select("anchor_id", F.col("p.positive_ids").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"), F.col("p.tops").alias("positive_score"), F.col("score").alias("negative_score"))


def mined(vectors: DataFrame, **how) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, where one label in seven was moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label, **how)
