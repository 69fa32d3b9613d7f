"""Nearest neighbours by a block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantised(x):
    """int8 codes with a scale per row, the norm of what the codes stand for and the norm of the error."""
    import numpy as np

    scale = np.abs(x).max(1) / 127.0
    safe = np.where(scale > 0, scale, 1.0)
    code = np.rint(x / safe[:, None]).astype(np.int8)
    held = code * safe[:, None]
    return code, safe, np.sqrt((held**2).sum(1)), np.sqrt(((x - held) ** 2).sum(1))


def exact(a, b):
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    import numpy as np

    return np.add.reduce((a * b).T.copy(), axis=0) if len(a) else np.zeros(0)


def tile_top(qid, q, cid, c, k: int, step: int = 1024, band: int = 256):
    """Arrays query, candidate, score: the k best candidates of each query in one tile, ties to the smaller id.

    The product of int8 codes (exact in float32 up to 1024 components at a time) gives each pair's value
    within a bound on the quantisation error. A pair survives if its upper bound reaches the k-th largest
    lower bound of its query; survivors are computed again from the vectors themselves. Vectors of any magnitude take part: products
    that underflow tie at zero, those that overflow at infinity.
    """
    import numpy as np

    # Bounds are taken of scaled vectors: one power of two for each side, which changes no digit, keeps their products in range.
    power = [int(np.clip(np.floor(np.log2(np.abs(x).max(initial=0) or 1.0)), -1000, 1000)) for x in (q, c)]
    q2, c2 = q * 2.0 ** -power[0], c * 2.0 ** -power[1]
    qc, qs, qn, qe = quantised(q2)
    cc, cs, cn, ce = quantised(c2)
    # What the vectors' own products lose to underflow, and from where on they are infinite and so alike, in these units.
    lost = q.shape[1] * 2.0 ** min(1000, -1074 - sum(power))
    most = 2.0 ** (1024 - sum(power)) if sum(power) > 1 else np.inf

    def products(x, x2, rows):
        with np.errstate(over="ignore", invalid="ignore"):
            got = exact(np.broadcast_to(x, (len(rows), len(x))), c[rows])
            odd = ~np.isfinite(got)
            if odd.any():  # a partial sum has left the range; the whole may lie in it, and has a sign in any case
                got[odd] = exact(np.broadcast_to(x2, (odd.sum(), len(x))), c2[rows[odd]]) * 2.0 ** (sum(power) // 2) * 2.0 ** (sum(power) - sum(power) // 2)
        return got

    out = []
    for at in range(0, len(q), band):
        rows = slice(at, at + band)
        value = np.zeros((len(qid[rows]), len(c)))
        for d in range(0, q.shape[1], step):
            value += qc[rows, d : d + step].astype(np.float32) @ cc[:, d : d + step].astype(np.float32).T
        value *= qs[rows, None] * cs[None, :]
        slack = qe[rows, None] * cn[None, :] + qn[rows, None] * ce[None, :] + qe[rows, None] * ce[None, :]
        slack += 1e-9 * (np.abs(value) + qn[rows, None] * cn[None, :] + slack) + 1e-300 + lost
        own = qid[rows, None] == cid[None, :]
        low, high = np.where(own, -np.inf, np.clip(value - slack, -most, most)), np.clip(value + slack, -most, most)
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        for r in range(len(low)):
            left = np.flatnonzero((high[r] >= floor[r]) & ~own[r])
            score = products(q[at + r], q2[at + r], left)
            best = np.lexsort((cid[left], -score))[:k]
            out.append((np.full(len(best), qid[at + r]), cid[left[best]], score[best]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tile: tuple[int, int] = (1024, 8192)) -> DataFrame:
    """The k nearest candidates of every query by inner product: query_id, rank (from 1), the candidate's id, score.

    Candidates are all rows but the query's own. Null, empty and zero vectors, vectors holding null or
    non-finite components and rows with a null id take no part; of rows repeating an id the largest vector
    counts. Vectors meet only those of their own length; a score beyond the range of doubles is infinite, never NaN. Ties go to the smaller id. No candidates: no rows.

    Both sides are dealt by hash into blocks of a fixed size, and every query block meets every candidate
    block in a task of its own, which holds one tile. Each tile's k best then go to their query's task,
    where a heap of k merges them.
    """
    sound = "id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(sound)
    rows = rows.groupBy("id").agg(F.max("v").alias("v"), F.max("q").alias("q"))
    n, nq = vectors.agg(F.count("*"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()
    qs, cs = max(1, math.ceil(nq / tile[0])), max(1, math.ceil(n / tile[1]))
    own = F.pmod(F.xxhash64("id"), F.lit(qs)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(cs))
    a = rows.where("q").select(F.lit(True).alias("q"), F.size("v").alias("d"), own[0].alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cs - 1).cast("long"))).alias("cb"), "id", "v")
    b = rows.select(F.lit(False).alias("q"), F.size("v").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qs - 1).cast("long"))).alias("qb"), own[1].alias("cb"), "id", "v")

    def tile_job(t):
        import numpy as np
        import pyarrow as pa

        q, ids, d = t.column("q").to_numpy(), t.column("id").to_numpy(), t.column("d")[0].as_py()
        v = t.column("v").combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        got = tile_top(ids[q], v[q], ids[~q], v[~q], k) if q.any() and (~q).any() else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(got[0], pa.int64()), id_col: pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    found = a.union(b).groupBy("d", "qb", "cb").applyInArrow(tile_job, f"query_id long, `{id_col}` long, score double")

    def merge(batches):
        import heapq

        import pyarrow as pa

        def closed(query, heap):
            return [(query, i + 1, -x[1], x[0]) for i, x in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])))]

        now, heap, out = None, [], []
        for b in batches:
            for query, vec, score in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if query != now:
                    out += closed(now, heap)
                    now, heap = query, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", id_col, "score"])
            out = []
        if out := closed(now, heap):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", id_col, "score"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    return found.repartition(F.col("query_id")).sortWithinPartitions("query_id").mapInArrow(merge, schema)
