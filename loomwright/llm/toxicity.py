"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import bounded_sample, cut, slices

BUCKETS = 1 << 20
TERM = re.compile(r"\w+")


def terms(word: str) -> list[int]:
    """Hashed terms of a word: the word itself, and its beginnings of 4 to 6 letters, which inflected forms share."""
    forms = ["=" + word] + [f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n]
    return [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in forms]


class Reader:
    """Sorted distinct hashed terms of a text; remembers a bounded number of words."""

    def __init__(self, wanted=None):
        self.wanted, self.seen = wanted, {}

    def __call__(self, text: str | None) -> list[int]:
        out: set[int] = set()
        if text:
            seen = self.seen
            if len(seen) > 150_000:
                seen.clear()
            for w in set(TERM.findall(text.lower())):
                got = seen.get(w)
                if got is None:
                    got = tuple(terms(w)) if self.wanted is None else tuple(t for t in terms(w) if t in self.wanted)
                    seen[w] = got
                if got:
                    out.update(got)
        return sorted(out)


@dataclass
class Model:
    """Factorization machine: bias, a weight and a vector for each chosen term, 0/1 inputs."""

    bias: float
    place: dict[int, int]
    weight: object
    factor: object

    def score(self, found: list[int]) -> float:
        import numpy as np

        i = [self.place[t] for t in found if t in self.place]
        z = self.bias
        if i:
            v = self.factor[i]
            z += self.weight[i].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit_machine(rows: list[tuple[int, list[int]]], chosen: list[int], rank: int = 4, epochs: int = 200, seed: int = 5) -> Model:
    """Fits weights and factors by full-batch AdaGrad on the log loss with an L2 penalty; the same rows give the same model."""
    import numpy as np

    place = {t: i for i, t in enumerate(chosen)}
    lists = [[place[t] for t in r[1] if t in place] for r in rows]
    # Rows with the same inputs and label count as one with a weight.
    same: dict[tuple, int] = {}
    for (y, _), x in zip(rows, lists, strict=True):
        same[y, tuple(x)] = same.get((y, tuple(x)), 0) + 1
    y, share = np.array([k[0] for k in same], float), np.array(list(same.values()), float) / max(1, len(rows))
    at = np.array([i for _, x in same for i in x], np.int64)
    of = np.repeat(np.arange(len(same)), [len(x) for _, x in same])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (rank, len(chosen)))
    ones = float((y * share).sum()) * len(rows)
    base = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5))) if rows else -3.0
    bias, gb, gw, gv = base, 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(epochs if len(at) else 0):
        held = v[:, at]
        total = np.stack([np.bincount(of, h, len(same)) for h in held])
        square = np.bincount(of, (held**2).sum(0), len(same))
        z = bias + np.bincount(of, w[at], len(same)) + 0.5 * ((total**2).sum(0) - square)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        dw = np.bincount(at, e[of], len(w)) + 2e-5 * w
        dv = np.stack([np.bincount(at, e[of] * (t[of] - h), len(w)) for t, h in zip(total, held, strict=True)]) + 2e-4 * v
        gb, gw, gv = gb + e.sum() ** 2, gw + dw**2, gv + dv**2
        bias -= 0.1 * e.sum() / np.sqrt(gb)
        w -= 0.3 * dw / np.sqrt(gw)
        v -= 0.05 * dv / np.sqrt(gv)
    return Model(bias, place, w, v.T.copy())


def tells(n0: Column, n1: Column, all0: int, all1: int) -> Column:
    """How much a term tells about the label either way: the log-likelihood ratio (G squared) of its two-by-two table."""
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    cells = [n0, n1, F.lit(float(all0)) - n0, F.lit(float(all1)) - n1]
    sums = [n0 + n1, F.lit(float(all0 + all1)) - n0 - n1, F.lit(float(all0)), F.lit(float(all1))]
    add = lambda xs: reduce(lambda a, b: a + b, [part(x.cast("double")) for x in xs])
    return 2 * (add(cells) - add(sums) + part(F.lit(float(all0 + all1))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, least: float = 10.83, seed: int = 11) -> Model:
    """A machine fitted on at most most_rows labelled documents, chosen by a seeded hash of the id.

    labels holds only rows that may be learned from. Counts of terms are taken by Spark over the whole sample. Inputs are
    all terms in three or more texts that tell about the label, either way, beyond chance (a log-likelihood ratio of
    `least`, p = 0.001), and all that do so among the texts with a term that speaks for toxicity without deciding it: a
    group's name, say, that is neutral by itself and not beside an insult. Their number is not cut; the sample bounds it.
    Rows with a null id or label are left out. Without labels the machine gives every text the same low score.
    """
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lw_id")).agg(F.max(F.col(label_col).cast("int")).alias("_lw_y"))
    lab = cut(bounded_sample(cut(lab), most_rows, "_lw_id", seed))
    # At most most_rows rows of an id and a label: a bounded broadcast.
    rows = docs.select(F.col(id_col).alias("_lw_id"), F.col(text_col).alias("_lw_text")).join(F.broadcast(lab), "_lw_id").select("_lw_y", "_lw_text")

    def read(batches):
        import pyarrow as pa

        reader = Reader()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([reader(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["y", "terms"])

    sparse = cut(rows.mapInArrow(read, "y int, terms array<int>"))

    def counted(among: frozenset | None) -> tuple[DataFrame, int, int]:
        """Terms with their numbers of clean and toxic texts, of all or of those that hold one of the terms, and the numbers of texts."""

        def count(batches):
            import numpy as np
            import pyarrow as pa

            seen = np.zeros((2, BUCKETS), np.int64)
            texts = [0, 0]
            wanted = np.array(sorted(among or ()), np.int64)
            for b in batches:
                for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    got = t.values.to_numpy()
                    if among is None or np.isin(got, wanted).any():
                        seen[1 if y else 0, got] += 1
                        texts[1 if y else 0] += 1
            at = np.flatnonzero(seen.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[0, at], texts[0])), pa.array(np.append(seen[1, at], texts[1]))], names=["term", "n0", "n1"])

        per = cut(sparse.mapInArrow(count, "term int, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
        n = per.where("term = -1").first() or (0, 0, 0)
        return per.where("term >= 0 AND n0 + n1 >= 3"), n[1], n[2]

    per, all0, all1 = counted(None)
    if not all1:
        return Model(-4.0, {}, [], [])
    strong = [tuple(r) for r in per.where(tells(F.col("n0"), F.col("n1"), all0, all1) >= least).select("term", "n0", "n1").collect()]
    open_ones = frozenset(t for t, n0, n1 in strong if n0 >= 3 and n1 >= 3 and n1 * all0 > n0 * all1)
    chosen = {t for t, _, _ in strong}
    if open_ones:
        beside, some0, some1 = counted(open_ones)
        if some0 and some1:
            chosen |= {r[0] for r in beside.where(tells(F.col("n0"), F.col("n1"), some0, some1) >= least).select("term").collect()}
    wanted = frozenset(chosen)

    def narrow(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[t for t in x if t in wanted] for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["y", "terms"])

    small = sparse.mapInArrow(narrow, "y int, terms array<int>").collect()
    return fit_machine(sorted((1 if r[0] else 0, sorted(r[1])) for r in small), sorted(chosen))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the score of each whole text; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        machine = shared.value
        reader, known = Reader(frozenset(machine.place)), {}
        for b in slices(batches):
            got = []
            for t in b.column(len(keep)).to_pylist():
                found = tuple(reader(t))
                if found not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[found] = machine.score(list(found))
                got.append(known[found])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, name])

    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField(name, T.DoubleType())])
    return docs.select(*keep, F.col(text_col).alias("_lw_text")).mapInArrow(each, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2. A null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """Per document: id, held_out, score (0 to 1) and predicted, learned from the labels of rows that are not held out.

    Null and empty texts get the score of a text without terms. Repeated rows repeat.
    """
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    s = score(docs, model, [id_col], text_col)
    return s.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, columns as they were."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    return score(docs, model, docs.columns, text_col, "_lw_score").where(F.col("_lw_score") < threshold).drop("_lw_score")
