"""Packing documents into sequences by first-fit decreasing over a tournament tree."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import encoder, slices, vocabulary


class Bins:
    """Free room of bins under a tournament tree whose inner nodes hold the larger of their children."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with the room, which is taken."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.tree[at] < need:
                at += 1
        found = at - self.leaves
        self.tree[at] -= need
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        return found


def place(lengths: list[int], room: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold every token of every item once.

    Items longer than a sequence first give whole sequences; the rests are placed whole by first-fit
    decreasing. Then the emptiest sequences are dissolved: their pieces, cut where needed, fill the gaps
    that are left in the others, so that one sequence of a group at most ends with padding worth naming.
    """
    out = [[(i, s, room)] for i, n in enumerate(lengths) for s in range(0, n - room + 1, room)]
    rests = sorted(((n % room, i) for i, n in enumerate(lengths) if n % room), key=lambda x: (-x[0], x[1]))
    bins, held = Bins(len(rests), room), []
    for n, i in rests:
        b = bins.first_fit(n)
        if b == len(held):
            held.append([])
        held[b].append((i, lengths[i] - n, n))
    used = lambda h: sum(p[2] for p in h)
    held.sort(key=used)
    gaps = [room - used(h) for h in held]
    low, high = 0, len(held) - 1
    left: list[tuple[int, int, int]] = []
    while low <= high and sum(gaps[low + 1 : high + 1]) >= used(held[low]):
        left, low = left + held[low], low + 1
        while left and high >= low:
            if not gaps[high]:
                high -= 1
                continue
            i, s, n = left.pop()
            take = min(n, gaps[high])
            held[high].append((i, s, take))
            gaps[high] -= take
            if take < n:
                left.append((i, s + take, n - take))
        if left:
            break
    kept = held[low:]
    return out + ([left] if left else []) + [h for h in kept if h]


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """Columns id, ids: each document's token ids and the end id, as little-endian unsigned 32-bit bytes."""
    end = int(end_id).to_bytes(4, "little")

    def each(batches):
        import pyarrow as pa

        words = encoder(path)
        for b in slices(batches):
            got = pa.array([t + end for t in words.many(b.column(1).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, F.col(text_col).cast("binary").alias("_lw_text")).mapInArrow(each, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, room: int = 2048, group_bytes: int = 8_000_000, seed: int = 7) -> DataFrame:
    """One row per piece: id, start (in its document), length, doc_tokens, sequence_id, offset (in its sequence) and ids.

    ids holds the piece's token ids as little-endian unsigned 32-bit bytes. Every id of every document, the
    end id included, lies in exactly one piece; offsets are gapless from 0. Documents are dealt to groups by
    a seeded hash of id and text; a group holds about group_bytes of text, so that tasks stay small however
    large the table; the place of a row in its partition is part of the hash, so that very many rows repeating id and text
    (or null id and text) spread over groups. A scan of files repeats these places if a task is lost; write a table that a
    shuffle has made to files first. A null or empty text gives the end id alone. Rows repeating id and text stay apart.
    Any vocabulary of the tokenizers or sentencepiece libraries may be named; columns other than id and text are not read.
    """
    path = tokenizer or vocabulary()
    total = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    groups = max(1, math.ceil((total[0] or 0) / group_bytes), math.ceil(total[1] / 100_000))
    # Rows that repeat id and text have no order, so their place in the table may part them; it is fixed before rows are dealt.
    tokens = encoded(docs, id_col, text_col, path, end_id).withColumn("_lw_place", F.pmod(F.monotonically_increasing_id(), F.lit(1009)))
    tokens = tokens.withColumn("_lw_group", F.pmod(F.xxhash64(F.lit(seed), id_col, F.crc32("ids"), "_lw_place"), F.lit(groups)))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(k, T.LongType()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())]

    def group_job(t):
        import pyarrow as pa

        ids, names, group = t.column("ids"), list(map(str, t.column(id_col).to_pylist())), t.column("_lw_group")[0].as_py()
        data = [x.as_buffer() for x in ids]
        order = sorted(range(len(data)), key=lambda i: (len(data[i]), names[i], zlib.crc32(data[i])))
        lengths = [len(data[i]) // 4 for i in order]
        rows = []
        for s, pieces in enumerate(place(lengths, room)):
            at = 0
            for i, start, n in pieces:
                rows.append((order[i], start, n, lengths[i], (group << 32) + s, at, data[order[i]][4 * start : 4 * (start + n)].to_pybytes()))
                at += n
        cols = list(zip(*rows, strict=True))
        return pa.table([t.column(id_col).take(pa.array(cols[0])), *[pa.array(c, pa.int64()) for c in cols[1:6]], pa.array(cols[6], pa.binary())], names=[f.name for f in fields])

    # As many partitions as the groups ask for, two to each, whatever number the session has for shuffles.
    dealt = tokens.repartition(max(8, math.ceil(groups / 2)), "_lw_group")
    return dealt.groupBy("_lw_group").applyInArrow(group_job, T.StructType(fields))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The pieces of pack with ids_crc32 in place of the ids."""
    p = pack(docs, id_col, text_col, tokenizer)
    return p.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
