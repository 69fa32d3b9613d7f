"""Packing documents into as few sequences as possible by best-two-fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import encoder, slices, stash, vocabulary


class Lengths:
    """The lengths that are not packed yet, as one number whose bits say which there are, and how many of each."""

    def __init__(self, lengths: list[int], room: int):
        self.room, self.left = room, [0] * (room + 1)
        for n in lengths:
            self.left[n] += 1
        self.there = sum(1 << n for n, k in enumerate(self.left) if k)
        # Bit room - n for a length n: shifted, it shows for each length the one that makes up a sum with it.
        self.mirror = sum(1 << (room - n) for n, k in enumerate(self.left) if k)

    def take(self, n: int) -> int:
        self.left[n] -= 1
        if not self.left[n]:
            self.there ^= 1 << n
            self.mirror ^= 1 << (self.room - n)
        return n

    def give(self, n: int) -> None:
        if not self.left[n]:
            self.there ^= 1 << n
            self.mirror ^= 1 << (self.room - n)
        self.left[n] += 1

    def largest(self, most: int) -> int:
        """The largest length up to `most`, 0 if there is none."""
        return (self.there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.there & ((1 << (most + 1)) - 1) else 0

    def two(self, most: int, above: int) -> tuple[int, int] | None:
        """Two lengths with the greatest sum of at most `most` that is over `above`; of those the pair with the greatest length."""
        for total in range(most, above, -1):
            pairs = self.there & (self.mirror >> (self.room - total))
            if not total % 2 and self.left[total // 2] == 1:
                pairs &= ~(1 << (total // 2))
            if pairs:
                big = pairs.bit_length() - 1
                return big, total - big
        return None


def best_two_fit(lengths: list[int], room: int = 2048) -> list[list[int]]:
    """Bins of lengths from 1 to room: each is filled with the largest that fits, again and again; then its smallest gives way
    to two that are not packed yet, if they fill the widened gap more tightly than it did."""
    held, bins = Lengths(lengths, room), []
    while held.there:
        out, gap = [], room
        while gap and (n := held.largest(gap)):
            out.append(held.take(n))
            gap -= n
        if gap and (pair := held.two(gap + out[-1], out[-1])):
            held.give(out.pop())
            out += [held.take(n) for n in pair]
        bins.append(out)
    return bins


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, room: int, with_ids: bool) -> DataFrame:
    """Columns id, piece, start, length, ids_crc32 and, with with_ids, ids of each document's pieces of at most `room` ids."""
    import zlib

    end = int(end_id).to_bytes(4, "little")

    def each(batches):
        import pyarrow as pa

        words = encoder(path)
        for part in slices(batches):
            row, piece, size, crc, ids = [], [], [], [], []
            for i, t in enumerate(words.many(part.column(1).to_pylist())):
                t += end
                for p, c in enumerate(range(0, len(t), 4 * room)):
                    x = t[c : c + 4 * room]
                    row.append(i)
                    piece.append(p)
                    size.append(len(x) // 4)
                    crc.append(zlib.crc32(x))
                    if with_ids:
                        ids.append(x)
            cols = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array([room * p for p in piece], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=[f.name for f in fields])

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    return docs.select(id_col, F.col(text_col).cast("binary").alias("_lw_text")).mapInArrow(each, T.StructType(fields))


def placed(pieces: DataFrame, key: str, length: str, room: int = 2048, group_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """Columns key, sequence_id, offset of rows with a length up to room. Rows are dealt by a seeded hash of their key into groups
    of about group_rows, each packed by itself, so a group's task stays small and one bin of a group at most is left half empty."""
    groups = max(1, math.ceil(pieces.count() / group_rows))
    dealt = pieces.select(F.col(key).alias("key"), F.col(length).alias("length"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(groups)).alias("group"))

    def pack(t):
        import numpy as np
        import pyarrow as pa

        keys, n, group = t.column("key").to_numpy(), t.column("length").to_numpy(), t.column("group")[0].as_py()
        order = np.lexsort((keys, n))
        # Of each length the keys in order; a bin takes the next one.
        at = np.searchsorted(n[order], np.arange(room + 2)).tolist()
        ordered = keys[order].tolist()
        out, number, offset = [], [], []
        for b, held in enumerate(best_two_fit(n.tolist(), room)):
            used = 0
            for x in held:
                out.append(ordered[at[x]])
                at[x] += 1
                number.append((group << 32) + b)
                offset.append(used)
                used += x
        return pa.table({"key": pa.array(out, pa.int64()), "sequence_id": pa.array(number, pa.int64()), "offset": pa.array(offset, pa.int64())})

    spread = dealt.repartition(max(8, groups), "group")
    return spread.groupBy("group").applyInArrow(pack, "key long, sequence_id long, offset long").withColumnRenamed("key", key)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, room: int = 2048, group_rows: int = 20_000, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece (from 0), start (in its document), length, ids_crc32, ids (unless with_ids is false), sequence_id, offset (in its sequence).

    A document's ids are those of its text and the end id. One of up to `room` ids stays whole; a longer one is cut into pieces
    of `room`, and only the last may be shorter. Every sequence holds at most `room` ids, offsets are gapless from 0. ids are
    little-endian unsigned 32-bit bytes.

    A null or empty text gives the end id alone; repeated rows and null ids are packed like any other; an empty table gives no
    rows; columns other than id and text are not read. Pieces are numbered and written once, so a lost executor changes no
    place; whole sequences need no packing, and the others travel as numbers and lengths.
    A text's ids are held by one task.
    """
    path = tokenizer or vocabulary()
    pieces = stash(cut_pieces(docs, id_col, text_col, path, end_id, room, with_ids).withColumn("_lw_key", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == room).withColumns({"sequence_id": -1 - F.col("_lw_key"), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < room)
    put = placed(short, "_lw_key", "length", room, group_rows)
    both = full.unionByName(short.hint("merge").join(put.hint("merge"), "_lw_key"))
    return both.select(id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The pieces of pack with checksums in place of the ids, which are then not written."""
    return pack(docs, id_col, text_col, tokenizer, with_ids=False)
