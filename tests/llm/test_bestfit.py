import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import bestfit
from loomwright.llm.common import vocabulary


def plain(lengths, room):
    """The same rule over a list: the largest that fits, then the best two for the smallest."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        out, gap = [], room
        while (fit := next((n for n in left if n <= gap), None)) is not None:
            left.remove(fit)
            out.append(fit)
            gap -= fit
        low = out[-1]
        pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if low < a + b <= gap + low]
        if gap and pairs:
            _, a, b = max(pairs)
            out[-1:] = [a, b]
            left += [low]
            left.remove(a)
            left.remove(b)
            left.sort(reverse=True)
        bins.append(out)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(40, 60))
def test_same_bins_as_a_plain_loop(lengths, room):
    got = bestfit.best_two_fit(lengths, room)
    assert got == plain(lengths, room)
    assert sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= room for b in got)


def test_few_bins():
    rng = random.Random(0)
    for lo, hi, more in ((1, 2047, 1.01), (300, 900, 1.01), (20, 400, 1.001)):
        n = [rng.randint(lo, hi) for _ in range(4000)]
        assert len(bestfit.best_two_fit(n)) <= more * sum(n) / 2048 + 1


def check(rows, docs, room):
    """Every id of every document once, whole where it fits, in gapless sequences."""
    library = Tokenizer.from_file(vocabulary())
    want = sorted((str(i), struct.pack(f"<{len(x) + 1}I", *x, 0)) for i, t in docs for x in [library.encode(t or "", add_special_tokens=False).ids])
    by, seqs = {}, {}
    for r in rows:
        ids = bytes(r.ids)
        assert len(ids) == 4 * r.length <= 4 * room and r.ids_crc32 == zlib.crc32(ids) and r.start == room * r.piece
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(str(r.doc_id), []).append((r.start, ids))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= room
    # Repeats of an id have the same pieces, each as often as the other.
    got = []
    for i, pieces in by.items():
        copies = sum(s == 0 for s, _ in pieces)
        for x in sorted({p for p in pieces if p[0] == 0}):
            n = pieces.count(x)
            rest = sorted({p for p in pieces if p[0]}) if copies == n else []
            got += [(i, x[1] + b"".join(p[1] for p in rest))] * n
    assert sorted(got) == want
    return len(seqs)


@pytest.mark.parametrize("room", [2048, 7])
def test_round_trip(spark, frame, room):
    docs = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "word " * 5000), (None, "a b"), (5, "x" * 30_000)] + [(i, "ab cd " * (i % 90)) for i in range(10, 300)]
    df = frame(docs).withColumns({"piece": F.lit(1), "_lw_key": F.lit(2), "group": F.lit(3), "ids": F.lit("x")})
    rows = bestfit.pack(df, room=room, group_rows=100).collect()
    seqs = check(rows, docs, room)
    total = sum(r.length for r in rows)
    assert seqs <= 1.2 * total / room + 4
    again = bestfit.pack(df, room=room, group_rows=100).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = bestfit.pack(docs).collect()
    seqs = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert seqs <= -(-sum(r.length for r in rows) // 2048) + 1
    assert bestfit.pack(docs.limit(0)).count() == 0 and bestfit.pieces(docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
