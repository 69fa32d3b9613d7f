"""Alignment of two tokenizers' tokens over the same bytes, by lockstep vectorised merging."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import stash, vocabulary

#: A space or line feed and what follows it, up to the next one that stands between signs that are no white space.
UNIT = re.compile(r"\s++\S*+(?:(?![ \n]\S)\s++\S*+)*+")
#: Fixed value: settings of the byte-level file for which a lone space or line feed always starts a token.
BYTE_LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}


def byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: itself where it prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Ids of texts by both tokenizers, kept by unit: what cannot be crossed by a token of either is encoded once and remembered.

    A text with a space before it falls into units that start with a lone space or line feed between signs that are no white
    space. The byte-level pre-tokenizer starts a token there, and no piece of the other vocabulary holds such a sign behind
    another; files for which this does not hold are encoded text by text. `most` units are remembered.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 300_000):
        import os

        import numpy as np
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.most = most
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        sign = byte_signs()
        held = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode() for t in held]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Texts of the ids with what stands behind them: inside a group, at the end of its A side, at the end of its B side.
        self.written = [b"%d%s" % (i, s) for n, seps in ((len(held), (b",", b"|")), (len(pieces), (b",", b";"))) for s in seps for i in range(n)]
        file = json.loads(Path(a_path).read_text())
        split = file.get("pre_tokenizer") or {}
        self.cuts = file.get("normalizer") is None and all(split.get(k) == v for k, v in BYTE_LEVEL.items()) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.cuts = self.cuts and [pieces[i] for i in self.b.encode("a  b\nc")][-2:] == ["<0x0A>", "c"]
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.seen: dict[str, int] = {}
        self.sound: list[bool] = []
        self.parts = [[np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]]
        self.sizes: list[list[int]] = [[], []]
        self.flat = None

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text) if self.cuts else [" " + text]

    def learn(self, new: list[str], together: int = 4096) -> None:
        """Encodes units and notes whether both joined byte strings are the unit's own."""
        import numpy as np

        for at in range(0, len(new), together):
            some = new[at : at + together]
            a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # The library writes a space before what it gets; before a line feed this is a piece of its own, which goes.
            b = [ids if u[0] == " " else ids[1:] for u, ids in zip(some, self.b.encode([u[1:] if u[0] == " " else u for u in some], num_threads=1), strict=True)]
            for u, x, y in zip(some, a, b, strict=True):
                own = u.encode()
                self.seen[u] = len(self.sound)
                self.sound.append(b"".join(map(self.a_bytes.__getitem__, x)) == own == b"".join(map(self.b_bytes.__getitem__, y)))
                self.sizes[0].append(len(x))
                self.sizes[1].append(len(y))
            self.parts[0].append(np.array([i for x in a for i in x], np.uint32))
            self.parts[1].append(np.array([i for x in b for i in x], np.uint32))
        if new or self.flat is None:
            self.parts = [[np.concatenate(p)] for p in self.parts]
            n = [np.array(s, np.int64) for s in self.sizes]
            self.flat = [(p[0], np.cumsum(k) - k, k) for p, k in zip(self.parts, n, strict=True)]
            self.good = np.array(self.sound, bool)

    def batch(self, texts: list[str]):
        """Of texts: for each side its ids in one array, then the number of a text, of A and B tokens and of bytes before each unit."""
        import numpy as np

        if len(self.seen) > self.most:
            self.forget()
        units = [self.units(t) if t else [] for t in texts]
        self.learn(sorted(set().union(*units).difference(self.seen)))
        at = np.fromiter(map(self.seen.__getitem__, (u for x in units for u in x)), np.int64, sum(map(len, units)))
        doc = np.repeat(np.arange(len(texts)), list(map(len, units)))
        bad = np.bincount(doc[~self.good[at]], minlength=len(texts)) > 0
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        ids, before = [], []
        for flat, start, n in self.flat:
            k = n[at]
            first = np.cumsum(k) - k
            ids.append(flat[np.repeat(start[at] - first, k) + np.arange(k.sum())])
            before.append(first)
        return ids, doc, before


def merged(a_end, b_end, a_at, a_stop, b_at):
    """Arrays of A and B token numbers of every link, and of the last A and B token of every group.

    Lanes are stretches of which both sides start and end at the same byte. One state vector holds every lane's A and B
    pointer; a step emits a link for each lane and a cut where both tokens end, moves on what ends first, and drops the
    lanes that are done.
    """
    import numpy as np

    a, b, stop = a_at.copy(), b_at.copy(), a_stop
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        x, y = a_end[a], b_end[b]
        links_a.append(a)
        links_b.append(b)
        both = x == y
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + (x <= y), b + (y <= x)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    none = [np.zeros(0, np.int64)]
    return [np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b)]


def lanes(doc, before, ends, total, units: int = 48, most: int = 2000):
    """A start, A stop and B start of lanes: runs of up to `units` units of a text; a run of more than `most` tokens, such as
    a text without spaces, is parted at bytes where both sides end."""
    import numpy as np

    if not len(doc):
        return [np.zeros(0, np.int64)] * 3
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    place = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
    first = np.flatnonzero(place % units == 0)
    a, b = before[0][first], before[1][first]
    stop = np.append(a[1:], total[0])
    if (wide := np.flatnonzero(stop - a > most)).size:
        more_a, more_b = [], []
        b_stop = np.append(b[1:], total[1])
        for i in wide:
            _, x, y = np.intersect1d(ends[0][a[i] : stop[i] - 1], ends[1][b[i] : b_stop[i] - 1], assume_unique=True, return_indices=True)
            keep = np.flatnonzero(np.diff(x // (most // 4), prepend=0) > 0)
            more_a.append(a[i] + x[keep] + 1)
            more_b.append(b[i] + y[keep] + 1)
        a, b = np.sort(np.concatenate([a, *more_a])), np.sort(np.concatenate([b, *more_b]))
        stop = np.append(a[1:], total[0])
    return a, stop, b


def aligned(pair: Pair, texts: list[str], detail: bool = False) -> dict:
    """Columns of texts: n_a, n_b, n_groups, n_links, groups_sha256, and codes and counts, the distinct linked id pairs of a text
    (A id times the size of B's vocabulary, plus B id, ascending) as little-endian unsigned 64-bit bytes, and how often each is
    linked as 32-bit ones. With detail also the ids and the group ends of both sides."""
    import numpy as np

    n, va, vb = len(texts), len(pair.a_bytes), len(pair.b_bytes)
    (a, b), doc, before = pair.batch(texts)
    a_end, b_end = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    link_a, link_b, cut_a, cut_b = merged(a_end, b_end, *lanes(doc, before, (a_end, b_end), (len(a), len(b))))
    # Tokens before each text, on both sides.
    unit = np.searchsorted(doc, np.arange(n + 1))
    off_a, off_b = (np.append(x, total)[unit] for x, total in zip(before, (len(a), len(b)), strict=True))
    doc_a = np.repeat(np.arange(n), np.diff(off_a))
    cut_a.sort()
    cut_b.sort()
    # The ids in the order of groups, A's before B's, as numbers of their written forms.
    end_a, end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    end_a[cut_a], end_b[cut_b] = True, True
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + np.append(0, cut_b + 1)[np.cumsum(end_a) - end_a]] = a + va * end_a
    line[np.arange(len(b)) + (np.append(cut_a, 0) + 1)[np.cumsum(end_b) - end_b]] = 2 * va + b.astype(np.int64) + vb * end_b
    spans = (off_a + off_b).tolist()
    sha = []
    for s, e in zip(spans, spans[1:], strict=False):
        h = hashlib.sha256()
        for k in range(s, e, 1 << 20):
            text = b"".join(map(pair.written.__getitem__, line[k : min(e, k + (1 << 20))].tolist()))
            h.update(text[:-1] if k + (1 << 20) >= e else text)
        sha.append(h.hexdigest() if e > s else "")
    size = va * vb
    own = doc_a[link_a]
    code, count = np.unique(own * size + a[link_a].astype(np.int64) * vb + b[link_b], return_counts=True)
    at = np.searchsorted(code, np.arange(n + 1) * size)
    code, count = (code % size).astype("<u8"), count.astype("<u4")
    out = {
        "n_a": np.diff(off_a), "n_b": np.diff(off_b), "n_groups": np.bincount(doc_a[cut_a], minlength=n), "n_links": np.bincount(own, minlength=n), "groups_sha256": sha,
        "codes": [code[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], "counts": [count[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)],
    }
    if detail:
        cut = np.searchsorted(cut_a, off_a)
        spread = lambda x, o: [x[i:j].tolist() for i, j in zip(o, o[1:], strict=False)]
        out |= {"a_ids": spread(a, off_a), "b_ids": spread(b, off_b)}
        out |= {k: [(x - o).tolist() for x, o in zip(np.split(c + 1, cut[1:-1]), off, strict=False)] if n else [] for k, c, off in (("a_ends", cut_a, off_a), ("b_ends", cut_b, off_b))}
    return out


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, detail: bool = False, together: int = 4_000_000) -> DataFrame:
    """One row per document: its id and the columns of aligned(). Nothing is shuffled; texts are taken about `together` characters
    at a time. A null or empty text, and one whose tokens do not spell it with a space before it, has no tokens."""
    a_path, b_path = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")
    kinds = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType(), "codes": T.BinaryType(), "counts": T.BinaryType()}
    if detail:
        kinds |= dict.fromkeys(("a_ids", "b_ids", "a_ends", "b_ends"), T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(k, v) for k, v in kinds.items()]])

    def each(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        pair, types = Pair(a_path, b_path), [to_arrow_type(t) for t in kinds.values()]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, n = [], 0
                while at + len(texts) < batch.num_rows and n < together:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    n += len(texts[-1])
                got = aligned(pair, texts, detail)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(got[k], t) for k, t in zip(kinds, types, strict=True)]], names=[id_col, *kinds])
                at += len(texts)

    return docs.select(id_col, F.col(text_col).alias("_lw_text")).mapInArrow(each, schema)


def flat(column, kind: str):
    """The numbers of a binary Arrow column in one array."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind)


def pair_totals(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Columns code, n: how often every pair is linked in all rows. Each task first sums its own, about `most` pairs at a time."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list = []

        def fold():
            both = np.concatenate([code, *[w[0] for w in waiting]])
            kinds, place = np.unique(both, return_inverse=True)
            return kinds, np.bincount(place, np.concatenate([n, *[w[1] for w in waiting]]), len(kinds)).astype(np.int64)

        def said():
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                waiting.append((flat(part.column(0), "<u8"), flat(part.column(1), "<u4").astype(np.int64)))
                if sum(len(w[0]) for w in waiting) > 2 * most:
                    (code, n), waiting = fold(), []
                    if len(code) > most:
                        yield said()
                        code, n = code[:0], n[:0]
        code, n = fold()
        yield said()

    return rows.select("codes", "counts").mapInArrow(each, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def pair_table(rows: DataFrame, b_size: int) -> DataFrame:
    """Columns code, n, best: every pair's links in all rows, and whether none of its B id's pairs has more. The table of the
    most per B id has no more rows than B's vocabulary and is broadcast."""
    totals = stash(pair_totals(rows)).withColumn("b", F.col("code") % b_size)
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, head: int = 1_000_000) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text with a space before it is encoded by a byte-level vocabulary (a, a .json file) and a piece vocabulary (b, a .model
    file, which writes that space itself), special strings as plain text. Bytes where tokens of both end part them into
    groups; tokens whose bytes overlap are linked. A pair of ids counts as often as it is linked in all documents;
    n_best are the links whose count no other pair of their B id exceeds, count_sum is the sum over links.
    groups_sha256 is that of `a1,a2|b1;a3|b2,b3`.

    Null, empty and otherwise spelt texts have zeros and ''. Repeated rows repeat and count; null ids stay; other columns are
    not read; an empty table gives no rows. A text's tokens are held whole by one task.

    Alignments are written once. The table of pairs is summed from sums per task. Of it the most frequent pairs, up to `head`
    rows, go to every task (17 bytes a row); links of all others are joined by pair, and none of those is frequent.
    """
    b_size = _b_size(b or vocabulary("piece_bpe_32k.model"))
    rows = stash(align(docs, id_col, text_col, a, b).withColumn("_lw_key", F.monotonically_increasing_id()))
    pairs = stash(pair_table(rows, b_size))
    # The least power of two from which on the pairs are few enough to be sent to every task.
    level = F.floor(F.log2("n")).cast("int")
    by_level = sorted(((r.level, r.k) for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = 0, 0
    for power, k in by_level:
        total += k
        if total > head:
            least = power + 1
            break
    top = pairs.where(F.col("n") >= F.lit(2).cast("double") ** least if least else F.lit(True)).orderBy("code").toArrow()
    share = docs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("code", "n", "best")))
    narrow = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches):
        import numpy as np
        import pyarrow as pa

        known, n, best = share.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                code, times = flat(part.column("codes"), "<u8").astype(np.int64), flat(part.column("counts"), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), [len(x) // 8 for x in part.column("codes").to_pylist()])
                place = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                hit = known[place] == code if len(known) else np.zeros(len(code), bool)
                add = lambda x: np.array([int(v) for v in _sums(doc[hit], x, part.num_rows)], np.int64)
                sums = [pa.array(add(x)) for x in (times[hit] * best[place[hit]], times[hit] * n[place[hit]])] if hit.any() else [pa.array(np.zeros(part.num_rows, np.int64))] * 2
                off = np.searchsorted(doc[~hit], np.arange(part.num_rows + 1)).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(off), pa.array(x[~hit])) for x in (code, times)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in (id_col, "_lw_key", *narrow)], *sums, *rest], names=[id_col, "_lw_key", *narrow, "n_best", "count_sum", "codes", "times"])

    fields = [rows.schema[c] for c in (id_col, "_lw_key", *narrow)] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("codes", "times")]
    scored = rows.mapInArrow(score, T.StructType(fields))
    out = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not least:
        return scored.select(*out)
    scored = stash(scored)
    rare = scored.select("_lw_key", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("_lw_key", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    more = rare.hint("merge").join(pairs.hint("merge"), "code").groupBy("_lw_key").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = scored.drop("codes", "times").hint("merge").join(more.hint("merge"), "_lw_key", "left")
    return whole.withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}).select(*out)


def _sums(place, values, n: int):
    """Whole-number sums of values by place; places ascend."""
    import numpy as np

    at = np.searchsorted(place, np.arange(n + 1))
    run = np.append(0, np.cumsum(values))
    return run[at[1:]] - run[at[:-1]]


def _b_size(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
