"""Token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import WordIds, encoder, slices, vocabulary

STABLE = frozenset(" \t\n\x0b\x0c\r")


def spliced(library, text: str, chunk: int = 16384, overlap: int = 256) -> int:
    """Number of tokens of one text, from overlapping chunks encoded with offsets.

    White space is a boundary that no token crosses, whatever stands around it. Two neighbouring chunks are
    joined at such a boundary in their overlap, the one nearest its middle at which the tokens that both
    chunks hold up to the next boundary agree in number and place. If there is none, the overlap is doubled
    back into the first chunk, and once it fills that chunk the first chunk itself is made longer.
    """
    encode = lambda a, b: library.encode(text[a:b], add_special_tokens=False).offsets
    total, begin, a, b = 0, 0, 0, min(len(text), chunk)
    now = encode(a, b)
    while b < len(text):
        width = overlap
        while True:
            start = max(a + 1, b - width)
            stop = min(len(text), start + chunk)
            after = encode(start, stop) if stop > b else []
            cut = agreed(text, now, a, after, start, b) if stop > b else None
            if cut is not None or start == a + 1:
                break
            width *= 2
        if cut is None:
            b = min(len(text), b + (b - a))
            now = encode(a, b)
            continue
        total += sum(1 for s, e in now if begin <= a + s and a + e <= cut)
        begin, a, b, now = cut, start, stop, after
    return total + sum(1 for s, _ in now if begin <= a + s)


def agreed(text: str, left: list, a: int, right: list, start: int, end: int) -> int | None:
    """A boundary in text[start:end] that both encodings respect, with the same tokens up to the next one."""
    spots = [p for p in range(start + 1, end - 1) if text[p] in STABLE and text[p + 1] not in STABLE]
    if len(spots) < 2:
        return None
    ours = [(a + s, a + e) for s, e in left if a + e > start]
    theirs = [(start + s, start + e) for s, e in right if start + s < end]
    middle = (start + end) // 2
    for k in sorted(range(len(spots) - 1), key=lambda k: abs(spots[k] - middle)):
        p, q = spots[k], spots[k + 1]
        crossing = any(s < p < e for s, e in ours) or any(s < p < e for s, e in theirs)
        if not crossing and [t for t in ours if p <= t[0] and t[1] <= q] == [t for t in theirs if p <= t[0] and t[1] <= q]:
            return p
    return None


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 2048, huge: int = 65_536) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens as the library gives them for the whole text, over_limit.

    Texts of more than `huge` bytes are encoded in overlapping chunks; others word by word, from words
    already seen where possible. Both need a vocabulary whose tokens provably end at white space; with any other
    the library encodes every text whole. A null or empty text has 0 tokens. Repeated rows repeat.
    """
    path = tokenizer or vocabulary()

    def each(batches):
        import pyarrow as pa

        words = encoder(path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            cut = lambda t: isinstance(words, WordIds) and t is not None and len(t) > huge
            n = [len(x) // 4 for x in words.many([None if cut(t) else t for t in texts])]
            n = [spliced(words.library, t.decode("utf-8", "replace")) if cut(t) else k for t, k in zip(texts, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    got = docs.select(id_col, F.col(text_col).cast("binary").alias("_lw_text")).mapInArrow(each, schema)
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
