"""Helpers that the corpus operators share: cutting lineage, hashing, and exact tokenisation."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from itertools import compress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts list it: space and the codes 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint; a lost executor loses nothing.

    The plan's statistics are cut as well. A checkpoint hands them on, and the size of a join is taken as the product of its sides',
    so in a loop the digits of that one number would double with every round and fill the driver's memory.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def stash(df: DataFrame) -> DataFrame:
    """The same rows, written as compressed Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_or_merge(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The narrow, already written table for a join: broadcast up to a counted number of rows, joined by shuffle and merge beyond."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def unit(*cols: Column | str) -> Column:
    """A reproducible number in [0, 1) from the text forms of the columns; DuckDB gives the same from the same md5."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def bounded_sample(rows: DataFrame, most: int, key: str, seed: int) -> DataFrame:
    """At most `most` rows, those with the least seeded hash of the key. Rows well above the expected threshold go before the
    sort, so each partition sends about its share and not `most` rows."""
    h = F.xxhash64(F.lit(seed), key)
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(h, F.lit(1 << 30)) < int((1.2 * most / n + 20 / n) * (1 << 30)))
    return rows.orderBy(F.pmod(h, F.lit(1 << 30)), h, key).limit(most)


def slices(batches, rows: int = 500):
    """Arrow batches in slices of a few rows, so a worker holds few texts as Python values at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; the file is read where it lies and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Punctuation (no apostrophe) that ends a word after an ASCII letter or digit or a Latin-1 letter; the pre-tokenizer parts it from the word.
ENDS = re.compile(rb"([!-&(-/:-@\[-`{-~])(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))([!-&(-/:-@\[-`{-~]*)(?=[\x20\x09-\x0D]|\Z)")


def by_words(path: str) -> bool:
    """Whether a tokenizer file is one whose texts may be encoded word by word: its normaliser only composes, lower-cases and makes
    white space one space, its pre-tokenizer keeps runs of letters, single digits and runs of other signs, none of which crosses
    white space, and its model marks the ends of words. Files of other kinds are not."""
    if not path.endswith(".json"):
        return False
    held = json.loads(Path(path).read_text())
    steps = lambda x, name: x.get(name, []) if (x or {}).get("type") == "Sequence" else []
    normal = [n.get("type") for n in steps(held.get("normalizer"), "normalizers")]
    spaces = [n for n in steps(held.get("normalizer"), "normalizers") if n.get("type") == "Replace"]
    split = [p for p in steps(held.get("pre_tokenizer"), "pretokenizers") if p.get("type") == "Split"]
    # The settings that the word memory was tested with.
    return (
        normal == ["NFC", "Replace", "Lowercase"] and spaces[0].get("pattern") == {"Regex": r"\s+"} and spaces[0].get("content") == " "
        and [p.get("pattern") for p in split] == [{"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}]
        and split[0].get("behavior") == "Removed" and split[0].get("invert") is True and held["model"].get("end_of_word_suffix") == "</w>"
    )


class LibraryIds:
    """Token ids of whole texts by the library alone: tokenizers for .json files, sentencepiece for .model files."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: library.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, texts: list[bytes | None], together: int = 64) -> list[bytes]:
        import numpy as np

        out = []
        for i in range(0, len(texts), together):
            out += [np.array(ids, "<u4").tobytes() for ids in self.encode([(t or b"").decode("utf-8", "replace") for t in texts[i : i + together]])]
        return out


def encoder(path: str) -> WordIds | LibraryIds:
    """What encodes whole texts exactly as the library does: word by word where the file allows it, else the library itself."""
    return WordIds(path) if by_words(path) else LibraryIds(path)


class WordIds:
    """Token ids of whole texts, word by word, with a bounded memory of words already seen.

    The vocabulary's pre-tokenizer never lets a token cross white space and its normaliser never joins
    characters across it, so a text's ids are the ids of its words in order. It also always parts a letter
    or digit from punctuation that ends the word, and lower-cases, so texts are first brought to that form
    (not those with special strings, which are case-sensitive). The library encodes every word that is not
    remembered, many in one call; ids are kept as little-endian unsigned 32-bit bytes. The memory has two
    generations of about MOST words each: a full one is set aside, and words met again come back.
    """

    MOST, LONG = 200_000, 48

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.closes = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes], together: int = 200) -> dict[bytes, bytes]:
        """Ids of each word from the library, which gets the words in lines. Words of letters alone end with the id that
        closes a word; others are encoded one by one."""
        import numpy as np

        if not words:
            return {}
        out: dict[bytes, bytes] = {}
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        plain = list(map(str.isalpha, texts))
        others = [(w, t) for w, t, p in zip(words, texts, plain, strict=True) if not p]
        letters, words = list(compress(texts, plain)), list(compress(words, plain))
        spans = range(0, len(letters), together)
        for a, e in zip(spans, self.library.encode_batch_fast(["\n".join(letters[a : a + together]) for a in spans], add_special_tokens=False), strict=True):
            ids, line = np.array(e.ids, "<u4"), words[a : a + together]
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            if len(ends) != len(line):
                others += zip(line, letters[a : a + together], strict=True)
                continue
            data = ids.tobytes()
            out.update(zip(line, [data[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
        for (w, _), e in zip(others, self.library.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def many(self, texts: list[bytes | None], most: int = 200_000) -> list[bytes]:
        """The ids of UTF-8 texts; about `most` words are held at a time, and a very long text is taken in pieces of whole words."""
        done: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0
        for i, t in enumerate(texts):
            if t and b"<|" not in t:
                t = ENDS.sub(rb" \1\2", t.lower())
            for words in word_runs(t or b"", 1 << 20):
                held.append((i, words))
                n += len(words)
                if n > most:
                    self._fill(held, done)
                    held, n = [], 0
        self._fill(held, done)
        return [x[0] if len(x) == 1 else b"".join(x) for x in done]

    def _fill(self, held: list[tuple[int, list[bytes]]], done: list[list[bytes]]) -> None:
        every = set().union(*[words for _, words in held])
        missing = every.difference(self.seen)
        if len(self.seen) + len(missing) > self.MOST:
            self.old, self.seen, missing = self.seen, {}, every
        back = missing.intersection(self.old)
        self.seen.update(zip(back, map(self.old.__getitem__, back), strict=True))
        self.seen.update(self.encode(sorted(missing - back)))
        for i, words in held:
            done[i].append(b"".join(map(self.seen.__getitem__, words)))
        for w in [w for w in missing if len(w) > self.LONG]:
            del self.seen[w]


def word_runs(data: bytes, piece: int = 1 << 20):
    """Lists of the words of a text, about piece bytes at a time, never cutting a word."""
    at = 0
    while at < len(data):
        end = at + piece
        while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield data[at:end].split()
        at = end
