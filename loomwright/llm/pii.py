"""Personal data by exact patterns and a boosted-tree judge of further candidates."""

from __future__ import annotations

import bisect
import hashlib
import pickle
import random
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import bounded_sample, cut, slices

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract; an email's host is sought first and its name is read backwards from there.
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can begin inside a run of digits only where it could at the run's start, and ends with a run: no start inside one is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Generators of further candidates, wider than the patterns above.
AT, DOT = r"(?:@|\[at\]|\(at\)|\{at\}|<at>|[ _-](?:at|AT)[ _-])", r"(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>|\[\.\]|\(\.\)|[ _-](?:dot|DOT)[ _-])"
WIDE = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}\s?{AT}\s?[A-Za-z0-9-]{{1,63}}(?:\s?{DOT}\s?[A-Za-z0-9-]{{1,63}}){{1,4}}"),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:\s?(?:{DOT}|\{{\.\}}|,)\s?[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9](?:[ .\-–—_/,:|]{0,3}[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+|00|\()?[0-9](?:[ ().\-–—_/]{0,3}[0-9]){6,14}"),
}
#: Texts without any of these hold no candidate for an email.
MAIL = re.compile(r"@|at[\])}>]|[ _-](?:at|AT)[ _-]")
CUES = {
    "email": re.compile(r"mail|contact|write|reach|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay|expir|cvv", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|cell|fax|whatsapp|contact|sms", re.I),
}
DIGIT = re.compile(r"[0-9]")
FOLDS = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the contract's base: leftmost, not overlapping within a kind, failing matches dropped."""
    out = []
    if "@" in text:
        free = 0
        for m in HOST.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in NAME:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                free = m.end()
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together, in order."""
    starts, ends = [], []
    for _, a, e in sorted(spans, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(a)
            ends.append(e)
    return starts, ends


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the wide generators that touch no base span; spans of different kinds may overlap. Each is sought by halving
    among the stretches that base spans cover, so many spans cost no more than their sorting."""
    has_digit = DIGIT.search(text) is not None
    out = []
    for kind in KINDS:
        if has_digit if kind != "email" else MAIL.search(text):
            out += [(kind, m.start(), m.end()) for m in WIDE[kind].finditer(text)]
    starts, ends = merged(base)
    free = lambda a, e: (k := bisect.bisect_right(ends, a)) == len(ends) or e <= starts[k]
    return [c for c in out if free(c[1], c[2])]


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 24]
    digits = only_digits(s)
    groups = re.findall(r"[0-9]+", s)
    parts = [int(g[:6]) for g in groups[:4]]
    near = lambda c: float(c.isalnum()) if c else 0.0
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(luhn(digits)) if digits else 0.0,
        float(sum(p <= 255 for p in parts)) if len(groups) == 4 else -1.0, float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(s[:1] == "+"), float(s[:2] == "00"), float("(" in s), float(s.count(" ")), float(s.count("-")), float(s.count(".")), float("@" in s), float("at" in s.lower() and "@" not in s),
        float(len(re.split(r"\.|dot", s, flags=re.I)[-1].strip(" ])}")) if kind == "email" else 0), near(before[-1:]), near(after[:1]), float(before[-1:] in "#$€=_/:\"" if before else 0),
        float(bool(CUES[kind].search(before))), float(bool(CUES[kind].search(after))), float(len(DIGIT.findall(before))), float(len(DIGIT.findall(after))), float(len(set(digits)) if digits else 0),
        float(any(c in s for c in "[({<")), float(bool(re.search(r"[.,]\s", s))), float("\n" in s), float(any("A" <= c <= "Z" for c in s)), float(any(c.isalpha() for c in s)),
        float(re.split(r"\.|dot", s, flags=re.I)[-1].strip(" ])}>").isalpha()), float(digits != "" and len(digits) > 0.4 * len(s)),
    ]


def letters(rng: random.Random, least: int = 3, most: int = 9) -> str:
    return "".join(rng.choice("aabcdeefghiijklmnoopqrstuuvwxyz") for _ in range(rng.randrange(least, most)))


def disguised(kind: str, s: str, rng: random.Random) -> str:
    """Another common way to write a base span, which the base patterns miss."""
    if kind == "email":
        at, dot = rng.choice([("[at]", "."), ("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", "(dot)"), ("@", " dot "), (" [at] ", ".")])
        name, host = s.rsplit("@", 1)
        if rng.random() < 0.6:  # other names and hosts than this corpus has
            name = letters(rng) + rng.choice(["", "", rng.choice("._-") + letters(rng), str(rng.randrange(100))])
            host = letters(rng) + rng.choice(["", "", "-" + letters(rng), str(rng.randrange(10))]) + "." + rng.choice(["com", "org", "net", "de", "fr", "io", "co.uk", "info"])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        dot = rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]"])
        return s.replace(".", dot, rng.choice([1, 3, 3, 3]))
    d = only_digits(s)
    if kind == "card":
        sep = rng.choice([".", "/", "  ", "–", " - "])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    if rng.random() < 0.5:  # without its country
        d = d[-10:]
    return rng.choice([f"00{d}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[1:4]}/{d[4:]}", f"00 {d[:2]} {d[2:5]} {d[5:]}", f"{d[:3]} {d[3:6]} {d[6:]}"])


def spoiled(kind: str, s: str, rng: random.Random) -> str:
    """A look-alike that is no personal data: a broken checksum, a part over 255, a date, a version, a bare number."""
    d = only_digits(s) or str(rng.randrange(10**9))
    if kind == "card":
        n = "".join(str(rng.randrange(10)) for _ in range(rng.choice([13, 14, 15, 16, 17, 18])))
        return n if not luhn(n) else n[:-1] + str((int(n[-1]) + 1) % 10)
    if kind == "ip":
        return ".".join(str(rng.choice([rng.randrange(256, 999), rng.randrange(20)])) for _ in range(4)).replace(".", rng.choice([".", " . "]), 3)[:40] if rng.random() < 0.7 else f"{rng.randrange(300, 900)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}"
    if kind == "phone":
        return rng.choice([f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(10**7, 10**12)}", f"{rng.randrange(1, 99)}.{rng.randrange(100, 999)}.{rng.randrange(100, 999)}", f"{d[:2]}-{d[2:3]}-{d[3:9]}"])
    a, b, c = letters(rng), letters(rng), letters(rng)
    return rng.choice([f"{a} at {b}. {c.title()}", f"{a} at {b}.\n{c.title()} {b}", f"{a} at {b}. {c}", f"at {d[:3]}", f"look at me. {d[:2]}", f"{d[:3]} @ {d[3:5]}.{d[5:7]}", f"arrive at noon.{d[:1]}"])


@dataclass
class Judge:
    """Boosted trees over candidate features with a threshold per kind; None accepts nothing."""

    trees: object
    limits: dict[str, float]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates above their kind's threshold, best first, none overlapping another."""
        import numpy as np

        found = candidates(text, base) if self.trees is not None else []
        if not found:
            return []
        z = np.concatenate([self.trees.decision(np.array([features(text, c) for c in found[i : i + 4096]])) for i in range(0, len(found), 4096)])
        starts: list[int] = []
        taken: list[tuple[str, int, int]] = []
        for i in np.lexsort((np.arange(len(z)), -z)):
            kind, a, e = found[i]
            if z[i] < self.limits.get(kind, float("inf")):
                continue
            k = bisect.bisect_left(starts, a)
            if (k == 0 or taken[k - 1][2] <= a) and (k == len(taken) or e <= starts[k]):
                starts.insert(k, a)
                taken.insert(k, found[i])
        return taken


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 2_000, most_cases: int = 20_000, precision: float = 0.98, seed: int = 3) -> Judge:
    """A judge fitted on a bounded sample of at most most_rows texts that hold a digit or an at sign, chosen by a seeded hash.

    No table labels personal data, so the sample labels itself: each base span is rewritten in its own
    sentence in a way the base patterns miss (right) and as a look-alike (wrong), and candidates as the
    texts hold them, such as a number that fails its checksum or an "at" in prose, count as wrong. Texts are dealt to
    FOLDS folds; trees of the other folds score each fold, and these scores set each kind's threshold at the wanted
    precision, before the trees are grown again on all. Every span and candidate of a sampled text
    is a case; at most most_cases cases, again by a seeded hash, come to the driver as features.
    """
    holds = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9]{3}|@"))
    sample = bounded_sample(holds, most_rows, "id", seed).select("id", "t")

    def rewrite(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rng = random.Random(f"{seed}:{key}")
                base = base_spans(text)
                fold = rng.randrange(FOLDS)
                cases = [(text, c, 0) for c in candidates(text, base)]
                for kind, s, e in base:
                    left, right = text[max(0, s - 60) : s], text[e : e + 40]
                    for label, make in ((1, disguised), (1, disguised), (0, spoiled), (0, spoiled)):
                        new = make(kind, text[s:e], rng)
                        line = (left := left + "at " if kind == "ip" and rng.random() < 0.3 else left) + new + right
                        lies = [c for c in candidates(line, base_spans(line)) if c[1] < len(left) + len(new) and c[2] > len(left)]
                        cases += [(line, c, int(label and c[0] == kind and abs(c[1] - len(left)) <= 1 and abs(c[2] - len(left) - len(new)) <= 1)) for c in lies]
                rows += [(f"{key}:{i}", features(t, c), y, fold) for i, (t, c, y) in enumerate(cases)]
            kinds = pa.string(), pa.list_(pa.float64()), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["case", "x", "y", "fold"])

    every = cut(cut(sample).mapInArrow(rewrite, "case string, x array<double>, y int, fold int"))
    got = sorted((tuple(r[0]), r[1], r[2]) for r in bounded_sample(every, most_cases, "case", seed).select("x", "y", "fold").collect())
    import numpy as np

    from loomwright.llm.boosting import Boosted, calibrated_threshold

    x, y, fold = np.array([r[0] for r in got]), np.array([r[1] for r in got], float), np.array([r[2] for r in got])
    if len(np.unique(y)) < 2 or any(len(np.unique(y[fold != f])) < 2 for f in range(FOLDS)):
        return Judge(None, {})
    # One task for each fold left out and one for none; the cases, bounded above, go to each of them.
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast((x, y, fold))

    def fit(batches):
        import pyarrow as pa

        x, y, fold = share.value
        for b in batches:
            out = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps(Boosted().fit(x[fold != f], y[fold != f])) for f in out], pa.binary())], names=["id", "model"])

    models = {r.id: pickle.loads(r.model) for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "id long, model binary").collect()}
    z, limits = np.zeros(len(y)), {}
    for f in range(FOLDS):
        z[fold == f] = models[f].decision(x[fold == f])
    for i, kind in enumerate(KINDS):
        mine = x[:, 0] == i
        limits[kind] = max(0.0, calibrated_threshold(z[mine], y[mine], precision))
    return Judge(models[FOLDS], limits)


def find(docs: DataFrame, keep: list[str], judge: Judge, text_col: str = "text") -> DataFrame:
    """The kept columns with base and added: arrays of kind, start, end (code points, end exclusive) in order of kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    order = {k: i for i, k in enumerate(KINDS)}

    def each(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        listed = lambda spans: [{"kind": k, "start": a, "end": e} for k, a, e in sorted(spans, key=lambda s: (order[s[0]], s[1]))]
        for b in slices(batches):
            base, more = [], []
            for t in b.column(len(keep)).to_pylist():
                spans = base_spans(t) if t else []
                base.append(listed(spans))
                more.append(listed(shared.value.added(t, spans)) if t else [])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(base, kind), pa.array(more, kind)], names=[*keep, "base", "added"])

    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("base", span), T.StructField("added", span)])
    return docs.select(*keep, F.col(text_col).alias("_lw_text")).mapInArrow(each, schema)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans with the judge's too.

    A null text counts as empty: no spans, and the hash of nothing. Repeated rows repeat.
    """
    found = find(docs, [id_col], train(docs, id_col, text_col), text_col)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    place = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), place))
    by = lambda k: lambda s: s["kind"] == k
    n = [F.size(F.filter("base", by(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *n, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are replaced together, and
    size_col, where the table has it, is counted anew for the texts that changed. Other columns stay."""
    judge = train(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = sorted((a, e, k) for k, a, e in base + shared.value.added(text, base))
        out, done = [], 0
        while spans:
            a, e, k = spans.pop(0)
            while spans and spans[0][0] < e:
                e = max(e, spans.pop(0)[1])
            out += [text[done:a], f"[{k.upper()}]"]
            done = e
        return "".join([*out, text[done:]])

    def each(batches):
        import pyarrow as pa

        for b in slices(batches):
            new = pa.array([clean(t) if t else t for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=names)

    out = docs.mapInArrow(each, docs.schema)
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in names else out


def sha_of(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of plain Python spans, for tests."""
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in order).encode()).hexdigest()
