import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomwright.llm import simhash
from loomwright.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    h = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def plain_classes(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


TEXTS = [None, "", " \t\n", "One", "one", "a b c", "A b c D", "x " * 50, "é É straße Straße a b", "no-break space is no space here", "w" * 5000, "the cat sat on the mat " * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_contract_s(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_long_text_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_native_hash_agrees(spark):
    df = spark.createDataFrame([("a b c é",)], "t string").select(F.xxhash64("t").alias("h"))
    assert df.first().h & (1 << 64) - 1 == xxh64_intdigest("a b c é".encode(), 42)


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    fps = {0} | {rng.getrandbits(64) for _ in range(150)}
    center = rng.getrandbits(64)
    for _ in range(250):  # a dense ball
        x = center
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            x ^= 1 << b
        fps.add(x)
    walk = rng.getrandbits(64)
    for _ in range(40):  # a chain
        for b in rng.sample(range(64), 4):
            walk ^= 1 << b
        fps.add(walk)
    want = plain_classes(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {}
    for r in simhash.classes(df).collect():
        got.setdefault(r.root, set()).add(int(np.int64(r.fp).view(np.uint64)))
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    cls = plain_classes(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[cls[f]] = min(d, least.get(cls[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{f:016x}", least[cls[f]]) for d, f in fps.items()}


def test_edges(frame):
    rows = [(5, None), (3, ""), (9, "same text here for all"), (9, "same text here for all"), (7, "SAME text here for all"), (None, "same text here for all"), (None, "alone it stands quite alone")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(rows)).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (7, 7), (9, 7), (9, 7), (None, 7), (None, None)], key=str)
    kept = sorted((r.doc_id or -1, r.size) for r in simhash.keep_first(frame(rows)).collect())
    assert kept == [(-1, "x"), (3, "x"), (7, "x")]
    assert simhash.near_duplicates(frame([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_of_chains_and_stars(spark, few):
    e = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long"), few=few).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_stage_links_at_similarity_of_shingles(frame):
    rng = random.Random(7)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for _ in range(12):
            words = list(words)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(200)] = f"n{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(words)))
    line = "one line that very many of the texts hold in the middle of their own words "
    rows += [(len(rows) + i, f"a{i} b{i} c{i} {line} d{i}") for i in range(60)]
    sets = {i: plain_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i for i in sets if find(i) == i}
    got = {r.doc_id for r in simhash.keep_first(frame(rows)).collect()}
    # What is dropped is linked at 0.8 or more, without exception; the fingerprints find nearly all such links.
    assert want <= got and len(got - want) <= 0.05 * (len(rows) - len(want))


def test_stage_against_all_pairs_of_the_smallest_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, frozenset(plain_sets(r.text))) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, sa) in enumerate(rows):
        for b, sb in rows[:k]:
            if 10 * len(sa & sb) >= 8 * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i for i, _ in rows if find(i) == i}
    got = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert want <= got and len(got - want) <= 1 and len(got) < len(rows)


def family(rng, size=60, n=90):
    """Sets around one base: each swaps some of its hashes for others, and some repeat another one's swaps with few more."""
    base = [rng.getrandbits(63) for _ in range(size)]
    out = []
    for i in range(n):
        own = set(base) if i % 3 or not out else set(rng.choice(out))
        for h in rng.sample(sorted(own), rng.randrange(0, 3) if i % 3 == 0 else rng.randrange(0, 18)):
            own.discard(h)
            own.add(rng.getrandbits(63))
        out.append(frozenset(own))
    return list(dict.fromkeys(out))


def alike_sets(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def test_bounds_allow_all_that_are_alike(spark):
    sets = family(random.Random(5))
    bounds = [(len(s), *map(int, simhash.parity(np.array(sorted(s), np.uint64)))) for s in sets]
    rows = [(i, j, *bounds[i], *bounds[j]) for i in range(len(sets)) for j in range(i)]
    names = ["i", "j", *[f"{side}_{c}" for side in "ab" for c in simhash.BOUNDS]]
    got = {(r.i, r.j) for r in spark.createDataFrame(rows, names).where(simhash.may_be_alike("a", "b", 8)).collect()}
    links = {(i, j) for i, j in ((r[0], r[1]) for r in rows) if alike_sets(sets[i], sets[j])}
    assert links and links <= got and len(got) < len(rows) / 2


@pytest.mark.parametrize("start", [[], [(0, 1)]])
def test_hubs_and_prefixes_lose_no_link(spark, start):
    sets = family(random.Random(11))
    held = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "node long, n int, set array<bigint>")
    bounds = spark.createDataFrame([(i, len(s), *map(int, simhash.parity(np.array(sorted(s), np.uint64)))) for i, s in enumerate(sets)], ["node", *simhash.BOUNDS])
    links = spark.createDataFrame(start, "a long, b long")
    known = components(links)
    spots = spark.createDataFrame([(i, 0 if i == 1 and start else i, 0) for i in range(len(sets))], "node long, root long, main long")
    got = simhash.through_hubs(spots, known, links, lambda pairs: simhash.alike(pairs, held, 8), lambda nodes: held.join(nodes, "node"), bounds, 8)
    root = {i: i for i in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in [*start, *[(i, j) for i in root for j in range(i) if alike_sets(sets[i], sets[j])]]:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in got.collect()} == {i: find(i) for i in root if sum(find(j) == find(i) for j in root) > 1}
    assert len({find(i) for i in root}) > 5
