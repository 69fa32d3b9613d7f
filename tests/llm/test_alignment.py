import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import alignment
from loomwright.llm.common import vocabulary

ODD = ["", "  x  y\n\n z ", " ", "\n", "a\n b", "x\ty z", "日本語のテキスト です。", "▁x y", "<|endoftext|> <s> <0x41> a", "é é", "a" * 5000, "日本" * 3000, "  b　 c", "q\x1c r s\x85 t", "don't we'll it's 12 345", "a \n b", "x\r\ny", "é ́x", "� \x00 a"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def brute(pair, text):
    """One text by the libraries and plain loops: ids, links, groups as written; None without tokens."""
    if not text:
        return None
    ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    spans = []
    for x, table in zip(ids, (pair.a_bytes, pair.b_bytes), strict=True):
        if b"".join(table[i] for i in x) != (" " + text).encode():
            return None
        ends = np.cumsum([len(table[i]) for i in x]).tolist()
        spans.append(list(zip([0, *ends], ends, strict=False)))
    links, low = [], 0
    for i, (s, e) in zip(ids[0], spans[0], strict=True):
        while spans[1][low][1] <= s:
            low += 1
        j = low
        while j < len(spans[1]) and spans[1][j][0] < e:
            links.append((i, ids[1][j]))
            j += 1
    groups, at = [], [0, 0]
    for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        sides = []
        for k in (0, 1):
            n = at[k]
            while n < len(ids[k]) and spans[k][n][1] <= cut:
                n += 1
            sides.append(",".join(map(str, ids[k][at[k] : n])))
            at[k] = n
        groups.append("|".join(sides))
    return ids, links, groups


def whole(pair, docs):
    """The rows of the query, by brute force."""
    each = [(i, brute(pair, t)) for i, t in docs]
    count = Counter(x for _, b in each if b for x in b[1])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    none = (0, 0, 0, 0, 0, 0, "")
    return sorted(
        repr((i, *none) if b is None else (i, len(b[0][0]), len(b[0][1]), len(b[2]), len(b[1]), sum(count[x] == most[x[1]] for x in b[1]), sum(count[x] for x in b[1]), hashlib.sha256(";".join(b[2]).encode()).hexdigest()))
        for i, b in each
    )


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tab'1.é日 ▁") if rng.random() < 0.5 else rng.choice("abc the") for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_lockstep_against_plain_loops(pair):
    every = ODD + texts(1500) + [" ".join(texts(400, 2)).replace("▁", "")]
    got = alignment.aligned(pair, every, detail=True)
    assert pair.cuts and sum(brute(pair, t) is not None for t in every) > 500
    for k, t in enumerate(every):
        want = brute(pair, t)
        if want is None:
            assert not got["n_a"][k] and not got["n_links"][k] and got["groups_sha256"][k] == "" and not got["codes"][k] and not got["a_ids"][k]
            continue
        (a, b), links, groups = want
        assert got["a_ids"][k] == a and got["b_ids"][k] == b and (got["n_a"][k], got["n_b"][k]) == (len(a), len(b))
        assert (got["n_groups"][k], got["n_links"][k]) == (len(groups), len(links)) and got["groups_sha256"][k] == hashlib.sha256(";".join(groups).encode()).hexdigest()
        codes = dict(zip(np.frombuffer(got["codes"][k], "<u8").tolist(), np.frombuffer(got["counts"][k], "<u4").tolist(), strict=True))
        assert codes == Counter(x * len(pair.b_bytes) + y for x, y in links)
        ends = list(zip([0, *got["a_ends"][k]], got["a_ends"][k], [0, *got["b_ends"][k]], got["b_ends"][k], strict=False))
        assert [",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[x:y])) for i, j, x, y in ends] == groups


def test_whole_texts_where_units_are_not_safe(pair):
    other = alignment.Pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    other.cuts = False
    every = ODD + texts(100, 3)
    one, two = alignment.aligned(pair, every), alignment.aligned(other, every)
    assert all(np.array_equal(one[k], two[k]) for k in one)


@pytest.mark.parametrize("head", [1_000_000, 50, 0])
def test_query_against_brute_force(spark, frame, pair, head):
    docs = list(enumerate(ODD + texts(200, 4))) + [(7, "the end of the line"), (7, "the end of the line"), (None, "the end"), (8, None), (9, "long words and lines\n" * 20_000)]
    df = frame(docs).withColumns({"codes": F.lit("x"), "n": F.lit(1), "n_a": F.lit(2), "_lw_key": F.lit("y"), "best": F.lit(0)})
    assert sorted(repr(tuple(r)) for r in alignment.alignment(df, head=head).collect()) == whole(pair, docs)


def test_whole_table_and_none(spark, small, pair):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in alignment.alignment(docs).collect()) == whole(pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.alignment(docs.limit(0)).count() == 0
