"""Personal data, licences, quality, packing, main text, toxicity, token counts."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import html, licenses, packing, pii, quality, tokens, toxicity
from loomwright.llm.common import WordIds, vocabulary


# Personal data ------------------------------------------------------------------------------------------------------
def plain_base(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        odd = sum(int(x) for x in d[-1::-2])
        even = sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and (odd + even) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_on_random_texts():
    rng = random.Random(0)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", ".", "@", "-", "1", "25", "0", "+", " ", "(", ")", "%", "é", "4111111111111111", "192.168.0.1", "x@y.z", "\n"]) for _ in range(rng.randrange(30)))
        assert sorted(pii.base_spans(t)) == sorted(plain_base(t)), t


def test_query_keeps_base_and_adds_disguised_forms(spark, small, frame):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r.base_sha256 == pii.sha_of(base)
        assert {f"{k}:{a}:{e}" for k, a, e in base} <= set(r.spans.split(",") if r.spans else [])
    rng = random.Random(4)
    card = lambda: next(c for c in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), "") if pii.luhn(c))
    rows = [(i, f"please write to ann{i}@mail{i % 7}.org or call +1 ({200 + i % 700}) 555-{1000 + i % 9000} about card {card()} from host 10.0.{i % 250}.7 today") for i in range(400)]
    judge = pii.train(frame(rows))
    assert judge.trees is not None
    t = "please write to ann907[at]mail3.org or call +1 (300) 555-2222 about card 5222/5754/8020/4181 from host 10.0.9.7 today"
    assert {k for k, _, _ in judge.added(t, pii.base_spans(t))} >= {"email", "card"}
    calm = "In 1998 there were 12345678 lines, version 3.14.15, on page 7 of 300.400.500.600 at noon. Done"
    assert judge.added(calm, pii.base_spans(calm)) == []


def test_personal_data_edges(frame):
    docs = frame([(1, None), (2, ""), (None, "a@b.c"), (3, "x" * 200_000 + " a@b.co")])
    got = {r.doc_id: (r.n_email, r.spans) for r in pii.personal_data(docs).collect()}
    assert got == {1: (0, ""), 2: (0, ""), None: (1, "email:0:5"), 3: (1, "email:200001:200007")}
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert out[None] == ("[EMAIL]", 7) and out[1] == (None, None) or out[1][0] is None
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).columns == docs.columns


# Licences -----------------------------------------------------------------------------------------------------------
def test_notices():
    t = "Some prose.\nLicensed under the Apache License, Version 2.0.\nmore\nThis work is licensed under the GNU General Public License, version 3."
    got = [(n["license"], t[n["start"] : n["end"]]) for n in licenses.notices(t, licenses.TEMPLATES)]
    assert got == [("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3")]
    for near in ("Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-ND 4.0.", "This is not Released under the MIT License, we took no licence.", "Drivers need a licence. Copyright is a word."):
        assert [n["license"] for n in licenses.notices(near, licenses.TEMPLATES) if n["missing"] or n["extra"]] == [] and not any(n["license"] in ("Apache-2.0", "CC-BY-NC-4.0") for n in licenses.notices(near, licenses.TEMPLATES))


def test_scan(spark, small, frame):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {(r.doc_id, name) for r in docs.collect() for name, ts in licenses.TEMPLATES.items() for t in ts for line in (r.text or "").split("\n") if line == t}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} >= want and want
    assert licenses.scan(frame([(1, None), (2, ""), (3, "licence")])).count() == 0


# Quality ------------------------------------------------------------------------------------------------------------
def plain_measures(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_measures(frame):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "b", "c d", " ", " ", "\n", "\t", "é", "#", "|", " "]) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "a b c d e " * 400), (903, "x y z\n" * 30), (904, " a b c d e"), (905, "a b c d e a b c d e")]
    texts = dict(rows)
    for r in quality.report(frame(rows)).collect():
        m = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, texts[r.doc_id]
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r.kept and r.base_failed)


def test_order_never_changes_verdicts(spark, frame):
    rows = [(i, f"word{i} " * (i % 30) + "more words here and there") for i in range(60)]
    one = sorted((r.doc_id, r.kept) for r in quality.verdicts(frame(rows), rules=dict(quality.RULES)).collect())
    two = sorted((r.doc_id, r.kept) for r in quality.verdicts(frame(rows), rules=dict(reversed(quality.RULES.items()))).collect())
    assert one == two and {k for _, k in one} == {True, False}
    assert len(quality.cascade_order(frame(rows), quality.RULES)) == len(quality.RULES)
    assert quality.report(frame(rows).limit(0)).count() == 0


def test_order_follows_rejection_per_cost_and_no_clock(spark):
    # Half the texts are short, all hold repeats: the rule over windows rejects more, the one over words costs far less.
    rows = [(i, ("a b c " if i % 2 else "so it goes on and on with more " * 4) + f"w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = {"windows": "n_repeat_words > 3", "words": "n_words < 10", "never": "n_symbols > 100000"}
    got = quality.cascade_order(docs, rules, sample_rows=400)
    share, cost = {k: s for k, _, s in got}, {k: c for k, c, _ in got}
    assert [k for k, _, _ in got] == sorted(rules, key=lambda k: (-share[k] / cost[k], k)) and got[0][0] == "words" and got[-1][0] == "never"
    assert share["words"] == share["windows"] == 0.5 and cost["windows"] > 2 * cost["words"]
    # Reruns and other partitionings give the same order and the same rule that failed.
    failed = lambda d: sorted((r.doc_id, r.failed_rule or "") for r in quality.verdicts(d, sample_rows=50).collect())
    assert quality.cascade_order(docs.repartition(7), rules, sample_rows=400) == got and failed(docs) == failed(docs.repartition(5))


# Packing and tokens -------------------------------------------------------------------------------------------------
ODD = ["", " ", "It's. DON'T! <|endoftext|> <|STARTOFTEXT|> x<|startoftext|>.", "éa. É. ½. 3. a̸. ≠ İstanbul. ΣΑΣ. a…. x'. 'S. foo'S. 日本語. \x1c a\x85b a b.", "a" * 300 + ".", "…. .. a*** é%%% x_ y-- 'll. we'LL. 1.5. 1st. Ⅷ. ²."]


@pytest.fixture(scope="module")
def library():
    return WordIds(vocabulary()).library


def test_word_memory_is_exact(library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aB*&_=(. ,!'sé̸́<|>İß1½日\n\t…") for _ in range(60)) for _ in range(1500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    w = WordIds(vocabulary())
    w.MOST = 500
    assert w.many([t.encode() for t in texts], most=300) == want


@pytest.mark.parametrize("text", ["word another, and more. " * 3000, "ab" * 4000, "日本" * 3000, "1234567890" * 2000, "don't <|endoftext|> stop\n\n" * 2500])
def test_spliced_counts(library, text):
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert tokens.spliced(library, text, 2048, 32) == tokens.spliced(library, text) == want


def test_counts(library, frame):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "some words here. " * 9000), (None, "a")]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.counts(frame(rows)).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_the_library_s(name, spark, small, frame):
    from loomwright.llm import common

    path = vocabulary(name)
    assert common.by_words(vocabulary()) and not common.by_words(path)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        ids = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    else:
        from sentencepiece import SentencePieceProcessor

        ids = SentencePieceProcessor(model_file=path).encode
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "some words here. " * 9000)]
    got = {r.doc_id: r.n_tokens for r in tokens.counts(frame(rows), tokenizer=path).collect()}
    assert got == {i: len(ids(t or "")) for i, t in rows}
    by_doc = {}
    for r in packing.pack(frame(rows), tokenizer=path).collect():
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in by_doc.items()} == {i: np.array([*ids(t or ""), 1], "<u4").tobytes() for i, t in rows}


def test_first_fit_is_the_plain_one():
    rng = random.Random(8)
    for _ in range(30):
        needs = sorted((rng.randrange(1, 2048) for _ in range(rng.randrange(1, 300))), reverse=True)
        bins, room = packing.Bins(len(needs), 2048), []
        for n in needs:
            k = next((i for i, r in enumerate(room) if r >= n), len(room))
            room += [2048] * (k == len(room))
            room[k] -= n
            assert bins.first_fit(n) == k


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words in every row " * 20).alias("text"))
    groups = packing.pack(docs, group_bytes=200_000).selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()
    assert len(groups) > 5


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049], [1, 1, 1], [5000, 3, 2047], [random.Random(7).randrange(1, 3000) for _ in range(500)]])
def test_place_covers_every_token_once(lengths):
    seen = {i: np.zeros(n, int) for i, n in enumerate(lengths)}
    seqs = packing.place(lengths)
    for s in seqs:
        assert s and sum(n for _, _, n in s) <= 2048
        for i, a, n in s:
            assert n > 0
            seen[i][a : a + n] += 1
    assert all((v == 1).all() for v in seen.values())
    assert len(seqs) <= sum(lengths) // 2048 + 2


def test_packing_round_trip(library, frame):
    rows = [(i, f"word{i} and more " * (i * 7 % 900)) for i in range(120)] + [(500, None), (501, ""), (7, "twice"), (7, "twice")]
    docs = frame(rows)
    out = packing.pack(docs, group_bytes=200_000).collect()
    by_seq, by_doc = {}, {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids, r.doc_tokens))
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    for i, t in rows:
        want = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        if i != 7:
            assert b"".join(p[2] for p in sorted(by_doc[i])) == want and all(p[3] == len(want) // 4 for p in by_doc[i])
    assert sum(p[1] for p in by_doc[7]) == 2 * 2 + len(library.encode(rows[7][1], add_special_tokens=False).ids) + 1 or len(by_doc[7]) >= 3
    crc = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in packing.pieces(docs).collect()}
    assert crc[501, 0, 1] == zlib.crc32((1).to_bytes(4, "little"))
    assert packing.pack(docs.limit(0)).count() == 0


# Main text ----------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="no-sidebar">
<div class="site-header"><a href="/">Home</a></div><nav><ul><li>Menu</li></ul></nav><div class="wrap%d"><%s><h1>Big &amp; bold</h1><p><b>First  line<br><p>Second &lt;b&gt; &copy text with
a break and words enough to count</p><div class="ad">Buy</div><aside>Side</aside><form><p>Mail</p></form><ul><li>one<li>two</ul><table><tr><td>cell a<td>cell b</table>
<p>Tail with <a href="/x">a link</a>, more text and an unclosed <i>tag</p></%s><div id="comments"><article class="comment"><p>Reader says a lot of words that should not count at all here</p></article></div></div>
<div class="cookie-notice">We use cookies</div><footer>&copy; 2024</footer></body></html>"""
WANT = "Big & bold\nFirst line\nSecond <b> © text with a break and words enough to count\none\ntwo\ncell a\ncell b\nTail with a link, more text and an unclosed tag"


@pytest.mark.parametrize(("opens", "tag"), [("article", "article"), ("main", "main"), ('div class="post-content"', "div")])
def test_extract(opens, tag):
    assert html.extract(PAGE % (3, opens, tag), []) == WANT


def test_hosts_vote(spark):
    rows = [(i, f"https://H.example.org/{i}", PAGE % (i, "article", "article")) for i in range(5)]
    rows += [(9, "https://h.example.org/9", "<p>short"), (10, None, None), (11, "no host", ""), (12, "http://other.net/", "plain text only &amp; more"), (13, "http://x.org", "<div><p>a</p>" * 3000)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (WANT, len(WANT)) for i in range(5))
    assert got[9][0] == "short" and got[10] == got[11] == ("", 0) and got[12][0] == "plain text only & more" and 2 * 2900 < got[13][1] < 2 * 3000
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Toxicity -----------------------------------------------------------------------------------------------------------
def test_pairs_count_where_single_words_do_not():
    rng = random.Random(0)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((int(a and b), [t for t, x in ((1, a), (2, b)) if x] + [rng.randrange(3, 30)]))
    m = toxicity.fit_machine(rows, list(range(1, 30)), epochs=400)
    assert m.score([1, 2]) > 0.8 and max(m.score([1]), m.score([2]), m.score([])) < 0.3


def both_words(n=3000):
    """Texts that are toxic if and only if both of two words occur, each of which 0.4 of the texts hold."""
    rng = random.Random(1)
    vocabulary = [f"w{i}x" for i in range(400)]
    for i in range(n):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = [rng.choice(vocabulary) for _ in range(30)] + ["folk"] * a + ["vermin"] * b
        rng.shuffle(words)
        yield i, " ".join(words), int(a and b)


def test_pairs_are_learned_from_texts(spark):
    rows = list(both_words())
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    mark = {i: y for i, _, y in rows}
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    toxic = [r.predicted for r in held if mark[r.doc_id]]
    assert len(toxic) > 80 and np.mean(toxic) >= 0.9 and np.mean([r.predicted for r in held if not mark[r.doc_id]]) <= 0.05
    # The same machine without its pairs does worse.
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    alone = toxicity.Model(model.bias, model.place, model.weight, 0 * model.factor)
    texts = {i: t for i, t, _ in rows}
    loss = lambda m: -np.mean([np.log(p if mark[r.doc_id] else 1 - p) for r in held for p in [min(max(m.score(toxicity.Reader(frozenset(m.place))(texts[r.doc_id])), 1e-9), 1 - 1e-9)]])
    assert loss(model) < 0.5 * loss(alone)


def test_words_that_matter_only_beside_others_are_inputs(spark):
    # "grim" leans to toxic; "folk" says nothing by itself, and decides beside it.
    rng, rows = random.Random(2), []
    for i in range(2400):
        a, b = rng.random() < 0.3, rng.random() < 0.5
        y = int((a and b) or (not a and not b and rng.random() < 0.22))
        words = [f"w{rng.randrange(300)}x" for _ in range(20)] + ["grim"] * a + ["folk"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert set(toxicity.terms("folk")[:1]) <= set(model.place)


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.8), ("sf0.1", 0.95)])
def test_held_out_quality(spark, sf, least):
    d = f"/root/testdata/{sf}"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    mark = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, mark[r.doc_id]) for r in rows if r.held_out and r.doc_id in mark]
    pos, neg = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]) > least


def test_labels_of_held_out_rows_are_never_read(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, lab).collect()) for lab in (labels, flipped))
    assert one == two


def test_toxicity_edges(spark, frame):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame([(1, None), (2, ""), (3, "fine words"), (3, "fine words"), (None, "x"), (4, "long " * 200_000)])
    assert toxicity.toxicity(docs.withColumn("score", F.lit("a clash")).withColumn("_lw_y", F.lit(1)), labels).count() == 6
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.clean(docs, labels).columns == docs.columns


@pytest.mark.parametrize("attrs", ['href="/hidden-valley"', 'title="the hidden city"', 'data-hidden="false"', 'href="/p?id=ad-server"', 'data-role="navigation"', "title='class=ad'", "href=/a?class=sidebar"])
def test_main_text_reads_attribute_names(attrs):
    page = f"<html><body><article><p>Before it <a {attrs}>the words of a link</a> and after it.</p></article></body></html>"
    assert html.extract(page, []) == "Before it the words of a link and after it."
    assert html.describe("div", f' {attrs} class="text" id=a1 ') == ("div.text", False, True)


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", 'a="b"hidden', "aria-hidden = true", "role='navigation'", "class=ad", 'style="x: y; display : none"', 'id="sidebar" id="text"'])
def test_main_text_leaves_out_what_is_marked(attrs):
    assert html.describe("div", f" {attrs} ")[1]


@pytest.mark.parametrize("before", ["", " * ", "# "])
@pytest.mark.parametrize("width", [30, 50, 72])
def test_licences_wrapped_over_lines(before, width):
    import textwrap

    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            page = "Some prose.\n\n" + textwrap.indent(textwrap.fill(t, width, break_long_words=False), before, lambda _: True) + "\n\nMore of it."
            got = licenses.notices(page)
            assert licenses.CUES.search(t) and [(n["license"], n["missing"], n["extra"]) for n in got] == [(name, "", "")], t
            assert licenses.words(page[got[0]["start"] : got[0]["end"]])[-1] == licenses.words(t)[-1]


def test_spdx_lines_and_near_misses():
    names = lambda t: [n["license"] for n in licenses.notices(t)]
    assert names("// SPDX-License-Identifier: MIT\nint main;") == ["MIT"] and names("# SPDX-License-Identifier: GPL-2.0-or-later\n") == ["GPL-2.0"]
    assert names("x SPDX-License-Identifier: Apache-2.0 y\nSPDX-License-Identifier: BSD-2-Clause") == ["Apache-2.0", "BSD-2-Clause"]
    assert names("SPDX-License-Identifier: LicenseRef-Own") == names("This code has a MIT feel and no licence.") == []
    assert names("Licensed under the MIT License.") == ["MIT"] and names("It is licensed under GPLv3.") == ["GPL-3.0"]
    assert names(licenses.TEXTS["BSD-3-Clause"][1].replace("3. Neither", "3. All of")) != ["BSD-3-Clause"]
    assert names(licenses.TEXTS["BSD-2-Clause"][0]) == ["BSD-2-Clause"] and names(licenses.TEXTS["AGPL-3.0"][0]) == ["AGPL-3.0"]
    assert names(licenses.TEXTS["MPL-1.1"][0].replace("1.1", "1.0")) == []


def test_scan_against_every_template_at_every_place(spark, small):
    """Brute force: each template against the words around each word of each text, not packed, not ranked."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = set()
    for d, t in docs.items():
        if not licenses.CUES.search(t):
            continue
        w = licenses.words(t)
        for name, ts in licenses.TEMPLATES.items():
            for a in map(licenses.words, ts):
                m, rare = licenses.reach(len(a)), set(a) & licenses.TERMS
                for k in range(0, len(w), max(1, m // 3)):
                    b = w[k : k + 2 * m]
                    if rare <= set(b) and len(set(a) & set(b)) >= 0.8 * len(set(a)) and licenses.differences(a, b, 0.85):
                        want.add((d, name))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == want and want


def test_scan_edges(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, None, "x"), (2, "", "x"), (None, notice, "x"), (3, "a " * 200_000 + notice + " b" * 200_000, "x"), (4, notice, "x"), (4, notice, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or -1, r.license, r.start) for r in licenses.scan(docs).collect())
    assert got == [(-1, "Apache-2.0", 0), (3, "Apache-2.0", 400_000), (4, "Apache-2.0", 0), (4, "Apache-2.0", 0)]
    assert licenses.scan(docs.limit(0)).columns == ["doc_id", "license", "start", "end", "saved", "missing", "extra", "or_later"]


def test_licences_beyond_the_fourth_in_rank():
    # Near templates save more bytes, but each has a term that the text lacks.
    text = "This tool is licensed under the GNU General Public License, version 3."
    near = {f"L{i}": [f"{text[:-1]}, not {w}."] for i, w in enumerate("one two six ten red".split())}
    right = {"right": ["This work is licensed under the GNU General Public License, version 3."]}
    assert [n["license"] for n in licenses.notices(text, {**near, **right})] == ["right"]


def test_licences_wrapped_with_another_term():
    for t in ("This work is licensed under the\nGNU Lesser General\nPublic License, version 2.", "This work is licensed under a\nCreative Commons Attribution-\nNoDerivatives 3.0 Unported License.", "Licensed under the Apache\nLicense, Version 1.1."):
        assert licenses.notices(t, licenses.TEMPLATES) == []
    # The term behind the wrapped hyphen decides; that licence has a template of its own.
    nd = "This work is licensed under a\nCreative Commons Attribution-\nNoDerivatives 4.0 International License."
    assert [n["license"] for n in licenses.notices(nd, licenses.TEMPLATES)] == ["CC-BY-ND-4.0"]
    assert licenses.notices(nd, {k: v for k, v in licenses.TEMPLATES.items() if k != "CC-BY-ND-4.0"}) == []
    two = "Licensed under the Apache\nLicense, Version 2.0.\nThis work is licensed under the GNU General\nPublic License, version 3."
    assert [n["license"] for n in licenses.notices(two, licenses.TEMPLATES)] == ["Apache-2.0", "GPL-3.0"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# SPDX-License-Identifier: MIT OR Apache-2.0\nimport x", [("MIT", False), ("Apache-2.0", False)]),
        ("// SPDX-License-Identifier: (MIT AND BSD-3-Clause)", [("MIT", False), ("BSD-3-Clause", False)]),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR LicenseRef-x", [("GPL-2.0", True)]),
        ("SPDX-License-Identifier: GPL-2.0+\nx", [("GPL-2.0", True)]),
        ("SPDX-License-Identifier: GPL-3.0-or-later\nx", [("GPL-3.0", True)]),
        ("MIT License\n\nCopyright (c) 2020 Some One\n", [("MIT", False)]),
        ("version: 1\nLicense: MIT\nauthor: x", [("MIT", False)]),
        ("This project is MIT licensed.", [("MIT", False)]),
        ('name = "x"\nlicense = "Apache-2.0"\n', [("Apache-2.0", False)]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n", [("Apache-2.0", False)]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", [("GPL-3.0", False)]),
        ("This code has a MIT feel and no licence.", []),
        ("The MIT students have a driving license.", []),
        ("SPDX-License-Identifier: LicenseRef-A OR LicenseRef-B", []),
    ],
)
def test_expressions_titles_and_fields(text, want):
    assert [(n["license"], n["or_later"]) for n in licenses.notices(text)] == want
