"""Personal data planted in forms that the judge's training never writes, and look-alikes, with precision and recall per kind."""

import random
import time

import pytest

from loomwright.llm import pii

LEAD = {"email": ["please write to ", "contact: ", "mail me at ", "reach him via "], "ip": ["the server at ", "from host ", "login from ", "address "], "card": ["card number ", "paid by card ", "visa ", "my credit card is "], "phone": ["call ", "phone: ", "tel. ", "my number is ", "whatsapp "]}


def planted(kind, rng):
    if kind == "email":
        n, h, t = rng.choice(["ann", "bob.lee", "k_meier", "j99"]), rng.choice(["mail", "post-box", "firma7"]), rng.choice(["org", "com", "net"])
        return rng.choice([f"{n}{{at}}{h}.{t}", f"{n} AT {h} DOT {t}", f"{n} [at] {h} [dot] {t}", f"{n}<at>{h}.{t}", f"{n}@{h}[.]{t}", f"{n}{{at}}{h}{{dot}}{t}"])
    if kind == "ip":
        p = [str(rng.randrange(1, 255)) for _ in range(4)]
        return rng.choice(["{.}".join(p), f"{p[0]}[.]{p[1]}[.]{p[2]}.{p[3]}", " DOT ".join(p), "(dot)".join(p)])
    if kind == "card":
        c = next(c for c in iter(lambda: rng.choice("45") + "".join(rng.choice("0123456789") for _ in range(15)), "") if pii.luhn(c))
        g = [c[i : i + 4] for i in range(0, 16, 4)]
        return rng.choice(["_".join(g), "—".join(g), " / ".join(g), "..".join(g), "|".join(g), c[:4] + "." + c[4:10] + "." + c[10:]])
    d = "".join(rng.choice("23456789") for _ in range(10))
    return rng.choice([f"({d[:3]}){d[3:6]} {d[6:]}", f"0{d[:3]}-{d[3:]}", f"({d[:4]}) {d[4:]}", f"00 {d[:2]} {d[2:4]} {d[4:7]} {d[7:]}"])


def alike(kind, rng):
    r = rng.randrange
    if kind == "email":
        return rng.choice([f"look at page {r(99)}.{r(9)}", "he sat at home. Then", f"meet @ noon. {r(9)}", "arrived at ten. She"])
    if kind == "ip":
        return rng.choice([f"{r(9)}.{r(9)}.{r(300, 999)}.{r(9)}", f"{r(256, 999)},{r(99)},{r(99)},{r(99)}", f"version {r(9)}.{r(9)}.{r(9)}", f"{r(300, 900)}.{r(99)}.{r(99)}.{r(99)}"])
    if kind == "card":
        return next(x for x in iter(lambda: "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 15, 16, 17]))), "") if not pii.luhn(x))
    return rng.choice([f"{r(1900, 2100)}-{r(1, 12):02d}-{r(1, 28):02d}", f"{r(10**8, 10**9)}", f"{r(1, 99)}.{r(100, 999)}.{r(100, 999)}", f"{r(1990, 2020)} {r(1990, 2020)}"])


@pytest.fixture(scope="module")
def judge(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_planted(judge, kind):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("lorem dolor sit amet vuna kelo mira tasu bero".split()) for _ in range(n))
    hit = wrong = 0
    for _ in range(300):
        s = planted(kind, rng)
        text = f"{prose(8)} {rng.choice(LEAD[kind])}{s} {prose(6)}."
        a, base = text.index(s), pii.base_spans(text)
        hit += any(k == kind and abs(x - a) <= 1 and abs(y - a - len(s)) <= 1 for k, x, y in base + judge.added(text, base))
        text = f"{prose(8)} {rng.choice(['in ', 'of ', 'number '])}{alike(kind, rng)} {prose(6)}."
        wrong += len(judge.added(text, pii.base_spans(text)))
    assert hit >= 0.9 * 300 and hit / (hit + wrong) >= 0.95


def test_many_spans_in_one_text(judge):
    began = time.perf_counter()
    text = " ".join(f"a{i}@b.co" for i in range(100_000))
    assert len(pii.base_spans(text)) == 100_000 and judge.added(text, pii.base_spans(text)) == []
    text = " ".join(f"mail ann{i}[at]firm.org" for i in range(20_000))
    assert len(judge.added(text, pii.base_spans(text))) > 10_000
    assert time.perf_counter() - began < 60
