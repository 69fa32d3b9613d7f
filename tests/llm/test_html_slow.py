"""The extraction against a plain slow one: characters one by one, paths as tuples of steps, recursion, no shortcuts."""

import html as entities
import random
import re
import time

import pytest

from loomwright.llm import html as H


def slow_tag_end(page, i):
    """Attribute text by characters: a quote counts after = and white space, and if it closes."""
    quote, after_equals = None, False
    while i < len(page):
        c = page[i]
        if quote:
            if c == quote:
                quote = None
        elif c == ">":
            return i
        elif c in "\"'" and after_equals:
            if c not in page[i + 1 :]:
                return page.find(">", i + 1)
            quote = c
        after_equals = c == "=" or after_equals and c.isspace()
        i += 1
    return -1


def slow_tokens(page):
    out, i, text = [], 0, ""
    while i < len(page):
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = len(page) if end < 0 else end + 3
            kind = None
        elif page[i] == "<" and i + 1 < len(page) and page[i + 1] in "!?":
            end = page.find(">", i + 2)
            if end < 0:
                return [*out, ("text", text + page[i:])]
            i, kind = end + 1, None
        elif page[i] == "<" and (m := re.match(r"/?[a-zA-Z]", page[i + 1 :])):
            j = i + 1 + len(m[0])
            while j < len(page) and not page[j].isspace() and page[j] not in "/>":
                j += 1
            end = slow_tag_end(page, j)
            if end < 0:
                return [*out, ("text", text + page[i:])]
            name = page[i + 1 : j]
            kind = ("close", name[1:].lower()) if name[0] == "/" else ("open", name.lower(), page[j:end])
            i = end + 1
        else:
            text += page[i]
            i += 1
            continue
        out.append(("text", text))
        text = ""
        if kind:
            out.append(kind)
        if kind and kind[0] == "open" and kind[1] in H.RAW and not (kind[2].rstrip().endswith("/") and kind[1] not in H.BLOCK):
            while i < len(page) and not re.match(rf"</{kind[1]}\s*>", page[i:], re.I):
                i += 1
            i = page.find(">", i) + 1 if i < len(page) else i
    return [*out, ("text", text)]


def slow_tree(page):
    """Elements as dicts; open ones as a list."""
    root = {"tag": "", "path": (), "away": False, "home": False, "parts": []}
    every, stack = [root], [root]
    for kind, *token in slow_tokens(page):
        top = stack[-1]
        if kind == "text":
            top["parts"].append(token[0])
        elif kind == "close":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k]["tag"] == token[0]:
                    del stack[k:]
                    break
                if stack[k]["tag"] in ("table", "td", "th", "article", "main", "body") and token[0] in ("p", "li", "span", "a", "b", "i", "em", "strong"):
                    break
            else:
                if token[0] == "br":
                    top["parts"].append(" ")
        else:
            tag, attrs = token
            if tag in ("br", "wbr"):
                top["parts"].append(" " if tag == "br" else "")
                continue
            if tag in H.CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k]["tag"] == "p":
                        del stack[k:]
                        break
                    if stack[k]["tag"] in H.BLOCK:
                        break
            if tag in H.SIBLING:
                mine, ends = H.SIBLING[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k]["tag"] in ends:
                        k = -1
                        break
                upper = max([k for k in range(1, len(stack)) if stack[k]["tag"] in ends], default=0)
                own = [k for k in range(upper + 1, len(stack)) if stack[k]["tag"] in mine]
                if own:
                    del stack[own[0] :]
            top = stack[-1]
            step, away, home = slow_describe(tag, attrs)
            node = {"tag": tag, "path": (*top["path"], step) if tag in H.BLOCK else top["path"], "away": away or top["away"], "home": home, "parts": []}
            top["parts"].append(node)
            every.append(node)
            if not (tag in H.VOID or attrs.rstrip().endswith("/") and tag not in H.BLOCK or tag in H.RAW):
                stack.append(node)
    return every


def slow_describe(tag, attrs):
    """Furniture by whole names, then by lists of compounds written out."""
    held = {}
    for m in H.ATTR.finditer(attrs or ""):
        held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [n for k in ("class", "id", "role") for n in held.get(k, "").lower().split()]
    away = tag in H.DROP or "hidden" in held or held.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held.get("style", ""), re.I))
    if tag in H.BLOCK and tag not in ("main", "body", "html"):
        for n in names:
            first, end = re.split(r"[-_]", n)[0], re.split(r"[-_]", n)[-1]
            if tag == "article":
                away |= n in H.SMALL
            elif n in H.AWAY:
                away = True
            elif first != n and first not in ("no", "has", "with", "without"):
                two = re.split(r"[-_]", n, maxsplit=1)
                away |= first in "nav navbar sidebar footer ad ads advert cookie cookies comment comments newsletter breadcrumb breadcrumbs sponsored promo".split()
                away |= end in "nav navbar navigation sidebar footer ad ads advert adverts comments newsletter breadcrumb breadcrumbs pagination".split()
                away |= two[0] in "site page global top main primary secondary".split() and two[1] in "header menu banner search".split()
                away |= two[0] in "share sharing social related".split() and two[1] in "button buttons link links icon icons bar post posts article articles stories media".split()
                away |= two[0] in "search login signup subscribe contact".split() and two[1] in "form box bar".split()
    home = tag in ("article", "main") or any(w in H.HOME for n in names if re.split(r"[-_]", n)[0] == n or re.split(r"[-_]", n)[0] not in ("no", "has", "with", "without") for w in re.split(r"[^a-z]+", n))
    classes = sorted(re.sub(r"\d+", "#", c) for c in held.get("class", "").split())
    own = re.sub(r"\d+", "#", re.sub(r"\s+", "", held.get("id", "")))
    return (f"{tag}#{own}" if own and not classes else ".".join([tag, *classes])), away, home


def slow_blocks(node):
    lines, now = [], {"text": "", "links": 0}

    def flush():
        text = re.sub(r"\s+", " ", entities.unescape(now["text"])).strip()
        if text:
            lines.append((text, min(now["links"], len(text))))
        now.update(text="", links=0)

    def walk(x, in_link):
        for part in x["parts"]:
            if isinstance(part, str):
                now["text"] += part
                now["links"] += len(part) * in_link
            elif not part["away"]:
                if part["tag"] in H.BLOCK:
                    flush()
                walk(part, in_link or part["tag"] == "a")
                if part["tag"] in H.BLOCK:
                    flush()

    walk(node, node["tag"] == "a")
    flush()
    return lines


def slow_scores(every):
    above = {id(p): x for x in every for p in x["parts"] if not isinstance(p, str)}
    got = {}
    for x in every:
        if x["away"]:
            continue
        if x["tag"] in H.BLOCK and x["tag"] not in ("html", "body", "article", "main", "section", "div", "table", "tr", "ul", "ol"):
            weight = sum(len(p) for p in x["parts"] if isinstance(p, str))
            weight += sum(len(q) for p in x["parts"] if not isinstance(p, str) and p["tag"] not in H.BLOCK and p["tag"] != "a" and not p["away"] for q in p["parts"] if isinstance(q, str))
        elif x["tag"] in H.CONTAINER:
            weight = sum(len(p.strip()) for p in x["parts"] if isinstance(p, str))
        else:
            continue
        share, up = 1.0, x if x["tag"] in H.CONTAINER else above.get(id(x))
        while up is not None:
            if up["tag"] in H.CONTAINER and weight:
                got[id(up)] = got.get(id(up), 0.0) + weight * share
                share *= 0.6
            up = above.get(id(up))
    best = {}
    for x in every:
        if id(x) in got and not x["away"]:
            v = got[id(x)] * (3.0 if x["tag"] in ("article", "main") else 1.5 if x["home"] and x["tag"] != "body" else 0.5 if x["tag"] == "body" else 1.0)
            best[x["path"]] = max(best.get(x["path"], 0.0), v)
    return best


def hashed(path):
    h = 0
    for step in path:
        h = H.path_of(h, step)
    return h


def slow_extract(page):
    every = slow_tree(page)
    own = slow_scores(every)
    chosen = every[:1]
    if own:
        path = max(own, key=lambda p: (own[p], -hashed(p)))
        chosen = [x for x in every if x["path"] == path and x["tag"] in H.CONTAINER and not x["away"]]
    parts = [slow_blocks(x) for x in chosen]
    plain = [b for b in parts if 2 * sum(n for _, n in b) <= sum(len(t) for t, _ in b)]
    return "\n".join(t for b in plain or parts for t, _ in b) or "\n".join(t for t, _ in slow_blocks(every[0]))


def test_every_page_of_the_smallest_table(spark, small):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    assert len(pages) > 10
    for p in pages:
        assert H.extract(p, []) == slow_extract(p)


def test_random_markup():
    rng = random.Random(5)
    bits = ["<div>", "</div>", "<p>", "</p>", "<article class=x1>", "</article>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<a href='/x'>", "</a>", "<b>", "</b>", "<br>", "<script>", "</script>", "<nav>", "</nav>", '<div class="ad">', "<!-- c", "-->", "<!", ">", "<a '", '<i title="a>b">', "</i>", '<p id="', '"', "'", "<span hidden>", "</span>", "<img/>", "&amp;", " ", "\n", "word ", "more text here ", "<", "</", "é", "<textarea>", "</textarea >", "=", "= '"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        assert H.extract(page, []) == slow_extract(page), page


PAGES = {
    "nested": "<div>" * 100_000 + "deep text here" + "</div>" * 100_000 + "<p>tail</p>",
    "unclosed quotes": "<p>text</p>" + "<a '" * 100_000,
    "unclosed values": "<p>text</p>" + "<a =\"x='" * 100_000,
    "unclosed comments": "<p>text</p>" + "<!" * 100_000,
    "inline": "<article><p>text" + "<i>" * 100_000 + "<div>a</div>" * 5_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_time_and_room_follow_the_length(name):
    began = time.perf_counter()
    assert H.extract(PAGES[name], [])
    assert time.perf_counter() - began < 20


def test_text_below_the_depth_stays():
    page = "<article>" + "<div>" * 9_000 + "".join(f"<p>line {i} of the text</p>" for i in range(50)) + "</div>" * 9_000 + "</article>"
    assert H.extract("<body>" + page + "</body>", []) == "\n".join(f"line {i} of the text" for i in range(50))


@pytest.mark.parametrize("inside", ['<p class="share-price">kept</p>', '<p class="form-factor">kept</p>', '<a class="related-term">kept</a>', '<section class="social-history">kept</section>', '<div class="notice-of-meeting">kept</div>', '<div class="page-text-search">kept</div>', '<span class="banner-image">kept</span>', '<div class="has-sidebar">kept</div>'])
def test_compound_names_are_text(inside):
    page = f"<html><body><div class='nav'>gone</div><article><p>Before it.</p>{inside}<p>After it.</p></article></body></html>"
    assert H.extract(page, []).split() == "Before it. kept After it.".split()


@pytest.mark.parametrize("name", ["nav", "main-nav", "site-header", "cookie-banner", "comments", "comment-list", "ad", "ad-slot", "top_sidebar", "share-buttons", "related-posts", "newsletter", "search-form", "ADS"])
def test_furniture_is_left_out(name):
    page = f"<html><body><article><p>Before it.</p><div class='x1 {name}'>gone</div><section id='{name}'>gone</section><p>After it.</p></article></body></html>"
    assert H.extract(page, []).split() == "Before it. After it.".split()


@pytest.mark.parametrize("page", ["<span>" * 4000 + "<p>x</p>" * 80_000, "<b>" * 3000 + "<td>x" * 80_000, "<div>" * 3000 + "<td>x" * 40_000, "<b><article>" + "<span>" * 4000 + "x</b>" * 80_000, "<ul><li>" * 1500 + "<i>" * 2000 + "<p>a<li>b" * 20_000])
def test_time_follows_the_length(page):
    import time

    began = time.perf_counter()
    text = H.extract(page, [])
    assert "x" in text or "b" in text
    assert time.perf_counter() - began < 6
