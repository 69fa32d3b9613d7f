"""Main text of web pages by consensus container paths per host."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import cut, slices

#: Fixed values of HTML: elements without an end tag, elements whose content is no markup, and elements that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split())
#: Elements that never hold main text.
DROP = frozenset("nav footer header aside form script style noscript template iframe button select input textarea object embed applet svg math canvas audio video dialog menu title head noembed noframes xmp label".split())
#: A paragraph ends where one of these begins.
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Open elements that one of the same family ends, and where the search for them stops.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: The families by a name, the tags that belong to each, and the end tags of light elements that no heavy one lets through.
FAMILY = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
FAMILIES = {t: {f for k, f in FAMILY.items() if t in SIBLING[k][0] | SIBLING[k][1]} for k in SIBLING for t in SIBLING[k][0] | SIBLING[k][1]}
LIGHT = frozenset(("p", "li", "span", "a", "b", "i", "em", "strong"))
HEAVY = ("table", "td", "th", "article", "main", "body")
#: Whole names of class, id or role that mark furniture, and those whose parts mark the article.
AWAY = frozenset("nav navbar navigation menu submenu footer header masthead sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager widget form login search toolbar skip hidden contentinfo complementary dialog paywall".split())
#: Names made of several words: what they begin or end with to be furniture, and the pairs that name a page's own parts. Other
#: words say nothing beside a second one: a share price, a form factor or a notice of meeting is text.
PARTED = re.compile(
    r"(?:nav|navbar|sidebar|footer|ads?|advert|cookies?|comments?|newsletter|breadcrumbs?|sponsored|promo)[-_].*|.*[-_](?:nav|navbar|navigation|sidebar|footer|ads?|adverts?|comments|newsletter|breadcrumbs?|pagination)"
    r"|(?:site|page|global|top|main|primary|secondary)[-_](?:header|menu|banner|search)|(?:share|sharing|social|related)[-_](?:buttons?|links?|icons?|bar|posts?|articles?|stories|media)|(?:search|login|signup|subscribe|contact)[-_](?:form|box|bar)"
)
#: A page that has or lacks furniture is none.
ABOUT = re.compile(r"(?:no|has|with|without)[-_]")
#: Of these, what makes even an article element no main text.
SMALL = frozenset("comment comments reply replies related promo sponsored ad ads advert advertisement recommended".split())
HOME = frozenset("article content main post entry story body text page".split())
CONTAINER = frozenset("article main section div td body".split())

#: What begins a comment, a declaration or a tag, with the tag's slash and name.
OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: Where a tag ends, or a quoted value begins.
STOP = re.compile(r">|=\s*([\"'])")
#: One attribute: its name, then a quoted or bare value.
ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SAYS = frozenset("class id role style hidden aria-hidden".split())
GAP = re.compile(r"\s+")


#: Elements below this depth hang side by side on the one at it, as browsers have it; their text stays.
DEPTH = 4096


class Node:
    """An element. Its path is a hash of its block elements' steps from the top, which takes as much room at any depth; block and
    box are the nearest block and the nearest container at or above it, so no walk goes through inline elements."""

    __slots__ = ("tag", "path", "up", "away", "parts", "home", "depth", "block", "box")

    def __init__(self, tag, path, up, away, home):
        self.tag, self.path, self.up, self.away, self.home = tag, path, up, away, home
        self.parts = []
        self.depth = up.depth + 1 if up is not None else 0
        self.block = self if up is None or tag in BLOCK else up.block
        self.box = self if tag in CONTAINER else up.box if up is not None else None


def path_of(above: int, step: str) -> int:
    """The path of a block element below another: the number of steps, and 48 bits that hash them. Of two, the smaller lies higher."""
    from xxhash import xxh64_intdigest as xxh

    return ((above >> 48) + 1 << 48) + (xxh(step.encode("utf-8", "replace"), above) >> 16)


def tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, not in a quoted value; -1 if there is none. A quote that never closes counts as none,
    which can happen once for each kind of quote, so all tags of a page take time in proportion to its length."""
    while m := STOP.search(page, at):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1
    return -1


def furniture(name: str, whole: frozenset) -> bool:
    """Whether a class, id or role names furniture: as a whole, or as one of the known compounds. An article is judged by whole names."""
    return name in whole or whole is AWAY and not ABOUT.match(name) and PARTED.fullmatch(name) is not None


def describe(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """The generalised step of a path (tag and classes, or else its id, with digits as #), whether it is furniture, whether it names the article.
    Inline elements are no furniture by their names, only by being hidden."""
    found: dict[str, str] = {}
    for m in ATTR.finditer(attrs or ""):
        if (name := m[1].lower()) in SAYS:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    names = [GAP.sub("", re.sub(r"\d+", "#", c)) for c in found.get("class", "").split()]
    said = " ".join((found.get("class", ""), found.get("id", ""), found.get("role", ""))).lower().split()
    words = {w for x in said if not ABOUT.match(x) for w in re.split(r"[^a-z]+", x)}
    away = tag in DROP or tag in BLOCK and tag not in ("main", "body", "html") and any(furniture(x, SMALL if tag == "article" else AWAY) for x in said)
    away = away or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    if not names and (name := re.sub(r"\d+", "#", GAP.sub("", found.get("id", "")))):
        return f"{tag}#{name}", away, tag in ("article", "main") or bool(words & HOME)
    return ".".join([tag, *sorted(names)]), away, tag in ("article", "main") or bool(words & HOME)


def parse(page: str) -> list[Node]:
    """The page's elements in order; parts holds text and elements. Broken markup is closed where HTML closes it."""
    root = Node("", 0, None, False, False)
    nodes, top, at, n, over = [root], root, 0, len(page), 0
    ends: dict[str, int] = {}
    # Open elements by tag, and by family in the order they were opened: the last one is found without a walk.
    opened: dict[str, list[Node]] = {}
    families: dict[str, list[Node]] = {}

    def rise(to: Node) -> Node:
        """Ends the open elements below one."""
        now = top
        while now is not to:
            opened[now.tag].pop()
            for f in FAMILIES.get(now.tag, ()):
                families[f].pop()
            now = now.up
        return to

    def last(tag: str) -> Node | None:
        held = opened.get(tag)
        return held[-1] if held else None

    while at < n:
        m = OPENS.search(page, at)
        if m is None:
            top.parts.append(page[at:])
            break
        if m[1]:
            end = page.find("-->", m.end())
            stop = end + 3 if end >= 0 else n
        else:
            end = page.find(">", m.end()) if m[2] else tag_end(page, m.end())
            if end < 0:  # nothing that begins from here on ends
                top.parts.append(page[at:])
                break
            stop = end + 1
        if m.start() > at:
            top.parts.append(page[at : m.start()])
        at = stop
        if not m[4]:
            continue
        tag = m[4].lower()
        if m[3]:
            if over and tag not in VOID:
                over -= 1
                top = rise(top.up) if top.depth >= DEPTH else top
                continue
            node = last(tag)
            if node is not None and tag in LIGHT and any((x := last(t)) is not None and x.depth > node.depth for t in HEAVY):
                node = None
            if node is not None and node.up is not None:
                top = rise(node.up)
            elif tag == "br":
                top.parts.append(" ")
            continue
        if tag in ("br", "wbr"):
            top.parts.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P and top.block.tag == "p":
            top = rise(top.block.up)
        if tag in SIBLING:
            outer = None
            for node in reversed(families.get(FAMILY[tag], ())):
                if node.tag in SIBLING[tag][1]:
                    break
                outer = node
            if outer is not None:
                top = rise(outer.up)
        attrs = page[m.end() : end]
        step, away, home = describe(tag, attrs)
        alone = tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK
        while top.depth >= DEPTH:
            top, over = rise(top.up), over + (not alone and tag not in RAW)
        node = Node(tag, path_of(top.path, step) if tag in BLOCK else top.path, top, away or top.away, home)
        top.parts.append(node)
        nodes.append(node)
        if alone:
            continue
        if tag in RAW:
            # An end tag that is nowhere behind one place is nowhere behind a later one.
            if ends.get(tag) != n:
                found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                ends[tag] = found.end() if found else n
            at = ends[tag]
            continue
        opened.setdefault(tag, []).append(node)
        for f in FAMILIES.get(tag, ()):
            families.setdefault(f, []).append(node)
        top = node
    return nodes


def blocks(node: Node) -> list[tuple[str, int]]:
    """Text of each block under the node, in page order, with the number of its characters that lie in links."""
    out, now, links = [], [], [0]

    def flush():
        if now:
            text = GAP.sub(" ", entities.unescape("".join(now))).strip()
            if text:
                out.append((text, min(links[0], len(text))))
            now.clear()
            links[0] = 0

    stack = [(iter(node.parts), False, node.tag == "a")]
    while stack:
        parts, is_block, in_link = stack[-1]
        for x in parts:
            if isinstance(x, str):
                now.append(x)
                if in_link:
                    links[0] += len(x)
            elif not x.away:
                if x.tag in BLOCK:
                    flush()
                stack.append((iter(x.parts), x.tag in BLOCK, in_link or x.tag == "a"))
                break
        else:
            stack.pop()
            if is_block:
                flush()
    flush()
    return out


def scores(nodes: list[Node]) -> dict[int, float]:
    """Path -> score of its best container. A block's plain characters count for its container and less for those above;
    elements that name the article count more, the page's body less."""
    got: dict[int, float] = {}
    held: dict[int, Node] = {}
    for node in nodes:
        if node.tag in BLOCK and not node.away and node.tag not in ("html", "body", "article", "main", "section", "div", "table", "tr", "ul", "ol"):
            weight = sum(len(x) for x in node.parts if isinstance(x, str)) + sum(len(y) for x in node.parts if isinstance(x, Node) and x.tag not in BLOCK and x.tag != "a" and not x.away for y in x.parts if isinstance(y, str))
        elif node.tag in CONTAINER and not node.away:
            weight = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        else:
            continue
        box, share = node.box, 1.0
        while box is not None and weight and share >= 1e-6:
            got[id(box)] = got.get(id(box), 0.0) + weight * share
            held[id(box)] = box
            share *= 0.6
            box = box.up.box if box.up is not None else None
    best: dict[int, float] = {}
    for k, v in got.items():
        node = held[k]
        if not node.away:
            best[node.path] = max(best.get(node.path, 0.0), v * (3.0 if node.tag in ("article", "main") else 1.5 if node.home and node.tag != "body" else 0.5 if node.tag == "body" else 1.0))
    return best


def extract(page: str, paths: list[int]) -> str:
    """The main text by the first of the host's paths that the page has, else by the page's own best container, else all that is no furniture."""
    nodes = parse(page)
    for path in paths:
        if chosen := [x for x in nodes if x.path == path and x.tag in CONTAINER and not x.away]:
            break
    else:
        own = scores(nodes)
        path = max(own, key=lambda p: (own[p], -p)) if own else None
        chosen = [x for x in nodes if x.path == path and x.tag in CONTAINER and not x.away] if own else nodes[:1]
    parts = [blocks(x) for x in chosen]
    # Of several containers on one path, those that are mostly links are lists of links and not the article.
    plain = [b for b in parts if 2 * sum(n for _, n in b) <= sum(len(t) for t, _ in b)]
    text = "\n".join(t for b in plain or parts for t, _ in b)
    return text or "\n".join(t for t, _ in blocks(nodes[0]))


def votes(pages: DataFrame, host: str, html_col: str = "html", keep: int = 3) -> DataFrame:
    """Per host the `keep` best paths of its pages' containers, best first: each page gives every path that has half of its best
    path's score or more its share of these scores. A page with none of its host's paths is read by its own best container."""

    def each(batches):
        import pyarrow as pa

        for b in slices(batches, 50):
            rows = []
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = scores(parse(page)) if page else {}
                most = max(own.values(), default=0.0)
                top = {p: v for p, v in own.items() if 2 * v >= most > 0}
                rows += [(h, p, v / sum(top.values())) for p, v in top.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["host", "path", "share"])

    cast = pages.select(F.col(host).alias("host"), html_col).mapInArrow(each, "host string, path long, share double")
    summed = cast.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "path"))
    best = summed.withColumn("place", place).where(F.col("place") <= keep)
    ranked = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("best"))
    return ranked.select(F.col("host").alias("_lw_h"), F.col("best.path").alias("_lw_paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 20_000) -> DataFrame:
    """Per page: id, url, text (blocks joined by line feeds, empty if none) and n_chars, its code points.

    Null html gives an empty text; pages with a null url or without a host vote together as one host.
    Repeated rows repeat; an empty table gives none. The winners, one row per host, are broadcast while
    their counted number stays below broadcast_hosts and joined by shuffle beyond.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(id_col, url_col, F.col(html_col).alias("_lw_html"), host.alias("_lw_host"))
    won = cut(votes(rows, "_lw_host", "_lw_html"))
    won = F.broadcast(won) if won.count() <= broadcast_hosts else won.hint("merge")
    both = rows.join(won, rows["_lw_host"] == won["_lw_h"], "left").select(id_col, url_col, "_lw_html", "_lw_paths")

    def each(batches):
        import pyarrow as pa

        for b in slices(batches, 50):
            text = [extract(p, w or []) if p else "" for p, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return both.mapInArrow(each, schema)
