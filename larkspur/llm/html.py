"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is tokenised once into blocks: runs of text between block-level tags. A block has its
word count, link density, those of its neighbours, and what encloses it (article or main;
navigation, header, footer, aside, form, or a class or id that says so; heading). The tree is
grown by Gini impurity on the small labelled table below, once per process.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import small_batches

#: A tag whose attribute values may be quoted; what is between quotes that are never closed is read plainly. No step is ever tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: In a page with a tag that is never closed: up to the next sign of a tag.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)(?:>|\Z|(?=<))")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=\s|$))""", re.I)
SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source area map math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mspace mstyle mfenced semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option title svg annotation annotation-xml iframe object canvas audio video noframes head".split())
UNPARSED = frozenset("script style textarea title iframe noframes xmp".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN_NAME = frozenset("article post entry story articlebody main maincontent content articlecontent postcontent entrycontent postbody articletext storybody mainbody".split())
ASIDE_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adbanner banner sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside side header topbar masthead footer foot bottombar "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skip copyright legal disclaimer form search tags toc".split()
)
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Parts of a longer name that tell of an aside only outside an article: "post-header" in one is its own.
WEAK_PART = frozenset("head header top foot footer side search form tags toc legal copyright notice notices alert banner masthead nav menu skip reply signup login logo".split())
#: What takes names in parts: "main-nav" on a div, not on a heading or a paragraph.
BOXES = frozenset("div section ul ol dl table details aside center figure span".split())
#: Elements of a head; any other one ends it.
HEAD = frozenset("head title meta link style script base noscript template".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {k: ("ul", "ol", "dl", "table", "tbody", "select") + (("tr",) if k in ("td", "th") else ()) for k in CLOSES}


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    in_main: int
    in_aside: int
    heading: int


#: The features of a block in the tree's order.
FEATURES = ("in_main", "in_aside", "words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "page_has_main", "page_longest")
#: Labelled blocks: FEATURES, then 1 for main text. Text blocks off any article are content if they are long and not links, or stand between such blocks; on a page without any long block, short ones are.
_ON_LONG_PAGES = np.array(
    [
        (1, 0, 40, 0.0, 6, 0.0, 55, 0.0, 0, 1, 1), (1, 0, 1, 0.0, 60, 0.0, 30, 0.0, 0, 1, 1), (1, 0, 6, 0.0, 3, 1.0, 80, 0.0, 1, 1, 1), (1, 0, 25, 0.4, 40, 0.0, 10, 0.0, 0, 1, 1),
        (1, 0, 4, 1.0, 50, 0.0, 50, 0.0, 0, 1, 1), (1, 0, 2, 0.0, 0, 0.0, 5, 0.0, 0, 1, 1), (1, 0, 120, 0.05, 90, 0.0, 0, 0.0, 0, 1, 1), (1, 0, 3, 0.0, 7, 0.0, 12, 1.0, 0, 1, 1),
        (1, 1, 12, 0.0, 60, 0.0, 9, 0.0, 0, 1, 0), (1, 1, 45, 0.0, 70, 0.0, 33, 0.0, 0, 1, 0), (1, 1, 3, 1.0, 80, 0.0, 3, 1.0, 0, 1, 0), (1, 1, 5, 0.0, 20, 0.0, 45, 0.0, 1, 1, 0),
        (0, 1, 1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (0, 1, 40, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0), (0, 1, 9, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0), (0, 1, 70, 0.0, 60, 0.0, 65, 0.0, 0, 0, 0), (0, 1, 22, 0.0, 45, 0.0, 1, 1.0, 0, 0, 0), (0, 1, 2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (0, 1, 4, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0),
        (0, 0, 6, 0.0, 80, 0.0, 4, 0.5, 0, 1, 0), (0, 0, 35, 0.0, 90, 0.0, 5, 0.0, 0, 1, 0), (0, 0, 3, 1.0, 2, 1.0, 60, 0.0, 0, 1, 0), (0, 0, 8, 0.0, 0, 0.0, 6, 0.0, 1, 1, 0), (0, 0, 60, 0.1, 2, 1.0, 70, 0.0, 0, 1, 0),
        (0, 0, 45, 0.0, 8, 0.0, 60, 0.0, 0, 0, 1), (0, 0, 80, 0.1, 30, 0.0, 25, 0.0, 0, 0, 1), (0, 0, 22, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1), (0, 0, 16, 0.2, 50, 0.0, 0, 0.0, 0, 0, 1), (0, 0, 13, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1),
        (0, 0, 5, 0.0, 45, 0.0, 50, 0.0, 0, 0, 1), (0, 0, 3, 0.0, 30, 0.0, 70, 0.0, 0, 0, 1), (0, 0, 7, 0.0, 2, 1.0, 60, 0.0, 1, 0, 1), (0, 0, 6, 0.0, 0, 0.0, 35, 0.0, 1, 0, 1), (0, 0, 4, 0.0, 20, 0.0, 18, 0.0, 1, 0, 1),
        (0, 0, 14, 0.9, 20, 0.0, 20, 0.0, 0, 0, 0), (0, 0, 30, 0.8, 3, 1.0, 25, 0.9, 0, 0, 0), (0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (0, 0, 1, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), (0, 0, 5, 0.7, 40, 0.0, 40, 0.0, 0, 0, 0),
        (0, 0, 3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (0, 0, 4, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (0, 0, 2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0), (0, 0, 3, 0.0, 4, 0.0, 0, 0.0, 1, 0, 0), (0, 0, 6, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0),
        (0, 0, 40, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1), (0, 0, 40, 0.0, 2, 0.0, 30, 0.0, 0, 0, 1), (0, 0, 35, 0.05, 90, 0.0, 5, 0.0, 0, 0, 1), (0, 0, 30, 0.0, 2, 0.0, 30, 0.0, 0, 0, 1), (0, 0, 28, 0.1, 3, 1.0, 3, 1.0, 0, 0, 1), (0, 0, 60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
        (0, 0, 90, 0.2, 4, 1.0, 4, 1.0, 0, 0, 1), (0, 0, 200, 0.0, 12, 0.0, 9, 0.0, 0, 0, 1), (0, 0, 18, 0.0, 9, 0.0, 8, 0.0, 0, 0, 1), (0, 0, 24, 0.1, 1, 1.0, 4, 0.0, 0, 0, 1), (0, 0, 4, 0.1, 40, 0.0, 9, 0.0, 0, 0, 1), (0, 0, 2, 0.0, 25, 0.0, 25, 0.0, 0, 0, 1),
        (0, 0, 30, 0.0, 40, 0.0, 8, 0.0, 0, 1, 0), (0, 0, 45, 0.0, 50, 0.0, 30, 0.0, 0, 1, 0), (0, 0, 4, 0.0, 45, 0.0, 50, 0.0, 0, 1, 0), (0, 0, 18, 0.0, 9, 0.0, 8, 0.0, 0, 1, 0), (0, 0, 60, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), (0, 0, 3, 0.0, 30, 0.0, 70, 0.0, 0, 1, 0),
        (0, 0, 8, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0), (0, 0, 5, 0.0, 1, 1.0, 6, 1.0, 0, 0, 0), (0, 0, 7, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0), (0, 0, 40, 0.6, 40, 0.0, 30, 0.0, 0, 0, 0), (0, 0, 9, 0.5, 2, 0.0, 40, 0.0, 0, 0, 0), (0, 0, 3, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0),
    ]
)
#: Blocks of pages whose longest block (the last feature) is short.
_ON_SHORT_PAGES = np.array(
    [
        (0, 0, 3, 0.0, 0, 0.0, 5, 0.0, 1, 0, 9, 1), (0, 0, 9, 0.0, 3, 0.0, 7, 0.0, 0, 0, 9, 1), (0, 0, 7, 0.0, 9, 0.0, 0, 0.0, 0, 0, 9, 1), (0, 0, 2, 0.0, 0, 0.0, 4, 0.0, 1, 0, 4, 1), (0, 0, 4, 0.0, 2, 0.0, 3, 0.0, 0, 0, 4, 1), (0, 0, 3, 0.0, 4, 0.0, 0, 0.0, 0, 0, 4, 1),
        (0, 0, 1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1), (0, 0, 6, 0.0, 2, 1.0, 8, 0.0, 1, 0, 8, 1), (0, 0, 8, 0.0, 6, 0.0, 2, 1.0, 0, 0, 8, 1), (0, 0, 10, 0.1, 1, 1.0, 1, 1.0, 0, 0, 10, 1), (0, 0, 5, 0.2, 10, 0.1, 11, 0.0, 0, 0, 11, 1), (0, 0, 2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 2, 1),
        (0, 0, 2, 1.0, 6, 0.0, 8, 0.0, 0, 0, 8, 0), (0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 5, 0), (0, 0, 4, 0.8, 3, 0.0, 5, 0.0, 0, 0, 5, 0), (0, 1, 5, 0.0, 3, 0.0, 4, 0.0, 0, 0, 6, 0), (0, 1, 9, 0.0, 0, 0.0, 7, 0.0, 0, 0, 7, 0), (0, 1, 2, 0.0, 9, 0.0, 9, 0.0, 1, 0, 9, 0),
        (0, 0, 6, 0.0, 4, 0.0, 3, 0.0, 0, 1, 9, 0), (0, 0, 3, 0.0, 9, 0.0, 0, 0.0, 1, 1, 9, 0), (1, 0, 5, 0.0, 2, 0.0, 6, 0.0, 0, 1, 6, 1), (1, 1, 5, 0.0, 2, 0.0, 6, 0.0, 0, 1, 6, 0), (1, 0, 2, 1.0, 2, 0.0, 6, 0.0, 0, 1, 6, 1),
    ]
)
LABELLED = np.concatenate([np.insert(_ON_LONG_PAGES, len(FEATURES) - 1, np.maximum(40, _ON_LONG_PAGES[:, [2, 4, 6]].max(1)), 1), _ON_SHORT_PAGES])


@cache
def tree() -> tuple:
    """Nested (feature, threshold, under, over), leaves 0 or 1, grown until each leaf is pure."""

    def grow(rows: np.ndarray) -> tuple | int:
        y = rows[:, -1]
        if y.min() == y.max():
            return int(y[0])
        best = None
        for f in range(rows.shape[1] - 1):
            v = np.unique(rows[:, f])
            for t in (v[1:] + v[:-1]) / 2:
                under = rows[:, f] < t
                gini = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[under], y[~under]))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, t, under)
        if best is None:
            return int(round(y.mean()))
        return best[1], best[2], grow(rows[best[3]]), grow(rows[~best[3]])

    return grow(LABELLED)


def classify(features: tuple[float, ...]) -> int:
    node = tree()
    while not isinstance(node, int):
        node = node[2] if features[node[0]] < node[1] else node[3]
    return node


def _names(attrs: str) -> tuple[frozenset[str], frozenset[str], str, bool]:
    """The words of class and id, their parts, role, whether the element is hidden."""
    names: set[str] = set()
    pieces: set[str] = set()
    role, hidden = "", False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "itemprop"):
            for token in value.split():
                names.add(token.replace("-", "").replace("_", ""))
                pieces.update(x for x in re.split(r"[-_]+", token) if x)
        elif key == "role":
            role = value
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return frozenset(names), frozenset(pieces), role, hidden


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, empty ones left out. Time grows with the page's length alone, however broken it is."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int, int]] = []  # tag, and main, aside, raw, link, heading before it
    where: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    solid: list[int] = []  # where the elements that are not inline are
    main = aside = raw = link = heading = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                inside = SPACE.sub(" ", entities.unescape("".join(linked))).strip()
                out.append(Block(text, text.count(" ") + 1, inside.count(" ") + 1 if inside else 0, int(main > 0), int(aside > 0), int(heading > 0)))
            parts.clear()
            linked.clear()

    def close(to: int) -> None:
        nonlocal main, aside, raw, link, heading
        _, main, aside, raw, link, heading = stack[to]
        while len(stack) > to:
            name = stack.pop()[0]
            where[name].pop()
            if name not in INLINE:
                solid.pop()

    def last(*names: str) -> int:
        """Where the innermost of these is open, or -1."""
        return max((w[-1] for n in names if (w := where.get(n))), default=-1)

    def say(text: str) -> None:
        if raw and where.get("head") and len(stack) == where["head"][-1] + 1 and not text.isspace():
            close(where["head"][-1])  # text is no part of a head
        if not raw:
            parts.append(text)
            if link:
                linked.append(text + " ")

    at, end, tag = 0, len(page), TAG
    while at < end:
        stop = page.find("<", at)
        if stop < 0:
            stop = end
        if stop > at:
            say(page[at:stop])
        if stop == end:
            break
        sign = page[stop + 1 : stop + 2]
        if sign == "!" or sign == "?":
            if page.startswith("<!--", stop):
                if page.startswith((">", "->"), stop + 4):
                    at = page.index(">", stop) + 1
                else:
                    m = COMMENT_END.search(page, stop + 4)
                    at = m.end() if m else end
            else:
                at = page.find(">", stop) + 1 or end
            continue
        m = tag.match(page, stop)
        if not m and (sign.isalpha() or sign == "/") and sign.isascii():
            if page[stop + 2 : stop + 3].isalpha() or sign != "/":
                tag = LOOSE  # this tag is never closed: from here on quotes hold nothing together
                m = tag.match(page, stop)
            else:  # "</" and no name: a comment up to the next >
                at = page.find(">", stop) + 1 or end
                continue
        if not m:
            say("<")
            at = stop + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "p" and not where.get("p"):
                flush()
            if (i := last(name)) >= 0:
                if name not in INLINE:
                    flush()
                    close(i)
                elif not solid or i > solid[-1]:
                    close(i)  # an inline end tag doesn't close the blocks around it
            continue
        if where.get("head") and name not in HEAD:
            close(where["head"][-1])
        if name not in INLINE:
            flush()
            # Inline elements and paragraphs left open end where a block begins.
            if name not in ("ins", "del") and solid and stack[solid[-1]][0] == "p":
                close(solid[-1])
        elif name == "br":
            parts.append(" ")
            if link:
                linked.append(" ")
        if name in VOID:
            continue
        names, pieces, role, hidden = _names(m[3]) if m[3] else (frozenset(), frozenset(), "", False)
        if name in CLOSES and (i := last(*CLOSES[name])) > last(*HOLDS[name]):
            close(i)
        where.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, main, aside, raw, link, heading))
        said = names | pieces
        is_main = name in MAIN or role == "main" or (name in ("div", "section", "td") and bool(said & MAIN_NAME) and not said & ASIDE_NAME)
        own_header = name == "header" and main > 0
        named = names & ASIDE_NAME or (name in BOXES and pieces & (ASIDE_NAME - WEAK_PART if main else ASIDE_NAME))
        is_aside = (name in ASIDE and not own_header) or role in ASIDE_ROLE or (name not in ("html", "body", "article", "main") and not own_header and bool(named))
        if name == "body":
            raw = 0
        main += is_main
        aside += is_aside
        raw += name in RAW or hidden
        link += name == "a"
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in UNPARSED:
            ending = _ending(name).search(page, at)
            at = ending.end() if ending else end
            close(len(stack) - 1)
    flush()
    return out


@cache
def _ending(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def main_text(page: str | None) -> str:
    """The blocks that the tree takes for main text, joined by one space; empty for null."""
    if not page:
        return ""
    bs = blocks(page)
    has_main = int(any(b.in_main and not b.in_aside for b in bs))
    density = [b.linked / b.words for b in bs]
    longest = max((b.words for b, d in zip(bs, density, strict=True) if not b.in_aside and d < 0.5), default=0)
    out = []
    for i, b in enumerate(bs):
        before = (bs[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (bs[i + 1].words, density[i + 1]) if i + 1 < len(bs) else (0, 0.0)
        if classify((b.in_main, b.in_aside, b.words, density[i], *before, *after, b.heading, has_main, longest)):
            out.append(b.text)
    return " ".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 256):
        got = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    Null and empty html give an empty text; markup without text too. Null keys and repeated
    rows keep their rows; an empty table gives an empty table; other columns are left out.
    Pages are read whole, however long; broken markup never fails: open comments and quotes
    run to where a browser would end them, or to the end.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
