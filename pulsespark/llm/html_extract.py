"""HTML extraction: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks.  Each has its own and its neighbours' word count and
link density, and what the tags and names around it say.  A small decision tree, grown on a labelled table of blocks that
`labelled_blocks` writes from page layouts, tells article from the rest.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resting, table

_RAW = "script|style|noscript|template|title|textarea|select|button|iframe|svg|object|option"
_INSIDE = r"""(?:[^<>"']++|"[^"]*"|'[^']*')*+"""
#: Comments, elements whose content is no text, tags, tags that break off at the next one, other markup.  No start looks past
#: the next "<" outside quotes, so a page takes time in its length.
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)({_INSIDE})>|<(/?)([a-z][a-z0-9:-]*)([^<>\"']*+)(?=<|\Z)|<[!?/][^<>]*>?",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr"
    " html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
OPEN = BLOCKS - {"p", "li", "hr", "dt", "dd", "tr", "td", "th"}
BAD_TAGS = frozenset("nav aside footer form menu head dialog".split())
GOOD_TAGS = frozenset(("article", "main"))
#: Parts of class names, ids and roles that tell what a container is for.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation topbar masthead header footer"
    " cookie cookies consent notice notices gdpr alert newsletter subscribe signup login search comment comments commentlist disqus replies reply discussion"
    " related recommended share sharing social breadcrumb breadcrumbs popup modal overlay widget toolbar tags pagination pager copyright legal disclaimer paywall"
    " contentinfo complementary form rail teaser".split()
)
GOOD_NAMES = frozenset("article content post entry story main maincontent body text articlebody".split())
#: Beside one of these a bad name says what a container comes with, not what it is: "content-with-sidebar".
BESIDE = frozenset("with has no without".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inner", "bad_around", "good_around", "heading")


@dataclass
class Block:
    text: str
    words: int
    links: float
    inner: int
    bad_around: int
    good_around: int
    heading: int


@lru_cache(4096)
def _sign(tag: str, attributes: str, in_good: bool) -> int:
    """1: a container of main text, -1: of anything else, 0: it does not say."""
    named = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return -1
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = set(re.split(r"[^a-z]+", name))
                bad, good = parts & BAD_NAMES, parts & GOOD_NAMES
                if bad == {"header"} and (good or in_good):  # the heading of an article
                    bad = set()
                if bad and not parts & BESIDE and tag not in ("html", "body", "main", "article"):
                    named = -1
                elif good and not named:
                    named = 1
    if tag in BAD_TAGS:
        return -1
    if tag == "header" and named < 1:  # of the page, or else the heading of the article it stands in
        return -1 if named < 0 or not in_good else 0
    return named or (1 if tag in GOOD_TAGS else 0)


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order; unclosed and misnested tags are taken as they come."""
    out: list[Block] = []
    # open containers: (tag, innermost sign, bad ones around, good ones around); and how many of each tag
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading, leaf = False, 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                _, inner, bad, good = stack[-1]
                count = len(html.unescape(" ".join(linked)).split())
                out.append(Block(" ".join(words), len(words), min(1.0, count / len(words)), leaf or inner, int(bad > 0 or leaf < 0), int(good > 0 or leaf > 0), heading))
            parts, linked = [], []

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked.append(parts[-1])
        at = m.end()
        ends, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            leaf = 0
            _, inner, bad, good = stack[-1]
            sign = 0
            if not ends and (attributes or tag in OPEN):
                sign = (_sign if len(attributes) < 500 else _sign.__wrapped__)(tag, attributes, good > 0)  # long ones stay out of the cache
            if tag[0] == "h" and tag[1:].isdigit():
                heading, leaf = int(not ends), sign
            elif tag not in OPEN:
                leaf = sign
            elif not ends:
                if tag == "body" and opened.get("head"):
                    stack = [x for x in stack if x[0] != "head"]
                    opened["head"] = 0
                    _, inner, bad, good = stack[-1][0], 0, 0, 0
                if not attributes.endswith("/"):
                    stack.append((tag, sign or inner, bad + (sign < 0), good + (sign > 0)))
                    opened[tag] = opened.get(tag, 0) + 1
            elif opened.get(tag):
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            linked.append(parts[-1])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.links) for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.vstack([none, own[:-1]]) if len(own) else own, np.vstack([own[1:], none]) if len(own) else own
    rest = np.array([(b.inner, b.bad_around, b.good_around, b.heading) for b in found], float).reshape(-1, 4)
    return np.hstack([own, before, after, rest])


# ---- the labelled table and the tree --------------------------------------------------------------------------------
def labelled_blocks(pages: int = 600, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the blocks of pages written from layouts: what is not article has 1 to 300 words, no, some or only
    links, and stands in containers whose tag or names tell, or in ones that don't, where links have to.

    Words of article text bear the mark "q", so that the label of a block can be read off it.
    """
    rng = random.Random(seed)
    say = lambda n, mark="": " ".join(f"{mark}w{rng.randrange(999)}" for _ in range(n))

    def spoken(n: int, share: float, mark: str = "") -> str:
        """n words, about `share` of them in links of a few words."""
        out = []
        while n > 0:
            k = min(n, rng.randint(1, 6))
            out.append(f'<a href="/{rng.randrange(99)}">{say(k, mark)}</a>' if rng.random() < share else say(k, mark))
            n -= k
        return " ".join(out)

    lengths = (1, 2, 4, 8, 15, 30, 45, 80, 150, 300)
    names = sorted(BAD_NAMES)

    def telling() -> str:
        """Something else than an article in a container that tells."""
        inside = "".join(f"<p>{spoken(rng.choice(lengths), rng.choice((0, 0, 0.2, 0.5, 1)))}</p>" for _ in range(rng.randint(1, 3)))
        tag, name = rng.choice(("div", "section", "ul", "div")), rng.choice(names)
        return rng.choice((
            f"<footer>{inside}</footer>", f"<aside>{inside}</aside>", f"<nav>{inside}</nav>", f"<form>{inside}</form>", f"<div hidden>{inside}</div>",
            f'<div style="display: none">{inside}</div>', *3 * (f'<{tag} class="{name} x{rng.randrange(9)}">{inside}</{tag}>', f"<{tag} id='{rng.choice(('site', 'page', 'the'))}-{name}'>{inside}</{tag}>"),
        ))

    def dense() -> str:
        """Links in a container that doesn't tell: a list of links, or a block that is mostly links."""
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li><a>{say(rng.choice((1, 1, 2, 3, 6, 10)))}</a></li>" for _ in range(rng.randint(2, 9))) + "</ul>"
        return f"<div>{spoken(rng.choice((2, 5, 12, 25, 60)), rng.uniform(0.75, 1))}</div>"

    paragraph = lambda some: f"<p>{spoken(rng.choice(some), rng.choice((0, 0, 0, 0, 0.1, 0.25)), 'q')}</p>"
    rows, labels = [], []
    for _ in range(pages):
        text = f"<h1>{say(rng.randint(1, 12), 'q')}</h1>"
        for _ in range(rng.randint(1, 9)):
            text += paragraph((1, 2, 5, 12, 30, 60, 120, 250)) if rng.random() < 0.85 else f"<h2>{say(3, 'q')}</h2>"
            if rng.random() < 0.08:
                text += rng.choice((telling, dense))()
        bare = "".join(paragraph((18, 30, 60, 120, 250)) for _ in range(rng.randint(3, 9)))
        article = rng.choice((
            f"<article>{text}</article>", f"<main><div>{text}</div></main>", f'<div class="post-content">{text}</div>', f"<div role='main'>{text}</div>",
            f'<article><header class="entry-header"><h1>{say(6, "q")}</h1></header>{text}</article>', f"<div>{bare}</div>", f"<div>{bare}</div>",
        ))
        around = lambda: "".join(rng.choice((telling, dense, telling))() for _ in range(rng.randint(0, 3)))
        found = blocks(f"<html><body>{rng.choice(('', f'<header>{say(2)}{dense()}</header>', dense()))}{around()}{article}{around()}{rng.choice(('', f'<footer>&copy; {say(7)}</footer>', f'<div>{spoken(6, 1)}</div>'))}</body></html>")
        rows.append(features(found))
        labels += [int(b.text.startswith("q")) for b in found]
    return np.vstack(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 8):
    """A decision tree by Gini impurity: (feature, bound, tree where value <= bound, tree above), or a leaf's share."""
    share = float(y.mean())
    if not depth or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if cut.any():
            left, right = ones[:-1], ones[-1] - ones[:-1]
            gini = left * (n - left) / n + right * (len(y) - n - right) / (len(y) - n)
            i = int(np.where(cut, gini, np.inf).argmin())
            if best is None or gini[i] < best[0] - 1e-9:
                best = (gini[i], f, (v[i] + v[i + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-9:
        return share
    _, f, bound = best
    under = x[:, f] <= bound
    return f, bound, grow(x[under], y[under], depth - 1, least), grow(x[~under], y[~under], depth - 1, least)


@lru_cache(1)
def tree():
    return grow(*labelled_blocks())


def is_main(rows: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, float):
        return np.full(len(rows), node >= 0.5)
    f, bound, low, high = node
    under = rows[:, f] <= bound
    out = np.zeros(len(rows), bool)
    out[under], out[~under] = is_main(rows[under], low), is_main(rows[~under], high)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, is_main(features(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html, ...).

    A null or empty page, or one without main text, gives an empty text and 0; ids and addresses pass as they are, null
    ones too; repeated rows give a row each; other columns are ignored; an empty table gives no rows.  Broken markup is
    read as far as it goes, and texts have no bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(resting(run), "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
