"""Main text of web pages by consensus paths of each host.

1. Every page's containers are scored by the text in their blocks; the best one's
   generalised path (tags with their first class, digits dropped) is its vote. Lists,
   tables, quotes and sections inside an article don't vote: their text counts for
   what holds them. A winner inside an article or main element stands for that.
2. Spark counts votes for each host and path. A path with at least a tenth of its
   host's votes wins, so a host has at most ten.
3. Every page is read again: the blocks below elements on a winning path are its
   text. A page without such an element uses its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles are left out wherever they stand: by tag, role, or a class or id that names
them, on any element. A name such as ``no-sidebar`` names nothing, and an element that
holds all articles of its page is never left out for its name.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, join_small, table

#: A winning path has at least one in WIN_SHARE of its host's votes.
WIN_SHARE = 10
#: Hosts up to which their paths are broadcast (at most WIN_SHARE numbers each).
BROADCAST_HOSTS = 20_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(script|style|noscript|template|svg|iframe|textarea|select|button|object|canvas|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|</?[a-z][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[\d_-]*\d[\w-]*")

CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure details fieldset blockquote center".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption legend summary head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Block elements whose end is often left out: the next block, or the next of their kind, ends them.
OPEN_ENDED = frozenset("p li dt dd h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset("article main".split())
VOTERS = frozenset("html body div section article main td center".split())
LEFT_OUT = frozenset("nav footer aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
#: Classes and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu sidebar side footer cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond breadcrumb breadcrumbs "
    "pagination pager widget toolbar masthead topbar skip copyright".split()
)
#: Those that also mark at an end of a longer name, and beginnings that take the meaning away.
AT_AN_END = frozenset("ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu sidebar footer cookie cookies consent newsletter comment comments breadcrumb breadcrumbs pagination widget".split())
NEGATED = frozenset("no not non has have with without hide show".split())


def marks(name: str) -> bool:
    """Whether a class or id says that its element is not the article."""
    if name in MARKS:
        return True
    parts = [p for p in re.split(r"[_-]+", name) if p]
    return 1 < len(parts) <= 4 and parts[0] not in NEGATED and (parts[0] in AT_AN_END or parts[-1] in AT_AN_END)


@dataclass
class Element:
    tag: str
    path: str
    parent: int
    out: bool
    marked: bool
    articles: int = 0


@dataclass
class Block:
    text: str
    linked: int
    at: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def settle(self) -> None:
        """Drop blocks of what is left out, now that it is known which elements hold articles."""
        total = sum(e.tag in ARTICLES and not e.out and not e.marked for e in self.elements)
        out: list[bool] = []
        for e in self.elements:
            excused = e.tag in {"html", "body"} or (total > 0 and e.articles == total)
            out.append((e.parent >= 0 and out[e.parent]) or e.out or (e.marked and not excused))
        self.blocks = [b for b in self.blocks if b.at < 0 or not out[b.at]]

    def chain(self, at: int) -> list[int]:
        """An element and what holds it, innermost first."""
        found = []
        while at >= 0:
            found.append(at)
            at = self.elements[at].parent
        return found

    def best(self) -> str | None:
        """The path of the container with the most text: all of its own blocks', half of those one level down, a quarter of deeper ones'."""
        scores: dict[int, float] = defaultdict(float)
        own: dict[int, int] = defaultdict(int)
        voters: dict[int, list[int]] = {}
        for b in self.blocks:
            worth = max(0, len(b.text) - 2 * b.linked)
            if b.at not in voters:
                above = self.chain(b.at)
                inner = any(self.elements[i].tag in ARTICLES for i in above)
                voters[b.at] = [i for i in above if self.elements[i].tag in VOTERS and not (inner and self.elements[i].tag == "section")]
            for up, i in enumerate(voters[b.at]):
                scores[i] += worth * (1.0, 0.5, 0.25)[min(up, 2)]
            if voters[b.at] and worth:
                own[voters[b.at][0]] += worth
        found = [(-v, i) for i, v in scores.items() if v > 0]
        if not found:
            return None
        at = min(found)[1]
        above = self.chain(at)
        articles = [i for i in above if self.elements[i].tag in ARTICLES]
        if articles:
            return self.elements[articles[-1]].path
        # what stands beside the winner in a container of its own belongs to it: a title, an introduction
        for i in above[1:]:
            if self.elements[i].tag in {"html", "body"} or not own[i]:
                break
            at = i
        return self.elements[at].path

    def below(self, wanted: set[int]) -> str | None:
        """Text of the blocks below elements whose path has one of these numbers, None without such a block."""
        hit: list[bool] = []
        for e in self.elements:
            hit.append((e.parent >= 0 and hit[e.parent]) or number(e.path) in wanted)
        own = [b.text for b in self.blocks if b.at >= 0 and hit[b.at]]
        return "\n\n".join(own) if own else None

    def text(self, wanted: set[int]) -> str:
        """By the host's paths, else by the page's own best container, else all there is."""
        found = self.below(wanted) if wanted else None
        if found is None and (own := self.best()) is not None:
            found = self.below({number(own)})
        return "\n\n".join(b.text for b in self.blocks) if found is None else found


@lru_cache(maxsize=100_000)
def number(path: str) -> int:
    """A path of any length as 64 bits."""
    return xxhash.xxh3_64_intdigest(path.encode()) - 2**63


def _attributes(text: str) -> tuple[str, bool, bool]:
    """The generalised first class; whether the element is left out in any case, and whether its name marks it."""
    step, out, marked = "", False, False
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name, value = name.lower(), entities.unescape(a or b or c).lower()
        if name == "class" and value.split():
            step = "." + _DIGITS.sub("", value.split()[0])
        if name in {"class", "id"}:
            marked = marked or any(marks(w) for w in value.split())
        elif name == "role":
            out = out or value in ROLES
        elif name == "hidden":
            out = True
        elif name == "aria-hidden":
            out = out or value == "true"
        else:
            out = out or "display:none" in value.replace(" ", "")
    return step, out, marked


def read_page(html: str | None) -> Page:
    page = Page()
    if not html:
        return page
    stack: list[int] = []
    parts: list[str] = []
    linked = links = at = 0
    # an element that is no container and is left out: its tag, how often it is open, and the containers around it
    skipped, depth, around = "", 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                page.blocks.append(Block(text, linked, stack[-1] if stack else -1))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at and not skipped:
            piece = html[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            continue
        closes = bool(m[2])
        if tag in BREAKS:
            flush()
            links = 0
            if skipped in OPEN_ENDED and not closes and (skipped[0] in "ph" or tag == skipped or (skipped in {"dt", "dd"} and tag in {"dt", "dd"})) and len(stack) == around:
                skipped = ""
        elif tag == "a":
            links = max(0, links + (-1 if closes else 1))
        elif tag == "br" and not skipped:
            parts.append(" ")
        if skipped and tag == skipped:
            depth += -1 if closes else 1
            if not depth:
                skipped = ""
            continue
        if tag not in CONTAINERS:
            if not closes and not skipped and m[4] and tag not in VOID and not m[4].endswith("/"):
                _, out, marked = _attributes(m[4])
                if out or marked:
                    skipped, depth, around = tag, 1, len(stack)
            continue
        if closes:
            for n in range(len(stack) - 1, -1, -1):
                if page.elements[stack[n]].tag == tag:
                    del stack[n:]
                    break
            if skipped and len(stack) < around:
                skipped = ""
        elif not (m[4] or "").endswith("/"):
            step, out, marked = _attributes(m[4]) if m[4] else ("", False, False)
            parent = stack[-1] if stack else -1
            inside = any(page.elements[i].tag in ARTICLES for i in stack)
            out = tag not in {"html", "body"} and (out or tag in LEFT_OUT or (tag == "header" and not inside))
            element = Element(tag, (f"{page.elements[parent].path}/" if parent >= 0 else "") + tag + step, parent, out, marked)
            stack.append(len(page.elements))
            page.elements.append(element)
            if tag in ARTICLES and not out and not marked:
                for i in stack:
                    page.elements[i].articles += 1
    if at < len(html) and not skipped:
        parts.append(html[at:])
    flush()
    page.settle()
    return page


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): at most WIN_SHARE paths a host, as numbers. Votes are counted before the shuffle, so a large host is no hot key."""

    @F.pandas_udf("long")
    def vote(html: pd.Series) -> pd.Series:
        own = [read_page(h).best() for h in html]
        return pd.Series([None if p is None else number(p) for p in own], index=html.index, dtype="Int64")

    votes = pages.select(host_of(F.col("url")).alias("host"), vote(F.col("html")).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    votes = cut(votes, "votes").filter("path IS NOT NULL")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(totals, "host").filter(F.col("votes") * WIN_SHARE >= F.col("total"))
    return won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; a page without text, or null, has an empty one.

    Pages without a URL, or with one that has no host, vote among themselves. Rows that
    repeat an id are rows of their own; extra columns are ignored; an empty table gives
    an empty result.
    """

    @F.pandas_udf("string")
    def read(html: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([read_page(h).text(set() if p is None else {int(x) for x in p}) for h, p in zip(html, paths, strict=True)], index=html.index)

    known = cut(winning_paths(pages), "host-paths")
    placed = join_small(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), known, ["host"], "left", BROADCAST_HOSTS)
    return placed.select("page_id", "url", read.asNondeterministic()(F.col("html"), F.col("paths")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
