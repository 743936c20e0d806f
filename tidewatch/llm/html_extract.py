"""Main text of web pages.

Elements are parsed into a tree. Block-level subtrees of every page are hashed, whatever their labels, and Spark counts
per host what each hash occurs on: the distinct pages, or within articles the distinct articles. Subtrees that recur on
`min_pages` of them and on a share (`min_share` of the pages, `article_share` of the articles) are the site's template and
are deleted wherever they stand. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are also known by tag, role and class. What is left of the article (of the body, without one) gives blocks of text.

Within an article only containers with more than headings go; paragraphs, headings and nested articles stay. Articles of
equal h1 (without any: of equal text) count once, so copies and versions of one are no template. An article keeps what
recurs if nothing but headings would stay, or, without an h1, if it would lose half of its text or more. An article in
an article is counted apart, with those of its depth.

Defined results: a null page counts as empty and gives empty text; text without any tag is one block; unclosed
elements end with their parent or the page; an unclosed comment or script runs to the end; equal pages of a host, told
by tags and text, count once, whatever their ids; pages of equal html get equal texts; a url without host has the host
""; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.joins import Scratch

MIN_PAGES, MIN_SHARE, ARTICLE_SHARE = 4, 0.1, 0.5

# Element names of the HTML standard, and class words that sites use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
DROP = frozenset("head nav footer aside form button input label menu dialog audio video canvas map".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ARTICLE = ("article", "main")
CONTAINERS = frozenset("div section aside ul ol table header footer nav form figure details fieldset".split())
FURNITURE = CONTAINERS | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKENS = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>""", re.S | re.I)
# one attribute with its value; read in order, so that names within values don't count
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
SPACE = re.compile(r"\s+")
UNITS = T.ArrayType(T.ArrayType(T.LongType()))


class Node:
    # key: what the subtree is counted by, 0 if it can't be part of a template; text: 0 none, 1 of headings, 2 more;
    # holds: an article that isn't dropped is in it
    __slots__ = ("tag", "drop", "main", "parts", "hash", "key", "text", "holds")

    def __init__(self, tag: str, drop: bool = False, main: bool = False):
        self.tag, self.drop, self.main, self.parts, self.hash = tag, drop, main, [], 0
        self.key, self.text, self.holds = 0, 0, False


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(dropped by tag, role or class; the article)."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name holds
    role = found.get("role", "").lower()
    names = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    main = tag in ARTICLE or role in ("main", "article")
    if tag in ("html", "body"):
        return False, False
    if "hidden" in found or names & (WORDS if not main else {"comment", "comments", "commentlist", "reply", "replies"}) or role in ROLES:
        return True, False
    if tag in DROP or tag == "header" and not in_article:
        return True, False
    return False, main


def parse(page: str) -> Node:
    """The page's tree; parts are texts and nodes in order."""
    root = Node("html")
    stack = [root]
    at = 0

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append(html.unescape(s))

    for m in TOKENS.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k and not (tag not in BLOCKS and any(n.tag in BLOCKS for n in stack[k + 1 :])):
                del stack[k:]
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if k and not any(n.tag in BLOCKS for n in stack[k + 1 :]):
                del stack[k:]
        if tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag] and stack[i].tag != tag:
                    break
                if stack[i].tag == tag or {stack[i].tag, tag} <= {"dt", "dd"} or {stack[i].tag, tag} <= {"td", "th"}:
                    del stack[i:]
                    break
        drop, main = _judge(tag, m[4], any(n.main for n in stack))
        node = Node(tag, drop, main)
        stack[-1].parts.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(node)
    text(page[at:])
    return root


class Unit:
    """The page (depth 0), or an article in it: what its subtrees are counted over."""

    __slots__ = ("depth", "above", "keys", "titles", "stay", "gone", "nodes")

    def __init__(self, above: Unit | None = None):
        self.depth, self.above = above.depth + 1 if above else 0, above
        self.keys, self.titles, self.stay, self.gone, self.nodes = set(), [], 0, 0, []


def hashes(root: Node) -> list[list[int]]:
    """Fill in hashes and keys; a row [depth, identity, keys that may belong to a template ...] for each unit of the page."""
    rows: list[list[int]] = []
    page = Unit()
    # without recursion: pages nest as deep as they like
    todo: list[tuple[Node, Unit, Unit, bool, bool]] = [(root, page, page, False, False)]
    while todo:
        n, unit, inner, gone, done = todo.pop()
        if not done:
            gone = gone or n.drop
            inner = Unit(unit) if n.main and not gone else unit
            todo.append((n, unit, inner, gone, True))
            todo += [(c, inner, inner, gone, False) for c in n.parts if isinstance(c, Node)]
            continue
        h = xxhash.xxh3_64(n.tag)
        heading = n.tag in HEADINGS
        for c in n.parts:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                n.text = max(n.text, min(c.text, 1) if heading else c.text)
                n.holds = n.holds or c.holds
            else:
                s = SPACE.sub(" ", c).strip()
                h.update(s)
                if s:
                    n.text = max(n.text, 1 if heading else 2)
        n.hash = h.intdigest()
        if inner is not unit:
            n.holds = True
            rows.append([inner.depth, _told_by(inner, n), *inner.keys])
            unit.titles += inner.titles
        elif n.tag == "h1" and n.text and not gone:
            unit.titles.append(n.hash)
        elif n is not root and not n.main and not n.holds and n.tag in (CONTAINERS if unit.depth else FURNITURE) and n.text > (unit.depth > 0):
            n.key = xxhash.xxh3_64_intdigest(n.hash.to_bytes(8, "little"), unit.depth) if unit.depth else n.hash
            unit.keys.add(n.key)
    return [*rows, [0, root.hash, *page.keys]]


def _told_by(unit: Unit, article: Node) -> int:
    """By its h1; without any, by all of it."""
    return xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little") for h in sorted(unit.titles))) if unit.titles else article.hash


def spare(root: Node, template: frozenset[int]) -> None:
    """Take the keys from articles that would lose too much: they are copies, and what recurs is their text."""
    units: list[Unit] = []
    todo: list[tuple[Node, Unit, bool, str]] = [(root, Unit(), False, "")]
    while todo:
        n, unit, gone, heading = todo.pop()
        if n.drop:
            continue
        heading = heading or (n.tag if n.tag in HEADINGS else "")
        if n.main:
            unit = Unit(unit)
            units.append(unit)
        elif n.key in template:
            gone = True
            unit.nodes.append(n)
        for c in n.parts:
            if isinstance(c, Node):
                todo.append((c, unit, gone, heading))
            elif size := len(SPACE.sub("", c)):
                # an article within an article stays, whatever goes from it
                u, lost = unit, gone
                while u:
                    if heading == "h1":
                        u.titles.append(size)
                    elif lost and not heading:
                        u.gone += size
                    elif not heading:
                        u.stay += size
                    u, lost = u.above, False
    for u in units:
        if not u.stay or not u.titles and u.gone >= u.stay:
            for n in u.nodes:
                n.key = 0


def has_article(root: Node) -> bool:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.main:
            return True
        todo += [c for c in n.parts if isinstance(c, Node) and not c.drop]
    return False


def blocks(root: Node, template: frozenset[int] = frozenset()) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        s = SPACE.sub(" ", "".join(now)).strip()
        if s:
            out.append(s)
        now.clear()

    only = has_article(root)
    todo: list = [(root, not only)]
    while todo:
        x, keep = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if keep:
                now.append(x)
        elif not x.drop and x.key not in template:
            keep = keep or x.main
            block = x.tag in BLOCKS
            if block:
                end()
                todo.append((None, keep))
            elif x.tag == "br" and keep:
                now.append(" ")
            todo += [(c, keep) for c in reversed(x.parts)]
    end()
    return out


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    root = parse(page or "")
    if template:
        hashes(root)
        spare(root, template)
        rest = blocks(root, template)
        # a template is furniture: where it would take the whole page, the page was a copy
        return "\n".join(rest if rest else blocks(root))
    return "\n".join(blocks(root))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """id, url, text and n_chars of every page."""
    # a page is told by its host and 128 bits of its html: copies count once, and ids don't matter
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"), host(F.col(url_col)).alias("_host"))
    p = p.withColumn("_k1", F.xxhash64("_html")).withColumn("_k2", F.xxhash64(F.lit(1), "_html"))
    key = ["_host", "_k1", "_k2"]
    scratch = Scratch(pages.sparkSession)

    @F.pandas_udf(UNITS)
    def units(htmls: pd.Series) -> pd.Series:
        return pd.Series([[[u[0], *(h - (1 << 63) for h in u[1:])] for u in hashes(parse(s))] for s in htmls], dtype=object)

    # stored, since it is read three times and a page's hashes are far smaller than the page
    seen = scratch.store(p.select(*key, units("_html").alias("_us")).dropDuplicates(key))
    each = seen.select(*key, F.explode("_us").alias("_u")).select(*key, F.col("_u")[0].alias("_depth"), F.col("_u")[1].alias("_unit"), F.expr("slice(_u, 3, size(_u))").alias("_hs"))
    # counted per host with partial sums, so a hot host or a menu on all its pages is a row per task
    sizes = each.select("_host", "_depth", "_unit").distinct().groupBy("_host", "_depth").agg(F.count(F.lit(1)).alias("_units"))
    sums = each.select("_host", "_depth", "_unit", F.explode("_hs").alias("_h")).distinct().groupBy("_host", "_depth", "_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages)
    share = F.when(F.col("_depth") == 0, min_share).otherwise(article_share)
    often = scratch.store(sums.join(sizes, ["_host", "_depth"]).filter(F.col("_n") >= share * F.col("_units")).select("_host", "_h"))
    mine = each.select(*key, F.explode("_hs").alias("_h")).join(often, ["_host", "_h"]).groupBy(*key).agg(F.collect_set("_h").alias("_template"))

    @F.pandas_udf(T.StringType())
    def main_text(htmls: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([extract(s, frozenset(int(h) + (1 << 63) for h in t) if t is not None else frozenset()) for s, t in zip(htmls, templates, strict=True)], dtype=object)

    text = p.join(mine, key, "left").select("_id", "_url", main_text("_html", "_template").alias("text"))
    return text.select(F.col("_id").alias(id_col), F.col("_url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
