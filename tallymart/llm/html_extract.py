"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged: nodes with the same path of tags
and classes are one node of the tree. Its presentation importance is the
entropy of the child sequences that pages show there, its content importance
the entropy of the texts below it, both to the base of its number of pages; a
node that looks and reads the same everywhere has neither. Few pages say little,
so the entropy is drawn towards 1 by ``DOUBT`` pages. What a tag, role or class
says of a branch is the prior by which its importance is multiplied. Branches of
low importance leave every page, those in the page's article only at a lower one.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import lean, stored

#: Weight of content in a node's importance; the rest is presentation.
CONTENT = 0.9
#: Branches below these importances go: outside and inside an element that is marked as the article.
LEAST, LEAST_INSIDE = 0.5, 0.25
#: Pages without repeats that are added to those that show a node.
DOUBT = 2
#: Priors of a mark that tells noise and of one that may.
NOISE, PERHAPS = 0.2, 0.55

# Quotes count after "=" only and where they are closed; nothing is tried twice, so the time follows the length.
_TOKEN = regex.compile(r"<!--.*?(-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?][^>]*+>", regex.S)
_ATTRIBUTE = regex.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = regex.compile(r"[^a-z]+")
_DIGITS = regex.compile(r"\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp".split())
#: Elements that hold no article text.
_NEVER = frozenset("head script style noscript template iframe nav footer aside form button select option textarea svg canvas object audio video map dialog menu title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or id that mark what isn't the article, and those that do if they are all of it.
_CLEAR = frozenset("nav navbar navigation footer sidebar ad ads advert adverts advertisement advertising adsense sponsored cookie cookies consent gdpr newsletter disqus comment comments respond breadcrumb breadcrumbs pagination pager masthead topbar".split())
_NOISE = _CLEAR | frozenset("menu header aside sponsor promo promotion banner notice notices alert popup modal overlay subscribe subscription signup login form search share sharing social related recommended recommendations trending reply replies toolbar widget copyright".split())
_INSIDE_FINE = frozenset(["header"])
_HIDDEN = regex.compile(r"(?:^|\s)hidden(?:\s|/|=|$)")
#: Start tags that end an open element: by tag, those that they end and those that shield it.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = (frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"]))


#: A style-tree node with the path above it; None at the root.
Path = tuple["Path", int] | None


class Block(NamedTuple):
    path: Path
    text: str
    prior: float
    inside: bool  # of an element marked as the article

    @property
    def noise(self) -> bool:
        return self.prior <= NOISE


class _Open(NamedTuple):
    tag: str
    path: Path
    prior: float
    inside: bool


def above(path: Path) -> Iterator[int]:
    """The nodes of a path, the last first."""
    while path is not None:
        path, node = path
        yield node


def _prior(tag: str, attributes: dict[str, str], marks: str, inside: bool) -> float:
    """What tag, role, class and id of an element say of it."""
    if tag in _NEVER or (tag == "header" and not inside) or attributes.get("role") in _ROLES:
        return NOISE
    if marks and (_HIDDEN.search(marks) or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")):
        return NOISE
    out = 1.0
    noise = _NOISE - _INSIDE_FINE if inside else _NOISE
    for name in ("class", "id"):
        for token in attributes.get(name, "").lower().split():
            words = {w for w in _SPLIT.split(token) if w}
            if words & noise:
                out = min(out, NOISE if words & _CLEAR or words <= noise else PERHAPS)
    return out


def _node(parent: int, tag: str, mark: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}>{tag}.{mark}") >> 1


def blocks(page: str) -> tuple[list[Block], dict[int, list[str]]]:
    """The text blocks of a page in order, and the tags of the children of each of its style-tree nodes."""
    found: list[Block] = []
    children: dict[int, list[str]] = {}
    stack = [_Open("", None, 1.0, False)]
    opened: Counter[str] = Counter()  # tags on the stack
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                top = stack[-1]
                found.append(Block(top.path, words, top.prior, top.inside))

    def close(at: int) -> None:
        """Close the open elements from ``at`` on."""
        if any(o.tag not in _INLINE for o in stack[at:]):
            flush()
        opened.subtract(o.tag for o in stack[at:])
        del stack[at:]

    # behind the last ">" there is no tag
    at, n, last = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = _TOKEN.search(page, at, last) if at < last else None
        if m is None:
            text.append(page[at:].partition("<!--")[0])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end() if m[1] != "" else n
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            end = _end_of(tag).search(page, at)
            at = end.end() if end else n
            continue
        inline = tag in _INLINE
        ends, shields = _CLOSES.get(tag, (frozenset(), frozenset())) if inline or tag in _CLOSES else _P
        for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in shields:
                break
        top = stack[-1]
        marks = m[4]
        attributes = {a.lower(): html.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(marks)} if marks and "=" in marks else {}
        inside = top.inside or (top.prior > NOISE and (tag in ("article", "main") or attributes.get("role") in ("main", "article")))
        prior = min(top.prior, _prior(tag, attributes, marks, top.inside))
        opened[tag] += 1
        if inline:
            if prior != top.prior:
                flush()
            stack.append(_Open(tag, top.path, prior, inside))
            continue
        flush()
        # classes as they are; numbers in an id tell pages apart, not kinds of branches
        mark = " ".join(sorted(attributes.get("class", "").lower().split())) + "#" + _DIGITS.sub("", attributes.get("id", "").lower())
        parent = top.path[1] if top.path else 0
        node = _node(parent, tag, mark)
        children.setdefault(parent, []).append(tag)
        stack.append(_Open(tag, (top.path, node), prior, inside))
    flush()
    return found, children


@cache
def _end_of(tag: str) -> regex.Pattern:
    return regex.compile(rf"</{tag}\s*>", regex.I)


def host_of(url: str | None) -> str:
    """The host of a URL without ``www.``; empty for null and for what has none."""
    rest = (url or "").partition("://")[2] or (url or "")
    return regex.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")


def _nodes(page: str) -> tuple[int, list[dict[str, int]]]:
    """Digest of a page's text without noise; child sequence and text below of each of its nodes, as hashes, by node."""
    found, children = blocks(page)
    below: dict[int, list[str]] = {}
    for b in found:
        for node in above(b.path):
            below.setdefault(node, []).append(b.text)
    out = []
    for node, texts in sorted(below.items()):
        tags = children.get(node, [])
        # repeats of one tag are one step of the sequence
        style = " ".join(t for k, t in enumerate(tags) if k == 0 or tags[k - 1] != t)
        out.append({"node": node, "style": xxhash.xxh64_intdigest(style) >> 1, "content": xxhash.xxh64_intdigest("\n".join(texts)) >> 1})
    return xxhash.xxh64_intdigest("\n".join(b.text for b in found if not b.noise)) >> 1, out


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, n_pages, importance) of every node of every host's style tree.

    Pages of a host with the same text are one page, so that copies don't make
    an article look like what the site repeats.
    """
    nodes = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("content", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_nodes(h) for h in b.column("html").to_pylist()]
            hosts = [host_of(u) for u in b.column("url").to_pylist()]
            yield pa.record_batch({"host": pa.array(hosts, pa.string()), "page": pa.array([p for p, _ in found], pa.int64()), "nodes": pa.array([x for _, x in found], nodes)})

    shown = pages.mapInArrow(lean(run), "host string, page long, nodes array<struct<node: long, style: long, content: long>>")
    # the least of the copies stands for all, whatever the order of rows
    distinct = shown.groupBy("host", "page").agg(F.min("nodes").alias("nodes")).select("host", F.explode("nodes").alias("n"))
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n.{c}").alias("value")) for k, c in enumerate(("style", "content")))))
    counts = distinct.select("host", F.col("n.node").alias("node"), values.alias("v")).groupBy("host", "node", "v.kind", "v.value").count()
    # -sum(p ln p) / ln m = (ln m - sum(c ln c) / m) / ln m
    sums = counts.groupBy("host", "node", "kind").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.log("count")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    weight = F.when(F.col("kind") == 1, F.lit(CONTENT)).otherwise(F.lit(1 - CONTENT))
    found = sums.groupBy("host", "node").agg(F.max("m").alias("n_pages"), F.sum(entropy * weight).alias("entropy"))
    return found.select("host", "node", "n_pages", ((DOUBT + F.col("n_pages") * F.col("entropy")) / (DOUBT + F.col("n_pages"))).alias("importance"))


def main_text(page: str, low: dict[int, float]) -> str:
    """The text of a page without branches of low importance; ``low``: nodes whose entropy isn't high, and their importance."""
    found = [b for b in blocks(page)[0] if not b.noise]
    total = sum(len(b.text) for b in found)
    share: dict[int, int] = {}
    for b in found:
        for node in above(b.path):
            share[node] = share.get(node, 0) + len(b.text)
    # a branch with half of the text is the article, whatever other pages say
    judged = {node: low[node] for node, n in share.items() if 2 * n < total and node in low}

    def importance(b: Block) -> float:
        return b.prior * min((judged.get(node, 1.0) for node in above(b.path)), default=1.0)

    return " ".join(b.text for b in found if importance(b) >= (LEAST_INSIDE if b.inside else LEAST))


def extracted(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text of the html), n_chars (its code points).

    Null or empty html, and html without main text: empty text. Null url: pages
    without host share a style tree. Null page_id and repeated rows: each row
    has its result. Texts of any length are taken whole. An empty table gives an
    empty table; other columns aren't read. A host of two pages can't tell what it
    repeats; there a tag or class must. A host with a large share of all pages
    is split by adaptive execution where the trees aren't small enough to be
    sent to all tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # nodes above that differ from page to page and count as unique
    low = style_tree(rows.select("url", "html")).where(F.col("importance") < LEAST / PERHAPS)
    low = stored(low.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("low")), "style-trees")

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([host_of(u) for u in b.column("url").to_pylist()], pa.string())], names=[*b.schema.names, "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes: dict[str, dict[int, float]] = {}
            out = []
            for h, host, some in zip(b.column("html"), b.column("host").to_pylist(), b.column("low"), strict=True):
                if host not in nodes:
                    nodes[host] = {x["node"]: x["importance"] for x in some.as_py() or ()}
                out.append(main_text(h.as_py(), nodes[host]))
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    known = rows.mapInArrow(hosts, "page_id long, url string, html string, host string")
    return known.join(low, "host", "left").select("page_id", "url", "html", "host", "low").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
