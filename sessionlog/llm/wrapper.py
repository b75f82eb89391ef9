"""Main text of pages by wrapper induction.

Pages of one host are aligned, by simple tree matching, with the block tree of one page of
that host.  Each block of text so gets a slot: the place it is matched with, or, if the
other page lacks it, its path below the nearest matched node.  Over all pages of the host,
a text that fills a slot on most of the pages is template; slots with varying texts hold
content.  A page's main text is what lies in its content region, without template and
without elements that can't be content.

Counts per slot are added up before they move, so a hot host is no large group anywhere.  A page
that occurs in copies counts once: copies are told by their three longest texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.joins import BROADCAST_ROWS

from .common import cut_lineage
from .domtree import Attributes, Matcher, Node, leaves, parse

#: Different pages of a host that a template text must be on, and the share of the host's pages,
#: within a marked article and elsewhere.
LEAST_PAGES = 4
SHARE_IN_ARTICLE = 0.8
SHARE = 0.5
#: Share of the text that one part must hold to be taken for the content region.
REGION_SHARE = 0.7
#: Share of link text that makes a list a menu.
MENU_SHARE = 0.8
#: Parsed reference pages that a task remembers.
REFERENCES = 64

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _hash(*parts: str) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p.encode("utf-8", "replace") + b"\0")
    return int.from_bytes(h.digest(), "little", signed=True)


class Aligner:
    """Parses pages and gives their blocks slots on a reference page."""

    def __init__(self):
        self.attributes, self.matcher, self.known = Attributes(), Matcher(), {}

    def page(self, text: str) -> Node:
        return self.matcher.ready(parse(text, self.attributes))

    def reference(self, text: str) -> Node:
        if text not in self.known:
            if len(self.known) >= REFERENCES or self.matcher.full():
                self.known.clear()
                self.matcher = Matcher()
            self.known[text] = self.page(text)
        return self.known[text]

    def slots(self, page: Node, reference: Node) -> dict[int, int]:
        """Slot of each block of text, by its place in the page."""
        matched, out = self.matcher.align(page, reference), {}
        stack = [(page, "")]
        while stack:
            n, way = stack.pop()
            way = str(matched[n.at]) if n.at in matched else f"{way}/{n.label}"
            if n.text is not None:
                out[n.at] = _hash(way)
            stack.extend((k, way) for k in n.kids)
        return out


def _kept(node: Node, inside: bool = False) -> list[Node]:
    """Blocks of text not in a dropped element; headers only go outside of articles and main parts."""
    out, stack = [], [(node, inside)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.article or n.main
        if n.dropped or n.header and not inside:
            continue
        if n.text is not None:
            out.append(n)
        stack.extend((k, inside) for k in reversed(n.kids))
    return out


def _mass(blocks: list[Node]) -> int:
    return sum(len(b.text) for b in blocks)


def _marked(tree: Node, article: bool) -> list[Node]:
    """Outermost articles (main parts) that are not in a dropped element."""
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        if n.article if article else n.main:
            out.append(n)
        else:
            stack.extend(reversed(n.kids))
    return out


def _without_menus(node: Node) -> list[Node]:
    """Kept blocks that are not in a list made of links."""
    menus, stack = set(), [node]
    while stack:
        n = stack.pop()
        if n.label.split(".")[0] in ("ul", "ol"):
            inner = leaves(n)
            if sum(b.linked for b in inner) >= MENU_SHARE * max(1, _mass(inner)):
                menus.update(b.at for b in inner)
                continue
        stack.extend(n.kids)
    return [b for b in _kept(node) if b.at not in menus]


def candidates(tree: Node) -> tuple[bool, list[Node], list[str]]:
    """(in a marked part, blocks, ways): what may be main text by the page's own markup.

    It is the largest article, else the largest main part, else all but dropped elements and menus.  Then
    a block's way names the elements around it that hold elements with elements, from the outside.
    """
    for article in (True, False):
        found = [b for b in (_kept(n, True) for n in _marked(tree, article)) if b]
        if found:
            blocks = max(found, key=_mass)
            return True, blocks, [""] * len(blocks)
    ways, stack = {}, [(tree, "")]
    while stack:
        n, way = stack.pop()
        if n.text is not None:
            ways[n.at] = way
        elif n is not tree and any(k.text is None for k in n.kids):
            way = f"{way}/{n.at}"
        stack.extend((k, way) for k in n.kids)
    blocks = _without_menus(tree)
    return False, blocks, [ways[b.at] for b in blocks]


def region(texts: list[str], ways: list[str]) -> list[int]:
    """Places of the texts in the innermost part that holds ``REGION_SHARE`` of the part around it."""
    inside, way = list(range(len(texts))), ""
    while True:
        mass: dict[str, int] = {}
        for i in inside:
            rest = ways[i][len(way):].split("/")
            if len(rest) > 1:
                mass[rest[1]] = mass.get(rest[1], 0) + len(texts[i])
        best = max(mass, key=mass.get, default=None)
        if best is None or mass[best] < REGION_SHARE * sum(len(texts[i]) for i in inside):
            return inside
        way = f"{way}/{best}"
        inside = [i for i in inside if ways[i] == way or ways[i].startswith(way + "/")]


def without_template(marked: bool, texts: list[str], ways: list[str], shares: list[float]) -> list[str]:
    """The main text's blocks; ``shares`` says on what part of the host's pages a block's text fills its slot.

    If nothing would be left, nothing is taken for template.
    """
    most = SHARE_IN_ARTICLE if marked else SHARE
    left = [i for i, s in enumerate(shares) if s < most] or list(range(len(texts)))
    if not marked:
        left = [left[j] for j in region([texts[i] for i in left], [ways[i] for i in left])]
    return [texts[i] for i in left]


def with_references(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, html, host) and (host, reference): the html of one page of each host.

    Which page it is does not depend on the order of rows.  Pages without a host have none.
    """
    host = F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    told = rows.select("host", "html", F.xxhash64("page_id", "url", "html").alias("draw")).filter("host is not null")
    first = told.groupBy("host").agg(F.min("draw").alias("draw"))
    chosen = told.join(_small(first), ["host", "draw"]).groupBy("host").agg(F.min("html").alias("reference"))
    return rows, cut_lineage(chosen)


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has few rows; they are counted first."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10 else df


def aligned_blocks(rows: DataFrame) -> DataFrame:
    """Each page parsed and aligned once: page_id, url, host, copy, marked, and by block text, way, slot, value.

    ``rows`` has (page_id, url, html, host, reference).
    """
    lists = [("texts", pa.string()), ("ways", pa.string()), ("slots", pa.int64()), ("filled", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            out = {name: [] for name in ("copy", "marked", *(n for n, _ in lists))}
            for html, other in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                reference = aligner.reference(other) if other is not None else None
                page = aligner.page(html)
                marked, blocks, ways = candidates(page)
                texts = [b.text for b in blocks]
                filled = [_hash(t) for t in texts] if reference else []
                slots = aligner.slots(page, reference) if reference else {}
                out["copy"].append(_hash(*sorted(texts, key=lambda t: (-len(t), t))[:3]))
                out["marked"].append(marked)
                out["texts"].append(texts)
                out["ways"].append(ways)
                out["slots"].append([slots[b.at] for b in blocks] if reference else [])
                out["filled"].append(filled)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(out["copy"], pa.int64()), pa.array(out["marked"], pa.bool_()),
                 *(pa.array(out[n], pa.list_(t)) for n, t in lists)],
                names=["page_id", "url", "host", "copy", "marked", *(n for n, _ in lists)])

    kind = dict(rows.dtypes)["page_id"]
    return rows.select("page_id", "url", "host", "html", "reference").mapInArrow(
        run, f"page_id {kind}, url string, host string, copy long, marked boolean, texts array<string>, "
             "ways array<string>, slots array<long>, filled array<long>")


def host_templates(blocks: DataFrame) -> DataFrame:
    """(host, templates): template texts of each host, array of (slot, filled, share).

    At most two texts of a slot are on half of the pages, so the arrays are bounded by what is on a page.
    """
    rows = blocks.filter("host is not null")
    whole = rows.groupBy("host").agg(F.count_distinct("copy").alias("pages"))
    often = (
        rows.select("host", "copy", F.inline(F.arrays_zip("slots", "filled"))).distinct()
        .groupBy("host", "slots", "filled").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {LEAST_PAGES}")
        .join(_small(whole), "host").filter(F.col("n") >= SHARE * F.col("pages"))
    )
    return often.groupBy("host").agg(F.collect_list(F.struct(
        F.col("slots").alias("slot"), "filled", (F.col("n") / F.col("pages")).alias("share"))).alias("templates"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars: the main text of every page.

    A null or empty html gives an empty text; a null url, or one without a host, a page that is
    read by its own markup alone.  So is a host with fewer than ``LEAST_PAGES`` different
    pages.  Repeated rows are given as often as they come; other columns are not looked at.
    White space is what Python's ``str.split`` takes for it; ``br`` is white space.
    """
    rows, references = with_references(pages)
    blocks = cut_lineage(aligned_blocks(rows.join(_small(references), "host", "left")))
    templates = cut_lineage(host_templates(blocks))
    known = blocks.join(_small(templates), "host", "left").select(
        "page_id", "url", "marked", "texts", "ways", "slots", "filled", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, (marked, blocks, ways) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                often = batch.column(7)[i].as_py()
                shares = [0.0] * len(blocks)
                if often:
                    share = {(t["slot"], t["filled"]): t["share"] for t in often}
                    placed = zip(batch.column(5)[i].as_py(), batch.column(6)[i].as_py())
                    shares = [share.get(x, 0.0) for x in placed]
                texts.append("\n".join(without_template(marked, blocks, ways, shares)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return known.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
