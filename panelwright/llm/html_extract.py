"""HTML extraction with wrappers inferred as union-free regular expressions.

The token streams of a host's pages are aligned one after another.  Under one
parent, elements of the same token meet; where they differ in text, a text slot
results; where one side lacks a token, an optional one; where a token stands
several times on a page, a repeated group.  The groups of an element are kept
by token, so the alignment of two wrappers is commutative and associative: a
wrapper does not depend on the order of the pages nor on how they are dealt to
tasks, and Spark computes it as an aggregate over (host, node).

The wrapper decides what is text: the content element is the one that holds
most of what varies over the host's pages; texts that most pages repeat at one
place are template; and elements that their tag or names make suspicious are
boilerplate unless the wrapper shows that hardly any text is left without them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._storage import materialize
from panelwright.llm.html_tokens import Page, collapse, pair_of

#: Distinct pages, and share of those with any text at its place, that a template text stands on.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Nodes on less than one in so many of a host's pages are no part of its wrapper; their text counts for the nodes around them.
RARE = 1000
#: Share of the text that the content element takes of the element around it.
MAIN_SHARE = 0.7
#: A marked element stays if less than this share of the text is left without it.
LEFT_SHARE = 0.05
#: An element with a marked word in some other name goes if this share of it is links.
LINK_SHARE = 0.5
#: How much more text counts inside these elements when the content element is sought.
FAVOURED = {"article": 10.0, "main": 3.0}
#: Elements that are parts of a content element, never the whole of it.
_PARTS = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 blockquote pre a".split())
_HINT_BYTES, _SALT = 64 << 20, 16
#: Nodes a task remembers as already described.
_DESCRIBED = 200_000


@dataclass
class Node:
    """A place in a wrapper: how many pages have it, the most siblings on one, pages with text of its own, characters and those in links below it."""

    parent: int
    token: str
    depth: int
    level: int
    pages: int
    most: int
    texts: int
    chars: int
    links: int


@dataclass
class Wrapper:
    """``nodes`` by hash; ``texts``: for each distinct text at a node the node, the pages that have it and its length."""

    pages: int = 0
    nodes: dict[int, Node] = field(default_factory=dict)
    texts: dict[int, tuple[int, int, int]] = field(default_factory=dict)


def texts_of(page: Page) -> dict[int, tuple[int, int, int]]:
    """Distinct texts of a page: pair to node, length and characters in links."""
    found: dict[int, tuple[int, int, int]] = {}
    for runs in page.blocks:
        for node, text, links in _by_node(runs):
            if text:
                found[pair_of(node, text)] = (node, len(text), min(links, len(text)))
    return found


def _by_node(runs: list) -> Iterable[tuple[int, str, int]]:
    if len(runs) == 1:
        return ((runs[0][0], collapse(runs[0][2]), runs[0][3]),)
    parts: dict[int, list] = {}
    for node, _, text, links in runs:
        x = parts.setdefault(node, [[], 0])
        x[0].append(text)
        x[1] += links
    return [(node, collapse("".join(x[0])), x[1]) for node, x in parts.items()]


def page_wrapper(page: Page) -> Wrapper:
    """The wrapper of one page: the page itself, its runs of like siblings as repeated groups."""
    texts = texts_of(page)
    w = Wrapper(1, {n: Node(parent, token, depth, level, 1, most, 0, 0, 0) for n, (parent, token, depth, level, most) in page.nodes.items()})
    w.nodes[0] = Node(0, "", 0, 0, 1, 1, 0, 0, 0)
    for pair, (node, size, links) in texts.items():
        w.texts[pair] = (node, 1, size)
        x = w.nodes[node]
        x.texts, x.chars, x.links = 1, x.chars + size, x.links + links
    _sum_up(w.nodes, ("chars", "links"))
    return w


def _sum_up(nodes: dict[int, Node], names: tuple[str, ...]) -> None:
    for n in sorted(nodes, key=lambda n: -nodes[n].depth):
        x = nodes[n]
        if n:
            for name in names:
                setattr(nodes[x.parent], name, getattr(nodes[x.parent], name) + getattr(x, name))


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The least general wrapper of both, in this form: what only one has is optional, what repeats in one is repeated, texts that differ are slots."""
    out = Wrapper(a.pages + b.pages, dict(a.nodes), dict(a.texts))
    for n, y in b.nodes.items():
        x = out.nodes.get(n)
        out.nodes[n] = y if x is None else Node(x.parent, x.token, x.depth, x.level, x.pages + y.pages, max(x.most, y.most), x.texts + y.texts, x.chars + y.chars, x.links + y.links)
    for pair, (node, pages, size) in b.texts.items():
        out.texts[pair] = (node, out.texts.get(pair, (node, 0, size))[1] + pages, size)
    return out


def template_of(w: Wrapper) -> dict[int, tuple[int, int, int]]:
    """The texts of a wrapper that are template, as in ``template_pairs``."""
    return {pair: t for pair, t in w.texts.items() if t[1] >= TEMPLATE_PAGES and t[1] >= TEMPLATE_SHARE * w.nodes[t[0]].texts and t[1] * RARE >= w.pages}


def expression(w: Wrapper) -> str:
    """The wrapper as a union-free regular expression over tokens: ``#`` is a text slot, a quoted hash template text, ``+`` a repeated and ``?`` an optional group."""
    inner: dict[int, list[int]] = {}
    for n, x in w.nodes.items():
        if n:
            inner.setdefault(x.parent, []).append(n)
    template = template_of(w)
    own: dict[int, list[str]] = {}
    for pair, (node, _, _) in sorted(w.texts.items()):
        shown = f"'{pair & 0xFFFF:04x}'" if pair in template else "#"
        if shown not in own.setdefault(node, []):
            own[node].append(shown)
    done: dict[int, str] = {}
    for n in sorted(w.nodes, key=lambda n: -w.nodes[n].depth):
        x = w.nodes[n]
        parts = own.get(n, []) + [done[c] for c in sorted(inner.get(n, []), key=lambda c: w.nodes[c].token)]
        body = " ".join(parts)
        sign = ("+" if x.most > 1 else "") + ("?" if x.pages < w.nodes[x.parent].pages else "")
        done[n] = f"({x.token}{' ' + body if body else ''}){sign}" if n else body
    return done.get(0, "")


def decide(nodes: dict[int, Node], template: dict[int, tuple[int, int, int]]) -> dict:
    """What a wrapper says about its host's pages.

    ``content``: the node whose text is the main text (0 for the whole page),
    and whether it lies in a marked article; ``kept``: suspicious nodes that
    are not boilerplate; ``dropped``: weakly suspicious ones that are.
    ``template`` has the node, pages and length of each template text.
    """
    order = sorted(nodes, key=lambda n: (nodes[n].depth, n))
    inner: dict[int, list[int]] = {n: [] for n in nodes}
    mass = {n: float(x.chars) for n, x in nodes.items()}
    spent = dict.fromkeys(nodes, 0.0)
    for node, pages, size in template.values():
        if node in spent:
            spent[node] += pages * size
    in_article = dict.fromkeys(nodes, False)
    for n in order:
        x = nodes[n]
        if n:
            inner[x.parent].append(n)
            in_article[n] = in_article[x.parent] or nodes[x.parent].token.split("!")[0] in FAVOURED
    for n in reversed(order):
        if n:
            spent[nodes[n].parent] += spent[n]
        mass[n] -= spent[n]

    strong = lambda n: nodes[n].level == 2 or nodes[n].level == 3 and not in_article[n]
    kept: set[int] = set()
    total = mass[0]

    def topmost(start: int) -> list[int]:
        """Marked nodes below ``start`` that are not within one another."""
        found, todo = [], list(inner[start])
        while todo:
            n = todo.pop()
            if strong(n) and n not in kept:
                found.append(n)
            else:
                todo += inner[n]
        return found

    marked = topmost(0)
    while total > 0:
        left = total - sum(mass[n] for n in marked)
        most = max(marked, key=lambda n: (mass[n], n), default=0)
        if not most or left >= LEFT_SHARE * total or mass[most] <= LEFT_SHARE * total:
            break
        # Without this element hardly anything is left: it is the page, not a part around it.
        kept.add(most)
        marked = [n for n in marked if n != most] + topmost(most)
    gone = set(marked)
    dropped: set[int] = set()
    effective = dict.fromkeys(nodes, 0.0)
    lost = dict.fromkeys(nodes, False)
    for n in order:
        x = nodes[n]
        weak = x.level == 1 and x.links >= LINK_SHARE * max(1, x.chars) and 2 * mass[n] < total
        if n and weak and not lost[x.parent]:
            dropped.add(n)
        lost[n] = n in gone or n in dropped or bool(n) and lost[x.parent]
    for n in reversed(order):
        if lost[n]:
            continue
        x = nodes[n]
        rest = mass[n] - sum(mass[c] for c in inner[n])
        found = rest + sum(effective[c] for c in inner[n] if not lost[c])
        plain = max(0.0, mass[n] - sum(mass[c] for c in inner[n] if lost[c]))
        favour = FAVOURED.get(x.token.split("!")[0], 1.0)
        effective[n] = max(found, favour * plain) if favour > 1.0 else found

    at = 0
    while effective[at] > 0:
        best = max((c for c in inner[at] if not lost[c]), key=lambda c: (effective[c], c), default=None)
        if best is None or effective[best] < MAIN_SHARE * effective[at]:
            break
        name = nodes[best].token.split("!")[0].split("#")[0].split(".")[0].split("@")[0]
        if nodes[best].most > 1 or name in _PARTS:
            break
        at = best
        if name == "article":
            break
    named = nodes[at].token.split("!")[0]
    return {"content": at, "article": in_article[at] or named in FAVOURED, "kept": sorted(kept), "dropped": sorted(dropped), "pairs": sorted(template)}


def hints(w: Wrapper) -> dict:
    return decide(w.nodes, template_of(w))


_GONE, _INSIDE, _HEADING = 1, 2, 4


def _read(source: str | None, hint: dict) -> Page:
    content, kept, dropped = hint["content"], hint["kept"], hint["dropped"]

    def enter(state: int, in_article: bool, node: int, level: int, name: str) -> int:
        if node in dropped or (level == 2 or level == 3 and not in_article) and node not in kept:
            state |= _GONE
        if node == content:
            state |= _INSIDE
        if name == "h1":
            state |= _HEADING
        return state

    return Page(source, enter, 0 if content else _INSIDE)


def _texts(page: Page, hint: dict) -> list[str]:
    """Blocks of the content element, and main headings outside it where it is not an article, without template texts unless that leaves nothing."""
    pairs, every, kept = hint["pairs"], [], []
    heading = 0 if hint["article"] else _HEADING
    for runs in page.blocks:
        good = [r for r in runs if not r[1] & _GONE and r[1] & (_INSIDE | heading)]
        if not good:
            continue
        text = collapse("".join(r[2] for r in good))
        if not text:
            continue
        every.append(text)
        if pairs:
            template = {node for node, t, _ in _by_node(good) if t and pair_of(node, t) in pairs}
            if template:
                text = collapse("".join(r[2] for r in good if r[0] not in template))
        if text:
            kept.append(text)
    return kept or every


def frozen(hint: dict) -> dict:
    return {k: frozenset(v) if isinstance(v, list) else v for k, v in hint.items()}


def extract(source: str | None, hint: dict | None = None) -> str:
    """Main text of a page, given what the wrapper of its host says; without a host the page is its own wrapper.

    A page that lacks its host's content element is its own wrapper but for the
    host's template texts and decisions about marked nodes.
    """
    if hint is not None:
        page = _read(source, hint)
        if not hint["content"] or hint["content"] in page.nodes:
            return "\n\n".join(_texts(page, hint))
    own = page_wrapper(Page(source))
    if hint is None:
        found = frozen(hints(own))
    else:
        template = {pair: t for pair, t in own.texts.items() if pair in hint["pairs"]}
        alone = decide(own.nodes, template)
        found = {**hint, "content": alone["content"], "article": alone["article"], "kept": hint["kept"] | frozenset(alone["kept"])}
    return "\n\n".join(_texts(_read(source, found), found))


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_FIELDS = (("host", "string"), ("page", "long"), ("nodes", "array<struct<node:long,most:int,texts:int,chars:long,links:long>>"), ("pairs", "array<struct<pair:long,node:long,size:long>>"), ("node", "long"), ("parent", "long"), ("token", "string"), ("depth", "int"), ("level", "int"))
_NODE = pa.struct([("node", pa.int64()), ("most", pa.int32()), ("texts", pa.int32()), ("chars", pa.int64()), ("links", pa.int64())])
_PAIR = pa.struct([("pair", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])
_ARROW = (pa.string(), pa.int64(), pa.list_(_NODE), pa.list_(_PAIR), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], names=[n for n, _ in _FIELDS])


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its wrapper's nodes and texts by hash; each node's token once, as far as a task remembers."""
    described: set[tuple[str, int]] = set()
    for batch in batches:
        rows = []
        for host, page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            w = page_wrapper(Page(source.as_py()))
            if len(described) > _DESCRIBED:
                described.clear()
            for n, x in w.nodes.items():
                if (host, n) not in described:
                    described.add((host, n))
                    rows.append((host, None, None, None, n, x.parent, x.token, x.depth, x.level))
            nodes = [{"node": n, "most": x.most, "texts": x.texts, "chars": x.chars, "links": x.links} for n, x in w.nodes.items()]
            pairs = [{"pair": p, "node": n, "size": size} for p, (n, _, size) in w.texts.items()]
            rows.append((host, page, nodes, pairs, None, None, None, None, None))
        yield _batch(rows)


def template_pairs(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``thost, pair, node, n, size`` of texts that stand at one node on enough of the host's distinct pages.  Counts are combined before the shuffle; only texts with enough pages meet the counts of their nodes."""
    texts = pages.select("host", F.explode("pairs").alias("t")).groupBy("host", "t.pair").agg(F.count(F.lit(1)).alias("n"), F.first("t.node").alias("node"), F.first("t.size").alias("size")).where(F.col("n") >= TEMPLATE_PAGES)
    met = texts.join(nodes.select("host", "node", "texts", "total"), ["host", "node"])
    return met.where((F.col("n") >= F.lit(TEMPLATE_SHARE) * F.col("texts")) & (F.col("n") * RARE >= F.col("total"))).select(F.col("host").alias("thost"), "pair", "node", "n", "size")


def host_wrappers(pages: DataFrame, *, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """The wrapper of every host as two tables: its nodes, and its template texts.

    Copies of a page count once.  A host's nodes are bounded: each stands on at
    least one in ``RARE`` of its pages, so there are at most ``RARE`` times as
    many as an average page has, and of template texts at most twice as many
    again.  Until they meet those bounds, nodes and texts are hashes in
    pre-aggregated shuffles.
    """
    source = F.col(html).cast("string")
    read = pages.select(_host(url).alias("host"), F.xxhash64(F.coalesce(source, F.lit(""))).alias("page"), source.alias("html"))
    read = materialize(read.mapInArrow(_read_pages, ", ".join(f"{n} {k}" for n, k in _FIELDS)), "html-pages")
    distinct = read.where("page is not null").groupBy("host", "page").agg(F.first("nodes").alias("nodes"), F.first("pairs").alias("pairs"))
    distinct = materialize(distinct, "html-distinct")
    x = F.col("x")
    counted = distinct.select("host", F.explode("nodes").alias("x")).groupBy("host", x["node"].alias("node")).agg(F.count(F.lit(1)).alias("pages"), F.max(x["most"]).alias("most"), F.sum(x["texts"]).alias("texts"), F.sum(x["chars"]).alias("chars"), F.sum(x["links"]).alias("links"))
    # The root of a host stands on all its pages.
    counted = counted.withColumn("total", F.max("pages").over(Window.partitionBy("host"))).where(F.col("pages") * RARE >= F.col("total"))
    names = read.where("page is null").groupBy("host", "node").agg(F.first("parent").alias("parent"), F.first("token").alias("token"), F.first("depth").alias("depth"), F.first("level").alias("level"))
    nodes = materialize(counted.join(names, ["host", "node"]), "html-nodes")
    return nodes, template_pairs(distinct, nodes)


def _decide_host(nodes: pd.DataFrame, template: pd.DataFrame) -> pd.DataFrame:
    found = {int(r.node): Node(int(r.parent), r.token, int(r.depth), int(r.level), int(r.pages), int(r.most), int(r.texts), int(r.chars), int(r.links)) for r in nodes.itertuples()}
    pairs = {int(r.pair): (int(r.node), int(r.n), int(r.size)) for r in template.itertuples()}
    return pd.DataFrame({"whost": nodes["host"].iloc[:1], "hint": [json.dumps(decide(found, pairs))]})


def host_hints(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``whost, hint``: what the wrapper of every host decides."""
    nodes, template = host_wrappers(pages, url=url, html=html)
    return materialize(nodes.groupBy("host").cogroup(template.groupBy("thost")).applyInPandas(_decide_host, "whost string, hint string"), "html-hints")


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    A null or empty page has an empty text.  Pages with a null or unreadable
    url share one host.  Repeated rows and pages that are alike are extracted
    alike, however they are dealt to tasks; a host with fewer than
    ``TEMPLATE_PAGES`` distinct pages has no template, and a host of one page
    is that page's wrapper.  A null id is passed through.  Pages of any length
    and depth are read in linear time.  An empty table gives an empty result.
    """
    hint = host_hints(pages, url=url, html=html)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), _host(url).alias("host"))
    size = hint.agg(F.coalesce(F.sum(F.length("hint") + F.length("whost") + 64), F.lit(0)).alias("n")).collect()[0]["n"]
    if size <= _HINT_BYTES:
        joined = rows.join(F.broadcast(hint), F.col("host") == F.col("whost"), "left")
    else:
        salted = hint.withColumn("wsalt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALT)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, (F.col("host") == F.col("whost")) & (F.col("salt") == F.col("wsalt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for source, raw in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if raw is not None and raw not in parsed:
                    if len(parsed) > 2000:
                        parsed.clear()
                    parsed[raw] = frozen(json.loads(raw))
                texts.append(extract(source.as_py(), parsed.get(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return joined.select("page_id", "url", "html", "hint").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
