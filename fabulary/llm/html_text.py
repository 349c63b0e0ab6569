"""Main text of web pages by wrapper induction.

Pages of one host are compared as DOM trees. A page is first reduced to slots: its elements, runs of equal paragraphs,
items or inline elements folded into one, each with its tag, the hash of its marks and of its own text, and its length.
Simple tree matching aligns the slots of a page with those of the host's wrapper, the weighted number of matched nodes
at its largest, order and parents kept; matched slots add up their figures and the others are put in where they stand.
Wrappers grow inside each partition first, over distinct pages only, and are then merged by the same matching, twice, so
that no task holds a host's pages. Hosts with fewer than LEAST distinct pages take the wrapper merged from all hosts.

The wrapper tells which slots are content. From the root down the slot with most text is followed while it carries half
of a page's text. Slots beside it that hold mostly links, and containers beside it with less than MARGINAL of the text,
are template; so is text that most pages of the host have alike in the same slot. A page is read by matching it with its
wrapper: what lies in content slots, or in none, is its text. Elements whose names say what they are (nav, footer, aside,
forms) and marks of adverts and reader comments, which vary like content and which no alignment can tell from it, go
too. Only where there is no wrapper, or it leaves nothing, does an element that a page marks as its article decide: the text is
what lies inside it.

Wrappers are joined back by host. They are broadcast only when their measured size is below a bound, else Spark joins
them by a shuffle, where adaptive execution splits a large host.

Cases: null or empty html gives the empty text; a page without a host belongs to the host ''; unclosed, crossed and
cut-off markup is read as browsers do in outline; a page of which the wrapper leaves nothing is read without it; copies
of one page count once; ties between alignments go to the earlier slots; repeated rows pass through one to one; clashing
columns are replaced; long and deep pages are matched whole, in time that grows with the product of their slots; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import bounds, cut, partitions, parts, table

#: Distinct pages that a wrapper needs; share of them that have a text alike before it is template.
LEAST, ALIKE = 5, 0.6
#: Share of the text that the leading slot carries; below which a container beside it is template; share of links of a menu.
LEADING, MARGINAL, LINKED = 0.5, 0.15, 0.6
#: Children of a wrapper's slot: above, those of the fewest pages go, their length is kept.
CHILDREN = 64
#: Hosts whose wrappers a partition holds before it hands them on.
HOSTS = 4_096
#: Bytes of the wrappers, as written, that a task keeps as trees.
HELD_BYTES = 2_000_000
#: Bytes of all wrappers up to which they are broadcast.
BROADCAST_BYTES = 16_000_000

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset("nav footer aside form button select menu head dialog label input".split())
CONTAINER = frozenset("div section center fieldset details table td".split())
#: Elements of which each stands for itself; runs of others are one slot.
ALONE = frozenset("html head body main article section div nav aside header footer form table ul ol dl blockquote figure details dialog fieldset center".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
#: Whole words of a class, id or role that name adverts, reader comments and page parts.
ASIDE = frozenset(
    "ad ads advert adverts advertisement adsense sponsored comment comments commentlist disqus navigation contentinfo complementary search".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "mark", "up", "parts", "skip")

    def __init__(self, tag: str, mark: str = "", up: Node | None = None, skip: bool = False) -> None:
        self.tag, self.mark, self.up, self.skip = tag, mark, up, skip
        self.parts: list[Node | str] = []  # children and text, in page order

    def children(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str)]

    def own_text(self) -> str:
        return " ".join(" ".join(x for x in self.parts if isinstance(x, str)).split())


def parse(page: str) -> Node:
    """The element tree. Scripts and the like are left out; an end tag closes the nearest open element of its name."""
    root = node = Node("#page")
    at = 0
    opened: dict[str, int] = {}  # open elements by tag

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.up

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            node.parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened.get(tag):
                seek = node
                while seek.tag != tag:
                    seek = seek.up
                leave(seek.up)
            continue
        extra = m[3] or m[6] or ""
        if tag in RAW:
            if not extra.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?![a-z0-9])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:  # a block ends an open paragraph and the item before it
            closing = CLOSES.get(tag, frozenset()) | {"p"}
            seek = node
            while seek is not root and (seek.tag not in BLOCK or seek.tag in closing):
                if seek.tag in closing:
                    leave(seek.up)
                seek = seek.up
        mark = " ".join(a or b or c for a, b, c in _NAMED.findall(extra)).lower() if "=" in extra else ""
        child = Node(tag, mark, node, bool(extra) and bool(_HIDDEN.search(extra)))
        node.parts.append(child)
        if tag not in VOID:
            node = child
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        node.parts.append(entities.unescape(page[at:]))
    return root


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


class Slot:
    """A place in a page or a wrapper. Of `pages` pages; `alike` are the candidates for a common text (all of a run, its first, its last) with their lead over other texts."""

    __slots__ = ("tag", "mark", "pages", "alike", "chars", "rest", "kids", "drop", "nodes")

    def __init__(self, tag: str, mark: int, pages: int = 1, alike: list | None = None, chars: int = 0, rest: int = 0, drop: bool = False) -> None:
        self.tag, self.mark, self.pages, self.chars, self.rest, self.drop = tag, mark, pages, chars, rest, drop
        self.alike: list[list[int]] = alike or [[0, 0], [0, 0], [0, 0]]
        self.kids: list[Slot] = []
        self.nodes: list[Node] = []


def slots(nodes: list[Node]) -> Slot:
    """The slot of a run of elements, and below it those of their children."""
    top = Slot(nodes[0].tag, _hash(nodes[0].mark) if nodes[0].mark else 0)
    open_ = [(top, nodes)]
    while open_:
        made, own = open_.pop()
        made.nodes = own
        texts = [t for t in (n.own_text() for n in own) if t]
        if texts:
            made.chars = sum(map(len, texts))
            made.alike = [[_hash("\n".join(texts)), 1], [_hash(texts[0]), 1], [_hash(texts[-1]), 1]]
        run: list[Node] = []
        for child in [*(c for n in own for c in n.children()), None]:
            if run and (child is None or child.tag != run[0].tag or child.tag in ALONE):
                below = Slot(run[0].tag, _hash(run[0].mark) if run[0].mark else 0)
                made.kids.append(below)
                open_.append((below, run))
                run = []
            if child is not None:
                run.append(child)
    return top


def dump(slot: Slot) -> str:
    """Slots in page order with their depth."""
    rows, stack = [], [(slot, 0)]
    while stack:
        s, depth = stack.pop()
        rows.append([depth, s.tag, s.mark, s.pages, s.alike, s.chars, s.rest, s.drop])
        stack += [(k, depth + 1) for k in reversed(s.kids)]
    return json.dumps(rows, separators=(",", ":"))


def load(text: str) -> Slot:
    path: list[Slot] = []
    for depth, *rest in json.loads(text):
        made = Slot(*rest)
        del path[depth:]
        if path:
            path[-1].kids.append(made)
        path.append(made)
    return path[0]


def _worth(a: Slot, b: Slot) -> int:
    """Of alignments with as many nodes the one with more equal marks, then more equal texts is taken."""
    return 4 + 2 * (a.mark == b.mark) + (a.alike[0][0] == b.alike[0][0])


def match(a: Slot, b: Slot) -> tuple[int, list]:
    """Simple tree matching: the worth of the nodes matched, order and parents kept, and the matched children with theirs, last first."""
    if a.tag != b.tag:
        return 0, []
    xs, ys = a.kids, b.kids
    if not xs or not ys:
        return _worth(a, b), []
    line, ways, made = [0] * (len(ys) + 1), [], {}
    for i, x in enumerate(xs):
        above, line, way = line, [0] * (len(ys) + 1), bytearray(len(ys) + 1)  # ways: 0 left, 1 up, 2 matched
        tag = x.tag
        for j, y in enumerate(ys, 1):
            keep = line[j - 1]
            if above[j] >= keep:
                keep, way[j] = above[j], 1
            if tag == y.tag:
                if x.kids and y.kids:
                    got = made[i, j - 1] = match(x, y)
                    worth = above[j - 1] + got[0]
                else:
                    worth = above[j - 1] + _worth(x, y)
                if worth > keep:
                    keep, way[j] = worth, 2
            line[j] = keep
        ways.append(way)
    i, j, pairs = len(xs), len(ys), []
    while i and j:
        way = ways[i - 1][j]
        if way == 2:
            pairs.append((xs[i - 1], ys[j - 1], made.get((i - 1, j - 1), (0, []))[1]))
        i, j = i - (way > 0), j - (way != 1)
    return _worth(a, b) + line[-1], pairs


def aligned(a: Slot, b: Slot) -> list:
    """The matched children of two trees with theirs. The matching calls itself as deep as the trees are; its frames are on the heap."""
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)
    return match(a, b)[1]


def merge(wrapper: Slot, other: Slot) -> None:
    """Adds the slots of a page, or of another wrapper, to a wrapper."""
    stack = [(wrapper, other, aligned(wrapper, other))]
    while stack:
        w, o, pairs = stack.pop()
        w.pages, w.chars, w.rest = w.pages + o.pages, w.chars + o.chars, w.rest + o.rest
        w.alike = [_voted(a, b) for a, b in zip(w.alike, o.alike)]
        mine, at, out = {id(y): x for x, y, _ in pairs}, 0, []
        for kid in o.kids:
            found = mine.get(id(kid))
            if found is None:
                out.append(kid)
                continue
            while w.kids[at] is not found:
                out.append(w.kids[at])
                at += 1
            out.append(found)
            at += 1
        w.kids = out + w.kids[at:]
        if len(w.kids) > CHILDREN:
            bar = sorted((k.pages for k in w.kids), reverse=True)[CHILDREN // 2]
            w.rest += sum(mass(k) for k in w.kids if k.pages < bar)
            w.kids = [k for k in w.kids if k.pages >= bar][:CHILDREN]
        stack += [(x, y, p) for x, y, p in pairs]


def _voted(a: list[int], b: list[int]) -> list[int]:
    """A text that more than half of the pages have keeps its lead over all others."""
    if a[0] == b[0]:
        return [a[0], a[1] + b[1]]
    return [a[0], a[1] - b[1]] if a[1] >= b[1] else [b[0], b[1] - a[1]]


def mass(slot: Slot) -> int:
    """Characters of a slot and all below it."""
    total, stack = 0, [slot]
    while stack:
        s = stack.pop()
        total += s.chars + s.rest
        stack += s.kids
    return total


def masses(root: Slot) -> dict[int, int]:
    """By id: characters of every slot and all below it, each slot seen once."""
    order, stack = [], [root]
    while stack:
        s = stack.pop()
        order.append(s)
        stack += s.kids
    out: dict[int, int] = {}
    for s in reversed(order):
        out[id(s)] = s.chars + s.rest + sum(out[id(k)] for k in s.kids)
    return out


def links(slot: Slot) -> int:
    """Characters that lie in links."""
    total, stack = 0, [slot]
    while stack:
        s = stack.pop()
        if s.tag == "a":
            total += mass(s)
        else:
            stack += s.kids
    return total


def judge(wrapper: Slot) -> Slot:
    """Marks the slots that are template, from the root down along the slot with most text."""
    of, at = masses(wrapper), wrapper
    whole = of[id(wrapper)]
    while at.kids and whole:
        sizes = [of[id(k)] for k in at.kids]
        lead = sizes.index(max(sizes))
        if sizes[lead] < LEADING * whole:
            break
        for nth, (kid, size) in enumerate(zip(at.kids, sizes)):
            if nth != lead and kid.tag in BLOCK and size:
                menu = links(kid) >= LINKED * size
                kid.drop = menu or (kid.tag in CONTAINER and size < MARGINAL * whole)
        at = at.kids[lead]
        if at.tag in ("article", "main"):
            break
    return wrapper


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _grown(wrappers: Iterable[str]) -> Slot:
    """One wrapper of many, in an order that does not depend on how they came."""
    first, *rest = sorted(wrappers)
    made = load(first)
    for other in rest:  # one at a time as a tree
        merge(made, load(other))
    return made


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host and tree of distinct pages: one wrapper for each host of the partition."""
    held: dict[str, Slot] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": pa.array(list(held), pa.string()), "wrapper": pa.array([dump(s) for s in held.values()], pa.string())})

    for batch in batches:
        for at, to in bounds(batch.column("tree")):
            for row in batch.slice(at, to - at).to_pylist():
                tree = load(row["tree"])
                if row["host"] in held:
                    merge(held[row["host"]], tree)
                else:
                    held[row["host"]] = tree
            if len(held) > HOSTS:
                yield told()
                held.clear()
    if held:
        yield told()


def _merged(rows: pa.Table) -> pa.Table:
    return pa.table({"host": pa.array([rows["host"][0].as_py()], pa.string()), "wrapper": pa.array([dump(_grown(rows["wrapper"].to_pylist()))], pa.string())})


def _combined(made: DataFrame) -> DataFrame:
    """host and wrapper, one row a host: groups of a host's wrappers first, then those."""
    few = max(1, round(partitions(made.sparkSession) ** 0.5))
    schema = "host string, wrapper string"
    first = made.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(few)).alias("group")).applyInArrow(_merged, schema)
    return first.groupBy("host").applyInArrow(_merged, schema)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper of all hosts, marked; the host null is the one that stands for all. pages: url and html."""

    @F.arrow_udf("string")
    def compact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            yield pa.array([dump(slots([parse(x or "")])) for x in part.to_pylist()], pa.string())

    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("h"), "html")
    trees = keyed.select("host", "h", compact("html").alias("tree")).dropDuplicates(["host", "h"]).select("host", "tree")
    hosts = cut(_combined(trees.mapInArrow(_grow, "host string, wrapper string")))
    every = _combined(hosts.select(F.lit("").alias("host"), "wrapper")).select(F.lit(None).cast("string").alias("host"), "wrapper")

    @F.arrow_udf("string")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            made = [load(w) for w in part.to_pylist()]
            yield pa.array([dump(judge(w)) if w.pages >= LEAST else None for w in made], pa.string())

    return cut(hosts.unionByName(every).select("host", judged("wrapper").alias("wrapper")).where("wrapper is not null"))


def _aside(node: Node, in_article: bool) -> bool:
    if node.skip or node.tag in NOT_CONTENT or (node.tag == "header" and not in_article):
        return True
    return bool(node.mark) and node.tag not in ("html", "body", "main") and not ASIDE.isdisjoint(re.split(r"[^a-z]+", node.mark))


def _read(root: Node, wrapper: Slot | None) -> tuple[set[int], dict[int, set[int]]]:
    """By id: nodes that the wrapper drops, and for nodes in its slots the texts that are template there."""
    dropped: set[int] = set()
    fixed: dict[int, set[int]] = {}
    if wrapper is None:
        return dropped, fixed
    page = slots([root])
    stack = [(wrapper, page, aligned(wrapper, page))]
    while stack:
        w, p, pairs = stack.pop()
        if w.drop:
            dropped.update(id(n) for n in p.nodes)
        alike = {text for text, lead in w.alike if text and lead >= ALIKE * w.pages}
        if alike:
            all_alike = p.alike[0][0] in alike
            fixed |= {id(n): {_hash(n.own_text())} if all_alike else alike for n in p.nodes}
        stack += [(x, y, below) for x, y, below in pairs]
    return dropped, fixed


def main_text(root: Node, wrapper: Slot | None = None) -> str:
    """The text of a page: blocks in page order, joined by empty lines. A wrapper decides what is content; without one the page's own marks do."""
    dropped, fixed = _read(root, wrapper)
    blocks: list[tuple[str, bool]] = []
    pending: list[str] = []
    article = False

    def flush(inside: bool) -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            blocks.append((text, inside))

    # A stack of node, whether it lies in an article, its next part, and whether its own text is template.
    walk: list[list] = [[root, False, 0, False]]
    while walk:
        top = walk[-1]
        node, in_article, nth, drop = top
        if nth == 0 and id(node) in fixed:
            drop = top[3] = _hash(node.own_text()) in fixed[id(node)]
        if nth == len(node.parts):
            if node.tag in BLOCK:
                flush(in_article)
            walk.pop()
            continue
        top[2] += 1
        part = node.parts[nth]
        if isinstance(part, str):
            if not drop:
                pending.append(part)
            continue
        if part.tag in ("br", "wbr", "img", "input"):
            pending.append(" " if part.tag == "br" else "")
            continue
        if _aside(part, in_article) or id(part) in dropped:
            if part.tag in BLOCK:
                flush(in_article)
            continue
        if part.tag in BLOCK:
            flush(in_article)
        inner = part.tag in ("article", "main")
        article = article or inner
        walk.append([part, in_article or inner, 0, False])
    flush(False)
    if wrapper is None and article and (inside := [t for t, own in blocks if own]):
        return "\n\n".join(inside)
    if not blocks and wrapper is not None:
        return main_text(root)
    return "\n\n".join(t for t, _ in blocks)


def extract(pages: DataFrame) -> DataFrame:
    """pages with `text` and `n_chars`. Needs url and html."""
    made = wrappers(pages.select("url", "html"))
    size = made.agg(F.sum(F.octet_length("wrapper").cast("long"))).first()[0] or 0
    own = made.where(F.col("host").isNotNull()).select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    every = made.where(F.col("host").isNull()).select("wrapper").first()
    every = every[0] if every else None
    keyed = pages.withColumn("_at", host_of(F.col("url")))
    joined = keyed.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, F.col("_at") == F.col("_host"), "left")

    @F.arrow_udf("string")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str | None, Slot | None] = {None: load(every) if every else None}
        held = 0
        for html, wrapper in batches:
            out = []
            for at, to in bounds(html):
                for page, own in zip(html.slice(at, to - at).to_pylist(), wrapper.slice(at, to - at).to_pylist()):
                    if own not in known:
                        held += len(own)
                        if held > HELD_BYTES:
                            known, held = {None: known[None]}, len(own)
                        known[own] = load(own)
                    out.append(main_text(parse(page or ""), known[own]))
            yield pa.array(out, pa.string())

    text = joined.withColumn("text", read("html", "_wrapper")).drop("_at", "_host", "_wrapper")
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
