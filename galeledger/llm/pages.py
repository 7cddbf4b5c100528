"""Main text of web pages by wrapper induction per host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import ready, slices
from .urls import split_url

# Markup by role (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head script style noscript template svg math iframe object select option button textarea input form nav header footer aside menu dialog canvas audio video".split())
CLOSES = {  # a start tag that ends an open element of these names
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
# Words of a class or id that mark what is no article text (fixed values).
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login search comment comments reply replies respond disqus pagination pager skip toolbar".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|\sstyle\s*=\s*[\"'][^\"'>]*display\s*:\s*none", re.IGNORECASE)
BLANK = re.compile(r"\s+")
LEAST_SHARE, CONSTANT_SHARE = 0.8, 0.95
# Different pages that a constant node stands on: half of the host's, or as many as this.
SPREAD, ENOUGH_PAGES = 0.5, 20


class Node:
    __slots__ = ("tag", "label", "kids", "void")

    def __init__(self, tag: str, label: str, void: bool):
        self.tag, self.label, self.kids, self.void = tag, label, [], void


class Tags:
    """Tags of a page from any place on, each place read once or twice whatever the page holds.

    A tag ends at the first ``>`` outside quotes. Once quotes are found that never close, tags end at the next ``>``.
    What no ``>`` follows is text; a comment without end goes on to the end of the page.
    """

    def __init__(self, text: str):
        self.text, self.last, self.plain = text, text.rfind(">"), False

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it closes, name or None for comments and declarations, attributes) of the next tag."""
        text = self.text
        while (start := text.find("<", at)) >= 0:
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                return start, len(text) if end < 0 else end + 3, False, None, ""
            if start > self.last:
                break
            if text.startswith(("<!", "<?"), start):
                return start, text.find(">", start) + 1, False, None, ""
            found = TAG.match(text, start)
            if found is None:
                at = start + 1
                continue
            end = -1 if self.plain else ATTRIBUTES.match(text, found.end()).end()
            if end < 0 or not text.startswith(">", end):
                self.plain = True
                end = text.find(">", found.end())
            return start, end + 1, bool(found[1]), found[2].lower(), text[found.end():end]
        at = text.find("<!--", at)  # the only markup that needs no end
        return (at, len(text), False, None, "") if at >= 0 else None


def parsed(text: str) -> Node:
    """Element tree of a page. Ends that are missing are supplied, stray ends are left out, raw elements hold no markup."""
    root = Node("", "", False)
    stack, at, low, tags = [root], 0, None, Tags(text)
    for start, end, closes, tag, attributes in iter(lambda: tags.after(at), None):
        if start > at:
            stack[-1].kids.append(text[at:start])
        at = end
        if tag is None:
            continue
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        closing = CLOSES.get(tag, ())
        if tag not in INLINE and stack[-1].tag not in ("", "p"):
            for i in range(len(stack) - 1, 0, -1):  # a block ends the paragraph around it, inline marks between are left open
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag not in INLINE and stack[-1].tag == "p":
            stack.pop()
        while closing and stack[-1].tag in closing:
            stack.pop()
        names = sorted({w for m in NAMES.finditer(attributes) for w in re.findall("[a-z]+", (m[1] or m[2] or m[3] or "").lower())}) if attributes else []
        node = Node(tag, ".".join([tag, *names]), tag in NO_TEXT or not ROLES.isdisjoint(names) or bool(attributes and HIDDEN.search(attributes)))
        stack[-1].kids.append(node)
        if tag in RAW:
            low = text.lower() if low is None else low
            end = low.find("</" + tag, at)
            at = len(text) if end < 0 else end
            stack.append(node)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    if at < len(text):
        stack[-1].kids.append(text[at:])
    return root


def skeleton(node: Node) -> str:
    """Block elements with equal siblings folded into one, as nested text ``label(children)``, children in order of first appearance."""
    top: dict = {}
    work = [([node], top)]
    while work:
        nodes, into = work.pop()
        by: dict[str, list[Node]] = {}
        for one in nodes:
            for kid in _blocks(one):
                by.setdefault(kid.label, []).append(kid)
        for label, kids in by.items():
            into[label] = {}
            work.append((kids, into[label]))
    out, open_ = [], [iter(top.items())]
    while open_:
        label, kids = next(open_[-1], (None, None))
        if label is None:
            open_.pop()
            out += [")"] if open_ else []
        else:
            out += [label, "("]
            open_.append(iter(kids.items()))
    return "".join(out)


def _blocks(node: Node) -> Iterator[Node]:
    """Block elements below a node with inline marks between at most."""
    open_ = [iter(node.kids)]
    while open_:
        kid = next(open_[-1], None)
        if kid is None:
            open_.pop()
        elif isinstance(kid, Node) and kid.tag not in RAW and kid.tag not in VOID:
            if kid.tag in INLINE:
                open_.append(iter(kid.kids))
            else:
                yield kid


def tree(shape: str) -> list[tuple[str, tuple[int, ...]]]:
    """Preorder of a skeleton: label and child numbers of every node; node 0 is the page."""
    out: list[tuple[str, list[int]]] = [("", [])]
    stack = [0]
    for token in re.findall(r"[^()]+|[()]", shape):
        if token == ")":
            stack.pop()
        elif token != "(":
            out.append((token, []))
            out[stack[-1]][1].append(len(out) - 1)
            stack.append(len(out) - 1)
    return [(label, tuple(kids)) for label, kids in out]


def matched(a: list, b: list) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping mapping of equal labels, parents on parents, as node numbers of a to b."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    work = [(0, 0)] if a[0][0] == b[0][0] else []
    while work:
        x, y = work[-1]
        p, q = a[x][1], b[y][1]
        fresh = [(u, v) for u in p for v in q if a[u][0] == b[v][0] and (u, v) not in memo]
        if fresh:  # first the children
            work += fresh
            continue
        work.pop()
        size = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, u in enumerate(p):
            for j, v in enumerate(q):
                size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + (memo[u, v][0] if a[u][0] == b[v][0] else 0))
        i, j, pairs = len(p), len(q), []
        while i and j:
            if size[i][j] == size[i - 1][j]:
                i -= 1
            elif size[i][j] == size[i][j - 1]:
                j -= 1
            else:
                pairs.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
        memo[x, y] = size[-1][-1] + 1, pairs
    out, open_ = {}, [(0, 0)] if memo else []
    while open_:
        x, y = open_.pop()
        out[x] = y
        open_ += memo[x, y][1]
    return out


def below(path: int, label: str) -> int:
    """Name of a label path, made from that of its parent's: as long for any depth, and valid within one process."""
    return hash((path, label))


_ALIGNED: dict[tuple[str, str], dict[int, int]] = {}


def aligned(shape: str, reference: str) -> dict[int, int]:
    """Label paths of a page's skeleton and the reference nodes they are matched with; the last few thousand pairs are kept."""
    key = shape, reference
    if key not in _ALIGNED:
        if len(_ALIGNED) > 4096:
            _ALIGNED.clear()
        own = tree(shape)
        found = matched(own, tree(reference))
        paths: dict[int, int] = {0: 0}
        for i, (_, kids) in enumerate(own):
            for k in kids:
                paths[k] = below(paths[i], own[k][0])
        _ALIGNED[key] = {paths[x]: y for x, y in found.items()}
    return _ALIGNED[key]


def blocks(root: Node, under: int = 0) -> list[tuple[int, bool, bool, str]]:
    """Text blocks of a page in order: label path, whether a role on the path excludes it, whether it lies in the path ``under``, text."""
    out: list[tuple[int, bool, bool, str]] = []
    run: list[str] = []

    def flush(path: int, void: bool, inside: bool) -> None:
        if run:
            text = BLANK.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                out.append((path, void, inside, text))
            run.clear()

    stack: list[tuple[Node, Iterator, int, bool, bool]] = [(root, iter(root.kids), 0, False, under == 0)]
    while stack:
        node, kids, path, void, inside = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if node.tag not in INLINE or node.void:
                flush(path, void, inside)
        elif isinstance(kid, str):
            run.append(kid)
        elif kid.tag == "br":
            run.append(" ")
        elif kid.tag in VOID and kid.tag not in ("hr",):
            continue
        elif kid.tag in INLINE and not kid.void:
            stack.append((kid, iter(kid.kids), path, void, inside))
        else:
            flush(path, void, inside)
            if not (kid.tag in RAW or kid.void and kid.tag in ("head", "svg", "template", "noscript")):
                own = below(path, kid.label)
                stack.append((kid, iter(kid.kids), own, void or kid.void, inside or own == under))
    return out


def content_root(reference: str, mass: dict[int, float]) -> int:
    """Reference node that holds the article: the deepest container with ``LEAST_SHARE`` of the varying text, or the article
    element around it. ``mass``: text by node."""
    nodes = tree(reference)
    total = [mass.get(i, 0.0) for i in range(len(nodes))]
    parent = {k: i for i, (_, kids) in enumerate(nodes) for k in kids}
    for i in range(len(nodes) - 1, 0, -1):
        total[parent[i]] += total[i]
    at = 0
    while True:
        down = [k for k in nodes[at][1] if total[k] >= LEAST_SHARE * total[0] and total[0] > 0 and nodes[k][1]]
        if not down:
            break
        at = down[0]
    up = at
    while up:
        if nodes[up][0].split(".")[0] in ("article", "main"):
            return up
        up = parent[up]
    return at


def _join(pages: DataFrame, by_host: DataFrame, size: int) -> DataFrame:
    """Pages with their host's row: broadcast where it is small, else a join that adaptive execution splits at a hot host."""
    return pages.join(F.broadcast(by_host) if size < 32 << 20 else by_host, "host")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Per host, the most frequent skeleton is the wrapper. Every page's skeleton is aligned with it by simple tree matching; the text of
    aligned nodes is compared over all pages of the host: a node with one text on nearly all pages that have it is template, the others are slots. Pages alike in all
    their text count once, and two different ones are enough; a node must stand on half of them or on ``ENOUGH_PAGES``. A host whose constant nodes hold more text on a page than
    its slots shows copies of one article and teaches no template. Of equally frequent skeletons the last in text order is the wrapper.
    The content is the container that holds most of the slots' text, with what a role (menu, notice, advert, ...) excludes left out.
    Character references are decoded, white space in a block is one space, blocks are joined by two line feeds. Null, empty and
    text-free pages give an empty text. A page without the container gives the blocks that no role excludes. Pages without host form one group.
    """
    ready(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), split_url(F.col(url))["host"].alias("host"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([skeleton(parsed(t or "")) for t in batch.column("html").to_pylist()], type=pa.string())], ["host", "shape"])

    seen = rows.select("host", "html").mapInArrow(shapes, "host string, shape string").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    wrappers = settle(seen.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("wrapper")), "wrappers")
    size = int(wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, int] = {}
            for host, text, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
                page = parsed(text or "")
                nodes = aligned(skeleton(page), wrapper)
                whole = xxhash.xxh64()
                mine: dict[int, list[str]] = {}
                for path, void, _, block in blocks(page):
                    if not void and path in nodes:
                        mine.setdefault(nodes[path], []).append(block)
                        whole.update(block.encode() + b"\n")
                copy = whole.intdigest() >> 1
                if mine:
                    out[host, -1, copy, copy] = 0
                for slot, texts in mine.items():
                    out[host, slot, xxhash.xxh64_intdigest("\n".join(texts).encode(), 42) >> 1, copy] = sum(map(len, texts))
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], type=pa.string()), pa.array([k[1] for k in keys], type=pa.int64()), pa.array([k[2] for k in keys], type=pa.int64()),
                 pa.array([k[3] for k in keys], type=pa.int64()), pa.array(list(out.values()), type=pa.int64())], ["host", "slot", "h", "copy", "chars"])

    texts = _join(rows, wrappers, size).select("host", "html", "wrapper").mapInArrow(slots, "host string, slot long, h long, copy long, chars long")
    once = texts.groupBy("host", "slot", "h", "copy").agg(F.max("chars").alias("chars"))
    by_text = once.groupBy("host", "slot", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    by_slot = by_text.groupBy("host", "slot").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    # As many rows of a host as the wrapper has nodes; node -1 counts the different pages.
    listed = by_slot.groupBy("host").agg(F.max(F.when(F.col("slot") < 0, F.col("n"))).alias("pages"), F.collect_list(F.struct("slot", "top", "n", "chars")).alias("all"))
    constant = lambda s: (s["n"] >= 2) & (s["top"] >= CONSTANT_SHARE * s["n"]) & ((s["n"] >= SPREAD * F.col("pages")) | (s["n"] >= ENOUGH_PAGES))
    slots_of = F.transform(F.filter("all", lambda s: s["slot"] >= 0), lambda s: F.struct(s["slot"].alias("slot"), constant(s).alias("fixed"), s["chars"].alias("chars")))
    mass = lambda fixed: F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + F.when(s["fixed"] == F.lit(fixed), s["chars"]).otherwise(0))
    varies = mass(False) >= mass(True)
    known = listed.select("host", slots_of.alias("slots")).withColumn("varies", varies).select(
        "host", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), (s["fixed"] & F.col("varies")).alias("fixed"), s["chars"].alias("chars"))).alias("slots"))
    learned = settle(wrappers.join(known, "host", "left"), "learned")

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[str, tuple[int, set[int]]] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for host, text, wrapper, slots in zip(*(part.column(c).to_pylist() for c in ("host", "html", "wrapper", "slots"))):
                    if host not in roots:
                        if len(roots) > 4096:
                            roots.clear()
                        fixed = {s["slot"] for s in slots or () if s["fixed"]}
                        roots[host] = content_root(wrapper, {s["slot"]: s["chars"] for s in slots or () if s["slot"] not in fixed}), fixed
                    root, fixed = roots[host]
                    page = parsed(text or "")
                    nodes = aligned(skeleton(page), wrapper)
                    under = next((path for path, node in nodes.items() if node == root), 0)
                    texts.append("\n\n".join(b for path, void, inside, b in blocks(page, under) if not void and inside and nodes.get(path, -1) not in fixed))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64())], ["id", "url", "text", "n_chars"])

    full = _join(rows, learned, 3 * size).select("id", "url", "host", "html", "wrapper", "slots")
    return full.mapInArrow(main_text, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", page_id).withColumnRenamed("url", url)
