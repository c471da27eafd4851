"""Main text of web pages by wrapper induction.

Pages become DOM trees. A page's shape is the tree of its block elements, where
neighbours of equal label and shape are one node. The shapes of a host are
merged, the most frequent first, by simple tree matching: matched nodes are one,
others are added at their place, so the host's tree covers all its layouts. All
shapes are aligned with it, which gives the same node to the same slot of all
pages. A text that stands in one slot on most pages that have the slot is
template; texts that vary are content. A host's tree has a bound; where nodes
have no room in it, all slots of the host are also known by their paths. Pages
are counted, not blocks, and pages of equal text once. Landmarks (navigation,
footer, adverts, comments and the like, by element, role, or a word of the class
or id) are never content, and articles, where a page has any, bound it, but for
teasers of others.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_schema, number_keys, text_keys

#: A text is template on more than this share of the pages that have its slot, and on so many different pages at least.
CONSTANT_SHARE = 0.5
LEAST_PAGES = 5
#: Largest table of template texts that is sent to all tasks; a larger one is joined by host and shape.
BROADCAST_BYTES = 16 << 20
#: Most nodes of a host's tree, and of a shape that it is compared with. Where a host has more, slots are known by their paths, too.
MOST_NODES = 5_000
#: Shapes of a host that one task merges at once; hosts with more are merged in parts first.
MERGED_SHAPES, PARTS = 1_000, 64

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("head script style noscript template svg iframe object canvas audio video form button select textarea input nav header footer aside menu dialog title xmp noembed noframes annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text, in which an inline element is part of a sentence whatever its class.
SENTENCES = HEADINGS | frozenset("p li td th dd dt blockquote figcaption caption pre summary".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets "
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle google-ad comment-form comment-list comment-section comments-area comments-section reader-comments cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav nav-bar nav-menu nav-links side-nav site-nav top-nav newsletter-form newsletter-signup page-footer site-footer page-header site-header related-articles related-links related-posts share-bar share-buttons social-links social-share side-bar skip-link widget-area".split()
)
#: Words that make a landmark of a class or id as one of its parts, between marks: of readers' comments, and others.
COMMENTS = frozenset("comment comments disqus replies respond".split())
PARTS_OF = frozenset("ad ads advert advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer masthead menu nav navbar navigation newsletter pagination popup promo related share sharing sidebar social sponsor sponsored subscribe subscription".split())
#: Parts of names of what lies around or beside landmarks, and of short articles that lead to others.
AROUND = frozenset("article content entry has layout no post story text with without wrap wrapper".split())
TEASERS = frozenset("card preview promo related teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

#: Landmarks at any place; headers, as an article's own holds its heading; landmarks by class only.
ALWAYS, HEADER, CLASSED = 1, 2, 3
#: By a part of a class or id: no landmark where it holds the page's article or heading.
PARTED = 4
_HEADER_MARKS = frozenset(("header", "page-header", "site-header"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'){0,500}+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([^<]+|<+?)", re.DOTALL)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_COMMENT = re.compile(r"comment(?:[-_](?:body|content|item|text|\d+))?|reply")
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
_CELLS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table select menu".split())
_BARRIERS = frozenset("article body table td".split())


class Node:
    __slots__ = ("boiler", "children", "label", "slot", "tag")

    def __init__(self, tag: str, label: str, boiler: int) -> None:
        self.tag, self.label, self.boiler, self.children, self.slot = tag, label, boiler, [], -1


@lru_cache(100_000)
def _element(tag: str, attributes: str) -> tuple[str, int]:
    """Label (tag and class, without digits) and the kind of landmark the element is, 0 for none."""
    found = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTR.findall(attributes)} if attributes else {}
    label = ".".join([tag, *sorted(re.sub(r"\d+", "", found.get("class", "")).split())])
    names = {*found.get("class", "").split(), *found.get("id", "").split()} if tag not in ("html", "body", "main") else set()
    marks, parts = names & BOILER if tag != "article" else set(), [{*re.split(r"[-_]+", x)} for x in names]
    if "hidden" in found or found.get("aria-hidden") == "true" or _UNSEEN.search(found.get("style", "")) or found.get("role", "") in ROLES or tag in SKIP and tag != "header":
        return label, ALWAYS
    if tag == "header" or marks and marks <= _HEADER_MARKS:
        return label, HEADER
    if marks:
        return label, CLASSED
    if tag == "article":  # a comment's own, or none
        return label, ALWAYS if any(_COMMENT.fullmatch(x) for x in names) else 0
    if any(x & COMMENTS and not x & {"has", "no", "with", "without"} for x in parts):
        return label, CLASSED
    return label, PARTED if any(x & PARTS_OF and not x & AROUND for x in parts) else 0


class _Stack:
    """The open elements, with the places of each tag, of blocks, lists and barriers."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.open, self.blocks, self.lists, self.barriers, self.parted = [root], {}, [], [], [], []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.open.setdefault(node.tag, []).append(at)
        for kind, places in ((BLOCK, self.blocks), (_LISTS, self.lists), (_BARRIERS, self.barriers)):
            if node.tag in kind:
                places.append(at)
        if node.boiler == PARTED:
            self.parted.append(at)

    def cut(self, at: int) -> None:
        """Closes all from place ``at`` on."""
        for node in self.nodes[at:]:
            self.open[node.tag].pop()
        del self.nodes[at:]
        for places in (self.blocks, self.lists, self.barriers, self.parted):
            while places and places[-1] >= at:
                places.pop()

    def last(self, tag: str) -> int:
        return self.open[tag][-1] if self.open.get(tag) else 0


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed and stray tags are mended, contents of scripts and the like dropped."""
    root = Node("#root", "#root", 0)
    stack, at, end, parted = _Stack(root), 0, len(page), []
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m.group(6)
        if text is not None:
            stack.nodes[-1].children.append(text)
            continue
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            place = stack.last(tag)
            if place and (tag in BLOCK or not stack.barriers or stack.barriers[-1] <= place):
                stack.cut(place)
            continue
        label, boiler = _element(tag, m.group(3) or "")
        if tag in BLOCK and stack.last("head"):
            stack.cut(stack.last("head"))
        if tag in ENDS_P:
            if stack.blocks and stack.nodes[stack.blocks[-1]].tag == "p":
                stack.cut(stack.blocks[-1])
        if tag in _CELLS:
            place = max(map(stack.last, _CELLS[tag]))
            if place > (stack.lists[-1] if stack.lists else 0):
                stack.cut(place)
        if tag in ("article", "main", "h1") and not boiler:  # what holds the whole text is no landmark, forms among it
            for place in (*stack.open.get("form", ()), *stack.parted):
                stack.nodes[place].boiler = 0
            stack.parted.clear()
        node = Node(tag, label, boiler)
        if boiler == PARTED:
            parted.append(node)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.start() if close else end
        elif tag not in VOID and not (m.group(3) or "").endswith("/"):
            stack.push(node)
    for node in parted:
        node.boiler = CLASSED if node.boiler == PARTED else node.boiler
    return root


def shape(root: Node) -> str:
    """The page's shape, a line "depth label" for each node in order; sets ``slot`` of each block element to its node's number."""
    nodes, kids, depth = [root], [[]], [0]
    todo = [(c, 0) for c in reversed(root.children)]
    while todo:
        node, parent = todo.pop()
        if isinstance(node, str) or node.boiler in (ALWAYS, CLASSED):
            continue
        if node.tag in BLOCK:
            kids[parent].append(len(nodes))
            nodes.append(node)
            kids.append([])
            depth.append(depth[parent] + 1)
            parent = len(nodes) - 1
        todo += [(c, parent) for c in reversed(node.children)]
    # Equal shapes get equal numbers, from the leaves up; neighbours of one number are one node.
    known: dict[tuple, int] = {}
    size: list[int] = []
    number = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        below, last = [], -1
        for k in kids[i]:
            if number[k] != last:
                last = number[k]
                below.append(last)
        key = (nodes[i].label, tuple(below))
        if key not in known:
            known[key] = len(size)
            size.append(1 + sum(size[c] for c in below))
        number[i] = known[key]
    lines = [""] * size[number[0]]
    root.slot = 0
    for i, node in enumerate(nodes):
        lines[node.slot] = f"{depth[i]} {node.label}"
        after, last, same = node.slot + 1, -1, 0
        for k in kids[i]:
            if number[k] != last:
                last, same = number[k], after
                after += size[last]
            nodes[k].slot = same
    return "\n".join(lines)


def paths(layout: str) -> list[int]:
    """For each node of a shape a number below zero that tells its path: of each step the label and how many of its siblings before have it."""
    import xxhash

    out: list[int] = []
    above: list[tuple[int, dict[str, int]]] = []  # the path's number, and its children by label
    for line in layout.split("\n"):
        depth, _, label = line.partition(" ")
        del above[int(depth) :]
        before, siblings = above[-1] if above else (0, {})
        k = siblings[label] = siblings.get(label, -1) + 1
        own = xxhash.xxh3_64_intdigest(f"{before} {k} {label}".encode("utf-8", "surrogatepass"))
        above.append((own, {}))
        out.append(-1 - (own >> 1))
    return out


class Tree:
    """A shape's first MOST_NODES nodes or a host's tree: labels and children by node."""

    def __init__(self, text: str) -> None:
        self.labels: list[str] = []
        self.kids: list[list[int]] = []
        above: list[int] = []
        for line in text.split("\n", MOST_NODES)[:MOST_NODES]:
            depth, _, label = line.partition(" ")
            del above[int(depth) :]
            if above:
                self.kids[above[-1]].append(len(self.labels))
            above.append(len(self.labels))
            self.labels.append(label)
            self.kids.append([])

    def text(self) -> str:
        out, todo = [], [(0, 0)]
        while todo:
            i, depth = todo.pop()
            out.append(f"{depth} {self.labels[i]}")
            todo += [(k, depth + 1) for k in reversed(self.kids[i])]
        return "\n".join(out)


def _numbers(tree: Tree, known: dict[tuple, int]) -> list[int]:
    """A number for each node, equal for equal subtrees; ``known`` has those of other trees."""
    out = [0] * len(tree.labels)
    for i in reversed(range(len(out))):  # children come after their parent
        out[i] = known.setdefault((tree.labels[i], *(out[k] for k in tree.kids[i])), len(known))
    return out


def _aligned(table: np.ndarray) -> list[tuple[int, int]]:
    """The order-preserving pairs of rows and columns with the greatest sum of scores."""
    best = np.zeros((table.shape[0] + 1, table.shape[1] + 1), np.int64)
    for i, row in enumerate(table):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + row))
    pairs, (i, j) = [], table.shape
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def tree_match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving match of two trees from their roots, as {node of b: node of a}.

    Equal subtrees match whole, and equal ones at either end of two lists of
    children match each other, so only what differs is compared, and each pair of
    different subtrees once.
    """
    if a.labels[0] != b.labels[0]:
        return {}
    known: dict[tuple, int] = {}
    one, two = _numbers(a, known), _numbers(b, known)
    size: dict[int, int] = {}
    score: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (_, *kids), n in known.items():
        size[n] = 1 + sum(size[k] for k in kids)
    todo = [(0, 0)]
    while todo:
        p, q = todo[-1]
        if one[p] == two[q] or (one[p], two[q]) in score:
            todo.pop()
            continue
        x, y = a.kids[p], b.kids[q]
        head, most = 0, min(len(x), len(y))
        while head < most and one[x[head]] == two[y[head]]:
            head += 1
        tail = 0
        while tail < most - head and one[x[-1 - tail]] == two[y[-1 - tail]]:
            tail += 1
        u, v = x[head : len(x) - tail], y[head : len(y) - tail]
        firsts, seconds = {one[i]: i for i in u}, {two[j]: j for j in v}
        need = [(i, j) for s, i in firsts.items() for t, j in seconds.items() if s != t and a.labels[i] == b.labels[j] and (s, t) not in score]
        if need:
            todo += need
            continue
        todo.pop()
        table = np.array([[size[s] if s == t else score.get((s, t), 0) for t in seconds] for s in firsts], np.int64).reshape(len(firsts), len(seconds))
        rows, columns = {s: n for n, s in enumerate(firsts)}, {t: n for n, t in enumerate(seconds)}
        middle = _aligned(table[[rows[one[i]] for i in u]][:, [columns[two[j]] for j in v]]) if u and v else []
        pairs = [*((k, k) for k in range(head)), *((head + i, head + j) for i, j in middle), *((len(x) - k, len(y) - k) for k in range(tail, 0, -1))]
        score[one[p], two[q]] = 1 + sum(size[one[x[i]]] if one[x[i]] == two[y[j]] else score[one[x[i]], two[y[j]]] for i, j in pairs)
        chosen[one[p], two[q]] = pairs
    out, todo = {}, [(0, 0)]
    while todo:
        p, q = todo.pop()
        out[q] = p
        if one[p] == two[q]:
            todo += zip(a.kids[p], b.kids[q], strict=True)
        else:
            todo += ((a.kids[p][i], b.kids[q][j]) for i, j in chosen[one[p], two[q]])
    return out


def add_shape(tree: Tree, other: Tree) -> bool:
    """Adds to ``tree`` the nodes of ``other`` that match none of its own, each after the match of its neighbour before; whether all had room."""
    if tree.labels[0] != other.labels[0]:
        return False
    match, whole = tree_match(tree, other), True
    if len(match) == len(other.labels):
        return True
    for q, p in sorted(match.items()):
        at = 0
        for k in other.kids[q]:
            if k in match:
                at = tree.kids[p].index(match[k]) + 1
                continue
            new, todo = [], [(k, -1)]
            while todo:
                x, above = todo.pop()
                new.append((other.labels[x], above))
                own = len(new) - 1
                todo += [(c, own) for c in reversed(other.kids[x])]
            if len(tree.labels) + len(new) > MOST_NODES:
                whole = False
                continue
            base = len(tree.labels)
            for label, above in new:
                tree.labels.append(label)
                tree.kids.append([])
                if above >= 0:
                    tree.kids[base + above].append(len(tree.labels) - 1)
            tree.kids[p].insert(at, base)
            at += 1
    return whole


def blocks(root: Node, drop: Callable[[int, str], bool] | None = None, lenient: bool = False) -> list[tuple[int, str, str]]:
    """(slot, text, tag) of each block with text outside landmarks, in page order, without those that ``drop(slot, text)`` takes.

    ``lenient``: landmarks by class, and forms, are none.
    """
    out: list[tuple[int, str, str]] = []
    run: list[str] = []
    where = [root]

    def flush() -> None:
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            if text and not (drop and drop(where[0].slot, text)):
                out.append((where[0].slot, text, where[0].tag))
            run.clear()

    # Each entry: children to come, the innermost block, whether the element is a block, whether it stands in an article.
    todo: list[tuple] = [(iter(root.children), root, False, root.tag in ("article", "main"))]
    while todo:
        rest, block, own, inside = todo[-1]
        for c in rest:
            if isinstance(c, str):
                if not run:
                    where[0] = block
                run.append(c)
                continue
            if c.tag == "br":
                run.append(" ")
            kind = c.boiler
            if lenient and (kind == CLASSED or c.tag == "form"):
                kind = 0
            if kind == CLASSED and c.tag in INLINE and block.tag in SENTENCES or kind == HEADER and inside:
                kind = 0
            if kind:
                if c.tag in BLOCK:
                    flush()
                continue
            is_block = c.tag in BLOCK
            if is_block:
                flush()
            todo.append((iter(c.children), c if is_block and c.slot >= 0 else block, is_block, inside or c.tag == "article"))
            break
        else:
            if own:
                flush()
            todo.pop()
    flush()
    return out


def _find(node: Node, tag: str, lenient: bool = False) -> list[Node]:
    """Outermost elements ``tag`` outside landmarks."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag == tag:
            found.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Node) and (c.tag == tag and c.boiler != ALWAYS or not c.boiler or lenient and (c.boiler == CLASSED or c.tag == "form"))]
    return found


def _chars(node: Node) -> tuple[int, int]:
    """Characters of the text in an element, and of that in its links; white space doesn't count."""
    total, linked, todo = 0, 0, [(node, False)]
    while todo:
        x, link = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                n = len(c) - sum(map(c.count, " \n\t\r"))
                total, linked = total + n, linked + n * link
            elif c.boiler != ALWAYS:
                todo.append((c, link or c.tag == "a"))
    return total, linked


def _without_teasers(own: list[Node]) -> list[Node]:
    """The articles but those that lead to others: by their class, or short ones of which half or more is links."""
    if len(own) < 2:
        return own
    named = [x for x in own if not {*re.split(r"[.\-_]+", x.label)} & TEASERS] or own
    sizes = [_chars(x) for x in named]
    longest = max(n for n, _ in sizes)
    return [x for x, (n, linked) in zip(named, sizes, strict=True) if 4 * n >= longest or 2 * linked < n]


def areas(root: Node, lenient: bool = False) -> list[Node]:
    """What bounds the content: the articles, the main elements where articles hold less than half of their text, or else the page."""
    whole, own = _find(root, "main", lenient), _without_teasers(_find(root, "article", lenient))
    if whole and own:
        length = lambda nodes: sum(len(t) for x in nodes for _, t, _ in blocks(x, lenient=lenient))
        return own if 2 * length(own) >= length(whole) else whole
    return own or whole or [root]


def main_text(root: Node, template: Callable[[int, str], bool]) -> str:
    """The page's main text; ``template(slot, text)`` tells template. Where nothing would be left, landmarks alone decide, then fewer of them."""
    for lenient in (False, True):
        within = areas(root, lenient)
        for drop in (template, None):
            parts = [t for x in within for _, t, _ in blocks(x, drop, lenient)]
            if parts:
                return "\n".join(parts)
    return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc or "").lower()
    except ValueError:
        return ""


def _digest(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def _host_trees(layouts: DataFrame) -> DataFrame:
    """(host, part, tree, whole): the merged tree of each host's shapes, once for each part of the host's shapes, and whether it has all their nodes."""
    names = ["host", "part", "n", "layout", "whole"]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tree, n, whole = None, None, 0, True
        for f in frames:
            out = []
            for host, part, own, layout, had in zip(f["host"], f["part"].tolist(), f["n"].tolist(), f["layout"], f["whole"].tolist(), strict=True):
                had = had and layout.count("\n") < MOST_NODES
                if (host, part) != now:
                    if tree:
                        out.append((*now, n, tree.text(), whole))
                    now, tree, n, whole = (host, part), Tree(layout), own, had
                else:
                    whole = add_shape(tree, Tree(layout)) and had and whole
                    n += own
            if out:
                yield pd.DataFrame(out, columns=names)
        if tree:
            yield pd.DataFrame([(*now, n, tree.text(), whole)], columns=names)

    def merged(rows: DataFrame) -> DataFrame:  # streamed: a task holds one tree
        return rows.repartition("host", "part").sortWithinPartitions("host", "part", F.desc("n"), "layout").mapInPandas(merge, "host string, part int, n long, layout string, whole boolean")

    parts = cut(merged(layouts.select("host", "part", "n", "layout", F.lit(True).alias("whole"))))
    whole = merged(parts.withColumn("part", F.lit(0)))
    return parts.select("host", "part").join(whole.select("host", F.col("layout").alias("tree"), "whole"), "host")


def template_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, shape, fixed): for each shape of a host its template texts, as (slot, digest of text); shapes without any are left out."""

    def facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: set[tuple] = set()
            for url, page in zip(f[url_col], f[html_col], strict=True):
                host, root = host_of(url), parse(page or "")
                layout = shape(root)
                own = [(slot, _digest(text), tag) for slot, text, tag in blocks(root)]
                plain = [x for *x, tag in own if tag not in HEADINGS] or [x for *x, _ in own]
                code, copy = _digest(layout), _digest(f"{layout}{plain}")
                seen.add((host, code, -1, 0, copy, layout))
                seen.update((host, code, slot, text, copy, None) for slot, text, _ in own)
            yield pd.DataFrame(list(seen), columns=["host", "shape", "slot", "text", "copy", "layout"])

    got = pages.select(url_col, html_col).mapInPandas(facts, "host string, shape long, slot int, text long, copy long, layout string")
    got = cut(got.distinct().groupBy("host", "shape", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.first("layout").alias("layout")))
    layouts = got.filter("slot = -1").select("host", "shape", "n", "layout")
    # Hosts with one page, or too few, tell no template.
    hosts = layouts.groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("shapes")).filter(F.col("pages") >= LEAST_PAGES)
    part = F.when(F.col("shapes") > MERGED_SHAPES, F.pmod(F.xxhash64("layout"), F.lit(PARTS))).otherwise(0).cast("int")
    layouts = cut(layouts.join(hosts, "host").withColumn("part", part).drop("pages", "shapes"))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, whole = None, True
        for f in frames:
            out = []
            for host, code, n, layout in zip(f["host"], f["shape"].tolist(), f["n"].tolist(), f["layout"], strict=True):
                if n < 0:
                    tree, whole = Tree(layout), n == -1
                    continue
                out += [(host, code, slot, node, n) for slot, node in tree_match(tree, Tree(layout)).items()]
                if not whole:
                    out += [(host, code, slot, node, n) for slot, node in enumerate(paths(layout))]
            if out:
                yield pd.DataFrame(out, columns=["host", "shape", "slot", "node", "pages"])

    # A tree comes before the shapes that are aligned with it; it is not copied to their rows.
    trees = _host_trees(layouts).select("host", "part", F.lit(0).cast("long").alias("shape"), F.when(F.col("whole"), -1).otherwise(-2).cast("long").alias("n"), F.col("tree").alias("layout"))
    both = trees.unionByName(layouts).repartition("host", "part").sortWithinPartitions("host", "part", F.col("n") >= 0, "shape")
    nodes = cut(both.mapInPandas(align, "host string, shape long, slot int, node long, pages long"))
    slots = nodes.groupBy("host", "node").agg(F.sum("pages").alias("pages"))
    # Texts on too few pages of the host are none, wherever they stand.
    texts = got.filter("slot >= 0").drop("layout")
    often = texts.groupBy("host", "text").agg(F.sum("n").alias("all")).filter(F.col("all") >= LEAST_PAGES).drop("all")
    placed = cut(texts.join(often, ["host", "text"], "left_semi").join(nodes.drop("pages"), ["host", "shape", "slot"]))
    most = placed.groupBy("host", "node", "text").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES).join(slots, ["host", "node"]).filter(F.col("n") > CONSTANT_SHARE * F.col("pages"))
    fixed = placed.join(most.select("host", "node", "text"), ["host", "node", "text"], "left_semi")
    return fixed.groupBy("host", "shape").agg(F.array_sort(F.collect_set(F.struct("slot", "text"))).alias("fixed"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``.

    Null html counts as empty, a null or broken url as host "". Pages without
    text give "". Repeated rows and null ids give a row each; an empty table
    gives none; other columns are not read. The whole page is read, however
    long or deeply nested; no step recurses.
    """
    templates = cut(template_texts(pages, url_col, html_col))
    size = templates.agg(F.sum(F.length("host") + 64 + 16 * F.size("fixed")).alias("n")).first()["n"] or 0

    def texts(frames: Iterator[pd.DataFrame], known: dict | None) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url, page, own in zip(f[url_col], f[html_col], f["fixed"] if known is None else f[url_col], strict=True):
                root = parse(page or "")
                layout = shape(root)
                if known is not None:
                    fixed = known.get((host_of(url), _digest(layout)), ())
                else:
                    fixed = () if own is None else {tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in own}
                at = {slot for slot, _ in fixed}
                out.append(main_text(root, lambda slot, text, at=at, fixed=fixed: slot in at and (slot, _digest(text)) in fixed))
            yield pd.DataFrame({id_col: f[id_col], "url": f[url_col], "text": out, "n_chars": [len(t) for t in out]})

    own = pages.select(id_col, url_col, html_col)
    rows, schema = text_keys(own, id_col), f"{keyed_schema(own, id_col)}, url string, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        known = {(r["host"], r["shape"]): frozenset(map(tuple, r["fixed"])) for r in templates.collect()}
        return number_keys(rows.mapInPandas(lambda frames: texts(frames, known), schema), own, id_col)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(host=[host_of(u) for u in f[url_col]], shape=[_digest(shape(parse(p or ""))) for p in f[html_col]])

    keyed = rows.mapInPandas(coded, f"{keyed_schema(own, id_col, url_col, html_col)}, host string, shape long")
    joined = keyed.join(templates, ["host", "shape"], "left").select(id_col, url_col, html_col, "fixed")
    return number_keys(joined.mapInPandas(lambda frames: texts(frames, None), schema), own, id_col)
