"""HTML extraction by wrapper induction.

Pages of one host share a template. Their DOM trees are aligned with the host's simplest page by simple tree matching: a
text that stays the same in most of the pages is template, one that varies fills a slot. The container that holds the
slots' prose, voted by all pages of the block, is the wrapper; the blocks of text in it that aren't template are the article.
Names of elements only help where the alignment can't tell: menus, adverts and comments vary from page to page too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, session
from .url_filter import host_and_path

#: Tags as the HTML standard has them. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
#: Elements that are never part of an article, and words of class and id that say so. Fixed values.
NOT_TEXT = frozenset("script style noscript template iframe head title svg canvas object embed select option button input textarea".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
FURNITURE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies disqus footer masthead menu nav navbar navigation newsletter pagination popup promo sidebar sponsor sponsored toolbar widget".split())
#: Words that say so only at the end of a name: a social-science isn't social, a comment-policy no comment.
FURNITURE_ENDS = frozenset("comment comments header notice related reply replies share sharing social subscribe".split())
#: What may follow such an end without another meaning.
AFTER_ENDS = frozenset("area articles bar block box button buttons container content count form icons inner items link links list outer posts section thread wrap wrapper".split())
#: Elements whose own names say nothing about what is in them, and words of a compound name after which it says how the page looks.
OWN_NAMES = frozenset("html body main article".split())
STATES = frozenset("has no not with without".split())
#: Pages of a host that are aligned with each other.
BLOCK_PAGES = 64
#: Texts inside the container are template if so many unlike articles, and this share of them, have them in the same place,
#: and if they are no more than this share of all prose: what most pages share beyond that is one article in many versions.
TEMPLATE_PAGES, TEMPLATE_SHARE, TEMPLATE_MOST = 5, 0.8, 0.5
#: Elements nested deeper are taken for siblings of what is in them, as browsers do; their text stays, and their end tags close no other element.
DEPTH = 200
#: Cells of an alignment's table beyond which its rows are made at once; the alignment is the same.
CELLS = 2_500

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("children", "doubt", "label", "skip", "tag", "text")

    def __init__(self, tag: str, label: str, skip: bool, text: str = "", doubt: int = 0):
        self.tag, self.label, self.skip, self.text, self.doubt = tag, label, skip, text, doubt
        self.children: list[Node] = []


@lru_cache(10_000)
def named_furniture(names: str) -> int:
    """2 if one of the names is a furniture word, 1 if one is a compound with such a word, else 0.

    Compounds with has, no, not, with or without say how the page looks from there on, and a share-page is a page.
    """
    found = 0
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        words = words[: next((k for k, w in enumerate(words) if w in STATES), len(words))]
        if not words or words[-1] == "page":
            continue
        end = next((w for w in reversed(words) if w not in AFTER_ENDS), "")
        if end in FURNITURE_ENDS or not FURNITURE_WORDS.isdisjoint(words):
            found = max(found, 1 + (len(words) == 1))
    return found


#: Of Node.doubt: a header inside an article or main element, which stays if it holds a title.
HEADS = 4


def settle(root: Node) -> None:
    """Mark what is in furniture by name and in forms, unless it is the page's main part or holds an article's title.

    The main part holds most of the page's prose, and is a form, or has a main or h1 element in it, or, known by a compound
    name only, all of the prose and every article element.
    """
    held: dict[int, tuple[int, int, int, int]] = {}

    def weigh(n: Node, linked: bool) -> tuple[int, int, int, int]:
        """Characters of prose under n, main and h1 elements, main and article elements, titles."""
        if n.skip:
            return 0, 0, 0, 0
        if n.tag == "#":
            return 0 if linked else len(n.text.strip()), 0, 0, 0
        size, heads, marks, titles = 0, n.tag in ("main", "h1"), n.tag in ("main", "article"), n.tag in ("h1", "h2", "h3")
        for c in n.children:
            a, b, d, e = weigh(c, linked or n.tag == "a")
            size, heads, marks, titles = size + a, heads + b, marks + d, titles + e
        if n.doubt:
            held[id(n)] = size, heads, marks, titles
        return size, heads, marks, titles

    total, _, marked, _ = weigh(root, False)
    todo = [root]
    while todo:
        n = todo.pop()
        if n.doubt and not n.skip:
            size, heads, marks, titles = held[id(n)]
            main = 2 * size > total and (n.tag == "form" or heads or (n.doubt == 1 and size == total and marks == marked))
            n.skip = not (main or (n.doubt & HEADS and titles))
        for c in n.children:
            c.skip = c.skip or n.skip
        todo += n.children


def parse(source: str) -> Node:
    """The DOM tree of a page. Missing end tags end as browsers end them; a tag that the page's end cuts off is dropped."""
    root = Node("html", "html", False)
    stack, at, doubts = [root], 0, False
    # Open elements beyond DEPTH that are not in the stack, and how many of each tag. They lie between stack[DEPTH - 1] and stack[DEPTH].
    deep: list[str] = []
    held: Counter = Counter()

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(Node("#", "#", stack[-1].skip, entities.unescape(piece)))

    def close(tags, within=frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if k == DEPTH - 1 and deep and any(held[t] for t in (*tags, *within)):
                j = next(j for j in range(len(deep) - 1, -1, -1) if deep[j] in tags or deep[j] in within)
                if deep[j] in tags:
                    held.subtract(deep[j:])
                    del deep[j:], stack[DEPTH:]
                return
            if stack[k].tag in tags:
                del stack[k:]
                if k < DEPTH:
                    deep.clear()
                    held.clear()
                return
            if stack[k].tag in within:
                return

    while True:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            if doubts:
                settle(root)
            return root
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag})
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in ENDS_P:
            close({"p"}, CONTAINER)
        if tag in ENDS_ITSELF:
            close(ENDS_ITSELF[tag], {"ul", "ol", "dl", "table", "select"})
        names = " ".join(filter(None, (g for f in _NAMES.finditer(m[3]) for g in f.groups()))).lower() if m[3] else ""
        doubt = named_furniture(names) if names and tag not in OWN_NAMES else 0
        doubt = doubt or int(tag == "form")
        if (tag == "header" or doubt and "header" in names) and any(x.tag in ("article", "main") for x in stack):
            doubt |= HEADS
        # What begins beyond DEPTH is never looked into again: its tree has no bound.
        skip = stack[-1].skip or tag in NOT_TEXT or (tag in FURNITURE and not doubt & HEADS) or (doubt > 0 and len(stack) >= DEPTH)
        doubts = doubts or (doubt > 0 and not skip)
        node = Node(tag, f"{tag}.{names}" if names else tag, skip, doubt=doubt)
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if len(stack) < DEPTH or skip:
            stack.append(node)
        else:
            deep.append(tag)
            held[tag] += 1


#: What a matched node counts against a matched text that says the same: equal texts only decide between alignments of as many nodes.
NODE = 1 << 24


def match(a: Node, b: Node, memo: dict) -> tuple[int, list]:
    """Simple tree matching: (nodes matched, aligned pairs of children) of the best order-preserving alignment of a and b."""
    weight, pairs = _match(a, b, memo)
    return weight // NODE, pairs


def _match(a: Node, b: Node, memo: dict) -> tuple[int, list]:
    if a.label != b.label:
        return 0, []
    if a.skip or b.skip:  # furniture isn't looked into
        return NODE, []
    if a.tag == "#":
        return NODE + (a.text == b.text and not a.text.isspace()), []
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    x, y = a.children, b.children
    if len(x) * len(y) > CELLS:
        weight, pairs = _by_rows(x, y, memo)
        memo[key] = (NODE + weight, pairs)
        return memo[key]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x, 1):
        row, above = best[i], best[i - 1]
        for j, q in enumerate(y, 1):
            w = _match(p, q, memo)[0] if p.label == q.label else 0
            row[j] = max(row[j - 1], above[j], above[j - 1] + w)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((x[i - 1], y[j - 1]))
            i, j = i - 1, j - 1
    memo[key] = (NODE + best[len(x)][len(y)], pairs)
    return memo[key]


def _kind(n: Node, memo: dict) -> tuple[int, int, frozenset]:
    """(number of n's shape, that is all that it matches but for equal texts, number of its content, its texts)."""
    known, numbers = memo.setdefault("kinds", {}), memo.setdefault("numbers", {})
    if id(n) not in known:
        texts: frozenset = frozenset()
        if n.skip:
            shape = content = (n.label, True)
        elif n.tag == "#":
            texts = frozenset() if n.text.isspace() else frozenset((n.text,))
            shape, content = (n.label, False), (n.label, False, texts)
        else:
            of = [_kind(c, memo) for c in n.children]
            shape, content = (n.label, "shape", tuple(k[0] for k in of)), (n.label, "content", tuple(k[1] for k in of))
            texts = frozenset().union(*(k[2] for k in of))
        known[id(n)] = numbers.setdefault(shape, len(numbers)), numbers.setdefault(content, len(numbers)), texts
    return known[id(n)]


def _by_rows(x: list[Node], y: list[Node], memo: dict) -> tuple[int, list]:
    """The best alignment of long lists of children, as by the table in _match, with a row of it at once and two bits kept of a cell.

    Nodes without a common text match as their shapes do; what a shape or a content matches is worked out once.
    """
    kinds = [_kind(q, memo) for q in y]
    shapes: dict[int, Node] = {}
    contents: dict[int, list[int]] = {}
    holders: dict[str, set[int]] = {}
    for j, (s, c, texts) in enumerate(kinds):
        shapes.setdefault(s, y[j])
        contents.setdefault(c, []).append(j)
        for t in texts:
            holders.setdefault(t, set()).add(c)
    order = {s: k for k, s in enumerate(shapes)}
    at = np.array([order[k[0]] for k in kinds])
    places = {c: np.array(js) for c, js in contents.items()}
    weights: dict = {}

    def weight(p: Node, q: Node, key: tuple) -> int:
        if key not in weights:
            weights[key] = _match(p, q, memo)[0] if p.label == q.label else 0
        return weights[key]

    above, ups, lefts = np.zeros(len(y) + 1, np.int64), [], []
    for p in x:
        shape, content, texts = _kind(p, memo)
        w = np.array([weight(p, q, (shape, s)) // NODE * NODE for s, q in shapes.items()], np.int64)[at]
        for c in set().union(*(holders.get(t, ()) for t in texts)):
            w[places[c]] = weight(p, y[contents[c][0]], (content, c))
        row = np.r_[0, np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w))]
        ups.append(np.packbits(row[1:] == above[1:]))
        lefts.append(np.packbits(row[1:] == row[:-1]))
        above = row
    pairs, i, j = [], len(x), len(y)
    while i and j:
        byte, bit = (j - 1) >> 3, 128 >> ((j - 1) & 7)
        if ups[i - 1][byte] & bit:
            i -= 1
        elif lefts[i - 1][byte] & bit:
            j -= 1
        else:
            pairs.append((x[i - 1], y[j - 1]))
            i, j = i - 1, j - 1
    return int(above[-1]), pairs


def aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of text nodes that the alignment of two trees puts in the same place."""
    memo: dict = {}
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.tag == "#":
            out.append((p, q))
        todo += match(p, q, memo)[1]
    return out


def _count(n: Node) -> int:
    total, todo = 0, [n]
    while todo:
        x = todo.pop()
        total += 1
        todo += x.children
    return total


def _plain(text: str) -> str:
    """text with each run of white space as one blank, and none at the ends."""
    return " ".join(text.split())


class Alignment:
    """All trees aligned with the simplest of them: which text nodes are in the same place and say the same."""

    def __init__(self, trees: list[Node]):
        #: For each distinct content the first tree. Trees of equal texts vote once, or a page that is copied many times would look like a template.
        self.first: dict[str, int] = {}
        for k, t in enumerate(trees):
            self.first.setdefault("\0".join(_texts(t)), k)
        #: (id of the simplest tree's node, number of a tree, its node) of equal texts.
        self.same: list[tuple[int, int, Node]] = []
        if len(self.first) < 3:
            return
        self.simplest = min(self.first.items(), key=lambda kv: (_count(trees[kv[1]]), kv[0]))[1]
        for k, t in enumerate(trees):
            self.same += [(id(p), k, q) for p, q in aligned(trees[self.simplest], t) if _plain(p.text) == _plain(q.text)]

    def constant(self, voters: set[int], least: float) -> set[int]:
        """Ids of the text nodes that are the same in at least that many of the voting trees."""
        votes = Counter(p for p, k, _ in self.same if k in voters)
        return {id(q) for p, _, q in self.same if votes[p] >= least}


def template_texts(trees: list[Node], most: float = 0.6, alignment: Alignment | None = None) -> set[int]:
    """Ids of the text nodes that are template: aligned with the simplest tree's, and the same in most of the other trees."""
    a = alignment or Alignment(trees)
    if len(a.first) < 3:
        return set()
    return a.constant(set(a.first.values()) - {a.simplest}, most * (len(a.first) - 1))


def template_inside(regions: list[list[Node]], texts: list[list[str]], alignment: Alignment) -> set[int]:
    """Ids of the text nodes of the trees' containers, whose blocks are texts, that are template, by votes of unlike articles (see TEMPLATE_PAGES)."""
    first: dict[str, int] = {}
    for k, found in enumerate(regions):
        if found:
            first.setdefault("\n\n".join(texts[k]), k)
    if len(first) < TEMPLATE_PAGES or len(alignment.first) < 3:
        return set()
    voters = set(first.values())
    constant = alignment.constant(voters, TEMPLATE_SHARE * len(voters))
    if not constant:
        return constant
    whole = sum(map(len, first))
    left = sum(len(b) for k in voters for n in regions[k] for b in blocks(n, constant))
    return constant if whole - left <= TEMPLATE_MOST * whole else set()


def _texts(tree: Node) -> list[str]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if x.tag == "#":
            out.append(x.text)
        todo += reversed(x.children)
    return out


def _mass(n: Node, template: set[int], path: tuple, into: Counter, linked: bool = False) -> int:
    """Characters of prose under n, slots only: no furniture, no links, no template. into: the same by path of containers."""
    if n.skip:
        return 0
    if n.tag == "#":
        return 0 if linked or id(n) in template else len(n.text.strip())
    path = (*path, n.label)
    total = sum(_mass(c, template, path, into, linked or n.tag == "a") for c in n.children)
    if n.tag in CONTAINER and total:
        into[path] += total
    return total


def wrapper(trees: list[Node], alignment: Alignment | None = None) -> tuple:
    """The path of the container of the article, voted by all trees: from the root down as long as one child holds all of the slots' prose; an article or main element is taken at once, an article ends it."""
    template = template_texts(trees, alignment=alignment)
    mass: Counter = Counter()
    for t in trees:
        _mass(t, template, (), mass)
    at: tuple = ("html",)
    while True:
        under = [(m, p) for p, m in mass.items() if len(p) == len(at) + 1 and p[: len(at)] == at]
        marked = [x for x in under if x[1][-1].split(".")[0] in ("article", "main")]
        m, path = max(marked or under, default=(0, at))
        if not marked and m < mass[at]:
            return at
        at = path
        if not m or marked and at[-1].split(".")[0] == "article":
            return at


def _find(tree: Node, path: tuple) -> list[Node]:
    level = [tree] if tree.label == path[0] else []
    for label in path[1:]:
        level = [c for n in level for c in n.children if c.label == label and not c.skip]
    return level


def blocks(region: Node, template: set[int] = frozenset()) -> list[str]:
    """The region's text by blocks, in order; white space inside a block is one blank, empty blocks are none. Blocks all of whose
    texts are template are left out; a constant word in a block of other words stays."""
    out, own = [], []

    def flush() -> None:
        joined = _plain("".join(n.text for n in own))
        if joined and not all(id(n) in template or not n.text.strip() for n in own):
            out.append(joined)
        own.clear()

    todo: list[Node | None] = [region]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif n.tag == "#":
            own.append(n)
        elif n.tag == "br":
            own.append(_BLANK)
        elif not n.skip:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return out


_BLANK = Node("#", "#", False, " ")


def extract(sources: list[str]) -> list[str]:
    """The main texts of pages of one host. A page without the voted container is read by its own wrapper."""
    trees = [parse(s) for s in sources]
    alignment = Alignment(trees)
    path = wrapper(trees, alignment)
    regions = [_find(t, path) for t in trees]
    texts = [[b for n in found for b in blocks(n)] for found in regions]
    template = template_inside(regions, texts, alignment)
    if template:
        texts = [[b for n in found for b in blocks(n, template)] for found in regions]
    return ["\n\n".join(x or [b for n in _find(t, wrapper([t])) for b in blocks(n, template)]) for t, x in zip(trees, texts, strict=True)]


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html; further columns don't matter).

    A null or empty html has an empty text, as has a page without prose. Pages with a null url, or one without a host, are
    one host. A host's pages are dealt out by a hash of page_id into blocks of about BLOCK_PAGES, so that no task holds a
    whole large host; the blocks are the same however the table is partitioned. Where page_ids repeat or are null, all pages
    are dealt out in the table's order instead, so that a block stays as small. Each page's text comes from its own html.
    An empty table gives an empty result.
    """
    session(pages)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    # A table of its own has a size that Spark knows: while hosts are few, it is broadcast and pages move once. The block's name
    # is one column, or a join dealt out by host would be taken for good enough a grouping and leave a large host to one task.
    held = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / BLOCK_PAGES).alias("blocks")))
    alike = rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null")
    spread = F.xxhash64("page_id") if alike.isEmpty() else F.monotonically_increasing_id()
    block = F.concat("host", F.lit(" "), F.pmod(F.col("spread"), F.col("blocks")).cast("string"))
    dealt = rows.withColumn("spread", spread).join(held, "host").select("page_id", "url", "html", block.alias("block"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id", kind="stable")
        text = extract(pdf["html"].tolist())
        return pd.DataFrame({"page_id": pdf["page_id"].to_numpy(), "url": pdf["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    return dealt.groupBy("block").applyInPandas(work, "page_id long, url string, text string, n_chars long")
