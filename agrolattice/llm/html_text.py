"""Main text of web pages: boosted trees over the features of DOM nodes, decoded top down."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_sample

# a quote opens a value only after "="; anywhere else it is a plain character
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>=]|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
# Elements by how HTML treats them.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_UNSEEN = _RAW | {"head", "svg", "math", "select", "option", "button", "object", "audio", "video", "canvas", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"html", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
          "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag ends these open elements, looked for up to the nearest of the second set.
_ENDS = {**{t: ({"p"}, {"table", "td", "th", "body"}) for t in _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}},
         "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
_NUMBERS = ["depth", "chars", "link_share", "density", "tags", "children", "siblings", "place", "like_siblings",
            "sentence_marks", "words", "above_link_share", "above_chars_share"]


@dataclass
class Node:
    """A block: an element, or ("#text") text that stands beside blocks."""

    tag: str
    up: "Node | None"
    tokens: tuple[str, ...] = ()
    children: list["Node"] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    chars = link_chars = marks = tags = 0
    source = 0  # characters of markup and text inside


def parse(page: str | None) -> Node:
    """The tree of blocks; inline elements only add to their block's figures.  Unclosed and
    cut-off elements end with the page."""
    root = Node("html", None)
    page = page or ""
    stack: list[tuple[str, Node]] = [("html", root)]
    unseen = links = at = 0

    def words(raw: str) -> None:
        if unseen or not raw:
            return
        text = entities.unescape(raw)
        node = stack[-1][1]
        node.text.append(text)
        if not text.isspace():
            size = len(text)
            node.chars += size
            node.source += len(raw)
            if links:
                node.link_chars += size
            node.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    def leave() -> None:
        nonlocal unseen, links
        tag, _ = stack.pop()
        unseen -= tag in _UNSEEN
        links -= tag == "a"

    while True:
        m = _TAG.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, _ in stack[1:]):
                while stack[-1][0] != tag:
                    leave()
                leave()
            continue
        node = stack[-1][1]
        node.source += m.end() - m.start()
        node.tags += 1
        if tag in _VOID:
            if tag in ("br", "hr", "img") and not unseen:
                node.text.append(" ")
            continue
        ended, wall = _ENDS.get(tag, ((), ()))
        if ended:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ended:
                    while len(stack) > i:
                        leave()
                elif stack[i][0] in wall:
                    break
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            stack.append((tag, stack[-1][1]))
            unseen += 1
            continue
        if tag == "html" or tag == "body" and any(t == "body" for t, _ in stack):
            continue
        node = stack[-1][1]
        if tag in _BLOCK and not unseen:
            found = [t for a in _ATTRIBUTE.finditer(m[3]) for t in _TOKEN.findall((a[2] or a[3] or a[4] or "").lower())]
            child = Node(tag, node, tuple(found))
            node.children.append(child)
            # text so far and text to come are blocks of their own
            node.text.append("\0")
            node = child
        unseen += tag in _UNSEEN
        links += tag == "a"
        stack.append((tag, node))
    _own_blocks(root)
    return root


def _own_blocks(root: Node) -> None:
    """Text beside child blocks becomes "#text" children, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        todo += node.children
        if not node.children:
            continue
        pieces, merged = "".join(node.text).split("\0"), []
        for i, piece in enumerate(pieces):
            if piece.strip():
                leaf = Node("#text", node, text=[piece])
                leaf.chars, leaf.source = len(piece), len(piece)
                leaf.marks = sum(map(piece.count, ".,!?"))
                merged.append(leaf)
            if i < len(node.children):
                merged.append(node.children[i])
        node.children, node.text = merged, []


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


@dataclass
class Features:
    """Names of the tag and token columns; numbers come first."""

    tags: dict[str, int]
    tokens: dict[str, int]

    def matrix(self, nodes: list[Node]) -> np.ndarray:
        """A row a node: the figures of its subtree, its siblings, and its own and its
        ancestors' tags and attribute tokens (1 own, 0.5 above)."""
        n, at = len(nodes), {id(x): i for i, x in enumerate(nodes)}
        up = [at.get(id(x.up), -1) for x in nodes]
        sums = np.array([(x.chars, x.link_chars, x.tags, x.source, x.marks, 1) for x in nodes], float).reshape(n, 6)
        for i in range(n - 1, 0, -1):
            if up[i] >= 0:
                sums[up[i]] += sums[i]
        base = len(_NUMBERS)
        out = np.zeros((n, base + len(self.tags) + len(self.tokens)))
        for i, x in enumerate(nodes):
            p = up[i]
            if p >= 0:
                out[i, base:] = np.where(out[p, base:] > 0, 0.5, 0)
                out[i, 0] = out[p, 0] + 1
                out[i, 6] = len(x.up.children)
            if x.tag in self.tags:
                out[i, base + self.tags[x.tag]] = 1
            for t in x.tokens:
                if t in self.tokens:
                    out[i, base + len(self.tags) + self.tokens[t]] = 1
            out[i, 5] = len(x.children)
            same = Counter(c.tag for c in x.children)
            for j, c in enumerate(x.children):
                out[at[id(c)], 7:9] = j / len(x.children), same[c.tag] / len(x.children)
        chars = sums[:, 0]
        out[:, 1] = np.log1p(chars)
        out[:, 2] = sums[:, 1] / np.maximum(chars, 1)
        out[:, 3] = chars / np.maximum(sums[:, 3], 1)
        out[:, 4] = np.log1p(sums[:, 2])
        out[:, 9] = sums[:, 4] / np.maximum(chars, 1)
        out[:, 10] = np.log1p(chars / 6)
        above = np.maximum(np.array(up), 0)
        out[:, 11] = out[above, 2]
        out[:, 12] = chars / np.maximum(chars[above], 1)
        return out


# What marks page furniture, for the labels of the training pages.
_FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_FURNITURE = {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sidebar", "menu", "nav", "navigation", "breadcrumb",
              "footer", "header", "masthead", "cookie", "notice", "consent", "popup", "newsletter", "subscribe", "comment", "comments",
              "disqus", "share", "social", "related", "login", "search", "widget", "form"}
_MAIN = ["content", "article", "post", "entry", "story", "main", "text", "body"]


def _labels(nodes: list[Node]) -> list[int]:
    """1 inside an article or main element, or the like, and in no furniture; else 0."""
    out: dict[int, tuple[bool, bool]] = {}
    for x in nodes:
        inside, furniture = out.get(id(x.up), (False, False))
        inside |= x.tag in ("article", "main") or bool(set(x.tokens) & set(_MAIN))
        furniture |= x.tag in _FURNITURE_TAGS and not (x.tag == "header" and inside) or bool(set(x.tokens) & _FURNITURE)
        out[id(x)] = inside, furniture
    return [int(out[id(x)][0] and not out[id(x)][1]) for x in nodes]


def rewritten(page: str, spare: str, rng: np.random.Generator) -> str:
    """A training page laid out otherwise: articles and furniture under other tags and class
    names, and furniture of kinds that the page lacks, with ``spare`` as its words."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    main = pick("main", "section", "div", "article")
    page = re.sub(r"<article[^>]*>", f'<{main} class="{pick(*_MAIN)}">', page)
    page = page.replace("</article>", f"</{main}>")
    if rng.random() < 0.5:
        page = re.sub(r"<nav[^>]*>", f'<div class="{pick("menu", "nav", "breadcrumb", "header")}">', page).replace("</nav>", "</div>")
    if rng.random() < 0.5:
        page = re.sub(r"<footer[^>]*>", '<div id="footer">', page).replace("</footer>", "</div>")
    if rng.random() < 0.6:  # short pages too
        most = int(rng.integers(20, 200))
        page = re.sub(r"<p>([^<]*)", lambda m: "<p>" + m[1][:most], page)
    # links and lists within the text as well
    page = re.sub(r"<p>(\w[^<]{12,})", lambda m: m[0] if rng.random() < 0.6 else "<p>" + m[1][:8] + f'<a href="/x">{m[1][8:20]}</a>' + m[1][20:], page)
    if rng.random() < 0.5:
        page = re.sub(r"<p>([^<]{20,}?[.,])([^<]+)</p>", r"<ul><li>\1</li><li>\2</li></ul>", page, count=2)
    some = [f"<p>{spare[i:i + int(rng.integers(30, 400))]}</p>" for i in range(0, min(len(spare), 1200), 400)]
    kinds = [f'<{pick("aside", "div")} class="{pick("sidebar", "related", "widget", "promo", "social")}">{"".join(some)}',
             f'<div class="{pick("comments", "comment", "disqus")}">{"".join(some)}',
             f'<div class="{pick("cookie", "notice", "banner", "consent", "newsletter")}">{spare[:150]}',
             f'<form class="{pick("search", "login", "form", "subscribe")}"><p>{spare[:60]}</p><input>',
             f'<header class="{pick("header", "masthead")}"><p>{spare[:80]}</p>']
    for k in rng.permutation(len(kinds))[:int(rng.integers(1, 4))]:
        block = kinds[k] + f"</{re.match(r'<(.+?) ', kinds[k])[1]}>"
        where = pick(f"<{main} ", f"</{main}>", "<footer", "</body>")
        page = page.replace(where, block + where, 1) if where in page else page + block
    return page


class Extractor:
    """The trained trees with their columns.

    The attribute tokens that are columns are the ``tokens`` commonest ones of the training pages;
    it bounds the model, not what is read of a page.
    """

    def __init__(self, pages: list[str], trees: int = 60, depth: int = 4, seed: int = 5, tokens: int = 80):
        rng = np.random.default_rng(seed)
        plain = [re.sub(r"<[^>]*>", " ", p)[-900:] for p in pages]
        parsed = [nodes_of(parse(p)) for p in pages]
        parsed += [nodes_of(parse(rewritten(p, plain[(i + 1) % len(pages)], rng))) for i, p in enumerate(pages) for _ in range(2)]
        found = Counter(t for nodes in parsed for x in nodes for t in set(x.tokens))
        tags = Counter(x.tag for nodes in parsed for x in nodes)
        self.features = Features({t: i for i, t in enumerate(sorted(tags))},
                                 {t: i for i, (t, _) in enumerate(sorted(found.most_common(tokens)))})
        rows = [self.features.matrix(nodes) for nodes in parsed]
        # the page and its body hold both kinds
        keep = [np.array([x.tag not in ("html", "body") for x in nodes], bool) for nodes in parsed]
        labels = np.concatenate([np.array(_labels(nodes))[k] for nodes, k in zip(parsed, keep)]) if parsed else np.zeros(0)
        self.trees = None
        if len(set(labels.tolist())) == 2:
            self.trees = BoostedTrees(np.concatenate([r[k] for r, k in zip(rows, keep)]), labels, trees, depth)

    def extract(self, pages: list[str | None]) -> list[str]:
        """The kept blocks of each page, joined by line feeds."""
        trees = [nodes_of(parse(p)) for p in pages]
        if self.trees is None:
            return ["\n".join(_blocks(nodes, [True] * len(nodes))) for nodes in trees]
        rows = np.concatenate([self.features.matrix(nodes) for nodes in trees]) if trees else np.zeros((0, 1))
        p = np.clip(self.trees.score(rows), 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log1p(-p)
        out, lo = [], 0
        for nodes in trees:
            hi = lo + len(nodes)
            out.append("\n".join(_blocks(nodes, decode(nodes, yes[lo:hi].tolist(), no[lo:hi].tolist()))))
            lo = hi
        return out


def decode(nodes: list[Node], yes: list[float], no: list[float]) -> list[bool]:
    """The likeliest choice of kept nodes in which nothing below a dropped node is kept.

    Dropping a node drops its subtree; keeping it leaves each child its better choice.  The
    page and its body are always kept.
    """
    at = {id(x): i for i, x in enumerate(nodes)}
    kept, dropped = list(yes), list(no)
    for i in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[i].up)]
        kept[up] += max(kept[i], dropped[i])
        dropped[up] += dropped[i]
    out = [False] * len(nodes)
    for i, x in enumerate(nodes):
        above = x.up is None or out[at[id(x.up)]]
        out[i] = above and (x.tag in ("html", "body") or kept[i] >= dropped[i])
    return out


def _blocks(nodes: list[Node], kept: list[bool]) -> list[str]:
    found = (" ".join("".join(x.text).split()) for x, k in zip(nodes, kept) if k and not x.children)
    return [b for b in found if b]


def extract_pages(pages: DataFrame, fit_pages: int = 300) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    The trees are fitted on at most ``fit_pages`` pages (the first in a hash order of page_id
    and url), as they are and laid out otherwise; each row is then parsed, scored and decoded
    from its whole html.  A null html is empty, a page without kept text gives an empty text;
    null ids and urls stay; repeated rows each get a row; where the sample shows one kind of
    node only, every block is kept; an empty table gives no rows; further columns are ignored.
    There is no shuffle but that of the sample.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = bounded_sample(rows.select("page_id", "url"), fit_pages, "page_id", "url")
    ids = sorted({r["page_id"] for r in keys if r["page_id"] is not None})
    sample = bounded_sample(rows.where(F.col("page_id").isin(ids)), fit_pages, "page_id", "url") if ids else []
    model = docs_broadcast(pages, Extractor([r["html"] for r in sample]))

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = model.value.extract(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def docs_broadcast(df: DataFrame, value):
    """A broadcast of a small driver object (bounded by the sample it was fitted on)."""
    return df.sparkSession.sparkContext.broadcast(value)
