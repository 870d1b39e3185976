"""Main text of HTML pages: flat text blocks judged by a decision tree.

A page is cut into flat blocks at block elements. The tree sees each block's words and link density,
those of the blocks before and after it, and where it stands (inside a menu, header, footer, aside or
form; inside an article; in an element whose class says advert, sidebar, notice, comments …). It is
trained (CART, Gini impurity) on the labelled pages at the end of this module, a few hundred blocks.

Defined cases: null pages are empty and have no text; unclosed elements and cut-off pages are read as
far as they go; repeated rows are read alone; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import map_batches

# --- blocks ----------------------------------------------------------------------------------

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*>",
    re.S,
)
NAMED = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z]+")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
#: Class words that tell of a sidebar or menu elsewhere.
ELSEWHERE = re.compile(r"(?<![a-z])(?:no|without|has|with|hide)[-_]+[a-z]+")

# Fixed values of HTML: elements by what they mean for flat text.
RAW = {"script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "xmp"}
#: Without an end tag these go on to the end of the page.
TO_THE_END = {"script", "style", "title", "textarea", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
MAIN = {"article", "main"}
BLOCKS = HEADINGS | BOILERPLATE | MAIN | {
    "address", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "header", "html", "legend", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot",
    "thead", "tr", "ul",
}
SPACES = {"br", "hr", "td", "th", "option"}
#: A block that begins ends these if they are open innermost.
SELF_CLOSING = {"p"} | HEADINGS
# Words in class, id and role that mark other things than the article.
HINTS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr infobar login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted promotion recommended related "
    "replies respond reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar "
    "alert complementary contentinfo reactions feedback discussion teaser tags byline widget widgets".split()
)
# Words that mark the article, and those of elements that lay out others.
CONTENT = {"main", "article", "content", "post", "entry", "story"}
LAYOUT = {"wrap", "wrapper", "container", "layout", "outer", "grid", "row", "columns"}


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    boilerplate: bool
    hinted: bool
    main: bool
    heading: bool
    item: bool


@dataclass(slots=True)
class _Open:
    tag: str
    boilerplate: bool
    #: 1 under a layout element with a hint, which the article below it ends; 2 under any other with a hint.
    hinted: int
    main: bool


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack = [_Open("", False, 0, False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    heading = item = False

    def flush() -> None:
        nonlocal heading, item
        if parts:
            words = references.unescape("".join(parts)).split()
            if words:
                top = stack[-1]
                n_linked = min(len(words), len(references.unescape("".join(linked)).split()))
                out.append(
                    Block(" ".join(words), len(words), n_linked, top.boilerplate, top.hinted > 0, top.main, heading, item)
                )
            parts.clear()
            linked.clear()

    at = 0
    end = len(html)
    while at < end:
        match = TOKEN.search(html, at)
        text = html[at : match.start() if match else end]
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if match is None:
            break
        at = match.end()
        closing = match[1] or match[4]
        tag = (match[2] or match[5] or "").lower()
        if tag in RAW and not closing:
            if not SELF_CLOSED.search(match[3] or match[6] or ""):
                found = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = found.end() if found else end if tag in TO_THE_END else at
        elif tag == "a":
            in_link = not closing
            linked.append(" ")
        elif tag in SPACES:
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
                in_link = False
            elif tag not in VOID:
                while stack[-1].tag in SELF_CLOSING or (tag == "li" and stack[-1].tag == "li"):
                    stack.pop()
                top = stack[-1]
                named = " ".join("".join(x) for x in NAMED.findall(match[3] or match[6] or "")).lower()
                words = set(WORD.findall(ELSEWHERE.sub(" ", named)))
                hinted = bool(words & HINTS) and tag not in ("html", "body")
                main = top.main or tag in MAIN or bool(words & CONTENT)
                own = tag in BOILERPLATE or (tag == "header" and not top.main)
                if hinted and tag in MAIN and not words <= {"comment", "comments", "teaser", "related"}:
                    hinted = bool(words & {"comment", "comments", "teaser", "related"})
                laid_out = bool(words & LAYOUT)
                if hinted and not (laid_out and words & CONTENT):
                    hint = max(top.hinted, 1 if laid_out else 2)
                elif tag == "main" or (top.hinted == 1 and (tag in MAIN or words & CONTENT)):
                    hint = 0
                else:
                    hint = top.hinted
                stack.append(_Open(tag, top.boilerplate or own, hint, main))
            heading = not closing and tag in HEADINGS
            item = not closing and tag in ("li", "dt", "dd")
    flush()
    return out


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "boilerplate", "hinted", "main", "heading", "item",
)


def features(found: list[Block]) -> np.ndarray:
    """One row per block; a missing neighbour counts as empty."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.linked for b in found]) / words
    pad = np.zeros(1)
    own = np.array([[b.boilerplate, b.hinted, b.main, b.heading, b.item] for b in found], dtype=float)
    return np.column_stack(
        [
            words,
            density,
            np.concatenate([pad, words[:-1]]),
            np.concatenate([pad, density[:-1]]),
            np.concatenate([words[1:], pad]),
            np.concatenate([density[1:], pad]),
            own,
        ]
    )


# --- the tree --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """Goes to ``low`` when the feature is at most the cut; a leaf has no feature."""

    keep: bool
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> Node:
    """CART: the split with the lowest weighted Gini impurity, ties to the first feature."""
    keep = bool(y.mean() >= 0.5)
    if depth == 0 or y.all() or not y.any():
        return Node(keep)
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n = low.sum()
            if min(n, len(y) - n) < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = (n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q)) / len(y)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best[1] < 0:
        return Node(keep)
    low = x[:, best[1]] <= best[2]
    return Node(
        keep,
        best[1],
        best[2],
        grow(x[low], y[low], depth - 1, least),
        grow(x[~low], y[~low], depth - 1, least),
    )


def judge(tree: Node, x: np.ndarray) -> np.ndarray:
    """Which blocks the tree keeps."""
    out = np.zeros(len(x), dtype=bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.feature < 0:
            out[rows] = node.keep
        else:
            low = x[rows, node.feature] <= node.cut
            todo += [(node.low, rows[low]), (node.high, rows[~low])]
    return out


def main_text(html: str, tree: Node) -> str:
    found = blocks(html)
    kept = judge(tree, features(found))
    return "\n\n".join([b.text for b, k in zip(found, kept) if k])


def extracted(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", tree: Node | None = None
) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = tree or trained()
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html"),
    )

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(v.as_py() or "", tree) for v in batch.column("html")]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text"])

    found = map_batches(rows, extract, rows.select("page_id", "url").schema.add("text", "string"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


# --- the labelled pages ----------------------------------------------------------------------

# Two sentences of prose to draw paragraphs from, and the frames that pages come in. In a frame, each
# line is one piece of a page: "+" marks main text, "-" anything else. @n stands for n words.
PROSE = (
    "the river had risen in the night and by morning the lower fields lay under water so that the farmers walked "
    "along the dyke to look at what was left of the harvest while children threw stones from the bridge"
).split()

FRAMES = (
    """
    -<nav><ul><li><a href=x>@1</a></li><li><a href=x>@1</a></li><li><a href=x>@2</a></li></ul></nav>
    -<div class=ad>@8</div>
    +<article><h1>@9</h1>
    +<p>@60</p>
    +<p>@1</p>
    +<p>@25</p>
    +<p><b>@14</b><br></p>
    +<p>@4</p></article>
    -<footer>&copy; @12</footer>
    """,
    """
    -<header><a href=x>@2</a> @5</header><div class=menu><a href=x>@1</a> <a href=x>@1</a></div>
    -<div id=cookie-notice>@30</div>
    +<main><h1>@5</h1>
    +<p>@40</p>
    -<div class=advert>@20</div>
    +<h2>@3</h2>
    +<p>@2</p>
    +<ul><li>@6</li>
    +<li>@3</li></ul>
    +<blockquote>@22</blockquote>
    +<p>@18 <a href=x>@3</a> @10</p></main>
    -<aside><h3>@2</h3>
    -<p>@35</p></aside>
    -<section class=comments><h3>@2</h3>
    -<p>@45</p>
    -<p>@9</p></section>
    -<form><p>@6</p><button>@1</button></form>
    -<footer><p>@25</p></footer>
    """,
    """
    -<div class=header>@3</div>
    -<div class=sidebar><p>@40</p>
    -<p>@12</p></div>
    +<div class=post-content><h1>@7</h1>
    +<p>@80</p>
    +<p>@33</p>
    +<p>@3</p></div>
    -<div class=related><a href=x>@6</a></div>
    -<div id=comments><p>@50</p>
    -<p>@7</p></div>
    """,
    """
    -<div><a href=x>@1</a> <a href=x>@1</a> <a href=x>@1</a></div>
    -<div>@3</div>
    +<div><h1>@8</h1>
    +<p>@55</p>
    +<p>@41</p>
    +<p>@29</p>
    +<p>@12</p>
    +<p>@63</p></div>
    -<div><a href=x>@4</a></div>
    -<div>@6</div>
    -<div><a href=x>@2</a> <a href=x>@2</a> @2</div>
    """,
    """
    -<table><tr><td><a href=x>@2</a></td><td><a href=x>@2</a></td></tr></table>
    -<p>@2</p>
    +<div><h2>@6</h2>
    +<p>@35</p>
    +<p>@70 <a href=x>@2</a></p>
    +<p>@21</p></div>
    -<ul><li><a href=x>@7</a></li><li><a href=x>@5</a></li><li><a href=x>@8</a></li></ul>
    -<p>&copy; @4</p>
    """,
    """
    +<h1>@6</h1>
    +<p>@40</p>
    +<p>@5</p>
    -<div class=ad>@10</div>
    +<p>@30</p>
    """,
    """
    +<p>@20</p>
    """,
    """
    -<nav>@15 <a href=x>@2</a></nav>
    -<header>@22</header>
    +<div><p>@50</p>
    +<p>@38</p>
    +<p>@6</p>
    +<p>@90</p></div>
    -<form><p>@30</p></form>
    -<aside>@40</aside>
    -<footer>@18</footer>
    """,
    """
    -<header><h1>@3</h1><p>@9</p></header>
    -<div class=notice>@17</div>
    +<article><header><h1>@6</h1></header>
    +<p>@48</p>
    +<pre>@15</pre>
    +<figure><figcaption>@8</figcaption></figure>
    -<div class=share><a href=x>@1</a> <a href=x>@1</a></div>
    +<table><tr><td>@2</td><td>@2</td></tr></table>
    +<p>@5</p>
    -<div class=newsletter>@22</div>
    -<footer>@6</footer></article>
    -<aside class=widget>@28</aside>
    """,
    """
    -<nav><a href=x>@1</a> <a href=x>@2</a></nav>
    +<div class="content-sidebar-wrap"><div class=content><h1>@6</h1>
    +<p>@45 <math><mi>@1</mi><mo>@1</mo></math> @12</p>
    +<p>@30 <svg width="9"/> @8</p>
    +<p><object data=x>@20</object></p>
    +<p>@7</p></div>
    -<div class=sidebar><p>@33</p>
    -<p>@11</p></div></div>
    -<footer>@9</footer>
    """,
    """
    -<div class=topbar>@4</div>
    -<div class="sidebar-wrapper"><div class=widget>@25</div>
    +<article><h1>@7</h1>
    +<p>@52</p>
    +<p>@4</p>
    +<p>@36</p></article>
    -<div class=comments><p>@40</p></div></div>
    """,
)
MAIN_MARK, OTHER_MARK = "\ue000", "\ue001"


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the frames, each drawn with several lengths of text."""
    rows, labels = [], []
    for frame in FRAMES:
        for scale in (0.5, 1.0, 1.7, 3.0, 6.0):
            page = []
            start = 0
            for line in frame.split("\n"):
                line = line.strip()
                mark = MAIN_MARK if line[:1] == "+" else OTHER_MARK

                def prose(found: re.Match, mark: str = mark) -> str:
                    n = max(1, round(int(found[1]) * scale))
                    return mark + " ".join(PROSE[(start + i) % len(PROSE)] for i in range(n))

                page.append(re.sub(r"@(\d+)", prose, line[1:]))
                start += 7
            found = blocks("<html><body>" + "".join(page) + "</body></html>")
            rows.append(features(found))
            labels += [MAIN_MARK in b.text for b in found]
    return np.vstack(rows), np.array(labels)


@cache
def trained() -> Node:
    return grow(*labelled_blocks())
