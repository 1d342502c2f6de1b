"""Main text of web pages by tag-path ratios.

A page is read as text nodes, each under its root-to-leaf tag path. Per path the text length, the number of nodes and the
punctuation are summed. The two ratios, of length and of punctuation to nodes, are smoothed over the paths in page order and fused
by multiplication; paths above ``SHARE`` of the mean score (by text) are content paths. Elements named as page
furniture, by tag or by class, id or role, only lower the score of the paths through them, by ``PENALTY`` each: where all stands in
a form or under ``class="sidebar-right"``, nothing changes.

The lowest element that holds all content paths, and isn't itself a part of a text such as a paragraph or list, is the
container; from there an ``article`` or ``main`` around it is taken if at least half of its text lies in it. All text nodes of
the container belong to the text, short headings and list items too, but those under furniture inside it whose own path isn't a
content path; so do headings of the first two levels that stand right beside the container, before it.

A block ends at a block element. Character references are decoded, white space inside a block becomes one space, empty
blocks vanish, and blocks are joined by a newline. Markup may be cut off or badly nested: a closing tag closes up to its
nearest open partner and is otherwise ignored, and an unclosed reference stays as HTML reads it.

Defined cases: a null or empty page, or one of blanks or scripts alone, has the empty text; repeated rows get equal
results; an empty table gives no rows; other columns are left out, whatever their names; pages of any length and
depth are read whole, in time that grows with their length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import struct_udf

SCHEMA = "text string, n_chars long, n_blocks long"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE_TAGS = frozenset("nav footer aside form header menu dialog button input label fieldset head".split())
#: Whole names (or their first part, as in ``comment-list``) in class, id or role that lower the score of what is below.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar "
    "navigation newsletter notice pagination pager popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget widgets".split()
)
_LAST = frozenset("content price prices state story stories text title view views".split())
_CONTENT = frozenset(("article", "main"))
#: Elements that are parts of a text and so no container of an article.
_PARTS = frozenset("p li ul ol dl dt dd td th tr tbody thead tfoot table pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 hgroup".split())
#: Factor on the score of a path for each element of furniture on it, and share of the mean score that makes content.
PENALTY, SHARE = 0.1, 0.5
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
#: An unclosed element of these ends where another one of its kind begins.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())


def _is_furniture(tag: str, attributes: str, in_content: bool) -> bool:
    """Named as page furniture. A header or label inside the article holds its title, so these tags count only outside."""
    if tag in _FURNITURE_TAGS and not (in_content and tag in ("header", "label")):
        return True
    for a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            first, _, rest = name.replace("_", "-").partition("-")
            if first in _FURNITURE and rest.rpartition("-")[2] not in _LAST:
                return True
    return False


class _Page:
    """Text nodes and elements of a page. Elements are numbered in page order, so that a parent comes before its children."""

    def __init__(self, page: str):
        #: Per element (0 is the page): parent, tag, furniture and hidden flag, number of its tag path.
        self.parent, self.tag, self.furniture, self.hidden, self.path = [0], [""], [False], [False], [0]
        #: Text nodes: element, block, text.
        self.nodes: list[tuple[int, int, str]] = []
        paths: dict[tuple[int, str], int] = {}
        content, stack, opened, block = [False], [0], defaultdict(int), 0
        for m in _TOKEN.finditer(page):
            raw, closing, tag, attributes, text = m.groups()
            if text is not None:
                self.nodes.append((stack[-1], block, text))
            elif raw is None and tag:
                tag = tag.lower()
                block += tag in _BLOCK
                if closing:
                    if opened[tag]:
                        self._close(tag, stack, opened)
                elif tag not in _VOID and not attributes.endswith("/"):
                    if tag in _SELF_CLOSING and any(self.tag[e] == tag for e in stack[-3:]):
                        self._close(tag, stack, opened)
                    e, up = len(self.parent), stack[-1]
                    self.parent.append(up)
                    self.tag.append(tag)
                    self.furniture.append(_is_furniture(tag, attributes, content[up]))
                    self.hidden.append(self.hidden[up] or bool(attributes and _HIDDEN.search(attributes)))
                    content.append(content[up] or tag in _CONTENT)
                    # Furniture is a step of its own, else its text would count with that of equal tags.
                    step = (self.path[up], f"{tag}!" if self.furniture[e] else tag)
                    self.path.append(paths.setdefault(step, len(paths) + 1))
                    stack.append(e)
                    opened[tag] += 1

    def _close(self, tag: str, stack: list[int], opened: dict[str, int]) -> None:
        while True:
            gone = self.tag[stack.pop()]
            opened[gone] -= 1
            if gone == tag:
                return

    def below(self, flags: list[bool], root: int = 0) -> list[int]:
        """Per element how many flags stand on its way up to, and without, ``root``."""
        out = [0] * len(flags)
        for e in range(1, len(flags)):
            out[e] = 0 if e == root else out[self.parent[e]] + flags[e]
        return out


def content_paths(page: _Page) -> set[int]:
    """Numbers of the tag paths whose smoothed and fused score is over the threshold."""
    depth = page.below(page.furniture)
    length, marks, number, factor = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for e, _, text in page.nodes:
        if not text.isspace() and not page.hidden[e]:
            k = page.path[e]
            length[k] += len(text)
            marks[k] += len(_PUNCTUATION.findall(text))
            number[k] += 1
            factor[k] = PENALTY ** min(depth[e], 8)
    keys = list(length)

    def smooth(x: list[float]) -> list[float]:
        return [sum(w * x[j] for j, w in ((i - 1, 1), (i, 2), (i + 1, 1)) if 0 <= j < len(x)) / 4 for i in range(len(x))]

    texts = smooth([factor[k] * length[k] / number[k] for k in keys])
    points = smooth([factor[k] * (1 + marks[k]) / number[k] for k in keys])
    fused = [factor[k] * t * q for k, t, q in zip(keys, texts, points, strict=True)]
    # The mean weighs each path by its text, so that many short paths don't lower it, and long furniture doesn't either.
    mean = sum(f * length[k] * factor[k] for k, f in zip(keys, fused, strict=True)) / max(1e-9, sum(length[k] * factor[k] for k in keys))
    return {k for k, f in zip(keys, fused, strict=True) if f >= SHARE * mean}


def _container(page: _Page, chosen: set[int]) -> int:
    """The lowest element that holds all text of the chosen paths and isn't a part of a text; 0 stands for the page."""
    size = len(page.parent)
    weight, plain = [0] * size, [0] * size
    furniture = page.below(page.furniture)
    for e, _, text in page.nodes:
        if not text.isspace() and not page.hidden[e]:
            weight[e] += len(text) * (page.path[e] in chosen)
            plain[e] += len(text)
    for e in range(size - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
        plain[page.parent[e]] += plain[e] * (furniture[e] <= furniture[page.parent[e]])
    root = max((e for e in range(size) if weight[e] == weight[0] and weight[0]), default=0)
    while root and (page.tag[root] in _PARTS or page.tag[root] not in _BLOCK):
        root = page.parent[root]
    # A title often stands beside the text in its article: that is taken where most of it is the text.
    e = page.parent[root]
    while e:
        if page.tag[e] in _CONTENT and 2 * plain[root] >= plain[e]:
            root = e
        e = page.parent[e]
    return root


def extract(html_text: str) -> tuple:
    """The row of ``SCHEMA`` for one page."""
    page = _Page(html_text)
    chosen = content_paths(page)
    root = _container(page, chosen)
    furniture = page.below(page.furniture, root)
    inside = [root == 0] * len(page.parent)
    for e in range(1, len(inside)):
        inside[e] = e == root or inside[page.parent[e]] or e < root and page.parent[e] == page.parent[root] and page.tag[e] in ("h1", "h2")
    blocks: list[str] = []
    at, parts = -1, []
    for e, block, text in page.nodes:
        if not inside[e] or page.hidden[e] or furniture[e] and page.path[e] not in chosen:
            continue
        if block != at:
            blocks.append("".join(parts))
            at, parts = block, []
        parts.append(text)
    blocks.append("".join(parts))
    lines = [" ".join(html.unescape(b).split()) for b in blocks]
    text = "\n".join(line for line in lines if line)
    return text, len(text), sum(map(bool, lines))


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` of every page."""
    run = struct_udf(pages.sparkSession, extract, SCHEMA)
    out = pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("__html"))
    return out.withColumn("__t", run("__html")).select("page_id", "url", "__t.*")
