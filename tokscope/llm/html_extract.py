"""Main-text extraction from HTML by tree scoring.

A page becomes a tree. Paragraph-like elements pass points (for length and
commas, discounted by link density) to their parent, half of them to the
grandparent and less further up. The best container is widened to the
article element it lies in, and siblings that look like more of the text are
kept with it. Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are told by element, role, class or id and never count. Each
page is handled on its own inside a task; pages are not shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokscope.llm.common import python_tasks


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option xmp noembed noframes".split())
SKIPPED = RAW | frozenset("head nav aside form footer button input label fieldset dialog menu object canvas audio video map".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening element of these ends an open paragraph.
_ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SAME = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_PARAGRAPH = frozenset("p pre td blockquote li dd".split())

#: Words in class or id values. The first always exclude; the second do unless a word of the third stands beside them.
_NEVER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar nav navbar navigation menu submenu breadcrumb breadcrumbs footer comment comments commentlist disqus newsletter subscribe subscription signup "
    "social share sharing related popup modal overlay pagination pager login searchform paywall toolbar skip".split()
)
_RARELY = frozenset("header masthead topbar widget widgets search form tags tagcloud meta legal copyright disclaimer rail aside links recommended recommendations trending popular teaser alert reply respond hidden".split())
_GOOD = frozenset("article body content main entry post story text page column blog prose".split())
_LAYOUT = frozenset("no with has without".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
_WORDS = re.compile(r"[a-z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "text_len", "link_len", "commas")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score, self.text_len, self.link_len, self.commas = 0.0, 0, 0, 0


def parse(html: str) -> Node:
    """Tree of a page in linear time. Unclosed and stray tags are repaired, never an error."""
    root = Node("html", "", None)
    open_ = [root]
    # Places in ``open_`` by tag, and of all blocks; the root is in neither.
    places: defaultdict[str, list[int]] = defaultdict(list)
    block_places: list[int] = []
    # Raw elements for which no end tag follows any more.
    endless: set[str] = set()
    pos, n = 0, len(html)

    def text(part: str) -> None:
        if part:
            open_[-1].children.append(unescape(part) if "&" in part else part)

    def enter(node: Node) -> None:
        places[node.tag].append(len(open_))
        if node.tag in BLOCK:
            block_places.append(len(open_))
        open_.append(node)

    def last(tags: tuple[str, ...] | list[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(tags: tuple[str, ...] | list[str], barrier: frozenset | tuple | list) -> None:
        at = last(tags)
        reach = last(barrier) if barrier is not BLOCK else block_places[-1] if block_places else 0
        if not at or at < reach:
            return
        while len(open_) > at:
            tag = open_.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()

    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            text(html[pos:])
            break
        m = _TAG.match(html, at)
        if not m:
            # A lone "<" is text.
            text(html[pos : at + 1])
            pos = at + 1
            continue
        text(html[pos:at])
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                open_[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                open_[-1].children.append(Node("br", "", open_[-1]))
            elif tag not in ("html", "body"):
                # An inline end tag does not reach across a block.
                close((tag,), () if tag in BLOCK else BLOCK)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not places["body"]:
                close(("head",), ())
            else:
                continue
        if tag in _ENDS_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        if tag in _SAME:
            own, scope = _SAME[tag]
            if tag in ("tr", "td", "th"):
                for name in reversed(own.split()):
                    close((name,), scope.split())
            else:
                close(own.split(), scope.split())
        node = Node(tag, m[3], open_[-1])
        open_[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
            if end is None:
                endless.add(tag)
            if tag in ("svg", "math", "select", "option", "noscript", "template") and end is None:
                continue
            pos = end.end() if end else n
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            enter(node)
    return root


def excluded(node: Node, in_article: bool) -> bool:
    """Whether an element is furniture: by its name, role, visibility, class or id. Headers of an article are not."""
    tag = node.tag
    if tag in SKIPPED:
        return True
    if tag == "header":
        return not in_article
    if not node.attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c, flag in _ATTR.findall(node.attrs):
        name, value = (name or flag).lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = _WORDS.findall(token)
                if any(w in _NEVER and not (i and words[i - 1] in _LAYOUT) for i, w in enumerate(words)):
                    return True
                if any(w in _RARELY for w in words) and not any(w in _GOOD for w in words):
                    return True
    return False


def _prune(root: Node) -> None:
    """Drop furniture and add up text, link lengths and commas bottom up (without recursion)."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not excluded(c, inside)]
        order.append(node)
        stack.extend((c, inside) for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.text_len += len(c.strip())
                node.commas += c.count(",") + c.count("،") + c.count("、") + c.count("，")
            else:
                node.text_len += c.text_len
                node.commas += c.commas
                node.link_len += c.text_len if c.tag == "a" else c.link_len


def _density(node: Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def _named_good(node: Node) -> bool:
    return any(w in _GOOD for name, a, b, c, _ in _ATTR.findall(node.attrs or "") if name.lower() in ("class", "id") for w in _WORDS.findall((a or b or c).lower()))


def best_container(root: Node) -> tuple[Node, list[Node]]:
    """The element holding the text, and the siblings kept with it (itself included), in page order."""
    scored: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        inner = [c for c in node.children if not isinstance(c, str)]
        stack.extend(inner)
        plain = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in node.children)
        if not (node.tag in _PARAGRAPH or plain) or not node.text_len:
            continue
        points = (1 + node.commas + min(node.text_len / 100, 3.0)) * (1 - _density(node))
        target, share, level = (node, 1.0, 0) if plain else (node.parent, 1.0, 0)
        while target is not None and level < 6:
            if not target.score:
                target.score = 1e-9 + (25.0 if target.tag in ("article", "main") else 10.0 if _named_good(target) else 0.0)
                scored.append(target)
            target.score += points * share
            target, level = target.parent, level + 1
            share = 0.5 if level == 1 else 1 / (3.0 * level)
    if not scored:
        return root, [root]
    best = max(scored, key=lambda x: x.score * (1 - _density(x)))
    # More of the same text stands in the article element (or the like) around it.
    node, wide = best, best
    while node is not None and node.tag not in ("body", "html"):
        if node.tag in ("article", "main") or _named_good(node):
            wide = node
        node = node.parent
    best = wide
    if best.parent is None or best.tag in ("body", "html", "article", "main"):
        return best, [best]
    least = max(5.0, 0.2 * best.score)
    kept = []
    for s in best.parent.children:
        if isinstance(s, str):
            continue
        density = _density(s)
        if s is best or s.score * (1 - density) >= least or (s.tag in ("p", "pre", "blockquote", "h1", "h2") and s.text_len and density < 0.25):
            kept.append(s)
    return best, kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order, white space turned into single spaces."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        if line:
            out.append(line)
        held.clear()

    stack: list[tuple[Node | str | None, bool]] = [(x, False) for x in reversed(nodes)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            held.append(item)
        elif done:
            flush()
        elif item.tag == "br":
            held.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
                stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """Main text of a page, '' if there is none."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    return "\n".join(blocks(best_container(root)[1]))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``.

    Other columns are ignored. Edge cases: a null or empty page, or one
    without text, gives ''. Broken markup is repaired. Text without any markup
    is the main text. Very long pages take time in proportion to their length, also malformed ones. Repeated rows are extracted each. ``n_chars`` counts code points.
    """
    python_tasks(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
