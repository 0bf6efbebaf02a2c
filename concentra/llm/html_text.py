"""Main text of HTML pages by tree scoring (op 4).

A page is read into a tree of elements (with the implied ends that browsers
assume, so unclosed paragraphs are no trouble). Subtrees that can't be part of
an article are left out: by element (scripts, styles, menus, footers, asides,
forms, ...), by what class, id and role say (adverts, notices, comments,
sidebars, ...), and hidden ones. A name alone does not drop an element with
more than half of the page's text outside links (comments apart), and if what
is kept is less than a tenth of that text, the page is scored again without the
names, those of comments last. Every paragraph gives points for its length
and its commas, all of them to its parent, half of them to the next ancestor
and less to those above. A container's points are discounted by the share of
its text that is within links. The best container is kept, with those of its
siblings that score well or read like text. If it lies in an article or main
element, the headings and the parts with few links beside it and beside its
ancestors, up to the outermost such element, are kept too; so are its own
siblings if none of them holds a link.

A block is a run of text between block-level boundaries; two line breaks in a
row end a block, one is white space. White space in a block becomes one blank.

Defined cases: a null or empty page, or one without text outside the parts
dropped by element or hidden, has the empty text; equal containers: the first of the page wins; text
that stands in no paragraph counts as one; repeated rows are answered each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import read_table, register

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button input select textarea option iframe object embed svg math canvas "
    "video audio dialog menu fieldset map".split()
)
#: start tag -> open elements that it ends, up to the nearest of the second set
_CLOSES = {
    **dict.fromkeys(_BLOCK - {"html", "body"}, ({"p"}, {"td", "th", "table", "button", "object"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: words that, first or last in a class, id or role, mark a part that is no article
_UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead footer comment comments commentlist disqus discussion reply replies respond related recommended recommendations share sharing social "
    "widget login signin signup register search pagination pager toolbar copyright legal disclaimer complementary contentinfo".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus discussion reply replies respond".split())
#: share of the page's text above which a name drops nothing, and share of it
#: that is too little to be the whole article
_MOST, _LITTLE = 0.5, 0.1
_KEEPS = frozenset("with has no without".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "points", "dropped", "named", "length", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list = []  # nodes and strings; None: a line break
        self.points = 0.0
        self.dropped = False
        self.named = ""  # what dropped it, if only a name did: "part" or "comments"
        self.length = self.linked = 0


def _unlikely(attributes: str) -> str:
    """"hidden", or what the first unlikely name stands for, or nothing."""
    found = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if name in ("class", "id", "role") and found != "comments":
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts and not _KEEPS.intersection(parts) and (parts[0] in _UNLIKELY or parts[-1] in _UNLIKELY):
                    found = "comments" if _COMMENTS.intersection((parts[0], parts[-1])) else found or "part"
    return found


def parse(html: str) -> Node:
    """The element tree of a page; parts that can't be article are marked."""
    root = Node("#root", None)
    here, at, size = root, 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None and tag not in ("html", "body"):
                here = node.parent
            continue
        ends, within = _CLOSES.get(tag, ((), ()))
        if ends:
            node, last = here, None
            while node is not None and node.tag not in within:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        if tag == "br":
            here.children.append(None)
            continue
        if tag in ("html", "body") and any(tag == n.tag for n in _up(here)):
            continue
        node = Node(tag, here)
        inside = any(n.tag in ("article", "main") for n in _up(here))
        node.dropped = tag in _DROPPED or tag == "header" and not inside
        if not node.dropped and attributes and tag not in ("html", "body", "article", "main"):
            why = _unlikely(attributes)
            node.dropped, node.named = bool(why), why if why != "hidden" else ""
        here.children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if end is None:
                break
            at = end.start()
            here = node
        elif tag not in _VOID and not attributes.endswith("/"):
            here = node
    return root


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _blocks(root: Node):
    """(owner, text, characters within links) of every block of the kept parts,
    in page order; the owner is the block-level element that holds it."""
    run: list[str] = []
    linked = breaks = 0
    # explicit stack: (node, next child, owner, within a link)
    stack = [(root, 0, root, False)]
    out = []

    def close(owner):
        nonlocal linked, breaks
        if run and (text := " ".join(unescape("".join(run)).split())):
            out.append((owner, text, min(linked, len(text))))
        run.clear()
        linked = breaks = 0

    while stack:
        node, i, owner, link = stack.pop()
        if i == 0 and node.tag in _BLOCK:
            close(stack[-1][2] if stack else root)
        if i == len(node.children):
            if node.tag in _BLOCK or node is root:
                close(owner)
            continue
        stack.append((node, i + 1, owner, link))
        child = node.children[i]
        if child is None:
            run.append(" ")
            breaks += 1
            if breaks > 1:
                close(owner)
        elif isinstance(child, str):
            run.append(child)
            if child.strip():
                breaks = 0
                linked += len(child.strip()) * link
        elif not child.dropped:
            header = child.tag == "header"
            stack.append((child, 0, child if child.tag in _BLOCK and not header else owner, link or child.tag == "a"))
    return out


_START = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 th".split())
#: share of linked text below which a part of an article is text
_LOW_LINK = 0.25


def _beside(node: Node) -> list[Node]:
    """The siblings that hold text of kept parts."""
    return [n for n in node.parent.children if isinstance(n, Node) and not n.dropped and n is not node and n.length] if node.parent is not None else []


def _plain(root: Node) -> tuple[int, list[tuple[Node, int]]]:
    """Characters outside links of the page, without what an element or hiding
    drops and without comments; and those of each part dropped by name."""
    named, total = [], 0
    stack = [(root, False, False)]  # (node, in a link or comments, left)
    open_at: list[tuple[Node, int]] = []
    while stack:
        node, aside, left = stack.pop()
        if left:
            if node.named:
                named.append((node, total - open_at.pop()[1]))
            continue
        if node.named:
            open_at.append((node, total))
        stack.append((node, aside, True))
        aside = aside or node.named == "comments" or node.tag == "a"
        for child in reversed(node.children):
            if isinstance(child, str):
                total += 0 if aside else len(" ".join(child.split()))
            elif child is not None and (not child.dropped or child.named):
                stack.append((child, aside, False))
    return total, named


def extract(html: str | None) -> list[str]:
    """Blocks of the page's main text, in page order."""
    if not html:
        return []
    root = parse(html)
    total, named = _plain(root)
    for node, size in named:
        if size > _MOST * total:
            node.dropped = False
    texts = _main(root)
    for kinds in (("part",), ("part", "comments")):
        if not any(n.dropped for n, _ in named) or texts and (sum(map(len, texts)) >= _LITTLE * total or "comments" in kinds):
            break
        root = parse(html)
        total, named = _plain(root)
        for node, _ in named:
            node.dropped = node.named not in kinds
        texts = _main(root)
    return texts


def _main(root: Node) -> list[str]:
    blocks = _blocks(root)
    seen: dict[int, Node] = {}
    for owner, text, linked in blocks:
        for node in _up(owner):
            node.length += len(text)
            node.linked += linked
        if owner.tag in _HEADINGS:
            continue
        points = (1 + text.count(",") + text.count("،") + text.count("，") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        parent = owner.parent if owner.tag in ("p", "li", "dd", "dt", "figcaption", "summary", "caption") and owner.parent is not None else owner
        for level, node in enumerate(_up(parent)):
            if id(node) not in seen:
                seen[id(node)] = node
                node.points = _START.get(node.tag, 0.0)
            node.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
    if not seen:
        return [text for _, text, _ in blocks] if any(o.tag in ("article", "main") for b, _, _ in blocks for o in _up(b)) else []
    score = {k: n.points * (1 - n.linked / n.length) for k, n in seen.items()}
    best = seen[max(score, key=score.get)]  # the first of equal ones: blocks come in page order
    while best.tag in ("tr", "td", "tbody", "li", "ul", "ol", "dl") and best.parent is not None and best.parent.tag != "#root":
        best = best.parent  # a part of a list or table stands for the whole
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, 0.2 * score.get(id(best), 0.0))
        for node in _beside(best):
            density = node.linked / node.length
            if score.get(id(node), 0.0) >= least or node.tag == "p" and (node.length > 80 and density < 0.25 or node.length <= 80 and not density):
                kept.add(id(node))
    path = [n for n in _up(best) if n.parent is not None]
    top = max((i for i, n in enumerate(path) if n.tag in ("article", "main")), default=0)
    for node in path[:top]:
        kept.update(id(n) for n in _beside(node) if n.tag in _HEADINGS or n.linked < _LOW_LINK * n.length)
    if not top and best.tag not in ("article", "main") and not any(n.linked for n in _beside(best)):
        kept.update(id(n) for n in _beside(best))
    around = {id(n) for n in path[1 : top + 1]}  # text that stands in these themselves
    return [
        text for owner, text, linked in blocks
        if id(owner) in around and linked < _LOW_LINK * len(text) or any(id(n) in kept for n in _up(owner))
    ]


def main_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with the blocks of the main text appended, joined by two line
    feeds; a column of that name gives way."""
    pages = pages.select(*[c for c in pages.columns if c != name])
    at, names = pages.columns.index(html), [*pages.columns, name]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = ["\n\n".join(extract(x.as_py())) for x in part.column(at)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names)

    return pages.mapInArrow(run, pages.withColumn(name, F.lit("")).schema)


@register("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    out = main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
