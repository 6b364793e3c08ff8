"""HTML to nodes: a forgiving reader and the features of each node.

The reader knows the usual rules of open ends (paragraphs, items, cells, raw text, void elements) and never fails; its
work is linear in the page. Elements deeper than 500 become siblings at that depth. Nodes are block elements, elements
with attributes that name them, and runs of text; other inline elements belong to the node around them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

DEEPEST = 500

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is never text of the page.
UNSEEN = frozenset("head script style template title textarea xmp iframe noembed noframes noscript object svg select datalist button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing "
    "main menu nav ol option p plaintext pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li option tbody tfoot thead tr".split())
#: What an element ends where it opens, and where the search for it stops.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "tr": ("tr td th caption", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "tbody": ("tr td th tbody thead tfoot caption", "table"), "thead": ("tr td th tbody thead tfoot caption", "table"), "tfoot": ("tr td th tbody thead tfoot caption", "table"),
}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPES = frozenset("table td th caption template object html".split())
TABLES = frozenset("table tr td th tbody thead tfoot caption".split())

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?+|[!?/][^>]*+>?+)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAMING = frozenset("class id role itemprop aria-label".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}

#: Counts of a node's own text and elements, summed up over what is below it.
COUNTS = "chars words commas stops digits capitals link_chars tags paragraphs paragraph_chars links items fields breaks headings media".split()
_C = {name: i for i, name in enumerate(COUNTS)}
MEDIA, FIELDS, HEADINGS = frozenset("img figure video audio picture".split()), frozenset("input select textarea button label".split()), frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Nodes:
    """Nodes of a batch of pages in page order; parent -1 for a page's root."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)
    #: Text in page order: (node, block, text).
    texts: list[tuple[int, int, str]] = field(default_factory=list)

    def new(self, page: int, parent: int, tag: str, tokens: tuple[str, ...]) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.counts.append([0] * len(COUNTS))
        return len(self.page) - 1


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of the attributes that name an element, and `hidden` for one that isn't shown."""
    out = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in _NAMING:
            out.update(t.lower() for t in _TOKEN.findall(value)[:50])
        elif name == "style" and "none" in value.replace(" ", "").lower().partition("display:")[2][:4]:
            out.add("hidden")
    if re.search(r"\bhidden\b(?!\s*=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        out.add("hidden")
    return tuple(sorted(out))


def read(page: int, source: str, nodes: Nodes) -> None:
    """Add a page's nodes."""
    root = nodes.new(page, -1, "#page", ())
    # Open elements: tag, node they belong to, whether unseen, whether in a link or a paragraph.
    stack: list[tuple[str, int, bool, bool, bool]] = [("#page", root, False, False, False)]
    opened: dict[str, int] = {}
    block, run, at, end = 0, -1, 0, len(source)

    def pop(to: int) -> None:
        nonlocal block, run
        while len(stack) > to:
            tag, node, *_ = stack.pop()
            opened[tag] -= 1
            if tag in BLOCKS:
                block += 1
            if node != stack[-1][1]:
                run = -1

    def find(tags: frozenset[str], stops: frozenset[str]) -> int:
        """Place of the innermost open element of these, -1 if there is none before a stop."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stops:
                return -1
        return -1

    def text(raw: str) -> None:
        nonlocal run
        _, node, unseen, link, paragraph = stack[-1]
        if unseen or not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        if run < 0:
            if value.isspace():
                return
            run = nodes.new(page, node, "#text", ())
        nodes.texts.append((run, block, value))
        size, c = len(value) - value.count(" "), nodes.counts[run]
        c[0] += size
        c[1] += value.count(" ") + 1
        c[2] += value.count(",")
        c[3] += value.count(".") + value.count("!") + value.count("?")
        if size < 200:
            c[4] += sum(map(str.isdigit, value))
            c[5] += sum(map(str.isupper, value))
        if link:
            c[6] += size
        if paragraph:
            c[9] += size

    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("body", "html") or not opened.get(tag):
                continue
            k = find(frozenset((tag,)), SCOPES if tag not in TABLES else frozenset(("table",)) - {tag})
            if k < 0:
                continue
            if tag not in BLOCKS and any(s[0] in BLOCKS for s in stack[k + 1 :]):
                continue  # an inline end inside a block that began later leaves the block open
            pop(k)
            continue
        if opened.get("head") and (tag in ("html", "body") or tag in BLOCKS):
            pop(find(frozenset(("head",)), frozenset()))
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and opened.get("p") and (k := find(frozenset(("p",)), SCOPES)) > 0:
            pop(k)
        if tag in _ENDS:
            tags, stops = _ENDS[tag]
            while any(map(opened.get, tags)) and (k := find(tags, stops)) > 0:
                pop(k)
        _, node, unseen, link, paragraph = stack[-1]
        c = nodes.counts[node]
        c[7] += 1
        c[8] += tag == "p"
        c[10] += tag == "a"
        c[11] += tag == "li"
        c[12] += tag in FIELDS
        c[13] += tag == "br"
        c[14] += tag in HEADINGS
        c[15] += tag in MEDIA
        if tag == "br" and run >= 0:
            text(" ")
        if tag in VOID:
            if tag == "hr":
                block, run = block + 1, -1
            continue
        if tag in RAW:
            closing = _RAW_END[tag].search(source, at)
            at = closing.start() if closing else end
            if closing:
                at = (source.find(">", closing.end()) + 1) or end
            continue
        if len(stack) > DEEPEST:
            block += tag in BLOCKS
            continue
        attributes = m[3]
        tokens = attribute_tokens(attributes) if "=" in attributes or "hidden" in attributes else ()
        if tag in BLOCKS:
            block += 1
        if (tag in BLOCKS or tag in ("td", "th") or tokens) and not unseen:
            node, run = nodes.new(page, node, tag, tokens), -1
            if tag in ("td", "th"):
                nodes.texts.append((node, block, " "))  # cells of a row are one block
        stack.append((tag, node, unseen or tag in UNSEEN, link or tag == "a", paragraph or tag == "p"))
        opened[tag] = opened.get(tag, 0) + 1


def assemble(nodes: Nodes, kept: np.ndarray, pages: int) -> list[str]:
    """Each page's text: kept runs of a block joined, white space made single, blocks apart by an empty line."""
    out: list[list[str]] = [[] for _ in range(pages)]
    last = (-1, -1)
    for node, block, value in nodes.texts:
        if kept[node]:
            page = nodes.page[node]
            if (page, block) == last:
                out[page][-1] += value
            else:
                out[page].append(value)
                last = (page, block)
    return ["\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b) for blocks in out]


class Tree:
    """Sums, paths and sibling places over the nodes of a batch, level by level."""

    def __init__(self, nodes: Nodes):
        self.parent, self.depth, self.page = (np.array(x, np.int64) for x in (nodes.parent, nodes.depth, nodes.page))
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it."""
        out = values.astype(float)
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray, pick) -> np.ndarray:
        """pick (np.minimum or np.maximum) over each node and all above it."""
        out = values.copy()
        for level in self.levels[1:]:
            out[level] = pick(out[level], out[self.parent[level]])
        return out

    def siblings(self, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number among siblings, how many there are, and sizes of the one before and after."""
        order = np.argsort(self.parent, kind="stable")
        p = self.parent[order]
        first = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.empty(0, bool)
        group = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        n = np.diff(np.append(begin, len(p)))
        index, count, before, after = (np.zeros(len(p)) for _ in range(4))
        index[order], count[order] = np.arange(len(p)) - begin[group], n[group]
        s = size[order]
        b, a = np.concatenate([[0], s[:-1]]), np.concatenate([s[1:], [0]])
        b[first] = 0
        a[np.concatenate([first[1:], [True]])] = 0
        before[order], after[order] = b, a
        roots = self.parent < 0
        index[roots], count[roots], before[roots], after[roots] = 0, 1, 0, 0
        return index, count, before, after

    def decode(self, logits: np.ndarray) -> np.ndarray:
        """The likeliest labels in which no node is kept below a dropped one."""
        gain = logits.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(gain, self.parent[level], np.maximum(gain[level], 0))
        kept = gain > 0
        for level in self.levels[1:]:
            kept[level] &= kept[self.parent[level]]
        return kept


def features(nodes: Nodes, tree: Tree, tags: dict[str, float], tokens: dict[str, float]) -> np.ndarray:
    """A row of numbers for each node: of its subtree, its names, its place, its parent and its neighbours."""
    own = np.array(nodes.counts, float).reshape(-1, len(COUNTS))
    total = tree.up(own)
    col = lambda name, t=total: t[:, _C[name]]
    above = np.where(tree.parent >= 0, tree.parent, np.arange(len(own)))
    chars, words = col("chars"), col("words")
    tag = np.array([tags.get(t, 0.0) for t in nodes.tag])
    named = [[tokens[x] for x in t if x in tokens] for t in nodes.tokens]
    low, high = np.array([min(s, default=0.0) for s in named]), np.array([max(s, default=0.0) for s in named])
    index, count, before, after = tree.siblings(chars)
    roots = np.flatnonzero(tree.parent < 0)
    whole = chars[roots][np.searchsorted(roots, np.arange(len(own)), "right") - 1] if len(roots) else chars
    level = np.arange(len(own))
    seen = np.concatenate([[0], np.cumsum(own[:, 0])])[level]
    start = seen - seen[roots][np.searchsorted(roots, level, "right") - 1] if len(roots) else seen
    ratio = lambda a, b: a / np.maximum(b, 1)
    own_features = [
        np.log1p(chars), np.log1p(words), ratio(chars, col("tags") + 1), ratio(col("link_chars"), chars), ratio(col("paragraph_chars"), chars), np.log1p(col("paragraphs")),
        ratio(col("commas"), words), ratio(col("stops"), words), ratio(chars, words), ratio(col("digits"), np.minimum(chars, 200)), ratio(col("capitals"), np.minimum(words, 50)),
        ratio(col("links"), words), ratio(col("items"), words), np.log1p(col("fields")), np.log1p(col("headings")), np.log1p(col("media")), ratio(chars, whole),
    ]
    path = [tag, low, high, tree.down(tag, np.minimum), tree.down(low, np.minimum), tree.down(high, np.maximum), tree.down(tag, np.maximum)]
    place = [tree.depth.astype(float), index, count, ratio(index, count), np.log1p(before), np.log1p(after), ratio(start, whole), ratio(chars, chars[above])]
    parent = [own_features[k][above] for k in (0, 2, 3, 4, 5, 7)] + [p[above] for p in path[:3]]
    return np.stack(own_features + path + place + parent, 1) if len(own) else np.zeros((0, 1))
