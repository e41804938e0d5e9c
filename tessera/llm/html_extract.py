"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its root-to-leaf path of tags and classes. For each
path, text outside links and punctuation are summed and divided by the path's blocks; both ratios are smoothed along the page,
fused into one score, and weighed by how much of the page's text the path holds.

What elements say of themselves enters in three ways. By tag, role or hiding (menus, footers, ...) a path scores 0, and by words for what
readers or the site add (comments, side bars, cookie notices, ...) next to nothing. Words that often mean an advert or a notice are only
a doubt: such a path needs as good a ratio as the best other one, and where there is too little text (EVIDENCE) for ratios to tell, the word
decides. Declared content scores somewhat more. A word on the frame around everything says nothing: marks on an element that holds FRAME
of all text are void.

Paths with a share THRESHOLD of the best score are chosen, and all their blocks stay, wherever they stand. The content node is the deepest
element that holds HOLDS of their text (of a paragraph, cell or item: what is around it), or the article or main element around it.
It adds the blocks in it of paths with a share LOW of the best, unless it is the body. Headings in front of a block that stays stay.

Character references are decoded, white space in a block becomes one space, blocks are joined in page order by an empty line.
Null or empty html, and pages without text: empty string. Null page_id or url stay null; repeated rows each get a row; extra
columns are ignored. Unclosed tags, comments, quotes and raw elements run to where the next tag or the page ends. Time and memory are
linear in the page, however deep or broken: open elements are kept in a stack for each tag name, paths as numbers.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?])")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none")
PLAIN = re.compile(r"""[^>"']*+""")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
#: Elements that an open paragraph or an open list item, cell or row does not reach out of.
SCOPE = frozenset("ul ol dl table article section div main aside body html td th".split())
WALLS = frozenset("ul ol dl table body article div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content post entry story main body".split())
BOILERPLATE = frozenset("nav footer aside button select option datalist dialog menu svg canvas object head".split())
BOILERPLATE_WORDS = frozenset(
    "cookie cookies consent gdpr popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus reply"
    " replies respond related recommended share sharing social newsletter subscribe subscription signup login widget pagination pager search skip".split()
)
DOUBTFUL_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices alert".split())
#: Before such a word a class word names what is missing or around, as in "no-sidebar".
MODIFIERS = frozenset("no not has with without is hide".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())

#: Elements that are part of a text, not around one.
PARTS = frozenset("p li ul ol dl dt dd td th tr tbody thead table blockquote pre figure figcaption address h1 h2 h3 h4 h5 h6".split())
FRAMES = frozenset("# html body".split())

#: Shares of the best path's score: to be chosen, and to stay inside the content node. Share of the chosen text in the content node.
THRESHOLD, LOW, HOLDS = 0.2, 0.06, 0.9
#: Text that a path without a mark must have for ratios to overrule a doubt.
EVIDENCE = 500
#: Power of a path's text, as a share of the largest path's, in its score.
WEIGHT = 0.125
#: Factors of a path's score.
SOFT, DECLARED, DECLARED_WORD = 0.02, 1.5, 1.2
#: A mark on an element with this share of all text, and as many characters outside links, is void.
FRAME, FRAME_TEXT = 0.95, 250
#: Weights of a block's neighbours in smoothing, nearest first.
KERNEL = (1.0, 0.6, 0.15)


class Node:
    """An element. hard: menu, footer, ... by tag, role or hiding, or inside one; soft: so by its own class words, or a form; doubt: an advert
    or a notice by its own class words."""

    __slots__ = ("block", "content", "depth", "doubt", "hard", "heading", "link", "number", "parent", "paragraph", "path", "soft", "tag", "wall", "word")

    def __init__(self, tag: str, parent: Node | None, number: int, path: int, hard: bool = False, soft: bool = False, word: bool = False, doubt: bool = False):
        inline = tag in INLINE
        self.tag, self.parent, self.number, self.path, self.soft, self.word, self.doubt = tag, parent, number, path, soft, word, doubt
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.heading = tag in HEADINGS or (parent is not None and parent.heading)
        self.hard = hard or (parent is not None and parent.hard)
        self.content = tag in CONTENT or (parent is not None and parent.content)
        # nearest element, itself included: block-level, paragraph or scope, wall
        self.block = parent.block if inline and parent else self
        self.paragraph = self if tag == "p" or tag in SCOPE or parent is None else parent.paragraph
        self.wall = self if tag in WALLS or parent is None else parent.wall


class Page:
    """Blocks of a page, (text, node, characters inside links), and all its elements in page order."""

    def __init__(self, page: str):
        self.root = Node("#", None, 0, 0)
        self.nodes, self.blocks = [self.root], []
        self.paths: dict[tuple[int, str], int] = {}
        self.open: dict[str, list[Node]] = {}
        self._node, self._parts, self._linked = self.root, [], 0
        self._read(page)

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            self.blocks.append((text, self._node.block, min(self._linked, len(text))))
        self._parts, self._linked = [], 0

    def _add(self, text: str) -> None:
        if text and not self._node.hard:
            text = entities.unescape(text)
            self._parts.append(text)
            if self._node.link:
                self._linked += len(text.strip())

    def _leave(self, to: Node) -> None:
        """Closes the open elements down to `to`, which stays open."""
        while self._node is not to:
            self.open[self._node.tag].pop()
            self._node = self._node.parent

    def _enter(self, tag: str, rest: str) -> None:
        words: set[str] = set()
        marks: set[str] = set()
        parent = self._node
        hard = tag in BOILERPLATE or (tag == "header" and not parent.content)
        if len(rest) > 1:
            for name, a, b, c in ATTRIBUTE.findall(rest):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id"):
                    for token in value.split():
                        found = WORD.findall(token)
                        words.update(found)
                        if found and found[0] not in MODIFIERS:
                            marks.update(found[:1] if tag in CONTENT else found)
                elif name == "role":
                    hard |= value in ROLES
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
                    hard = True
        plain = tag not in ("body", "html")
        soft = tag == "form" or (plain and bool(marks & BOILERPLATE_WORDS))
        path = parent.path
        if tag not in INLINE:
            path = self.paths.setdefault((path, tag + "".join("." + w for w in sorted(words))), len(self.paths) + 1)
        node = Node(tag, parent, len(self.nodes), path, hard, soft, plain and bool(words & CONTENT_WORDS), plain and bool(marks & DOUBTFUL_WORDS))
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(node)
        self._node = node

    def _nearest(self, tags: set[str]) -> Node | None:
        return max((s[-1] for t in tags if (s := self.open.get(t))), key=lambda n: n.depth, default=None)

    def _close(self, tag: str) -> None:
        if not (stack := self.open.get(tag)):
            return
        if tag in INLINE and stack[-1].depth < self._node.block.depth:
            return  # opened outside of the block
        self._leave(stack[-1].parent)

    def _make_room(self, tag: str) -> None:
        """Closes what a block-level tag ends: an open paragraph, list item, row or cell."""
        p = self._node.paragraph
        if p.tag == "p":
            self._leave(p.parent)
        if ends := CLOSED_BY.get(tag):
            n = self._nearest(ends)
            if n is not None and n.depth > self._node.wall.depth:
                while n.parent is not None and n.parent.tag in ends:
                    n = n.parent
                self._leave(n.parent)
        if tag == "body" and (head := self.open.get("head")):
            self._leave(head[-1].parent)

    def _read(self, page: str) -> None:
        last = {c: page.rfind(c) for c in ">\"'"}
        plain_until = 0  # quotes don't count up to here: one is never closed

        def tag_end(at: int) -> int:
            """Where the tag ends whose name ends at `at`, after its >; a > in closed quotes is not the end."""
            nonlocal plain_until
            i = at
            while at >= plain_until:
                i = PLAIN.match(page, i).end()
                if i >= len(page) or i > last[">"]:
                    break
                if page[i] == ">":
                    return i + 1
                if i >= last[page[i]]:
                    plain_until = i + 1
                    break
                i = page.index(page[i], i + 1) + 1
            return page.index(">", at) + 1

        at, lower = 0, None
        while (m := TAG.search(page, at)) and (m[3] or m.end() <= last[">"]):
            self._add(page[at : m.start()])
            if m[3]:
                end = page.find("-->", m.end())
                at = len(page) if end < 0 else end + 3
                continue
            if m[2] is None:
                at = page.index(">", m.end()) + 1
                continue
            at = tag_end(m.end())
            tag, rest = m[2].lower(), page[m.end() : at]
            if tag == "br" or tag == "wbr":
                self._parts.append(" " if tag == "br" else "")
                continue
            if tag not in INLINE:
                self._flush()
            if m[1]:
                self._close(tag)
                continue
            if tag in RAW:
                if lower is None:
                    lower = page.lower()
                    if len(lower) != len(page):  # a character whose lower case is longer
                        lower = "".join(c.lower() if c < "\x80" else c for c in page)
                end = lower.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
                continue
            if tag in VOID or rest.endswith("/>") and tag not in INLINE and tag not in SCOPE and tag != "p":
                continue
            if tag not in INLINE:
                self._make_room(tag)
            self._enter(tag, rest)
        tail = page[at:]
        cut_at = UNFINISHED.search(tail)
        self._add(tail[: cut_at.start()] if cut_at else tail)
        self._flush()


def path_scores(found: list[tuple[str, Node, int]]) -> dict[int, float]:
    """Fused ratio of each path, by what its blocks hold alone, weighed by its text."""
    sums: dict[int, list[float]] = {}
    for text, node, linked in found:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text) - linked
        s[2] += len(PUNCTUATION.findall(text)) * (1 - linked / len(text))
        s[3] += len(text)
    text_ratio = [sums[n.path][1] / sums[n.path][0] for _, n, _ in found]
    mark_ratio = [sums[n.path][2] / sums[n.path][0] for _, n, _ in found]

    def smooth(x: list[float]) -> list[float]:
        out = []
        for i in range(len(x)):
            near = [(KERNEL[abs(j - i)], x[j]) for j in range(max(0, i - len(KERNEL) + 1), min(len(x), i + len(KERNEL)))]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused: dict[int, list[float]] = {}
    for (_, node, _), t, p in zip(found, smooth(text_ratio), smooth(mark_ratio), strict=True):
        fused.setdefault(node.path, []).append(math.log1p(t) * math.sqrt(1 + p))
    most = max(s[1] for s in sums.values()) or 1
    return {path: sum(v) / len(v) * math.sqrt(sums[path][1] / sums[path][3]) * (sums[path][1] / most) ** WEIGHT for path, v in fused.items()}


def _sum_up(nodes: list[Node], own: dict[int, int]) -> list[int]:
    """Characters in each element, of those its blocks hold themselves; elements come after their parents."""
    held = [own.get(n.number, 0) for n in nodes]
    for n in reversed(nodes[1:]):
        held[n.parent.number] += held[n.number]
    return held


def factors(nodes: list[Node], held: list[int]) -> tuple[list[float], list[bool], list[bool]]:
    """Each element's factor, whether it lies in declared content, and whether in doubt; held: text outside links in each."""
    total = held[0]
    out, declared = [1.0] * len(nodes), [False] * len(nodes)
    marked, doubtful = [False] * len(nodes), [False] * len(nodes)
    for n in nodes[1:]:
        up = n.parent.number
        void = held[n.number] >= FRAME * total and held[n.number] >= FRAME_TEXT
        marked[n.number] = marked[up] or (n.soft and not void)
        doubtful[n.number] = doubtful[up] or (n.doubt and not void)
        declared[n.number] = declared[up] or n.tag in CONTENT or n.word
        out[n.number] = 0.0 if n.hard else (SOFT if marked[n.number] else 1.0) * (DECLARED if n.content else DECLARED_WORD if declared[n.number] else 1.0)
    return out, declared, doubtful


def scores(found: list[tuple[str, Node, int]], factor: list[float], doubtful: list[bool]) -> list[float]:
    """Each block's score: its path's ratio by what its elements say; what is in doubt must stand against the best of the others."""
    ratio = path_scores(found)
    text: dict[int, int] = {}
    for t, node, linked in found:
        if factor[node.number] >= 1 and not doubtful[node.number]:
            text[node.path] = text.get(node.path, 0) + len(t) - linked
    best = max(text, key=lambda p: ratio[p], default=None)
    tells = best is not None and max(text.values()) >= EVIDENCE
    out = []
    for _, node, _ in found:
        low = doubtful[node.number] and not (tells and ratio[node.path] >= ratio[best])
        out.append(ratio[node.path] * factor[node.number] * (SOFT if low else 1.0))
    return out


def content_node(found: list[tuple[str, Node, int]], chosen: list[bool], nodes: list[Node]) -> Node:
    """The deepest element around most of the chosen text, and what is around it where it is part of a text or in an article."""
    own: dict[int, int] = {}
    for (text, node, linked), yes in zip(found, chosen, strict=True):
        if yes:
            own[node.number] = own.get(node.number, 0) + len(text) - linked
    held = _sum_up(nodes, own)
    holder = max((n for n in nodes if held[n.number] >= HOLDS * held[0]), key=lambda n: n.depth)
    if holder.content:
        while holder.tag not in CONTENT:
            holder = holder.parent
    while holder.tag in PARTS or holder.tag in INLINE:
        holder = holder.parent
    return holder


def extract(page: str | None) -> str:
    """Main text of one page."""
    read = Page(page or "")
    found, nodes = [b for b in read.blocks if not b[1].hard], read.nodes
    if not found:
        return ""
    own: dict[int, int] = {}
    for text, node, linked in found:
        own[node.number] = own.get(node.number, 0) + len(text) - linked
    factor, declared, doubtful = factors(nodes, _sum_up(nodes, own))
    score = scores(found, factor, doubtful)
    best = max(score)
    fine = [factor[node.number] >= 1 and not doubtful[node.number] for _, node, _ in found]
    if best <= 0 or not any(yes and s > 0 for yes, s in zip(fine, score, strict=True)):
        return ""
    chosen = [s >= THRESHOLD * best for s in score]
    holder = content_node(found, chosen, nodes)
    end = [n.number for n in nodes]  # last element inside each
    for n in reversed(nodes[1:]):
        end[n.parent.number] = max(end[n.parent.number], end[n.number])
    adds = holder.tag not in FRAMES
    kept, after = [], False
    for (text, node, _), s, yes, ok in reversed(list(zip(found, score, chosen, fine, strict=True))):
        inside = holder.number <= node.number <= end[holder.number]
        stays = yes or (inside and s >= LOW * best and (declared[node.number] or (adds and ok))) or (node.heading and after and ok and s > 0)
        after = stays
        if stays:
            kept.append(text)
    return "\n\n".join(reversed(kept))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page; a map over the rows, without a shuffle."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("html"))
    return mapped(rows, _batches, "page_id long, url string, text string, n_chars long")
