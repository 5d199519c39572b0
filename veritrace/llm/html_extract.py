"""Main text of pages by wrapper induction.

Pages of a host are aligned with the host's pattern by simple tree matching. The pattern is
a merged tree of a few of its pages (those with the least hashes): what a page has beyond
the tree so far is inserted where it stands, so that parts that come and go and other
layouts have their nodes. Over all pages of the host, each pattern node gets its texts'
counts and its amount of text outside links. From these the wrapper follows:

* a node whose text is the same on most pages that have it is template, except within an
  article or main element, where a line that an author closes every article with is text;
* the content region is found by going down from the root into the one container that holds
  nearly all of the host's varying text, while there is one, down to an article or main
  element at most; of what a page has beside the region only loose headings and paragraphs
  stay;
* varying slots in the region are content, unless their element, role or class says that
  they are a menu, footer, sidebar, notice, advert, form or comment, which vary as articles
  do. Names alone decide on hosts with fewer than LEAST_PAGES pages.

The counts behind this cover every page of the host: each page is aligned on its own, next
to the pattern, and (host, pattern node) counts are summed with partial sums, so that a
host with a third of all pages is no larger for any task than another.

Very long pages. Trees are matched whole: a list of n varied items against one of m takes n x m
cells of arrays, never a Python step for a pair, and tables beyond Matching.CELLS are halved.

Odd inputs. Null or empty html gives an empty text. A page without host belongs to the host
''. Repeated rows get a row each and count each. Broken markup is read in linear time:
unknown ends are dropped, open elements end with their parent, after an unclosed quote tags
end at the next `>`. Of pages with the same least hash the first html in sort order is taken,
and of texts with the same count the greater hash. An empty table gives an empty one; extra
columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

#: A slot's text is template if so large a share of at least LEAST_PAGES pages agree on it.
CONSTANT_SHARE, LEAST_PAGES = 0.6, 4
#: A region's container holds this share of the varying text of what is around it.
REGION_SHARE = 0.95
#: Pages that a pattern is merged from.
MERGED = 3
#: Wrappers are broadcast while they are below this; beyond, pages meet them by host, in groups of about GROUP_PAGES.
BROADCAST_BYTES, GROUP_PAGES = 16 << 20, 1000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = re.compile(r"(?is)</(script|style|textarea|title|noscript|template|iframe|xmp)\s*>")
_RAW_NAMES = frozenset("script style textarea title noscript template iframe xmp".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|(?P<broken>[^>]*))>", re.S)
_PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_SKIP = frozenset("script style head nav header footer aside form button select option textarea template noscript iframe object svg canvas menu dialog input label fieldset title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: A whole attribute, so that nothing is read out of another one's name or value.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role that mark an element outside an article as no article, whatever is beside them,
_NOT_ARTICLE = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|masthead|footer|foot|sidebar|aside|breadcrumb\w*|cookie\w*|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|comment\w*|disqus|repl(?:y|ies)|respond|widget|toolbar|pagination|pager|copyright|contentinfo|navigation|complementary)(?=$|[\s_-])"
)
#: and words that mark one only where all parts of the name are among these or the general ones below.
_PARTS = frozenset("header side notice alert share sharing social search related recommend recommended recommendations legal dialog form".split())
#: Words for reader comments, adverts and notices, which mark an element in an article in a name that has general ones beside them.
_WITHIN_PARTS = frozenset("comment comments ad ads advert adverts advertisement promo promos promotion sponsor sponsored banner notice cookie cookies consent newsletter subscribe signup popup modal disqus".split())
_GENERAL = frozenset(
    "reader readers user users visitor site page global top bottom left right inner outer box container wrapper wrap block panel pane list area section slot unit bar links link buttons button icons items thread respond widget strip row col column module group media feed posts articles stories content main primary secondary small large sticky fixed overlay close".split()
)
#: Words that make a header that of a text.
_OF_TEXT = frozenset("section entry article post chapter content story main".split())
_PART = re.compile(r"[\s_-]+")


def _compound(name: str, words: frozenset) -> bool:
    """One of the words, with nothing but general words and others of them beside it; numbers count as general."""
    held = [p for p in _PART.split(name.lower()) if p and not p.isdigit()]
    return any(p in words for p in held) and all(p in words or p in _GENERAL for p in held) and not ("header" in held and any(p in _OF_TEXT for p in held))


_NO_ARTICLE_ITSELF = re.compile(r"(?i)comments?|comment-\w+|reply|replies|ads?|advert\w*|promo|sponsored|related|teaser")
#: Inside an article words are common in names of sections, so only whole names count: these of class, id and role,
_WITHIN_NAMES = (
    r"ads?|advert|advertisement|adverts|ad-(?:slot|unit|box|container|wrapper)|sponsored|sponsor|promo|breadcrumbs?|comments|comment-(?:list|form|area|section|thread|respond)|comments-(?:area|list|section)|commentlist|commentform|disqus|disqus_thread"
    r"|respond|cookie-(?:notice|banner|consent|bar)|newsletter-(?:signup|form|box)|subscribe-(?:box|form)|share-(?:buttons|bar|links)|sharing-buttons|social-(?:share|links|buttons)|related-(?:posts|articles|stories|links)|recommended-(?:posts|articles)|popup|modal|pagination|pager|navbar|nav-(?:menu|links)|site-(?:header|footer|nav)"
)
_WITHIN_ID = re.compile(rf"(?i){_WITHIN_NAMES}")
#: and these, which are slugs of headings too, of class and role only.
_WITHIN = re.compile(rf"(?i){_WITHIN_NAMES}|banner|nav|navigation|menu|header|masthead|footer|sidebar|aside|cookie|consent|gdpr|notice|alert|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comment|reply|replies|widget|toolbar|legal|copyright|contentinfo|complementary|dialog|form")
#: Elements that an opening of these ends, if it is the innermost block.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SPACE = re.compile(r"\s+")
_SAME_ITEM = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = ("ul", "ol", "dl", "table", "select", "tbody", "thead")
#: Elements that a content region can be.
_CONTAINERS = frozenset("# html body div section main article center table tbody tr td span".split())
#: Elements that stay beside a region.
_LOOSE = _HEADINGS | {"p", "blockquote", "pre"}


@dataclass
class Node:
    tag: str
    label: str
    parts: list = field(default_factory=list)  # str or Node, in page order
    size: int = 1
    #: hash of the tags and classes of the whole subtree
    shape: int = 0
    skip: bool = False
    #: it lies in an article or main element: constant text there is content too
    article: bool = False

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def _marks(tag: str, attributes: str, within: bool) -> tuple[str, bool]:
    """Class names, and whether hidden, class, id or role say that this is no article; for a page's large parts and
    what lies within an article only by whole names. The id of a heading is made from its words and says nothing."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return "", False
    held: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        held.setdefault(name.lower(), value.strip("\"'"))
    skip = "hidden" in held or held.get("aria-hidden", "").lower() == "true"
    large = tag in ("html", "body", "main", "article")
    for name in ("class", "id", "role", "aria-label"):
        value = held.get(name, "")
        if skip or not value or name == "id" and tag in _HEADINGS:
            continue
        if large or within:
            whole = _NO_ARTICLE_ITSELF if large else _WITHIN_ID if name == "id" else _WITHIN
            names = [value.strip()] if name == "aria-label" else value.split()
            skip = any(map(whole.fullmatch, names)) or not large and name in ("class", "id") and any(len(_PART.split(x)) > 1 and _compound(x, _WITHIN_PARTS) for x in names)
        else:
            skip = bool(_NOT_ARTICLE.search(value)) or any(_compound(x, _PARTS) for x in value.split())
    return held.get("class", ""), skip


def parse(text: str) -> Node:
    """A tolerant tree: unknown ends are dropped, open elements end with their parent."""
    root = Node("#", "")
    stack, block, at, n = [root], [0], 0, len(text)  # block: place of the innermost element that is not inline
    where: dict[str, list[int]] = {}  # places of open elements by name
    last_end, token = text.rfind(">"), _TOKEN

    def cut(k: int) -> None:
        while len(stack) > k:
            where[stack.pop().tag].pop()
            block.pop()

    innermost = lambda *names: max((where[x][-1] for x in names if where.get(x)), default=0)
    while at < n:
        m = token.search(text, at) if at <= last_end else None
        if m is None:
            stack[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        if token is _TOKEN and m["broken"] is not None:  # a quote that is never closed: from here on quotes mean nothing
            token = _PLAIN_TOKEN
        name, rest = name.lower(), text[m.end(2) : m.end() - 1]
        if m[1]:
            if k := innermost(name):
                cut(k)
            continue
        if name in _ENDS_P:
            if stack[block[-1]].tag == "p":
                cut(block[-1])
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            k = innermost(*_SAME_ITEM.get(name, (name,)))
            if k > innermost(*_LISTS, *(("tr",) if name in ("td", "th") else ())):
                cut(k)
        within = stack[-1].article
        label, skip = _marks(name, rest, within)
        # a page's header goes, an article's holds its title
        node = Node(name, label, skip=skip and name not in ("html", "body") or name in _SKIP and not (within and name == "header"), article=within or name in ("article", "main"))
        stack[-1].parts.append(node)
        if name in _RAW_NAMES:
            end = next((e for e in _RAW.finditer(text, at) if e[1].lower() == name), None)
            node.parts.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in _VOID and not rest.endswith("/"):
            where.setdefault(name, []).append(len(stack))
            block.append(block[-1] if name in _INLINE else len(stack))
            stack.append(node)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    for node in reversed(numbered(root)):
        children = node.children
        node.size = 1 + sum(c.size for c in children)
        node.shape = xxhash.xxh3_64_intdigest(f"{node.tag}\0{node.label}\0{[c.shape for c in children] if children else ''}".encode("utf-8", "surrogatepass"))


def _clean(text: str) -> str:
    return _SPACE.sub(" ", _html.unescape(text)).strip()


class Kinds:
    """Nodes of one level without repeated shapes, as arrays; `below` are their children, likewise."""

    def __init__(self, nodes: list[Node], names: dict[tuple[str, str], int]):
        self.nodes = list({n.shape: n for n in nodes}.values())
        self.number = {n.shape: k for k, n in enumerate(self.nodes)}
        self.names = names
        self.name = np.array([names.setdefault((n.tag, n.label), len(names)) for n in self.nodes], np.int32)

    @cached_property
    def padded(self) -> np.ndarray:
        """Names, and one behind them that no node has."""
        return np.append(self.name, np.int32(-1))

    @cached_property
    def below(self) -> Kinds:
        return Kinds([c for n in self.nodes for c in n.children], self.names)

    @cached_property
    def groups(self) -> list[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
        """Nodes with about as many children each: their places, a row of their children's numbers, padded, and the rows by names of children."""
        held: dict[int, list[int]] = {}
        children = [[self.below.number[c.shape] for c in n.children] for n in self.nodes]
        for k, row in enumerate(children):
            if row:
                held.setdefault(len(row).bit_length(), []).append(k)
        out = []
        for places in held.values():
            longest = max(len(children[k]) for k in places)
            pad = len(self.below.nodes)
            holding: dict[int, list[int]] = {}
            for i, k in enumerate(places):
                for name in set(self.below.name[children[k]].tolist()):
                    holding.setdefault(name, []).append(i)
            numbers = np.array([children[k] + [pad] * (longest - len(children[k])) for k in places], np.int32)
            out.append((np.array(places), numbers, {name: np.array(rows) for name, rows in holding.items()}))
        return out


class Open:
    """A node against all nodes of a level: one dynamic program for them together, a child at a time."""

    def __init__(self, x: Node, name: int, kinds: Kinds):
        self.x, self.kinds = x, kinds
        self.row = (kinds.name == name).astype(np.int32)
        self.children = iter(x.children)
        self.programs: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        if x.size == 1 or not self.row.any() or not kinds.groups:
            self.children = iter(())
            return
        # only nodes with a child whose name one of x's children has can score more than 1
        mine = {kinds.names[c.tag, c.label] for c in x.children if (c.tag, c.label) in kinds.names}
        for places, numbers, holding in kinds.groups:
            rows = [holding[name] for name in mine if name in holding]
            if rows:
                chosen = np.unique(np.concatenate(rows)) if len(rows) > 1 else rows[0]
                chosen = chosen[self.row[places[chosen]] > 0]
                if len(chosen):
                    held = numbers[chosen]
                    self.programs.append((places[chosen], held, [np.zeros((len(held), held.shape[1] + 1), np.int32)]))
        if not self.programs:
            self.children = iter(())

    def take(self, row: np.ndarray) -> None:
        """The scores of the next child of x against the level below."""
        row = np.append(row, np.int32(0))
        for _, held, state in self.programs:
            self._add(state, row[held])

    def take_leaf(self, name: int) -> None:
        """A next child without children of its own: 1 where the name is the same."""
        for _, held, state in self.programs:
            same = self.kinds.below.padded[held] == name
            if same.any():
                self._add(state, same)

    @staticmethod
    def _add(state: list[np.ndarray], weights: np.ndarray) -> None:
        best = state[0].copy()
        np.maximum(best[:, 1:], state[0][:, :-1] + weights, out=best[:, 1:])
        state[0] = np.maximum.accumulate(best, axis=1)

    def done(self) -> np.ndarray:
        for places, _, state in self.programs:
            self.row[places] += state[0][:, -1]
        return self.row


class Matching:
    """Simple tree matching: the order-keeping alignment of two trees with the most pairs of nodes of equal tag and class.

    Subtrees of one shape match whole, and where the children of two nodes begin or end with
    such subtrees these belong to a best alignment; what is between goes through the dynamic
    program, at any size. A node is scored against all shapes of the other side's level at
    once, so the work on varied items is that of arrays; trees of any depth are gone through without recursion.
    """

    #: Cells of a table of the dynamic program, and of scores, that are kept; beyond, the table is halved and scores made anew.
    CELLS = 1 << 22
    #: Levels of so few shapes keep their scores by pair: deep and narrow trees meet the same pairs at each depth.
    NARROW = 16

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def alignments(self, a: Node, b: Node) -> Iterator[tuple[Node, Node, list[tuple[Node, Node]]]]:
        """Pairs of nodes, each with the pairs of its children."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            held = self._aligned(x.children, y.children) if x.size > 1 < y.size else []
            yield x, y, held
            todo += held

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        return [(x, y) for x, y, _ in self.alignments(a, b)]

    def _row(self, x: Node, kinds: Kinds, kept: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """Pairs of the best matching of x with each of the kinds, 0 where tag or class differ."""
        stack: list[Open] = []
        while True:
            row = kept.get((x.shape, id(kinds)))
            if row is None and len(kinds.nodes) <= self.NARROW and all((x.shape, y.shape) in self.scores for y in kinds.nodes):
                row = np.array([self.scores[x.shape, y.shape] for y in kinds.nodes], np.int32)
            if row is None:
                stack.append(Open(x, self.names.setdefault((x.tag, x.label), len(self.names)), kinds))
            elif not stack:
                return row
            else:
                stack[-1].take(row)
            while (child := self._inner(stack[-1])) is None:
                last = stack.pop()
                row = last.done()
                if len(row) <= self.NARROW:
                    self.scores.update(((last.x.shape, y.shape), int(n)) for y, n in zip(last.kinds.nodes, row))
                elif last.x.size > 1:
                    if (len(kept) + 1) * len(row) > self.CELLS:
                        kept.clear()
                    kept[last.x.shape, id(last.kinds)] = row
                if not stack:
                    return row
                stack[-1].take(row)
            x, kinds = child, stack[-1].kinds.below

    def _inner(self, open_: Open) -> Node | None:
        """The next child that has children; those before it are taken."""
        for child in open_.children:
            if child.size > 1:
                return child
            open_.take_leaf(self.names.get((child.tag, child.label), -2))
        return None

    def _aligned(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        out, todo = [], [(xs, ys)]
        while todo:
            xs, ys = todo.pop()
            i, j, most = 0, 0, min(len(xs), len(ys))
            while i < most and xs[i].shape == ys[i].shape:
                i += 1
            while j < most - i and xs[-1 - j].shape == ys[-1 - j].shape:
                j += 1
            out += zip(xs[:i], ys[:i])
            out += zip(xs[len(xs) - j :], ys[len(ys) - j :])
            xs, ys = xs[i : len(xs) - j], ys[i : len(ys) - j]
            if not xs or not ys:
                continue
            if len(xs) == len(ys) == 1:
                out += [(xs[0], ys[0])] if _same(xs[0], ys[0]) else []
                continue
            kinds = Kinds(ys, self.names)
            of = np.array([kinds.number[y.shape] for y in ys])
            kept: dict[tuple[int, int], np.ndarray] = {}

            def weights(x: Node) -> np.ndarray:
                return self._row(x, kinds, kept)[of]

            def step(row: np.ndarray, w: np.ndarray) -> np.ndarray:
                """row: best scores of one more x against the first 0, 1, ... of the ys."""
                best = row.copy()
                np.maximum(best[1:], row[:-1] + w, out=best[1:])
                return np.maximum.accumulate(best)

            if len(xs) * len(ys) > self.CELLS and len(xs) > 1:
                # halve the xs; the best cut of the ys is where both halves' scores add up to the most
                half, zero = len(xs) // 2, np.zeros(len(ys) + 1, np.int32)
                front = back = zero
                for x in xs[:half]:
                    front = step(front, weights(x))
                for x in reversed(xs[half:]):
                    back = step(back, weights(x)[::-1])
                at = int(np.argmax(front + back[::-1]))
                todo += [(xs[:half], ys[:at]), (xs[half:], ys[at:])]
                continue
            table = [np.zeros(len(ys) + 1, np.int32)]
            for x in xs:
                table.append(step(table[-1], weights(x)))
            p, q = len(xs), len(ys)
            while p and q:
                if table[p][q] == table[p - 1][q]:
                    p -= 1
                elif table[p][q] == table[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    out.append((xs[p], ys[q]))
        return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    return Matching().pairs(a, b)


def _same(x: Node, y: Node) -> bool:
    return x.tag == y.tag and x.label == y.label


def merge(pattern: Node, page: Node) -> None:
    """Inserts into the pattern what the page has beyond it, each part behind the sibling that it follows."""
    for x, y, aligned in list(Matching().alignments(pattern, page)):
        held = {id(q): p for p, q in aligned}
        behind: dict[int | None, list[Node]] = {}
        last = None
        for q in y.children:
            if id(q) in held:
                last = id(held[id(q)])
            else:
                behind.setdefault(last, []).append(q)
        if behind:
            x.parts = behind.get(None, []) + [z for part in x.parts for z in (part, *behind.get(id(part), ()))]
    _measure(pattern)


def numbered(root: Node) -> list[Node]:
    """Nodes in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.children)
    return out


def blocks(root: Node) -> Iterator[tuple[Node, str, int]]:
    """Text blocks outside the parts that are no article, each with the element that holds it and its characters outside links."""
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    free = 0

    def flush(node: Node) -> None:
        nonlocal free
        if held:
            text = _clean("".join(held))
            held.clear()
            if text:
                out.append((node, text, free))
        free = 0

    # (node, its block, position, in a link): a stack in place of recursion, so that depth costs no frames
    stack = [(root, root, 0, False)]
    while stack:
        node, block, k, link = stack.pop()
        if k == len(node.parts):
            if node is block:
                flush(block)
            continue
        stack.append((node, block, k + 1, link))
        part = node.parts[k]
        if isinstance(part, str):
            held.append(part)
            free += 0 if link else len(part.strip())
        elif part.tag == "br":
            held.append(" ")
        elif part.skip:
            if part.tag not in _INLINE:
                flush(block)
        elif part.tag in _INLINE:
            stack.append((part, block, 0, link or part.tag == "a"))
        else:
            flush(block)
            stack.append((part, part, 0, link))
    return iter(out)


class Pattern:
    """A host's merged tree, its nodes numbered in page order."""

    def __init__(self, pages: tuple[str, ...]):
        self.tree = parse(pages[0]) if pages else Node("#", "")
        for page in pages[1:]:
            merge(self.tree, parse(page))
        self.nodes = numbered(self.tree)
        self.number = {id(x): k for k, x in enumerate(self.nodes)}

    def places(self, tree: Node) -> dict[int, int]:
        """Pattern node of each node of a page that has one, by the node's id."""
        return {id(y): self.number[id(x)] for x, y in match(self.tree, tree)}

    def outside(self, text: dict[int, int]) -> set[int]:
        """Nodes that lie beside the content region; text: amount of varying text of each node."""
        total = [text.get(k, 0) for k in range(len(self.nodes))]
        for k in range(len(self.nodes) - 1, -1, -1):
            for c in self.nodes[k].children:
                total[k] += total[self.number[id(c)]]
        out, at = set(), self.tree
        while not at.article:
            children = at.children
            best = max(children, key=lambda c: total[self.number[id(c)]], default=None)
            if best is None or best.tag not in _CONTAINERS or total[self.number[id(best)]] < REGION_SHARE * total[self.number[id(at)]] or not total[self.number[id(at)]]:
                break
            for c in children:
                if c is not best and c.tag not in _LOOSE:
                    out |= {self.number[id(x)] for x in numbered(c)}
            at = best
        return out


@lru_cache(maxsize=256)
def _pattern(pages: tuple[str, ...]) -> Pattern:
    return Pattern(pages)


def observe(page: str | None, pattern: Pattern) -> list[tuple[int, int, int]]:
    """(pattern node, hash of the text there, characters outside links) for each text-bearing block of the page that the pattern has."""
    if not page:
        return []
    tree = parse(page)
    place = pattern.places(tree)
    seen: dict[int, list] = {}
    for node, text, free in blocks(tree):
        if id(node) in place:
            got = seen.setdefault(place[id(node)], [[], 0])
            got[0].append(text)
            got[1] += free
    return [(k, _hash("\n".join(v)), free) for k, (v, free) in seen.items()]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(frozen=True)
class Wrapper:
    pattern: Pattern
    #: pattern node -> hash of the text that is the same on the host's pages
    template: dict[int, int]
    outside: frozenset[int]

    @staticmethod
    def of(pages: tuple[str, ...], nodes: list[tuple[int, int | None, int]]) -> Wrapper | None:
        """nodes: of each pattern node its constant text's hash, or None, and its amount of varying text."""
        if not nodes:
            return None
        pattern = _pattern(pages)
        return Wrapper(pattern, {k: t for k, t, _ in nodes if t is not None}, frozenset(pattern.outside({k: m for k, _, m in nodes})))


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    if not page:
        return ""
    tree = parse(page)
    found = list(blocks(tree))
    if wrapper:
        place = wrapper.pattern.places(tree)
        whole: dict[int, list[str]] = {}
        for node, text, _ in found:
            if id(node) in place:
                whole.setdefault(place[id(node)], []).append(text)
        template = wrapper.template
        gone = {k for k, v in whole.items() if k in wrapper.outside or k in template and template[k] == _hash("\n".join(v))}
        found = [x for x in found if x[0].article or place.get(id(x[0])) not in gone]
    return "\n\n".join(t for _, t, _ in found)


def host(url):
    """Host of a url column, in lower case."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))


def patterns(pages: DataFrame) -> DataFrame:
    """host, up to MERGED of its pages, and the number of them: of their texts those with the least hashes, which every task finds for its own rows first."""
    hashed = _with_host(pages).where(F.length("html") > 0).withColumn("h", F.xxhash64("html"))
    least = hashed.groupBy("host", F.pmod("h", F.lit(MERGED)).alias("part")).agg(F.min(F.struct("h", "html")).alias("m"), F.count("*").alias("n"))
    return least.groupBy("host").agg(F.transform(F.array_sort(F.collect_set("m")), lambda x: x["html"]).alias("pages"), F.sum("n").alias("n"))


_SEEN = "host string, node int, text long, n long, free long"


def _observed(pages: pa.RecordBatch | pa.Table, of) -> pa.Table:
    total: dict[tuple, list[int]] = {}
    hosts, texts = (pages.column(pages.schema.get_field_index(c)).to_pylist() for c in ("host", "html"))
    for h, page in zip(hosts, texts):
        for k, text, free in observe(page, of(h)):
            got = total.setdefault((h, k, text), [0, 0])
            got[0] += 1
            got[1] += free
    return pa.table(
        {"host": pa.array([k[0] for k in total], pa.string()), "node": pa.array([k[1] for k in total], pa.int32()), "text": pa.array([k[2] for k in total], pa.int64()), "n": pa.array([v[0] for v in total.values()], pa.int64()), "free": pa.array([v[1] for v in total.values()], pa.int64())}
    )


def wrappers(seen: DataFrame) -> DataFrame:
    """host and its nodes: number, hash of the text that is constant or null, and amount of varying text."""
    one = seen.groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.sum("free").alias("free"))
    node = one.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum("free").alias("free"), F.max(F.struct("n", "text", "free")).alias("top"))
    constant = (F.col("pages") >= LEAST_PAGES) & (F.col("top.n") >= CONSTANT_SHARE * F.col("pages"))
    kept = node.select("host", F.struct("node", F.when(constant, F.col("top.text")).alias("text"), (F.col("free") - F.when(constant, F.col("top.free")).otherwise(0)).alias("free")).alias("x"))
    return kept.groupBy("host").agg(F.collect_list("x").alias("nodes"))


def _by_host(pages: DataFrame, small: DataFrame, size: int, work, schema: str) -> DataFrame:
    """work(pages, host -> row of small) over all pages; small has `size` bytes in all: broadcast below the bound, else
    pages and a copy of their host's row meet in groups of about GROUP_PAGES, so that only large hosts are dealt out."""
    if size <= BROADCAST_BYTES:
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: r.asDict(recursive=True) for r in small.collect()})

        @lean
        def run(batches):
            for b in batches:
                yield from work(b, held.value.get).to_batches()

        return _with_host(pages).mapInArrow(run, schema)
    sizes = small.select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("parts"))
    dealt = _with_host(pages).join(sizes, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = small.join(sizes, "host").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    @lean
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.to_pylist()
        return work(left, lambda h: own[0] if own else None)

    return dealt.groupBy("host", "part").cogroup(copies.groupBy("host", "part")).applyInArrow(meet, schema)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url and the article's text."""
    own = written(patterns(pages), "html-patterns")
    size = own.agg(F.coalesce(F.sum(F.octet_length(F.array_join("pages", ""))), F.lit(0))).first()[0]

    def look(batch, of):
        return _observed(batch, lambda h: _pattern(tuple((of(h) or {}).get("pages") or ())))

    found = wrappers(_by_host(pages, own, size, look, _SEEN))
    both = written(own.join(found, "host", "left").select("host", "pages", "n", F.when(F.col("n") >= LEAST_PAGES, F.col("nodes")).alias("nodes")), "html-wrappers")
    size += both.agg(F.coalesce(F.sum(F.greatest(F.size("nodes"), F.lit(0))), F.lit(0))).first()[0] * 100

    def take(batch, of):
        known: dict[str, Wrapper | None] = {}

        def wrapper(h):
            if h not in known:
                row = of(h) or {}
                known[h] = Wrapper.of(tuple(row.get("pages") or ()), [(x["node"], x["text"], x["free"]) for x in row.get("nodes") or ()])
            return known[h]

        hosts, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "html"))
        text = pa.array([main_text(t, wrapper(h)) for h, t in zip(hosts, texts)], pa.string())
        return pa.table([batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")), text], names=["page_id", "url", "text"])

    return _by_host(pages, both, size, take, "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
