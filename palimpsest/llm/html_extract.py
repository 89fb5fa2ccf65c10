"""Main text of web pages by union-free wrappers (operator 2).

The block elements of a page are a token stream without its texts.  Streams of one host are aligned one after the
other: what only some hold becomes optional, what repeats side by side becomes one repeated group, and texts become
slots.  The result, a regular expression without unions, is the host's wrapper.  Each of its nodes knows on how many
pages and how different ones it stands, how much text it has, how much of that links, and whether it is always the same.

The wrapper decides, on every page: its heaviest node of changing text that does not link is the article's region; what
never changes over pages of different texts is template, also where it is optional; what links is a menu.  Markup only
weighs: an article or main element counts its text many times over, and names such as "comments" or "sidebar" take a
part out while it is a small one.  Elements that HTML itself sets apart (nav, footer, form, script ...) never are text.
Each page's elements are matched with the wrapper's nodes in order, and get what was decided for them.  A page on which
the region does not stand is a wrapper of its own.

Tasks fold their pages into one wrapper per host before anything is shuffled, and wrappers of a host are folded in two
steps, so a host of any size is never one task's rows.  A wrapper is bounded: elements nested deeper than DEPTH, and new
ones beyond NODES, count for the element that holds them and are decided with it.

Defined results: null or empty html, or a page without article text, gives an empty text; a very long or deeply nested
page is handled whole; a null or malformed url belongs to the host ''; repeated rows are extracted each, and copies of a
page, however many, show no template; of equally heavy nodes the first in page order is taken; an empty table gives no
rows; other columns, whatever their names, are ignored.  Characters are decoded as HTML says; white space (also the
no-break space) inside a block becomes one space; a line break element is white space.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, materialize

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input picture source area map object param track embed col link meta base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are never article text, wherever they stand; a header inside an article is its own heading.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg math select button dialog menu canvas audio video object head title textarea noembed noframes xmp datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names that hint at parts around an article: alone in a class or id they weigh more than as the first of several words.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond footer masthead social share sharing related recommended widget toolbar pagination pager search login".split())
ARTICLE = frozenset("content article post entry story articlebody maincontent".split())
#: How many times the text of an article element, or of one named so, counts.
ELEMENT_WEIGHT, NAME_WEIGHT = 50, 4
#: A part whose name hints at no article goes while it holds less than this share of its page's text.
SURE_SHARE, MAYBE_SHARE = 0.95, 0.3
#: Pages of different texts on which what never changes is template; a region holds this share of the text around it.
DISTINCT, REGION = 3, 0.6
#: Depth of a wrapper, its nodes, and the product of two lists of children that are aligned by their best match.
DEPTH, NODES, CELLS = 100, 3000, 250_000
CONTAINERS = frozenset("html body div section main article table tbody tr td center fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that the start of another closes.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
BOUND = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "thead": "table", "tbody": "table", "tfoot": "table", "option": "select"}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: A class or id as part of an element's key; long numbers, which may be of one page only, are all the same.
_KEY, _NUMBER = re.compile(r"[a-z0-9#]+"), re.compile(r"\d{3,}")


class Node:
    """A block element: key (tag and names), whether it is never text (HTML or its role says so, or it is hidden), how
    strongly its names hint at a part around the article (0 to 2), and its weight as an article."""

    __slots__ = ("tag", "key", "never", "hint", "weight", "parent", "depth", "within", "record", "at", "cursor", "kept", "gone")

    def __init__(self, tag: str, key: str, never: bool, hint: int, weight: int, parent: Node | None) -> None:
        self.tag, self.key, self.never, self.hint, self.weight, self.parent = tag, key, never, hint, weight, parent
        self.depth = parent.depth + 1 if parent is not None else 0
        self.within = tag == "article" or parent is not None and parent.within
        self.record = self.at = None
        self.cursor = -1
        self.kept = self.gone = False


def _node(tag: str, attributes: str, parent: Node) -> Node:
    never = tag in DROPPED or tag == "header" and not parent.within
    hint, weight, key = 0, ELEMENT_WEIGHT if tag in ("article", "main") else 1, tag
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                words = _NAME.findall(value)
                names = _KEY.findall(_NUMBER.sub("#", value))
                key += "." + "-".join(names[:4]) if names and not (name == "id" and any(x.isdigit() for x in value)) else ""
                if tag not in ("article", "main", "body", "html"):
                    for token in value.split():
                        parts = _NAME.findall(token)
                        if parts and parts[0] in MARKS:
                            hint = max(hint, 2 if len(parts) == 1 or all(x in MARKS or x in _NEUTRAL for x in parts[1:]) else 1)
                    if not ARTICLE.isdisjoint(words):
                        weight = max(weight, NAME_WEIGHT)
            elif name == "role":
                never |= value in ROLES
                weight = ELEMENT_WEIGHT if value in ("main", "article") else weight
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                never = True
    return Node(tag, key, never, 0 if weight > 1 else hint, weight, parent)


_NEUTRAL = frozenset("box bar block list item items section area wrapper container panel slot unit body form top bottom left right inner outer text".split())


def parse(page: str) -> Iterator[tuple[str, Node, str, bool]]:
    """Events of a page: ("open" | "close", node, "", False) and ("text", node, its text, whether it is a link's)."""
    root = Node("", "", False, 0, 1, None)
    stack, links, at, end = [root], 0, 0, len(page)
    opened: Counter[str] = Counter()  # by tag: what is not open need not be looked for in a deep stack
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            yield "text", stack[-1], html.unescape(page[at:lt]), links > 0
        if lt >= end:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:  # a lone "<" is text
            nxt = page.find("<", lt + 1)
            nxt = end if nxt < 0 else nxt
            yield "text", stack[-1], html.unescape(page[lt:nxt]), links > 0
            at = nxt
            continue
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and opened[tag]:
                while True:
                    node = stack.pop()
                    opened[node.tag] -= 1
                    yield "close", node, "", False
                    if node.tag == tag:
                        break
                links = 0
            continue
        if tag in INLINE:
            links += tag == "a"
            if tag == "br":
                yield "text", stack[-1], " ", False
            continue
        if tag in CLOSES_P:
            gone, bound = "p", "button td th table"
        else:
            gone, bound = CLOSES.get(tag, ""), BOUND.get(tag, "")
        if gone and any(opened[x] for x in gone.split()):
            names, stop, depth = gone.split(), bound.split(), 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in names:
                    depth = i
                    if gone == "p":
                        break
            if depth:
                while len(stack) > depth:
                    opened[stack[-1].tag] -= 1
                    yield "close", stack.pop(), "", False
                links = 0
        node = _node(tag, m.group(3), stack[-1])
        yield "open", node, "", False
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = stop.end()
            yield "close", node, "", False
        elif tag in VOID or m.group(3).endswith("/") and tag in ("svg", "math"):
            yield "close", node, "", False
        else:
            stack.append(node)
            opened[tag] += 1
    for node in reversed(stack[1:]):
        yield "close", node, "", False


# Wrappers.  A wrapper node is [key, optional, repeated, children, facts]; a group of keys that repeats has the key "()".
# Facts: pages, characters, characters in links, checksum of the own text if it is always the same (else -1), digests of
# some pages that have the node (the smallest, DISTINCT at most), never, hint and weight as of ``Node``.


def _same_page(x: list, y: list) -> list:
    check = zlib.crc32(f"{x[3]},{y[3]}".encode())
    return [max(x[0], y[0]), x[1] + y[1], x[2] + y[2], check, x[4], x[5] and y[5], min(x[6], y[6]), max(x[7], y[7])]


def _other_page(x: list, y: list) -> list:
    digests = x[4] if x[4] == y[4] else sorted({*x[4], *y[4]})[:DISTINCT]
    return [x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else -1, digests, x[5] and y[5], min(x[6], y[6]), max(x[7], y[7])]


def _again(x: list, y: list) -> list:
    """Neighbours in a wrapper, of whatever pages."""
    out = _other_page(x, y)
    out[0] = max(x[0], y[0])
    return out


def _alike(key: str, x: set[str], y: set[str]) -> bool:
    """Whether two elements of one key, with these keys of children, may be one node: containers need some in common."""
    if key.split(".", 1)[0] not in CONTAINERS or key == "()":
        return True
    return not x and not y or 2 * len(x & y) >= min(len(x), len(y)) > 0


def _one(a: list, b: list) -> bool:
    return a[0] == b[0] and _alike(a[0], {c[0] for c in a[3]}, {c[0] for c in b[3]})


def _fold(children: list[list], facts: Callable = _again) -> list[list]:
    """Neighbouring repeats of one node or of a group of two or three become one repeated node."""
    for size in (1, 2, 3):
        out: list[list] = []
        for child in children:
            out.append(child)
            while len(out) >= 2 * size and all(map(_one, out[-size:], out[-2 * size : -size])):
                again = out[-size:]
                del out[-size:]
                if size == 1:
                    out[-1] = align(out[-1], again[0], facts)
                    out[-1][2] = True
                else:
                    out[-size:] = [["()", False, True, [align(a, b, facts) for a, b in zip(out[-size:], again, strict=True)], _NOTHING]]
                    break
            if size > 1 and len(out) > 1 and out[-1][0] != "()":
                last = next((i for i in range(len(out) - 1, max(-1, len(out) - 5), -1) if out[i][0] == "()"), None)
                if last is not None and [c[0] for c in out[last][3]] == [c[0] for c in out[last + 1 :]]:
                    out[last][3] = [align(a, b, facts) for a, b in zip(out[last][3], out[last + 1 :], strict=True)]
                    del out[last + 1 :]
        children = out
    return children


_NOTHING = [0, 0, 0, 0, [], False, 0, 1]


def _grouped(children: list[list], groups: list[list]) -> list[list]:
    """``children`` with runs that hold the keys of one of ``groups`` as a group too."""
    for keys in ([c[0] for c in g[3]] for g in groups if g[0] == "()"):
        at, out = 0, []
        while at < len(children):
            run = children[at : at + len(keys)]
            if [c[0] for c in run] == keys:
                out.append(["()", False, False, run, _NOTHING])
                at += len(keys)
            else:
                out.append(children[at])
                at += 1
        children = out
    return children


def _matched(x: list[list], y: list[list]) -> Iterator[tuple[int | None, int | None]]:
    """Two lists of nodes in step: the best match, or, of very long lists, that of their common ends."""
    n, m, front = len(x), len(y), 0
    while front < min(n, m) and _one(x[front], y[front]):
        front += 1
    back = 0
    while back < min(n, m) - front and _one(x[n - 1 - back], y[m - 1 - back]):
        back += 1
    yield from ((i, i) for i in range(front))
    a, b = x[front : n - back], y[front : m - back]
    if len(a) * len(b) <= CELLS:
        same = [[_one(p, q) for q in b] for p in a]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if same[i][j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and same[i][j]:
                yield front + i, front + j
                i, j = i + 1, j + 1
            elif j >= len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
                yield front + i, None
                i += 1
            else:
                yield None, front + j
                j += 1
    else:
        yield from ((front + i, None) for i in range(len(a)))
        yield from ((None, front + j) for j in range(len(b)))
    yield from ((n - back + i, m - back + i) for i in range(back))


def align(a: list, b: list, facts: Callable = _other_page) -> list:
    """One node that covers both: matched children are aligned in turn, the others become optional."""
    if not a[3] and not b[3]:
        return [a[0], a[1] or b[1], a[2] or b[2], [], facts(a[4], b[4])]
    x, y = _grouped(a[3], b[3]), _grouped(b[3], a[3])
    out = []
    for i, j in _matched(x, y):
        if i is not None and j is not None:
            out.append(align(x[i], y[j], facts))
        else:
            c = x[i] if j is None else y[j]
            out.append([c[0], True, c[2], c[3], c[4]])
    return [a[0], a[1] or b[1], a[2] or b[2], _fold(out, facts if facts is _same_page else _again), facts(a[4], b[4])]


def _size(tree: list) -> int:
    n, stack = 0, [tree]
    while stack:
        node = stack.pop()
        n += 1
        stack += node[3]
    return n


def _bounded(tree: list) -> list:
    """Of a wrapper of too many nodes the NODES first by level: what hangs below counts for the node that holds it."""
    if _size(tree) <= NODES:
        return tree
    level, n = [tree], 1
    while level:
        below = [c for node in level for c in node[3]]
        if n + len(below) > NODES:
            for node in level:
                stack, node[3] = node[3], []
                while stack:
                    c = stack.pop()
                    stack += c[3]
                    node[4] = [node[4][0], node[4][1] + c[4][1], node[4][2] + c[4][2], -1, *node[4][4:]]
            return tree
        level, n = below, n + len(below)
    return tree


def page_tree(page: str) -> tuple[list, int]:
    """A page as a wrapper of its own, and the number of its characters outside links and never-text elements."""
    top = ["", False, False, [], [1, 0, 0, 0, [], False, 0, 1]]
    digest, live, records = hashlib.blake2b(digest_size=6), 0, [top]
    for kind, node, text, link in parse(page):
        if kind == "open":
            holder = node.parent.record or top
            if node.depth > DEPTH:
                node.record, node.gone = holder, node.parent.gone or node.never or node.hint == 2
                continue
            node.record = [node.key, False, False, [], [1, 0, 0, 0, [], node.never, node.hint, node.weight]]
            node.gone = node.parent.gone or node.never or node.hint == 2
            holder[3].append(node.record)
            records.append(node.record)
        elif kind == "text" and text and not text.isspace():
            facts = (node.record or top)[4]
            facts[1] += len(text)
            facts[2] += len(text) if link else 0
            body = text.strip().encode("utf-8", "replace")
            facts[3] = zlib.crc32(body, facts[3])
            if not node.gone:
                digest.update(body + b"\n")
                live += 0 if link else len(text)
    name = [digest.hexdigest()]
    for record in reversed(records):  # children before the element that holds them
        record[4][4] = name
        if len(record[3]) > 1:
            record[3] = _fold(record[3], _same_page)
    return top, live


@dataclass
class Wrapper:
    """The wrapper of some pages of a host."""

    pages: int = 0
    tree: list | None = None

    def add_page(self, page: str) -> None:
        self.merge(Wrapper(1, page_tree(page)[0]))

    def merge(self, other: Wrapper) -> None:
        if other.tree is not None:
            self.tree = _bounded(other.tree if self.tree is None else align(self.tree, other.tree))
        self.pages += other.pages

    def dumps(self) -> str:
        return json.dumps([self.pages, self.tree])

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))

    def expression(self) -> str:
        """The wrapper as a union-free regular expression over element keys; # is a text slot."""

        def show(node: list) -> str:
            inner = " ".join(show(c) for c in node[3])
            body = f"({inner})" if node[0] == "()" else f"<{node[0]}>{'# ' if node[4][1] else ''}{inner}</>"
            return body + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[node[1], node[2]]

        return " ".join(show(c) for c in self.tree[3]) if self.tree else ""

    def plan(self) -> list | None:
        """The wrapper's nodes as [key, decision, children], groups dissolved.  Decisions: ROOT, the article's region; DROP,
        no text of it or below; MUTE, no text of its own."""
        if self.tree is None:
            return None
        nodes: dict[int, list] = {}  # id of a node: [text that changes or links little, the same with weights, decision]
        all_text = template = 0

        def tag(node: list) -> str:
            return node[0].split(".", 1)[0]

        def kids(node: list) -> list[list]:
            return [k for c in node[3] for k in (kids(c) if c[0] == "()" else [c])]

        def constant(node: list) -> bool:
            f = node[4]
            return f[3] != -1 and f[1] > 0 and len(f[4]) >= DISTINCT and tag(node) not in HEADINGS

        def count(node: list) -> None:
            nonlocal all_text, template
            if node[4][5]:
                return
            own = max(0, node[4][1] - 2 * node[4][2])
            all_text += own
            template += own if constant(node) else 0
            for c in kids(node):
                count(c)

        count(self.tree)
        trusted = template <= all_text / 2  # else the pages are alike as a whole, and nothing tells their template

        def weigh(node: list) -> tuple[int, int]:
            f, mute = node[4], trusted and constant(node)
            if f[5]:
                nodes[id(node)] = [0, 0, DROP]
                return 0, 0
            plain = 0 if mute else max(0, f[1] - 2 * f[2])
            heavy = plain
            for c in kids(node):
                p, h = weigh(c)
                plain, heavy = plain + p, heavy + h
            decision = MUTE if mute else 0
            if f[6] and plain < (SURE_SHARE if f[6] == 2 else MAYBE_SHARE) * all_text and heavy == plain:
                plain, heavy, decision = 0, 0, DROP
            nodes[id(node)] = [plain, heavy * f[7], decision]
            return plain, heavy * f[7]

        weigh(self.tree)
        region = self.tree
        while tag(region) != "article":
            below = [c for c in kids(region) if nodes[id(c)][1]]
            best = max(below, key=lambda c: nodes[id(c)][1], default=None)
            if best is None or tag(best) not in CONTAINERS or best[2] and tag(best) != "article":
                break
            if nodes[id(best)][1] < REGION * sum(nodes[id(c)][1] for c in below):
                break
            if best[4][7] < ELEMENT_WEIGHT and nodes[id(best)][1] == nodes[id(best)][0] * best[4][7] and any(tag(c) in HEADINGS or tag(c) == "p" for c in below if c is not best):
                break
            region = best
        nodes[id(region)][2] |= ROOT

        def link_text(node: list) -> tuple[int, int]:
            chars, links = node[4][1], node[4][2]
            for c in [] if nodes[id(node)][2] & DROP else kids(node):
                x, y = link_text(c)
                chars, links = chars + x, links + y
                if tag(region) != "article" and tag(c) in ("ul", "ol", "div", "table", "section") and x and y >= 0.8 * x and not nodes[id(c)][2] & ROOT:
                    nodes[id(c)][2] |= DROP
            return chars, links

        link_text(self.tree)

        def show(node: list) -> list:
            decision = nodes[id(node)][2]
            return [node[0], decision, [] if decision & DROP else [show(c) for c in kids(node)]]

        return show(self.tree)


ROOT, DROP, MUTE = 1, 2, 4


def extract(page: str | None, plan: list | None = None) -> str:
    """The article's blocks, one per line.  plan: of the page's host; without one the page is a wrapper of its own."""
    if not page:
        return ""
    events = list(parse(page))
    if plan is None or not _placed(events, plan):
        own = Wrapper()
        own.add_page(page)
        _placed(events, own.plan())
    blocks, parts = [], []
    for kind, node, text, _ in events:
        if kind == "text":
            if node.kept and not node.gone and not (node.at is not None and node.at[1] & MUTE):
                parts.append(text)
        elif parts:
            if line := " ".join("".join(parts).split()):
                blocks.append(line)
            parts = []
    if line := " ".join("".join(parts).split()):
        blocks.append(line)
    return "\n".join(blocks)


def _placed(events: list[tuple[str, Node, str, bool]], plan: list) -> bool:
    """Match a page's elements with a plan's nodes, in order, and mark which are kept; whether the region is there."""
    found, cursors = False, {}
    if events:
        root = _top(events[0][1])
        root.at, root.cursor, root.kept = plan, -1, bool(plan[1] & ROOT)
        found = root.kept
    inner: dict[int, set[str]] = {}
    for kind, node, _, _ in events:
        if kind == "open":
            inner.setdefault(id(node.parent), set()).add(node.key)
    for kind, node, _, _ in events:
        if kind != "open":
            continue
        above, node.at = node.parent.at, None
        if above is not None and node.depth <= DEPTH:
            if id(above) not in cursors:
                places: dict[str, list[int]] = {}
                for i, child in enumerate(above[2]):
                    places.setdefault(child[0], []).append(i)
                cursors[id(above)] = places
            here = cursors[id(above)].get(node.key)
            if here:
                later = [i for i in here if i >= node.parent.cursor] or here[-1:]
                own = inner.get(id(node), set())
                node.parent.cursor = next((i for i in later if _alike(node.key, own, {c[0] for c in above[2][i][2]})), later[0])
                node.at = above[2][node.parent.cursor]
        node.cursor = -1
        decision = node.at[1] if node.at is not None else 0
        node.gone = node.parent.gone or node.never or bool(decision & DROP)
        node.kept = node.parent.kept or bool(decision & ROOT)
        found |= bool(decision & ROOT) and not node.gone
    return found


def _top(node: Node) -> Node:
    while node.parent is not None:
        node = node.parent
    return node


def host(url: str | Column = "url") -> Column:
    return F.coalesce(F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST"))), F.lit(""))


#: Hosts that a task holds wrappers of before it sends them on, and the steps' fan-in.
HELD_HOSTS, SALTS = 500, 32


def wrappers(pages: DataFrame) -> DataFrame:
    """Per host: host, wrapper (as Wrapper.dumps gives it)."""

    def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.dumps() for w in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    held.setdefault(name, Wrapper()).add_page(page)
            if len(held) > HELD_HOSTS:
                yield send()
        yield send()

    def fold(table: pa.Table) -> pa.Table:
        total = Wrapper()
        for text in sorted(table.column("wrapper").to_pylist()):
            total.merge(Wrapper.loads(text))
        return pa.table([[table.column("host")[0].as_py()], [total.dumps()]], ["host", "wrapper"])

    part = map_batches(pages.select(host().alias("host"), "html"), fold_pages, "host string, wrapper string")
    part = part.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInArrow(fold, "host string, wrapper string")
    return materialize(part.groupBy("host").applyInArrow(fold, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(Wrapper.loads(w).plan()) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["of", "plan"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list | None] = {None: None}
        for batch in batches:
            texts = []
            for page, plan in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if plan not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[plan] = json.loads(plan)
                texts.append(extract(page, known[plan]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    planned = materialize(map_batches(wrappers(pages), plans, "of string, plan string"), "plans")
    joined = pages.select("page_id", "url", "html", host().alias("host")).join(planned, F.col("host") == F.col("of"), "left")
    return map_batches(joined.select("page_id", "url", "html", "plan"), run, "page_id long, url string, text string, n_chars long")
