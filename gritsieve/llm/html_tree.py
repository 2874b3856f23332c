"""A page's html as a small tree of blocks: tolerant of unclosed and misplaced tags, repeated siblings folded into one."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import xxhash

#: Elements that never have content; those whose content is no markup; and where a paragraph ends by itself.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav noscript object ol "
    "optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
#: What an opening tag closes, and up to where.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
}
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
FENCES = frozenset(("table", "td", "th", "caption", "button", "object", "template", "html"))
#: Elements that are no article text, and words of class, id or role that say so.
NOISE_TAGS = frozenset(
    "nav footer header aside form button select dialog menu noscript template svg object head fieldset search option".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar masthead topbar header "
    "footer copyright share sharing social related recommended comments comment commentlist disqus reply replies respond "
    "complementary contentinfo search pagination pager skip".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: What makes an article element none, and words that turn the others round ("no-sidebar", "with-comments").
NOT_MAIN = frozenset("comment comments related ad ads advert promo sponsored".split())
NEGATIONS = frozenset("no not has have with without".split())
#: Siblings that are the same thing whatever they hold.
LISTED = frozenset("p li dt dd tr td th option h2 h3 h4 h5 h6 tbody blockquote pre figure #".split())

#: Shape of a tree, never of a text: levels with nodes of their own, items of a sequence, longest repeated sequence.
MOST_DEPTH = 64
MOST_ITEMS = 64
LONGEST_PERIOD = 4

_TAG = re.compile(r"""<([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Node:
    """An element or, with label `#`, a text slot; `opt` and `rep` make it optional or repeated.

    `loose`: its items come in any order and number, once each in `items`. `span` on the first of several neighbours says
    that they repeat together. A node merged into another points `to` it.
    """

    __slots__ = ("label", "items", "opt", "rep", "loose", "span", "to", "words", "links", "same", "pages", "keep")

    def __init__(self, label: str):
        self.label, self.items, self.opt, self.rep, self.loose, self.span = label, [], False, False, False, 1
        self.to, self.words, self.links, self.same, self.pages, self.keep = None, 0, 0, None, 0, False

    def end(self) -> Node:
        node = self
        while node.to is not None:
            node = node.to
        return node

    def slots(self) -> Iterator[Node]:
        if self.label == "#":
            yield self
        for item in self.items:
            yield from item.slots()


def merge(a: Node, b: Node) -> None:
    """Make `a` accept what `b` accepts: the items are aligned, what only one has becomes optional."""
    b.to, a.opt, a.rep = a, a.opt or b.opt, a.rep or b.rep
    if a.label == "#":
        a.same = a.same if a.pages and b.pages and a.same == b.same else (None if a.pages and b.pages else a.same or b.same)
        a.words, a.links, a.pages = a.words + b.words, a.links + b.links, a.pages + b.pages
    elif a.loose or b.loose:
        loosen(a)
        _put(a, b.items)
    else:
        a.items = fold(align(a.items, b.items))
        if len(a.items) > MOST_ITEMS:
            loosen(a)


def align(x: list[Node], y: list[Node]) -> list[Node]:
    """One sequence that accepts both. At a mismatch each side's label is looked for further on in the other; what lies
    before the nearer find is optional, and without any find both items are."""
    places: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for seen, items in zip(places, (x, y)):
        for at, item in enumerate(items):
            seen[item.label].append(at)

    def ahead(seen: dict, label: str, at: int) -> int | None:
        found = seen.get(label, ())
        k = bisect_left(found, at)
        return found[k] - at if k < len(found) else None

    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i].label == y[j].label:
            merge(x[i], y[j])
            out.append(x[i])
            i, j = i + 1, j + 1
            continue
        in_x, in_y = ahead(places[0], y[j].label, i), ahead(places[1], x[i].label, j)
        only_x = in_x if in_x is not None and (in_y is None or in_x < in_y) else (1 if in_y is None else 0)
        only_y = in_y if in_y is not None and not only_x else (1 if in_x is None and in_y is None else 0)
        for item in x[i : i + only_x] + y[j : j + only_y]:
            item.opt = True
            out.append(item)
        i, j = i + only_x, j + only_y
    for item in x[i:] + y[j:]:
        item.opt = True
        out.append(item)
    return out


def _alike(a: Node, b: Node) -> bool:
    """Whether two neighbours are repetitions of one thing: containers must hold much the same."""
    if a.label != b.label:
        return False
    if a.label in LISTED or "!" in a.label:
        return True
    x, y = {i.label for i in a.items}, {i.label for i in b.items}
    return x == y or 2 * len(x & y) >= len(x | y)


def fold(items: list[Node]) -> list[Node]:
    """Neighbouring repetitions of one to LONGEST_PERIOD items become one repeated group."""
    out: list[Node] = []
    for item in items:
        out.append(item)
        for period in range(1, LONGEST_PERIOD + 1):
            last, before = out[-period:], out[-2 * period : -period]
            if len(before) == period and all(_alike(a, b) for a, b in zip(before, last)):
                del out[-period:]
                for a, b in zip(before, last):
                    merge(a, b)
                    a.rep = True
                before[0].span = period
                break
    return out


def _put(node: Node, items: list[Node]) -> None:
    known = {item.label: item for item in node.items}
    for item in items:
        item.opt = True
        if item.label in known:
            merge(known[item.label], item)
        else:
            known[item.label] = item
            node.items.append(item)


def loosen(node: Node) -> None:
    """From a sequence to a repeated group of optional items, one of each label."""
    if not node.loose:
        items, node.items, node.loose = node.items, [], True
        for item in items:
            item.rep, item.span = True, 1
        _put(node, items)


def label_of(name: str, attributes: str, inside: bool = False) -> tuple[str, bool]:
    """The label of an element, and whether it is noise. Names of classes are part of it, those with digits are not.

    `inside` the main text a header is that of the article.
    """
    classes, hints, main = [], set(), name in MAIN_TAGS
    for kind, a, b, c in _NAMED.findall(attributes) if attributes else ():
        for value in (a or b or c).split():
            parts = {p.lower() for p in _PARTS.findall(value)}
            if kind.lower() == "class" and not any(ch.isdigit() for ch in value):
                classes.append(value)
            if parts.isdisjoint(NEGATIONS):
                hints |= parts
            main |= kind.lower() == "role" and value.lower() == "main"
    if inside:
        hints.discard("header")
    if main:
        noise = not hints.isdisjoint(NOT_MAIN)
    elif name in ("body", "html"):
        noise = False
    else:
        noise = (name in NOISE_TAGS and not (inside and name == "header")) or not hints.isdisjoint(NOISE_WORDS)
    label = name + ("*" if main else "") + ("." + ".".join(classes) if classes and name not in LISTED else "")
    return (label + "!" if noise else label), noise


class Page:
    """A parsed page: `root`, the folded tree, and `blocks`, its texts in order with their slots."""

    def __init__(self, text: str):
        self.root, self.blocks = Node("page"), []
        self._stack: list[tuple[str, Node]] = [("", self.root)]
        self._open: dict[str, int] = defaultdict(int)
        self._buffer: list[tuple[str, bool]] = []
        self._links = self._main = 0
        #: Inline elements that are noise: their text is dropped without ending the block.
        self._inline: list[tuple[str, int]] = []
        self._read(text)
        self._flush()
        while len(self._stack) > 1:
            self._pop()
        self._finish(self.root)

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            tag = text.find("<", at)
            if tag < 0:
                tag = size
            if tag > at and not self._inline:
                self._buffer.append((text[at:tag], self._links > 0))
            if tag == size:
                break
            sign = text[tag + 1 : tag + 2]
            if sign.isascii() and sign.isalpha():
                found = _TAG.match(text, tag)
                if not found:
                    break
                at = found.end()
                name = found[1].lower()
                if name in RAW:
                    closed = _RAW_END[name].search(text, at)
                    at = closed.end() if closed else size
                else:
                    self._start(name, found[2])
            elif sign == "/" and text[tag + 2 : tag + 3].isascii() and text[tag + 2 : tag + 3].isalpha():
                end = text.find(">", tag)
                if end < 0:
                    break
                self._end(re.split(r"[\s/]", text[tag + 2 : end], maxsplit=1)[0].lower())
                at = end + 1
            elif sign and sign in "!?/":
                comment = text.startswith("<!--", tag)
                end = text.find("-->", tag + 2) if comment else text.find(">", tag)
                at = size if end < 0 else end + (3 if comment else 1)
            else:
                if not self._inline:
                    self._buffer.append(("<", self._links > 0))
                at = tag + 1

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "br":
                self._buffer.append((" ", False))
            elif name == "hr":
                self._flush()
            return
        if name not in BLOCKS:
            if name == "a":
                self._links = 1
            if self._inline or (attributes and label_of(name, attributes, self._main > 0)[1]):
                self._inline.append((name, len(self._stack)))
            return
        if name in ("html", "body") and self._open[name]:
            return
        self._flush()
        if self._open["head"] and name != "head":
            self._close_within(("head",), ())
        if self._open["p"]:
            self._close_within(("p",), FENCES)
        if name in CLOSES:
            self._close_within(*CLOSES[name])
        elif name[0] == "h" and name[1:].isdigit() and self._stack[-1][0][:1] == "h" and self._stack[-1][0][1:].isdigit():
            self._pop()
        label, noise = label_of(name, attributes, self._main > 0)
        parent = self._stack[-1][1]
        node = parent
        if len(self._stack) <= MOST_DEPTH or (noise and "!" not in parent.label):
            node = Node(label)
            parent.items.append(node)
        self._stack.append((name, node))
        self._open[name] += 1
        self._main += name in MAIN_TAGS

    def _end(self, name: str) -> None:
        if name == "a":
            self._links = 0
        if any(own == name for own, _ in self._inline):
            while self._inline.pop()[0] != name:
                pass
            return
        if name in BLOCKS and name not in ("html", "body") and self._open[name]:
            self._flush()
            if name == "head":
                self._close_within(("head",), ())
            else:
                self._close_nearest(name, ("table",) if name in TABLE else FENCES)

    def _close_nearest(self, name: str, fences) -> None:
        for at in range(len(self._stack) - 1, 0, -1):
            own = self._stack[at][0]
            if own == name:
                while len(self._stack) > at:
                    self._pop()
                break
            if own in fences:
                break

    def _close_within(self, names: tuple[str, ...], fences) -> None:
        """Close the outermost open element of these names above the last fence."""
        goal = None
        for at in range(len(self._stack) - 1, 0, -1):
            own = self._stack[at][0]
            if own in names:
                goal = at
            elif own in fences:
                break
        while goal is not None and len(self._stack) > goal:
            self._pop()

    def _pop(self) -> None:
        name, node = self._stack.pop()
        self._open[name] -= 1
        self._main -= name in MAIN_TAGS
        while self._inline and self._inline[-1][1] > len(self._stack):
            self._inline.pop()
        if node is not self._stack[-1][1]:
            self._finish(node)

    @staticmethod
    def _finish(node: Node) -> None:
        node.items = fold(node.items)
        if len(node.items) > MOST_ITEMS:
            loosen(node)

    def _flush(self) -> None:
        pieces, self._buffer = self._buffer, []
        if not pieces:
            return
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if not text:
            return
        slot = Node("#")
        slot.pages, slot.words = 1, text.count(" ") + 1
        slot.links = sum(len(html.unescape(p).split()) for p, linked in pieces if linked)
        self._stack[-1][1].items.append(slot)
        self.blocks.append((slot, text))

    def shape(self) -> tuple[list, list[tuple[int, str]], list[tuple[int, int, int]]]:
        """The tree as nested lists, blocks as (number of slot, text), and (words, linked words, hash of text) of each slot."""
        slots = list(self.root.slots())
        number = {id(s): i for i, s in enumerate(slots)}
        blocks = [(number[id(s.end())], text) for s, text in self.blocks]
        hashes = [xxhash.xxh64() for _ in slots]
        for n, text in blocks:
            hashes[n].update(text + "\n")
        return packed(self.root), blocks, [(s.words, s.links, h.intdigest() >> 1) for s, h in zip(slots, hashes)]


def packed(node: Node) -> list:
    """[label, flags, items] for a tree without figures."""
    flags = node.opt + 2 * node.rep + 4 * node.loose + 8 * (node.span - 1)
    return [node.label, flags, [packed(i) for i in node.items]]


def unpacked(data: list) -> Node:
    node = Node(data[0])
    node.opt, node.rep, node.loose, node.span = bool(data[1] & 1), bool(data[1] & 2), bool(data[1] & 4), (data[1] >> 3) + 1
    node.items = [unpacked(i) for i in data[2]]
    return node


def expression(node: Node) -> str:
    """The tree as the union-free regular expression it stands for."""
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[node.opt, node.rep]
    if node.label == "#":
        return "#" + mark
    parts, at = [], 0
    while at < len(node.items):
        group = node.items[at : at + node.items[at].span]
        inner = " ".join(expression(i) for i in group)
        parts.append(f"({inner})+" if len(group) > 1 else inner)
        at += len(group)
    body = " ".join(parts)
    return f"<{node.label}>{f'({body})*' if node.loose else body}</>{mark}"
