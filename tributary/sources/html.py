"""A small document tree and CSS selector matcher over the standard library's HTML parser.

Selectors: tag, ``.class``, ``[attr]``, ``[attr=v]``, ``[attr^=v]``, their compounds,
descendants, and comma lists. Void elements have no children; script and style are raw text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that a following sibling closes.
_CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3"}, "td": {"td", "tr"}, "tr": {"tr"}, "option": {"option"}}


class Node:
    """An element: tag, attributes, and children that are elements or strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def text(self) -> str:
        """All text below, joined."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The document tree of a page."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_PART = re.compile(r"""\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\^?=)["']?(?P<val>[^"'\]]*)["']?)?\]|(?P<tag>[\w-]+)""")
Compound = tuple[tuple[str, ...], ...]


@functools.lru_cache(maxsize=256)
def compile_selector(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """A comma list of chains of compounds."""
    chains = []
    for chain in selector.split(","):
        compounds = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", chain):
            parts = []
            for m in _PART.finditer(word):
                if m["cls"]:
                    parts.append(("class", m["cls"]))
                elif m["attr"]:
                    parts.append((m["op"] or "has", m["attr"], m["val"] or ""))
                else:
                    parts.append(("tag", m["tag"].lower()))
            compounds.append(tuple(parts))
        chains.append(tuple(compounds))
    return tuple(chains)


def _fits(node: Node, compound: Compound) -> bool:
    for p in compound:
        kind = p[0]
        if kind == "tag":
            if node.tag != p[1]:
                return False
        elif kind == "class":
            if p[1] not in node.attrs.get("class", "").split():
                return False
        else:
            v = node.attrs.get(p[1])
            if v is None or kind == "=" and v != p[2] or kind == "^=" and not (p[2] and v.startswith(p[2])):
                return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether an element fits a selector; ancestors anywhere above count."""
    for chain in compile_selector(selector):
        if not _fits(node, chain[-1]):
            continue
        up, left = node.parent, len(chain) - 2
        while left >= 0 and up is not None:
            if _fits(up, chain[left]):
                left -= 1
            up = up.parent
        if left < 0:
            return True
    return False


def select(node: Node, selector: str) -> Iterator[Node]:
    """Descendants that fit, in document order."""
    return (n for n in node.walk() if matches(n, selector))


def first(node: Node, selector: str) -> Node | None:
    return next(select(node, selector), None)
