"""A small element tree over html.parser, with the selectors that page extractors need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_STEP = re.compile(r"(?P<tag>[a-z][a-z0-9]*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:(\*?)=\"?([^\"\]]*)\"?)?\]")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)

    def text(self, joint: str = "", strip: bool = False) -> str:
        """Its strings joined; with strip, each is stripped and empty ones are left out."""
        found = list(self.strings())
        return joint.join([s for s in map(str.strip, found) if s] if strip else found)

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def find(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next(self.find_all(*tags, where=where), None)

    def find_all(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n)))

    def select(self, selector: str) -> list[Node]:
        """Elements that match any of the comma-separated chains of descendants (tag, .class, #id, [attribute], [attribute="x"], [attribute*="x"]), in document order."""
        chains = [[_step(s) for s in chain.split()] for chain in selector.split(",")]
        return [n for n in self.walk() if any(_matches(n, c, self) for c in chains)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


def _step(text: str) -> Callable[[Node], bool]:
    m = _STEP.match(text)
    if not m:
        raise ValueError(f"unknown selector: {text}")
    tag, parts = m["tag"], _PART.findall(m["rest"])

    def test(n: Node) -> bool:
        if tag and n.tag != tag:
            return False
        for mark, name, attribute, part, value in parts:
            if mark == "." and name not in n.classes or mark == "#" and n.attrs.get("id") != name:
                return False
            if attribute and (attribute not in n.attrs or (value and (value not in n.attrs[attribute] if part else n.attrs[attribute] != value))):
                return False
        return True

    return test


def _matches(n: Node, chain: list[Callable[[Node], bool]], root: Node) -> bool:
    if not chain[-1](n):
        return False
    above, left = n.parent, len(chain) - 2
    while left >= 0:
        if above is None or above is root:
            return False
        if chain[left](above):
            left -= 1
        above = above.parent
    return True


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
