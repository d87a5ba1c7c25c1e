"""A small namespace-aware XML tree; documents that declare entities are refused."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat


class XmlError(ValueError):
    pass


class Node:
    """name is (namespace, local name); attributes without a prefix are in attrs by name, others by (namespace, name).

    content holds strings and nodes in document order.
    """

    __slots__ = ("ns", "name", "attrs", "content")

    def __init__(self, ns: str, name: str, attrs: dict):
        self.ns, self.name, self.attrs, self.content = ns, name, attrs, []

    def nodes(self) -> Iterator[Node]:
        return (x for x in self.content if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.content) if isinstance(x, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.content))
        return "".join(out)

    def get(self, name: str, ns: str | None = None, default: str | None = None) -> str | None:
        return self.attrs.get((ns, name) if ns else name, default)


def _split(name: str) -> tuple[str, str]:
    ns, _, local = name.rpartition("\n")
    return ns, local


def parse(data: bytes, part: str) -> Node:
    """The root of an XML part; part names it in errors."""
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.buffer_text = True
    root = Node("", "", {})
    stack = [root]

    def start(name, attrs):
        node = Node(*_split(name), {(_split(k) if "\n" in k else k): v for k, v in attrs.items()})
        stack[-1].content.append(node)
        stack.append(node)

    def refuse(*_):
        raise XmlError(f"{part} declares XML entities")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda s: stack[-1].content.append(s)
    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise XmlError(f"{part} is not well-formed XML: {e}") from None
    return next(root.nodes())
