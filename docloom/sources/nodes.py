"""XML parts of packages as a table of elements, each with the interval of places that its subtree has."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import refs
from docloom.sources.convert import ERRORS
from docloom.sources.engine import _pass
from docloom.sources.zipgate import open_package

NODES = "path string, part string, pre int, last int, depth int, ns string, name string, attrs map<string,string>, text string, error string"


def elements(data: bytes, part: str) -> Iterator[dict]:
    """A row for each element, as it ends: pre is its place among the starts, last that of the last element in it.

    attrs: values by name, of those with a namespace by {namespace}name. text: what stands in the element itself. No tree
    is built; open elements alone are held. A part that is malformed, or declares entities, ends in a row with an error.
    """
    rows: list[dict] = []
    open_: list[dict] = []
    count = 0

    def split(name: str) -> tuple[str, str]:
        ns, _, local = name.rpartition("\n")
        return ns, local

    def start(name: str, attrs: dict) -> None:
        nonlocal count
        ns, local = split(name)
        named = {("{%s}%s" % split(k) if "\n" in k else k): v for k, v in attrs.items()}
        open_.append({"part": part, "pre": count, "depth": len(open_), "ns": ns, "name": local, "attrs": named, "text": []})
        count += 1

    def end(_: str) -> None:
        row = open_.pop()
        rows.append({**row, "last": count - 1, "text": "".join(row["text"])})

    def refuse(*_) -> None:
        raise ValueError(f"{part} declares XML entities")

    parser = expat.ParserCreate(namespace_separator="\n")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, refuse
    parser.CharacterDataHandler = lambda s: open_[-1]["text"].append(s)
    try:
        for k in range(0, len(data), 1 << 16):
            parser.Parse(data[k : k + (1 << 16)], False)
            yield from rows
            rows.clear()
        parser.Parse(b"", True)
        yield from rows
    except (expat.ExpatError, ValueError) as e:
        yield from rows
        yield {"part": part, "error": str(e) if isinstance(e, ValueError) else f"{part} is not well-formed XML: {e}"}


def xml_nodes(files: DataFrame, parts: str) -> DataFrame:
    """NODES of the packages' parts whose whole name fits the pattern; packages that can't be read have a row with an error.

    Only packages are looked at, and of these only the named parts are inflated.
    """
    wanted = re.compile(parts)
    zips = files.where((refs.signature(F.col("content")) == "zip") | F.col("content").isNull())

    def rows(path: str, content: bytes) -> list[dict]:
        try:
            package = open_package(content)
            return [{"path": path, **x} for name in package.names if wanted.fullmatch(name) for x in elements(package.part(name), name)]
        except ERRORS as e:
            return [{"path": path, "error": str(e)}]

    return _pass(zips, NODES, rows, lambda path, why: {"path": path, "error": why})
