"""Image references in HTML: made safe, named in order of first occurrence, and rewritten."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlparse

#: Fixed value: what an image's source is. Groups: what is before it, the source, what ends it.
IMAGE = r"""(<img\b[^>]*\bsrc\s*=\s*["'])([^"']+)(["'])"""
_IMAGE = re.compile(IMAGE, re.I)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


class UnsafeReference(ValueError):
    def __init__(self, reference: str):
        super().__init__(f"The generated document contains an unsafe image reference: {reference}")


def resolved(reference: str) -> str:
    """The name inside the document's own files; raises UnsafeReference for anything that leads elsewhere."""
    plain = reference.replace("&amp;", "&")
    if plain.lower().startswith("file:"):
        return unquote(urlparse(plain).path).rpartition("/")[2]
    if _SCHEME.match(plain):
        raise UnsafeReference(reference)
    name = re.sub("/+", "/", re.sub(r"^(\./)+", "", unquote(plain)))
    name = name[:-1] if len(name) > 1 and name.endswith("/") else name
    if not name or name.startswith("/") or "\\" in name or {".", ".."} & {*name.split("/")}:
        raise UnsafeReference(reference)
    return name


def rewrite(html: str, files: dict[str, bytes]) -> tuple[str, dict[str, bytes], set[str]]:
    """(html, assets by new name, names that are referred to). Each file gets one name: image01.png, image02.jpg ..."""
    named: dict[str, str] = {}
    assets: dict[str, bytes] = {}

    def place(m: re.Match) -> str:
        name = resolved(m[2])
        if name not in files:
            raise UnsafeReference(m[2])
        if name not in named:
            suffix = name.rpartition("/")[2].rpartition(".")
            named[name] = f"image{len(named) + 1:02d}" + (f".{suffix[2].lower()}" if suffix[1] else "")
            assets[f"images/{named[name]}"] = files[name]
        return f"{m[1]}images/{quote(named[name])}{m[3]}"

    return _IMAGE.sub(place, html), assets, {*named}
