"""Targets of Markdown links, rewritten where a link really is one: not in code, not after an escape."""

from __future__ import annotations

import re

from docloom.functions.markdown import closes, is_blank, opening_fence

_QUOTE = re.compile(r" {0,3}>[ \t]?")
_MARKER = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?=[ \t]|$)")
_HEAD = re.compile(r" {0,3}(?:#{1,6}(?:[ \t]|$)|(?:[*_-][ \t]*){3,}$)")
_TICKS = re.compile(r"`+")


def columns(text: str, start: int = 0) -> int:
    """Columns of leading blanks; tabs go to the next stop of four."""
    at = start
    for ch in text:
        if ch == "\t":
            at += 4 - at % 4
        elif ch == " ":
            at += 1
        else:
            break
    return at - start


def _blocks(lines: list[str]) -> list[tuple[int, int, bool]]:
    """(first, end, is_code) runs of lines: paragraphs with the lines that go on in them, and code."""
    out: list[tuple[int, int, bool]] = []
    fence, fence_depth, items = None, 0, []
    start, paragraph = 0, False
    for i, line in enumerate(lines):
        body, depth = line, 0
        while m := _QUOTE.match(body):
            body, depth = body[m.end() :], depth + 1
        if fence:
            if depth < fence_depth:
                fence = None
            else:
                if closes(body.lstrip() if items else body, fence):
                    fence = None
                out.append((i, i + 1, True))
                continue
        if is_blank(body):
            paragraph = False
            continue
        indent = columns(body)
        items = [x for x in items if x <= indent] if not paragraph or _MARKER.match(body) else items
        inside = items[-1] if items else 0
        if not paragraph and indent >= inside + 4:
            out.append((i, i + 1, True))
            continue
        rest = body.lstrip(" \t")
        while m := _MARKER.match(rest):
            after = rest[m.end() :]
            gap = columns(after)
            items = [*items, indent + m.end() + (gap if 1 <= gap <= 4 else 1)]
            indent, rest, paragraph = items[-1], after.lstrip(" \t"), False
            if gap > 4:
                rest = ""
        if found := opening_fence(rest):
            fence, fence_depth, paragraph = found, depth, False
            out.append((i, i + 1, True))
            continue
        if paragraph and not _HEAD.match(rest):
            out[-1] = (start, i + 1, False)
        else:
            start = i
            out.append((i, i + 1, False))
        paragraph = bool(rest) and not _HEAD.match(rest)
    return out


def rewritten(markdown: str, old: str, new: str) -> str:
    """Links and images whose whole destination is `old`, plain or in angle brackets, have `new` instead; titles stay."""
    lines = markdown.split("\n")
    for first, end, code in _blocks(lines):
        if not code:
            lines[first:end] = _inline("\n".join(lines[first:end]), old, new).split("\n")
    return "\n".join(lines)


def _inline(text: str, old: str, new: str) -> str:
    """A destination follows a bracket that closes one opened before it; the path must end where the destination does."""
    destination = re.compile(rf"\]\((?:(<){re.escape(old)}(?=>)|{re.escape(old)}(?=[)\s]))")
    out, at, depth = [], 0, 0
    while at < len(text):
        ch, stop = text[at], at + 1
        if ch == "\\":
            stop = at + 2
        elif ch == "`":
            run = _TICKS.match(text, at)[0]
            close = next((m for m in _TICKS.finditer(text, at + len(run)) if len(m[0]) == len(run)), None)
            stop = close.end() if close else at + len(run)
        elif ch == "[":
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
            if m := destination.match(text, at):
                out.append(f"]({m[1] or ''}{new}")
                at = m.end()
                continue
        out.append(text[at:stop])
        at = stop
    return "".join(out)
