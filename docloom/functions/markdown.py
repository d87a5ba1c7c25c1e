"""Markdown text as it comes from a converter, made plain: a state machine over the lines of one document."""

from __future__ import annotations

import re

_BLANK = re.compile(r"[ \t]*")
_INDENT = re.compile(r"[ \t]*")
_MARKER = re.compile(r"[ \t]*((?:[-*+]|[0-9]{1,9}[.)])[ \t]+)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.S)
_RULE = re.compile(r"([ \t]*)((?:\\_){3,})")
_HYPHEN = re.compile(r"([ \t]*)\\-")
#: What is trimmed: tabs and the spaces of Unicode.
_SPACES = "\t \u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def width(indent: str) -> int:
    """Columns of an indentation; a tab is always four."""
    return len(indent) + 3 * indent.count("\t")


def is_blank(line: str) -> bool:
    return _BLANK.fullmatch(line) is not None


def opening_fence(line: str) -> str | None:
    m = _FENCE.fullmatch(line)
    return m[1] if m and not (m[1][0] == "`" and "`" in m[2]) else None


def closes(line: str, fence: str) -> bool:
    m = _FENCE.fullmatch(line)
    return bool(m) and m[1][0] == fence[0] and len(m[1]) >= len(fence) and is_blank(m[2])


def code_lines(lines: list[str]) -> list[bool]:
    """Which lines are code: fenced, or indented by four beyond the list item they are in, with the blanks between."""
    code = [False] * len(lines)
    fence, items, last_code, run = None, [], -1, []
    for i, line in enumerate(lines):
        if fence:
            code[i] = True
            if closes(line, fence):
                fence = None
        elif is_blank(line):
            run.append(i)
            continue
        else:
            indent = width(_INDENT.match(line)[0])
            items = [x for x in items if x <= indent] if items and indent < items[-1] else items
            inside = items[-1] if items else 0
            if indent >= inside + 4:
                code[i] = True
            elif found := opening_fence(line):
                code[i], fence = True, found
            elif m := _MARKER.match(line):
                items = [*items, indent + len(m[1])]
        if run and code[i] and last_code == run[0] - 1 and last_code >= 0:
            for k in run:
                code[k] = True
        run = []
        if code[i]:
            last_code = i
    return code


def plain_line(line: str, following: str | None) -> str:
    """One line that is not code; the first rule that fits holds."""
    indent = _INDENT.match(line)[0]
    if line.translate({42: None, 95: None}).strip(_SPACES) == "•":
        return indent + "-"
    if (len(line) - len(line.rstrip("\\"))) % 2:
        body = line[:-1]
        if not body.strip(_SPACES).strip("*_"):
            return "  "
        layout = following is None or is_blank(following) or _MARKER.match(following)
        return body.rstrip(" \t") + ("" if layout else "  ")
    if m := _RULE.fullmatch(line):
        return m[1] + "_" * (len(m[2]) // 2)
    return _HYPHEN.sub(r"\1-", line, count=1) if _HYPHEN.match(line) else line


def compact(lines: list[str], code: list[bool]) -> list[str]:
    """Without the empty lines beside a line of blanks alone, and those between two lone hyphens."""
    soft = lambda x: x != "" and is_blank(x)
    out: list[str] = []
    for i, line in enumerate(lines):
        if line == "" and not code[i] and out and i + 1 < len(lines):
            before, after = out[-1], lines[i + 1]
            if soft(before) or soft(after) or before.strip(_SPACES) == after.strip(_SPACES) == "-":
                continue
        out.append(line)
    return out


def normalized(markdown: str) -> str:
    """Hard breaks as two spaces, plain bullets, rules and hyphens, compact blanks; code stays; one final line end."""
    text = markdown.replace("\r\n", "\n")
    final = text.endswith("\n")
    lines = text.removesuffix("\n").split("\n")
    code = code_lines(lines)
    plain = [x if c else plain_line(x, lines[i + 1] if i + 1 < len(lines) else None) for i, (x, c) in enumerate(zip(lines, code))]
    out = "\n".join(compact(plain, code))
    return out + "\n" if final else out
