"""HTML to GitHub-Flavored Markdown: headings, paragraphs, emphasis, links, images, lists, tables, code, quotes, rules."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = {"br", "img", "hr", "meta", "link", "input", "col"}
_BLOCK = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "blockquote", "pre", "hr", "body", "html", "figure", "dl", "dt", "dd"}
_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_ESCAPE = re.compile(r"([\\`*_\[\]<>~])")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("root", {}, [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "td", "th", "tr"):
            self._close_open(tag)
        node = (tag, dict(attrs), [])
        self.stack[-1][2].append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def _close_open(self, tag):
        stops = {"p": _BLOCK - {"p"}, "li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead"}}[tag]
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag or tag in ("td", "th") and self.stack[k][0] in ("td", "th"):
                del self.stack[k:]
                return
            if self.stack[k][0] in stops:
                return

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def markdown(html: str) -> str:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    text = "\n\n".join(_blocks(tree.root[2]))
    return text + "\n" if text else ""


def _blocks(nodes: list) -> list[str]:
    """The blocks of a container; runs of inline content between them are paragraphs."""
    out, line = [], []

    def flush():
        text = _squeezed(_inline(line))
        if text:
            out.append(_unblocked(text))
        line.clear()

    for x in nodes:
        if isinstance(x, str) or x[0] not in _BLOCK:
            if not (not isinstance(x, str) and x[0] in ("head", "style", "script", "title")):
                line.append(x)
            continue
        flush()
        tag, _, inner = x
        if tag[0] == "h" and tag[1:].isdigit():
            out.append(f"{'#' * int(tag[1])} {_squeezed(_inline(inner)).replace(chr(10), ' ')}")
        elif tag in ("ul", "ol"):
            out.append(_list(x))
        elif tag == "table":
            out.append(_table(x))
        elif tag == "pre":
            body = _text(inner).strip("\n")
            mark = "`" * max([3, *(len(m) + 1 for m in re.findall("`+", body))])
            out.append(f"{mark}\n{body}\n{mark}")
        elif tag == "blockquote":
            out.append("\n".join(f"> {y}".rstrip() for y in "\n\n".join(_blocks(inner)).split("\n")))
        elif tag == "hr":
            out.append("---")
        else:
            out += _blocks(inner)
    flush()
    return [b for b in out if b]


def _list(node) -> str:
    tag, attrs, inner = node
    items = [x for x in inner if not isinstance(x, str) and x[0] == "li"]
    start = int(attrs["start"]) if (attrs.get("start") or "").isdigit() else 1
    texts, loose = [], False
    for k, (_, _, body) in enumerate(items):
        mark = f"{start + k}. " if tag == "ol" else "- "
        blocks = _blocks(body)
        loose |= sum(not isinstance(x, str) and x[0] == "p" for x in body) > 0
        tight = not any(not isinstance(x, str) and x[0] == "p" for x in body)
        text = ("\n" if tight else "\n\n").join(blocks)
        pad = " " * len(mark)
        texts.append(mark + "\n".join(pad + y if y and j else y for j, y in enumerate(text.split("\n"))))
    return ("\n\n" if loose else "\n").join(texts)


def _table(node) -> str:
    rows = []

    def walk(nodes):
        for x in nodes:
            if isinstance(x, str):
                continue
            if x[0] == "tr":
                rows.append([_squeezed(_inline(c[2])).replace("|", "\\|").replace("  \n", "<br>").replace("\n", " ") for c in x[2] if not isinstance(c, str) and c[0] in ("td", "th")])
            else:
                walk(x[2])

    walk(node[2])
    if not rows:
        return ""
    wide = max(1, *map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]])


def _text(nodes: list) -> str:
    return "".join(x if isinstance(x, str) else "\n" if x[0] == "br" else _text(x[2]) for x in nodes)


def _inline(nodes: list) -> str:
    out = []
    for x in nodes:
        if isinstance(x, str):
            out.append(_ESCAPE.sub(r"\\\1", re.sub(r"[ \t\r\n]+", " ", x)))
            continue
        tag, attrs, inner = x
        if tag == "br":
            out.append("  \n")
        elif tag == "img":
            out.append(f"![{_ESCAPE.sub(r'\\\1', attrs.get('alt') or '')}]({_target(attrs.get('src') or '')})")
        elif tag == "a" and attrs.get("href"):
            out.append(f"[{_inline(inner).strip()}]({_target(attrs['href'])})")
        elif tag in ("code", "tt"):
            body = _text(inner)
            mark = "`" * (max([0, *map(len, re.findall("`+", body))]) + 1)
            out.append(f"{mark} {body} {mark}" if body.startswith("`") or body.endswith("`") else f"{mark}{body}{mark}")
        elif tag in _WRAP:
            body = _inline(inner)
            core = body.strip()
            lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
            out.append(f"{lead}{_WRAP[tag]}{core}{_WRAP[tag]}{tail}" if core else body)
        else:
            out.append(_inline(inner))
    return "".join(out)


def _target(href: str) -> str:
    return f"<{href}>" if re.search(r"[\s()]", href) else href


def _squeezed(text: str) -> str:
    text = re.sub(r"(?<! ) *\n *", lambda m: "  \n", text) if "\n" in text else text
    return re.sub(r" {2,}(?!\n)", " ", text).strip()


def _unblocked(text: str) -> str:
    """A paragraph whose start would be read as another block is escaped."""
    return re.sub(r"(?m)^(?:([#+-]|=+$)(?=\s|$)|(\d{1,9})([.)])(?=\s|$))", lambda m: f"\\{m[1]}" if m[1] else f"{m[2]}\\{m[3]}", text)
