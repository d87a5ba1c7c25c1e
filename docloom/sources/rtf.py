"""Rich text as HTML: paragraphs, emphasis, breaks, tables, pictures; and what colours would be lost."""

from __future__ import annotations

import re
from html import escape
from urllib.parse import quote

HEADER = re.compile(rb"\{\\rtf[0-9]")
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
#: Groups whose text is not the document's.
_SKIPPED = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"generator", b"header", b"footer", b"headerl", b"headerr", b"footerl", b"footerr", b"listtable", b"listoverridetable", b"rsidtbl", b"themedata", b"fldinst", b"xmlnstbl", b"datastore", b"latentstyles"}
_MARKS = {b"b": "strong", b"i": "em", b"strike": "del"}
_CHARS = {b"tab": " ", b"emdash": "—", b"endash": "–", b"bullet": "•", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"~": " ", b"_": "‑"}
_PICTURES = {b"pngblip": "png", b"jpegblip": "jpg"}
#: Largest difference of colour components (0 to 255) that still counts as grey.
GREY = 5
#: A mark of a run that is not an element.
COLOUR = "=="


def colours(data: bytes) -> list[tuple[int, int, int]]:
    table = re.search(rb"\{\\colortbl([^{}]*)\}", data)
    entries = table[1].split(b";")[:-1] if table else []
    part = lambda e, name: int(m[1]) if (m := re.search(rb"\\" + name + rb"(\d+)", e)) else 0
    return [(part(e, b"red"), part(e, b"green"), part(e, b"blue")) for e in entries]


def loses_colour(data: bytes) -> bool:
    """Whether text is set in, or upon, a colour that is not grey."""
    table = colours(data)
    bright = {i for i, c in enumerate(table) if max(c) - min(c) > GREY}
    return any(int(n) in bright for n in re.findall(rb"\\(?:highlight|chcbpat|cb|cf)(\d+)", data))


def rtf_html(data: bytes, mark_colours: bool = False, attachments: dict[str, bytes] | None = None) -> tuple[str, dict[str, bytes]]:
    """(HTML, pictures by name). mark_colours: text in a colour that is not grey stands between == marks, line by line.

    attachments: files of a folder package; those that the text shows are among the pictures.
    """
    bright = {i for i, c in enumerate(colours(data)) if max(c) - min(c) > GREY} if mark_colours else set()
    attachments = attachments or {}
    files: dict[str, bytes] = {}
    paragraphs: list[str] = []
    rows: list[list[str]] = []
    row: list[str] = []
    runs: list[tuple[frozenset, str]] = []
    state = {"marks": frozenset(), "skip": False, "uc": 1, "picture": None}
    stack: list[dict] = []
    drop, fresh, graphic, at = 0, False, False, 0

    def text(s: str) -> None:
        if not state["skip"]:
            runs.append((state["marks"], s))

    def taken() -> str:
        out = shown = ""

        def settle() -> str:
            core = shown.strip()
            at = shown.find(core)
            return f"{shown[:at]}=={core}=={shown[at + len(core) :]}" if core else shown

        for marks, s in _joined(runs):
            body = s if s.startswith("<") else escape(s, quote=False)
            for m in sorted(marks - {COLOUR}):
                body = f"<{m}>{body}</{m}>" if body.strip() else body
            if COLOUR in marks and not s.startswith("<"):
                shown += body
            else:
                out, shown = out + settle() + body, ""
        runs.clear()
        return out + settle()

    def end_table() -> None:
        if rows:
            paragraphs.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
            rows.clear()

    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        word, number, byte, symbol, brace, plain = m.groups()
        if brace == b"{":
            stack.append(dict(state))
            fresh = True
            continue
        if brace == b"}":
            if state["picture"] and (stack and not stack[-1]["picture"]):
                kind, body = state["picture"]
                name = f"picture{len(files) + 1}.{kind}"
                files[name] = bytes.fromhex(re.sub(rb"[^0-9a-fA-F]", b"", b"".join(body)).decode()[: 2 * (sum(map(len, body)) // 2)])
                runs.append((frozenset(), f'<img src="{name}" alt="">'))
            state = stack.pop() if stack else state
        elif word == b"bin":
            at += int(number or 0)
        elif word in _SKIPPED or symbol == b"*" and fresh:
            state["skip"] = True
        elif word == b"pict":
            state["skip"] = True
        elif word in _PICTURES:
            state["picture"] = _PICTURES[word], []
        elif word in _MARKS:
            state["marks"] = state["marks"] - {_MARKS[word]} if number == b"0" else state["marks"] | {_MARKS[word]}
        elif word == b"cf" and bright:
            state["marks"] = state["marks"] | {COLOUR} if int(number or 0) in bright else state["marks"] - {COLOUR}
        elif word == b"NeXTGraphic":
            graphic = True
        elif word in (b"plain", b"pard"):
            state["marks"] = frozenset() if word == b"plain" else state["marks"]
        elif word == b"uc":
            state["uc"] = int(number or 1)
        elif word == b"u":
            text(chr(int(number or 0) % 65536))
            drop = state["uc"]
        elif word in (b"par", b"sect", b"page") or symbol in (b"\n", b"\r"):
            end_table()
            paragraphs.append(f"<p>{taken()}</p>")
        elif word == b"line":
            runs.append((frozenset(), "<br>"))
        elif word == b"cell":
            row.append(taken())
        elif word == b"row":
            rows.append(row)
            row = []
        elif word in _CHARS or symbol in _CHARS:
            text(_CHARS[word or symbol])
        elif byte:
            if drop:
                drop -= 1
            else:
                text(bytes([int(byte, 16)]).decode("cp1252", "replace"))
        elif symbol in (b"\\", b"{", b"}"):
            text(symbol.decode())
        elif plain:
            if state["picture"]:
                state["picture"][1].append(plain)
            if graphic:  # the name of an attachment; the character that stands for it comes after the group
                name = plain.decode("utf-8", "replace").strip()
                if name in attachments:
                    files[name] = attachments[name]
                    runs.append((frozenset(), f'<img src="{escape(quote(name))}" alt="">'))
                graphic, drop = False, 1
                continue
            if drop:
                plain, drop = plain[drop:], max(0, drop - len(plain))
            text(plain.decode("cp1252", "replace"))
        fresh = False
    end_table()
    if runs:
        paragraphs.append(f"<p>{taken()}</p>")
    return _paired("".join(p for p in paragraphs if p != "<p></p>")), files


def _paired(text: str) -> str:
    """UTF-16 halves that \\u gave one after the other become their character; a half alone becomes U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _joined(runs):
    """Neighbouring runs with the same marks are one."""
    out: list[list] = []
    for marks, s in runs:
        if out and out[-1][0] == marks and not s.startswith("<") and not out[-1][1].startswith("<"):
            out[-1][1] += s
        else:
            out.append([marks, s])
    return out
