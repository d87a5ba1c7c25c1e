"""One workbook or master document as Markdown text, with the output budget checked while it grows."""

from __future__ import annotations

import re

from docloom.sources.workbook import Sheet, Workbook, WorkbookError

MAX_OUTPUT = 134_217_728


class Output:
    def __init__(self, limit: int):
        self.parts, self.left = [], limit

    def add(self, text: str) -> None:
        self.left -= len(text.encode("utf-8", "surrogatepass"))
        if self.left < 0:
            raise WorkbookError("the spreadsheet output exceeds the supported size limit")
        self.parts.append(text)


def one_line(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", " ", text)


def gfm_cell(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", "<br>", text.replace("\\", "\\\\").replace("|", "\\|"))


def tsv_cell(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", r"\\n", text.replace("\\", "\\\\")).replace("\t", "\\t")


def unescaped_tsv(cell: str) -> str:
    """What tsv_cell() was given, with its line ends as LF."""
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), cell)


def _shape(sheet: Sheet) -> int:
    return max([1, *map(len, sheet.rows)])


def _table(sheet: Sheet, out: Output) -> None:
    wide = _shape(sheet)
    for n, row in enumerate(sheet.rows):
        cells = [gfm_cell(c.display) for c in row] + [""] * (wide - len(row))
        out.add(("\n" if n else "") + "| " + " | ".join(cells) + " |")
        if n == 0:
            out.add("\n| " + " | ".join(["---"] * wide) + " |")


def _block(sheet: Sheet, out: Output) -> None:
    wide = _shape(sheet)
    body = Output(out.left)
    longest = 0
    for row in sheet.rows:
        line = "\t".join([tsv_cell(c.display) for c in row] + [""] * (wide - len(row)))
        longest = max([longest, *map(len, re.findall("`+", line))])
        body.add(line + "\n")
    mark = "`" * max(3, longest + 1)
    out.add(mark + "tsv\n")
    for part in body.parts:
        out.add(part)
    out.add(mark)


def workbook(book: Workbook, stem: str, rendering: str = "table", limit: int = MAX_OUTPUT) -> str:
    """rendering: table (GitHub-Flavored) or tsv (a fenced block that can be read back)."""
    out = Output(limit)
    out.add(f"# {one_line(stem)}")
    for sheet in book.sheets:
        out.add(f"\n\n## Sheet: {one_line(sheet.name)}\n\n")
        if not any(sheet.rows):
            out.add("_Empty sheet._")
        elif rendering == "tsv":
            _block(sheet, out)
        else:
            _table(sheet, out)
    out.add("\n")
    return "".join(out.parts)
