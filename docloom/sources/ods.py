"""Workbooks in OpenDocument packages."""

from __future__ import annotations

from docloom.sources.workbook import EMPTY, MAX_CELLS, MAX_COLUMNS, MAX_ROWS, MAX_SHEETS, MAX_TEXT, Budget, Cell, Keep, Sheet, Workbook, WorkbookError, every, utf8
from docloom.sources.xmltree import Node, parse
from docloom.sources.zipgate import Package

#: Namespaces and the package's type.
OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
TABLE = "urn:oasis:names:tc:opendocument:xmlns:table:1.0"
TEXT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
DRAW = "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"
CHART = "urn:oasis:names:tc:opendocument:xmlns:chart:1.0"
MIMETYPE = "application/vnd.oasis.opendocument.spreadsheet"
#: value-type -> type of the cell
VALUE_TYPES = {"float": "number", "currency": "number", "percentage": "number", "boolean": "boolean", "date": "date", "time": "date"}

_CELLS = ("table-cell", "covered-table-cell")


def _count(node: Node, name: str, limit: int) -> int:
    text = node.get(name, TABLE, "1")
    if not text.isdigit() or not 0 < int(text) <= limit:
        raise WorkbookError("a repeated row or column count exceeds its budget")
    return int(text)


def paragraph(node: Node) -> str:
    """A paragraph's text, with its breaks, tabs and repeated spaces."""
    out = []
    for x in node.content:
        if isinstance(x, str):
            out.append(x)
        elif (x.ns, x.name) == (TEXT, "line-break"):
            out.append("\n")
        elif (x.ns, x.name) == (TEXT, "tab"):
            out.append("\t")
        elif (x.ns, x.name) == (TEXT, "s"):
            n = x.get("c", TEXT, "1")
            out.append(" " * min(MAX_COLUMNS, max(1, int(n) if n.isdigit() else 1)))
        else:
            out.append(paragraph(x))
    return "".join(out)


def _paragraphs(node: Node) -> list[Node]:
    """Paragraphs of a cell in document order; none inside another."""
    out = []
    for x in node.nodes():
        if (x.ns, x.name) == (TEXT, "p"):
            out.append(x)
        elif (x.ns, x.name) != (TABLE, "table"):
            out += _paragraphs(x)
    return out


def read_cell(node: Node, book: Workbook) -> Cell:
    kind = node.get("value-type", OFFICE)
    raw = next((v for a in ("value", "string-value", "date-value", "time-value", "boolean-value") if (v := node.get(a, OFFICE)) is not None), None)
    formula = node.get("formula", TABLE)
    display = "\n".join(map(paragraph, _paragraphs(node))) or raw or ""
    if any((node.get(f"number-{x}-spanned", TABLE) or "1") not in ("", "0", "1") for x in ("columns", "rows")):
        book.merges = True
    if formula is not None and not display:
        book.missing_results = True
    for x in node.walk():
        if x.ns in (DRAW, CHART) or (x.ns, x.name) in ((OFFICE, "annotation"), (TEXT, "a"), (TABLE, "table")):
            book.unsupported = True
    if kind in VALUE_TYPES:
        typed = VALUE_TYPES[kind]
        value = str((raw or display).lower() == "true").lower() if typed == "boolean" else raw or display
        return Cell(typed, value, display, formula)
    return Cell("string", display, display, formula) if display else Cell(formula=formula)


def _rows(node: Node):
    """Row elements in order, through groups and headers, not through nested tables."""
    for x in node.nodes():
        if (x.ns, x.name) == (TABLE, "table-row"):
            yield x
        elif x.ns == TABLE and x.name != "table":
            yield from _rows(x)


def read_row(node: Node, book: Workbook, text: Budget, times: int) -> list[Cell]:
    """One row; a run of empty cells is laid out only when something follows it, covered cells always."""
    row: list[Cell] = []
    waiting = 0
    for x in node.nodes():
        if x.ns != TABLE or x.name not in _CELLS:
            continue
        n = _count(x, "number-columns-repeated", MAX_COLUMNS)
        covered = x.name == "covered-table-cell"
        cell = EMPTY if covered else read_cell(x, book)
        if len(row) + waiting + n > MAX_COLUMNS:
            raise WorkbookError("a spreadsheet row exceeds the column budget")
        if cell.blank and not covered:
            waiting += n
            continue
        text.spend((utf8(cell.display) + utf8(cell.formula)) * n * times)
        row += [EMPTY] * waiting + [cell] * n
        waiting = 0
    return row


def read_ods(package: Package, cells: int = MAX_CELLS, limit: int = MAX_TEXT, keep: Keep = every) -> Workbook:
    """All tables in order; those that aren't kept have their place and name, but no cells."""
    root = parse(package.part("content.xml", None), "content.xml")
    if (root.ns, root.name) != (OFFICE, "document-content"):
        raise WorkbookError("content.xml has no valid OpenDocument content root")
    book = Workbook()
    left, text = Budget(cells, "the spreadsheet exceeds the expanded-cell budget"), Budget(limit, "the spreadsheet exceeds the materialized-text budget")
    bodies = [s for b in root.nodes() if (b.ns, b.name) == (OFFICE, "body") for s in b.nodes() if (s.ns, s.name) == (OFFICE, "spreadsheet")]
    for body in bodies:
        for table in body.nodes():
            if (table.ns, table.name) != (TABLE, "table"):
                continue
            if len(book.sheets) >= MAX_SHEETS:
                raise WorkbookError("the workbook contains too many sheets")
            sheet = Sheet(table.get("name", TABLE) or f"Sheet {len(book.sheets) + 1}")
            if any(x.ns in (DRAW, CHART) for x in table.nodes()) or any((x.ns, x.name) == (TABLE, "shapes") for x in table.nodes()):
                book.unsupported = True
            if not keep(len(book.sheets), sheet.name):
                book.sheets.append(sheet)
                continue
            waiting = 0
            book.parsed += 1
            for node in _rows(table):
                times = _count(node, "number-rows-repeated", MAX_ROWS)
                row = read_row(node, book, text, times)
                if len(sheet.rows) + waiting + times > MAX_ROWS:
                    raise WorkbookError("a spreadsheet sheet exceeds the row budget")
                if not row:
                    waiting += times
                    continue
                left.spend(len(row) * times)
                sheet.rows += [[]] * waiting + [row] * times
                waiting = 0
            book.sheets.append(sheet)
    if not book.sheets:
        raise WorkbookError("content.xml contains no spreadsheet sheets")
    return book
