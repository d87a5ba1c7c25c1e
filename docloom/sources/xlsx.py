"""Workbooks in Office Open XML packages."""

from __future__ import annotations

import re

from docloom.sources.workbook import EMPTY, MAX_CELLS, MAX_COLUMNS, MAX_ROWS, MAX_SHEETS, MAX_STRINGS, MAX_TEXT, Budget, Cell, Keep, Sheet, Workbook, WorkbookError, every, trimmed, utf8
from docloom.sources.xmltree import Node, parse
from docloom.sources.zipgate import Package

#: Namespaces, content type, relationship types, entries of what cannot be shown.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
METADATA = ("[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels")
OBJECTS = ("xl/charts/", "xl/drawings/", "xl/media/", "xl/comments", "xl/threadedComments/")

_ADDRESS = re.compile(r"([A-Za-z]+)([0-9]+)")
_LETTERS = re.compile(r"[A-Za-z]+")


def is_xlsx(package: Package) -> bool:
    return all(n in package.entries for n in METADATA)


def column_of(address: str) -> int | None:
    """The column of an address, from 0; None if there are no letters or more than any column has."""
    letters = _LETTERS.match(address)
    if not letters or len(letters[0]) > 12:
        return None
    n = 0
    for ch in letters[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def area_of(ref: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of an address or a range."""
    corners = [_ADDRESS.fullmatch(x) for x in ref.split(":")]
    if len(corners) not in (1, 2) or not all(corners) or any(int(m[2]) < 1 for m in corners):
        raise WorkbookError("an XLSX hyperlink cell reference is invalid")
    rows = [int(m[2]) - 1 for m in corners]
    columns = [c if (c := column_of(m[1])) is not None else MAX_COLUMNS for m in corners]
    return min(rows), min(columns), max(rows), max(columns)


def part_path(target: str) -> str:
    if not target or "\\" in target or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        raise WorkbookError(f"an XLSX worksheet relationship is unsafe: {target}")
    path = target[1:] if target.startswith("/") else f"xl/{target}"
    parts = [p for p in path.split("/") if p != "."]
    if ".." in parts or not path.startswith("xl/"):
        raise WorkbookError(f"an XLSX worksheet relationship leaves the package: {target}")
    return "/".join(parts)


def check_content_type(package: Package) -> None:
    root = parse(package.part("[Content_Types].xml"), "[Content_Types].xml")
    kinds = {n.get("ContentType", default="").lower() for n in root.nodes() if (n.ns, n.name) == (TYPES, "Override") and n.get("PartName") == "/xl/workbook.xml"}
    if kinds != {MAIN_TYPE}:
        raise WorkbookError("xl/workbook.xml has no supported XLSX main content type")


def sheet_list(package: Package) -> list[tuple[str, str]]:
    """(name, relationship id) in order."""
    root = parse(package.part("xl/workbook.xml"), "xl/workbook.xml")
    if (root.ns, root.name) != (MAIN, "workbook"):
        raise WorkbookError("xl/workbook.xml has no valid workbook root")
    out = [(n.get("name"), n.get("id", OFFICE_RELS)) for n in root.walk() if (n.ns, n.name) == (MAIN, "sheet")]
    if any(name is None or rel is None for name, rel in out):
        raise WorkbookError("an XLSX sheet declaration is incomplete")
    return out


def relationships(package: Package) -> dict[str, tuple[str, str]]:
    """id -> (worksheet or other, target) of the sheets' relationships."""
    name = "xl/_rels/workbook.xml.rels"
    root = parse(package.part(name), name)
    if (root.ns, root.name) != (RELS, "Relationships"):
        raise WorkbookError(f"{name} has no valid Relationships root")
    found: dict[str, tuple[str, str]] = {}
    for n in root.nodes():
        kind = (n.get("Type") or "").rpartition("/")[2]
        if (n.ns, n.name) != (RELS, "Relationship") or kind not in ("worksheet", "chartsheet", "dialogsheet"):
            continue
        rel, target = n.get("Id"), n.get("Target")
        if rel is None or target is None:
            continue
        if kind == "worksheet" and (n.get("TargetMode") or "").lower() == "external":
            raise WorkbookError(f"an external XLSX relationship is not allowed: {target}")
        if rel in found:
            raise WorkbookError("an XLSX worksheet relationship ID is duplicated")
        found[rel] = kind, target
    return found


def shared_strings(package: Package) -> list[str]:
    """The text of each item: all its runs, joined."""
    name = "xl/sharedStrings.xml"
    if (data := package.get(name)) is None:
        return []
    root = parse(data, name)
    if (root.ns, root.name) != (MAIN, "sst"):
        raise WorkbookError(f"{name} has no valid shared-string root")
    items = [n for n in root.nodes() if (n.ns, n.name) == (MAIN, "si")]
    if len(items) > MAX_STRINGS:
        raise WorkbookError("the XLSX shared-string table exceeds the budget")
    return ["".join(t.text() for t in si.walk() if (t.ns, t.name) == (MAIN, "t")) for si in items]


class Budgets:
    def __init__(self, cells: int = MAX_CELLS, text: int = MAX_TEXT, scans: int = MAX_CELLS):
        self.cells = Budget(cells, "the XLSX sheet exceeds the expanded-cell budget")
        self.text = Budget(text, "the spreadsheet exceeds the materialized-text budget")
        self.scans = Budget(scans, "the XLSX hyperlinks exceed the scan budget")


def _main(node: Node, name: str) -> list[Node]:
    return [n for n in node.nodes() if n.name == name and n.ns == MAIN]


def read_cell(node: Node, strings: list[str], book: Workbook, budgets: Budgets) -> Cell:
    kind = node.get("t")
    raw = "".join(v.text() for v in _main(node, "v"))
    formulas = _main(node, "f")
    formula = "".join(f.text() for f in formulas) if formulas else None
    if formula is not None and not raw and kind != "inlineStr":
        book.missing_results = True
    if kind == "s":
        if not raw.strip().isdigit() or int(raw) >= len(strings):
            raise WorkbookError("an XLSX shared-string index is invalid")
        cell = Cell("string", strings[int(raw)], strings[int(raw)], formula)
    elif kind == "inlineStr":
        text = "".join(t.text() for i in _main(node, "is") for t in i.walk() if (t.ns, t.name) == (MAIN, "t"))
        cell = Cell("string", text, text, formula)
    elif not raw:
        cell = Cell(formula=formula)
    elif kind == "b":
        yes = raw == "1" or raw.lower() == "true"
        cell = Cell("boolean", str(yes).lower(), str(yes).upper(), formula)
    elif kind in ("str", "e"):
        cell = Cell("string", raw, raw, formula)
    else:
        cell = Cell("number", raw, raw, formula)
    budgets.text.spend(utf8(cell.display) + utf8(cell.formula))
    return cell


def read_sheet(data: bytes, name: str, strings: list[str], book: Workbook, budgets: Budgets) -> Sheet:
    root = parse(data, name)
    if (root.ns, root.name) != (MAIN, "worksheet"):
        raise WorkbookError("an XLSX worksheet has no valid worksheet root")
    sheet, widths = Sheet(name), []
    for table in _main(root, "sheetData"):
        for node in _main(table, "row"):
            at = node.get("r")
            number = int(at) if at and at.isdigit() else len(sheet.rows) + 1
            if not len(sheet.rows) < number <= MAX_ROWS:
                raise WorkbookError("an XLSX row index is invalid or exceeds the budget")
            for _ in range(number - 1 - len(sheet.rows)):
                sheet.rows.append([])
                widths.append(0)
            row: list[Cell] = []
            for c in _main(node, "c"):
                address = c.get("r")
                column = len(row) if address is None else column_of(address)
                if column is None or column >= MAX_COLUMNS:
                    raise WorkbookError("an XLSX cell reference exceeds the column budget")
                budgets.cells.spend(max(0, column + 1 - len(row)))
                if column < len(row):
                    raise WorkbookError("XLSX cells are not in increasing column order")
                row += [EMPTY] * (column - len(row))
                row.append(read_cell(c, strings, book, budgets))
            widths.append(len(row))
            sheet.rows.append(trimmed(row))
    for node in root.walk():
        if node.ns != MAIN:
            continue
        if node.name == "mergeCell":
            book.merges = True
        elif node.name == "hyperlink":
            book.unsupported = True
            if (ref := node.get("ref")) is not None and (display := node.get("display")):
                fill(sheet, widths, area_of(ref), display, budgets)
    return sheet


def fill(sheet: Sheet, widths: list[int], area: tuple[int, int, int, int], display: str, budgets: Budgets) -> None:
    """A link's display goes to the empty cells of its area; rows and columns grow with it."""
    r0, c0, r1, c1 = area
    if r1 >= MAX_ROWS:
        raise WorkbookError("an XLSX hyperlink exceeds the row budget")
    if c1 >= MAX_COLUMNS:
        raise WorkbookError("an XLSX hyperlink exceeds the column budget")
    size = (r1 - r0 + 1) * (c1 - c0 + 1)
    if size > MAX_CELLS:
        raise WorkbookError(budgets.cells.message)
    budgets.scans.spend(size)
    cell = Cell("string", display, display)
    for r in range(r0, r1 + 1):
        while len(sheet.rows) <= r:
            sheet.rows.append([])
            widths.append(0)
        row = sheet.rows[r]
        if c1 + 1 > widths[r]:
            budgets.cells.spend(c1 + 1 - widths[r])
            widths[r] = c1 + 1
        row += [EMPTY] * (c1 + 1 - len(row))
        for c in range(c0, c1 + 1):
            if row[c].blank:
                budgets.text.spend(utf8(display))
                row[c] = cell
        sheet.rows[r] = trimmed(row)


def read_xlsx(package: Package, budgets: Budgets | None = None, keep: Keep = every) -> Workbook:
    """All worksheets in order; chart and dialog sheets are passed over and noted.

    Sheets that aren't kept have their place and name, but no cells: their parts are not opened, and spend no budget.
    """
    if not is_xlsx(package):
        raise WorkbookError("the XLSX package is missing workbook metadata")
    check_content_type(package)
    declared, rels = sheet_list(package), relationships(package)
    if not declared:
        raise WorkbookError("xl/workbook.xml contains no sheets")
    if len(declared) > MAX_SHEETS:
        raise WorkbookError("the workbook contains too many sheets")
    book, strings, budgets = Workbook(), shared_strings(package), budgets or Budgets()
    for name, rel in declared:
        if rel not in rels:
            raise WorkbookError("a workbook sheet relationship is missing")
        kind, target = rels[rel]
        if kind != "worksheet":
            book.unsupported = True
            continue
        path = part_path(target)
        if path not in package.entries:
            raise WorkbookError(f"the worksheet part is missing: {path}")
        sheet = Sheet(name)
        if keep(len(book.sheets), name):
            sheet = read_sheet(package.part(path, None), path, strings, book, budgets)
            sheet.name = name
            book.parsed += 1
        book.sheets.append(sheet)
    if not book.sheets:
        raise WorkbookError("the workbook contains no readable worksheets")
    book.unsupported |= any(n.startswith(OBJECTS) or n == "xl/vbaProject.bin" for n in package.entries)
    return book
