"""Readers and renderers on packages made here: exact results, and one broken package for each rule."""

import struct
import zlib

import pytest

from docloom.sources import build, ods, xls, xlsx
from docloom.sources.convert import convert, detectors, pick
from docloom.sources.workbook import WorkbookError
from docloom.sources.xlsx import Budgets, read_xlsx
from docloom.sources.zipgate import PackageError, open_package

SHEET = f'<worksheet xmlns="{xlsx.MAIN}"><sheetData>%s</sheetData>%s</worksheet>'


def book(rows="", tail="", sheets=1):
    files = build.xlsx_files([(n, []) for n in ("Summary", "Details & Notes")[:sheets]])
    files["xl/worksheets/sheet1.xml"] = SHEET % (rows, tail)
    return files


def link(ref, display="x"):
    return f'<hyperlinks><hyperlink ref="{ref}" display="{display}"/></hyperlinks>'


def test_two_sheets_exact():
    rows = [["Product", "Units"], ["Äpfel", 12], ["Birnen", 7]]
    content = build.package(build.xlsx_files([("Summary", rows), ("Details & Notes", [["a|b\nc", None, "d"]])]))
    r = convert("/x/Fruit.xlsx", content)
    assert r.status == "ok" and r.warnings == []
    assert r.markdown == (
        "# Fruit\n\n## Sheet: Summary\n\n| Product | Units |\n| --- | --- |\n| Äpfel | 12 |\n| Birnen | 7 |\n\n"
        "## Sheet: Details & Notes\n\n| a\\|b<br>c |  | d |\n| --- | --- | --- |\n"
    )


def test_hyperlink_display_fills_an_empty_cell():
    r = convert("/x/Hyperlink.xlsx", build.package(book("", link("A1", "Sichtbarer Text"), 2)))
    assert r.markdown == "# Hyperlink\n\n## Sheet: Summary\n\n| Sichtbarer Text |\n| --- |\n\n## Sheet: Details & Notes\n\n_Empty sheet._\n"


def test_first_link_wins_and_formula_cells_are_not_empty():
    rows = '<row r="1"><c r="A1"><f></f></c></row>'
    b = read_xlsx(open_package(build.package(book(rows, "<hyperlinks>" + '<hyperlink ref="A1:B1" display="one"/><hyperlink ref="A1:C1" display="two"/>' + "</hyperlinks>"))))
    assert [c.display for c in b.sheets[0].rows[0]] == ["", "one", "two"]
    assert b.sheets[0].rows[0][0].formula == "" and b.missing_results and b.unsupported


@pytest.mark.parametrize(
    "rows, tail, message",
    [
        ('<row r="7"><c r="ABCDEFGHIJKLMNOPQ7"><v>1</v></c></row>', "", "an XLSX cell reference exceeds the column budget"),
        ("".join(f'<row r="{k}"><c r="XFD{k}"><v>1</v></c></row>' for k in range(1, 63)), "", "the XLSX sheet exceeds the expanded-cell budget"),
        ('<row r="2"/><row r="1"/>', "", "an XLSX row index is invalid or exceeds the budget"),
        ('<row r="1"><c r="B1"/><c r="A1"/></row>', "", "XLSX cells are not in increasing column order"),
        ('<row r="1"><c r="A1" t="s"><v>9</v></c></row>', "", "an XLSX shared-string index is invalid"),
        ("", link("A100001"), "an XLSX hyperlink exceeds the row budget"),
        ("", link("XFE1"), "an XLSX hyperlink exceeds the column budget"),
        ("", link("A1:XFD100000"), "the XLSX sheet exceeds the expanded-cell budget"),
        ("", link("A1:A100000", "y" * 1400), "the spreadsheet exceeds the materialized-text budget"),
        ("", "<hyperlinks>" + '<hyperlink ref="A1:T100" display="x"/>' * 600 + "</hyperlinks>", "the XLSX hyperlinks exceed the scan budget"),
    ],
)
def test_xlsx_budgets(rows, tail, message):
    r = convert("/x/a.xlsx", build.package(book(rows, tail)))
    assert r.status == "error" and r.error.endswith(message)


def test_xlsx_relationships():
    files = book()
    files["xl/_rels/workbook.xml.rels"] = files["xl/_rels/workbook.xml.rels"].replace('Target="worksheets', 'TargetMode="External" Target="worksheets')
    assert "an external XLSX relationship is not allowed" in convert("/a.xlsx", build.package(files)).error
    files = book()
    files["xl/worksheets/sheet1.xml"] = "<wrong/>"
    assert "worksheet root" in convert("/a.xlsx", build.package(files)).error
    with pytest.raises(WorkbookError, match="leaves the package"):
        xlsx.part_path("../other.xml")
    with pytest.raises(WorkbookError, match="unsafe"):
        xlsx.part_path("http://x/y")


def test_column_addresses():
    assert [xlsx.column_of(a) for a in ("A1", "z9", "AA1", "XFD1", "1", "A" * 20)] == [0, 25, 26, 16383, None, None]
    assert xlsx.area_of("C3:A1") == (0, 0, 2, 2)


def test_shared_budget_over_sheets():
    files = build.xlsx_files([("a", []), ("b", [])])
    for k in (1, 2):
        files[f"xl/worksheets/sheet{k}.xml"] = SHEET % ("", "<hyperlinks>" + '<hyperlink ref="A1:T100" display="x"/>' * 300 + "</hyperlinks>")
    assert "scan budget" in convert("/a.xlsx", build.package(files)).error
    assert read_xlsx(open_package(build.package(files)), Budgets(scans=2_000_000)).sheets[1].rows[99][19].display == "x"


def test_ods_merge_and_formula():
    row = '<table:table-row><table:table-cell office:value-type="string" table:number-columns-spanned="2"><text:p>Merged</text:p></table:table-cell><table:covered-table-cell/></table:table-row>'
    row += '<table:table-row><table:table-cell office:value-type="float" table:formula="of:=1"/></table:table-row>'
    r = convert("/x/a.ods", build.package(build.ods_content(f'<table:table table:name="Generated">{row}</table:table>')))
    assert "| Merged |  |" in r.markdown
    assert [c for c, _ in r.warnings] == ["spreadsheet.mergesFlattened", "spreadsheet.formulaResultMissing"]


def ods_rows(cells):
    table = f"<table:table><table:table-row>{cells}</table:table-row><table:table-row table:number-rows-repeated='5'/></table:table>"
    return ods.read_ods(open_package(build.package(build.ods_content(table))))


def test_ods_repeats_text_and_trailing_cells():
    text = '<text:p>a<text:s text:c="3"/>b<text:tab/>c<text:line-break/>d</text:p><text:p>e</text:p>'
    b = ods_rows(f'<table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="string" table:number-columns-repeated="2">{text}</table:table-cell><table:table-cell table:number-columns-repeated="99"/>')
    assert b.sheets[0].name == "Sheet 1"
    assert [[c.display for c in r] for r in b.sheets[0].rows] == [["", "", "a   b\tc\nd\ne", "a   b\tc\nd\ne"]]


@pytest.mark.parametrize("n", ["16385", str(2**63 - 1), "0", "x"])
def test_ods_repeat_budget(n):
    with pytest.raises(WorkbookError, match="budget"):
        ods_rows(f'<table:table-cell table:number-columns-repeated="{n}"><text:p>x</text:p></table:table-cell>')


def test_xls_two_sheets():
    r = convert("/x/a.xls", build.xls_bytes([("First", [[1]]), ("Second", [[None, 2]])]))
    assert r.markdown == "# a\n\n## Sheet: First\n\n| 1 |\n| --- |\n\n## Sheet: Second\n\n|  | 2 |\n| --- | --- |\n"
    assert [c for c, _ in r.warnings] == ["legacySpreadsheet.potentialLoss"]


def test_xls_errors_and_chart_sheet():
    assert convert("/x/a.xls", build.xls_bytes([("a", [[1]]), ("b", [[2]])], end_sheets=False)).error.endswith("an XLS worksheet has no EOF before the next sheet")
    r = convert("/x/a.xls", build.xls_bytes([("a", [[1]]), ("c", [[2]])], kinds=[0, 2]))
    assert "spreadsheet.unsupportedObjects" in [c for c, _ in r.warnings]
    broken = build.xls_bytes([("a", [[1]])])
    assert "header is invalid" in convert("/x/a.xls", b"nonsense" + broken[8:]).error


def test_xls_cells():
    b = xls.Workbook()
    reader = xls.SheetReader(["s"], b)
    reader.read(xls.RK, struct.pack("<3HL", 0, 0, 0, 1234 << 2 | 3))
    reader.read(xls.MULRK, struct.pack("<HH", 0, 1) + struct.pack("<HLHL", 0, 5 << 2 | 2, 0, 0x3FF00000) + struct.pack("<H", 2))
    reader.read(xls.BOOLERR, struct.pack("<3HBB", 0, 3, 0, 1, 0))
    reader.read(xls.FORMULA, struct.pack("<3H", 1, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(6))
    reader.read(xls.STRING, struct.pack("<HB", 2, 0) + b"ok")
    reader.read(xls.FORMULA, struct.pack("<3H", 1, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(6))
    reader.settle()
    assert {k: c.display for k, c in reader.cells.items()} == {(0, 0): "12.34", (0, 1): "5", (0, 2): "1", (0, 3): "TRUE", (1, 0): "ok", (1, 1): ""}
    assert b.missing_results and reader.cells[1, 1].formula == xls.FORMULA_MARK
    assert xls.number_text(0.1) == "0.1" and xls.number_text(1e20) == "1e+20"


def test_xls_strings_over_continue_records():
    first = struct.pack("<LL", 1, 1) + struct.pack("<HB", 6, 0) + b"abc"
    assert xls.shared_strings([first, b"\x01" + "déf".encode("utf-16-le")]) == ["abcdéf"]
    with pytest.raises(WorkbookError, match="continuation"):
        xls.shared_strings([first, b"\x00d"])


def entry(**over):
    return [{"name": "a.txt", "content": b"hello"} | over]


def path_field(name, raw, version=1):
    body = struct.pack("<BL", version, zlib.crc32(raw)) + name
    return struct.pack("<HH", 0x7075, len(body)) + body


@pytest.mark.parametrize(
    "entries, message",
    [
        (entry(flags=0x801), "encrypted"),
        (entry(method=12), "unsupported compression method"),
        (entry(raw_name=b"\xff.txt"), "not valid UTF-8"),
        (entry(name="/a"), "unsafe entry path"),
        (entry(name="a/../b"), "unsafe entry path"),
        (entry(name="a\\b"), "unsafe entry path"),
        (entry(name="c:/b"), "unsafe entry path"),
        (entry() + entry(), "duplicate entry: a.txt"),
        (entry() + entry(name="A.TXT"), "duplicate entry: A.TXT"),
        (entry(name="e\u0301") + entry(name="é"), "duplicate entry"),
        (entry(name="ς") + entry(name="Σ"), "duplicate entry"),
        (entry(attrs=0xA1FF << 16), "symbolic links"),
        (entry(name="d/", usize=3), "a ZIP directory entry declares content: d/"),
        (entry(usize=1 << 30) + entry(name="b"), "expands beyond the supported size limit"),
        (entry(local_name=b"b.txt"), "the local ZIP entry for a.txt is inconsistent"),
        (entry(local_flags=0), "the local ZIP entry for a.txt is inconsistent"),
        (entry(usize=3), "a.txt expands beyond the size declared"),
        (entry(usize=9), "the uncompressed size of a.txt is inconsistent"),
        (entry(crc=1), "the checksum of a.txt is invalid"),
        (entry(stored=True, usize=4), "the stored size of a.txt does not match"),
        (entry(extra=path_field(b"d/", b"a.txt"), local_extra=path_field(b"d/", b"a.txt")), "disagree about being a directory"),
        (entry(extra=path_field(b"b.txt", b"a.txt", 2)), "unsupported Unicode path version"),
        (entry(extra=b"\x01"), "malformed extra field"),
        (entry(extra=path_field(b"b.txt", b"a.txt"), local_extra=b""), "declares a different Unicode path"),
    ],
)
def test_package_gate(entries, message):
    with pytest.raises(PackageError, match=message):
        open_package(build.zip_bytes(entries)).verify()


def test_package_gate_accepts():
    stale = path_field(b"other.txt", b"zzz")
    p = open_package(build.zip_bytes(entry(extra=stale) + [{"name": "d/"}, {"name": "ä", "raw_name": "ä".encode("cp437"), "flags": 0, "content": b"x"}])).verify()
    assert p.names == ["a.txt", "d/", "ä"] and p.part("a.txt") == b"hello"
    with pytest.raises(PackageError, match="missing b"):
        p.part("b")
    good = build.zip_bytes(entry())
    for bad in (good[:-1], good + b"x", b"", good[:10]):
        with pytest.raises(PackageError, match="central directory is missing"):
            open_package(bad)


def test_detection():
    assert convert("/x/a.bin", b"??").error_kind == "unsupported_input"
    assert convert("/x/a.docx", b"??").error == "Invalid DOCX input at /x/a.docx: the ZIP package signature is missing"
    sheet = build.package(build.xlsx_files([("a", [["x"]])]))
    assert convert("/x/a.txt", sheet).format == "xlsx"
    assert convert("/x/a.docx", sheet).format == "xlsx"  # content is the evidence, not the extension
    found = detectors("/x/a.xlsx", sheet)
    assert [d.kind for d in found] == ["none", "none", "none", "match", "none"]
    found[0].kind, found[0].format, found[0].priority = "match", "rtf", 108
    assert pick("/x", found)[1].error == "Input matches more than one format at /x: rtf, xlsx"
    assert convert("/x/a.doc", build.ole({"WordDocument": b"x"})).error_kind == "missing_tool"
    assert convert("/x/a.xlsx", build.package(book()) [:50]).error_kind == "invalid_input"
