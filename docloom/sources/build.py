"""Small packages made from plain rows, for tests and queries: enough of each format to be read back."""

from __future__ import annotations

import struct
import zlib
from html import escape

from docloom.sources import odm, ods, wordml, xls, xlsx
from docloom.sources.cfb import END, FAT, FREE, SIGNATURE


def zip_bytes(entries: list[dict]) -> bytes:
    """A ZIP file whose directory says what it is told to.

    An entry has name and content; optional are raw_name, flags, stored, crc, usize, extra, local_extra, local_name,
    attrs, method and local_flags, which may all lie.
    """
    body, directory = b"", b""
    for e in entries:
        raw = e.get("raw_name", e["name"].encode())
        content, flags, extra = e.get("content", b""), e.get("flags", 0x800), e.get("extra", b"")
        method = e.get("method", 0 if e.get("stored") or not content else 8)
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = engine.compress(content) + engine.flush() if method == 8 else content
        crc, usize = e.get("crc", zlib.crc32(content)), e.get("usize", len(content))
        local_name, local_extra = e.get("local_name", raw), e.get("local_extra", extra)
        offset = len(body)
        body += struct.pack("<4s5H3L2H", b"PK\x03\x04", 20, e.get("local_flags", flags), method, 0, 0, crc, len(data), usize, len(local_name), len(local_extra)) + local_name + local_extra + data
        directory += struct.pack("<4s6H3L5H2L", b"PK\x01\x02", e.get("made_by", 0x314), 20, flags, method, 0, 0, crc, len(data), usize, len(raw), len(extra), 0, 0, 0, e.get("attrs", 0), offset) + raw + extra
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(entries), len(entries), len(directory), len(body), 0)
    return body + directory + end


def package(files: dict[str, str | bytes]) -> bytes:
    return zip_bytes([{"name": n, "content": c.encode() if isinstance(c, str) else c, "stored": n == "mimetype"} for n, c in files.items()])


def a1(r: int, c: int) -> str:
    letters = ""
    n = c + 1
    while n:
        n, d = divmod(n - 1, 26)
        letters = chr(65 + d) + letters
    return f"{letters}{r + 1}"


def xlsx_files(sheets: list[tuple[str, list[list]]]) -> dict[str, str]:
    """sheets: (name, rows); None is no cell, numbers are numbers, text goes to the shared strings."""
    strings: dict[str, int] = {}
    files = {
        "[Content_Types].xml": f'<Types xmlns="{xlsx.TYPES}"><Override PartName="/xl/workbook.xml" ContentType="{xlsx.MAIN_TYPE}"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{xlsx.MAIN}" xmlns:r="{xlsx.OFFICE_RELS}"><sheets>'
        + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{xlsx.RELS}">'
        + "".join(f'<Relationship Id="r{k}" Type="{xlsx.OFFICE_RELS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        + "</Relationships>",
    }
    for k, (_, rows) in enumerate(sheets, 1):
        out = ""
        for r, row in enumerate(rows):
            cells = ""
            for c, v in enumerate(row):
                if isinstance(v, str):
                    cells += f'<c r="{a1(r, c)}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
                elif v is not None:
                    cells += f'<c r="{a1(r, c)}"><v>{v}</v></c>'
            out += f'<row r="{r + 1}">{cells}</row>'
        files[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{xlsx.MAIN}"><sheetData>{out}</sheetData></worksheet>'
    items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    files["xl/sharedStrings.xml"] = f'<sst xmlns="{xlsx.MAIN}">{items}</sst>'
    return files


def ods_content(tables: str) -> dict[str, str]:
    head = f'<office:document-content xmlns:office="{ods.OFFICE}" xmlns:table="{ods.TABLE}" xmlns:text="{ods.TEXT}" xmlns:draw="{ods.DRAW}">'
    return {"mimetype": ods.MIMETYPE, "content.xml": f"{head}<office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>"}


def ods_files(sheets: list[tuple[str, list[list]]]) -> dict[str, str]:
    out = ""
    for name, rows in sheets:
        out += f'<table:table table:name="{escape(name)}">'
        for row in rows:
            out += "<table:table-row>"
            for v in row:
                kind = 'office:value-type="string"' if isinstance(v, str) else f'office:value-type="float" office:value="{v}"'
                out += "<table:table-cell/>" if v is None else f"<table:table-cell {kind}><text:p>{escape(str(v))}</text:p></table:table-cell>"
            out += "</table:table-row>"
        out += "</table:table>"
    return ods_content(out)


#: A paragraph: its heading level, 0 for none, and its runs of text, each bold or not.
Block = tuple[int, list[tuple[str, bool]]]


def docx_files(blocks: list[Block]) -> dict[str, str]:
    body = ""
    for level, runs in blocks:
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        body += f"<w:p>{style}" + "".join(f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t, bold in runs) + "</w:p>"
    main = next(iter(wordml.MAIN_TYPES))
    return {
        "[Content_Types].xml": f'<Types xmlns="{xlsx.TYPES}"><Override PartName="/word/document.xml" ContentType="{main}"/></Types>',
        "word/styles.xml": f'<w:styles xmlns:w="{wordml.W}">' + "".join(f'<w:style w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in range(1, 7)) + "</w:styles>",
        "word/document.xml": f'<w:document xmlns:w="{wordml.W}"><w:body>{body}</w:body></w:document>',
    }


def _open_document(mimetype: str, body: str) -> dict[str, str]:
    spaces = {"office": ods.OFFICE, "text": ods.TEXT, "style": wordml.STYLE, "fo": wordml.FO, "xlink": odm.XLINK}
    names = " ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items())
    styles = '<office:automatic-styles><style:style style:name="B" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles>'
    return {"mimetype": mimetype, "content.xml": f"<office:document-content {names}>{styles}<office:body><office:text>{body}</office:text></office:body></office:document-content>"}


def _paragraphs(blocks: list[Block]) -> str:
    out = ""
    for level, runs in blocks:
        inner = "".join(f'<text:span text:style-name="B">{escape(t)}</text:span>' if bold else escape(t) for t, bold in runs)
        out += f'<text:h text:outline-level="{level}">{inner}</text:h>' if level else f"<text:p>{inner}</text:p>"
    return out


def odt_files(blocks: list[Block]) -> dict[str, str]:
    return _open_document(wordml.ODT_MIMETYPE, _paragraphs(blocks))


def odm_files(blocks: list[Block], sections: list[tuple[str, str]]) -> dict[str, str]:
    """A master document: its own paragraphs, then sections of (name, reference)."""
    parts = "".join(f'<text:section text:name="{escape(n)}"><text:section-source xlink:href="{escape(r)}"/></text:section>' for n, r in sections)
    return _open_document(odm.MIMETYPE, _paragraphs(blocks) + parts)


def rtf_bytes(blocks: list[Block]) -> bytes:
    """Headings are paragraphs like others; text beyond ASCII is written by number."""
    char = lambda c: f"\\{c}" if c in "\\{}" else c if c.isascii() else f"\\u{ord(c) - 65536 if ord(c) > 32767 else ord(c)}?"
    body = "".join("".join(("\\b " if bold else "") + "".join(map(char, t)) + ("\\b0 " if bold else "") for t, bold in runs) + "\\par\n" for _, runs in blocks)
    return f"{{\\rtf1\\ansi {body}}}".encode()


def record(kind: int, payload: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(payload)) + payload


def _text(s: str) -> bytes:
    return struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")


def biff(sheets: list[tuple[str, list[list]]], end_sheets: bool = True, kinds: list[int] | None = None) -> bytes:
    """A BIFF8 workbook stream."""
    strings: dict[str, int] = {}
    bodies = []
    for _, rows in sheets:
        body = record(xls.BOF, struct.pack("<4H", 0x0600, xls.WORKSHEET, 0, 0))
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if isinstance(v, str):
                    body += record(xls.LABELSST, struct.pack("<3HL", r, c, 0, strings.setdefault(v, len(strings))))
                elif v is not None:
                    body += record(xls.NUMBER, struct.pack("<3Hd", r, c, 0, v))
        bodies.append(body + (record(xls.EOF) if end_sheets else b""))
    table = struct.pack("<LL", len(strings), len(strings)) + b"".join(map(_text, strings))
    parts = [table[k : k + 8000] for k in range(0, len(table), 8000)]
    if len(parts) > 1:
        raise ValueError("the shared strings do not fit in one record")
    sst = record(xls.SST, table)
    head = record(xls.BOF, struct.pack("<4H", 0x0600, xls.GLOBALS, 0, 0))
    names = [n.encode("utf-16-le") for n, _ in sheets]
    at = len(head) + sum(4 + 8 + len(n) for n in names) + len(sst) + 4
    bounds = b""
    for k, (name, body) in enumerate(zip(names, bodies)):
        bounds += record(xls.BOUNDSHEET, struct.pack("<LBBBB", at, 0, kinds[k] if kinds else 0, len(name) // 2, 1) + name)
        at += len(body)
    return head + bounds + sst + record(xls.EOF) + b"".join(bodies)


def ole(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams are padded over the mini-stream's limit."""
    data, fat, entries = b"", [], [("Root Entry", 5, END, 0)]
    for name, body in streams.items():
        size = max(len(body), 4096)
        n = -(-size // 512)
        entries.append((name, 2, len(fat), size))
        data += body.ljust(n * 512, b"\0")
        fat += [*range(len(fat) + 1, len(fat) + n), END]
    directory = b""
    for name, kind, first, size in entries:
        raw = name.encode("utf-16-le") + b"\0\0"
        child = 1 if kind == 5 and len(entries) > 1 else FREE
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB3L", len(raw), kind, 1, FREE, FREE, child) + bytes(36) + struct.pack("<LQ", first, size)
    n = -(-len(directory) // 512)
    first_dir = len(fat)
    fat += [*range(len(fat) + 1, len(fat) + n), END]
    data += directory.ljust(n * 512, b"\0")
    n_fat = 1
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    first_fat = len(fat)
    fat += [FAT] * n_fat
    data += struct.pack(f"<{n_fat * 128}L", *fat, *[FREE] * (n_fat * 128 - len(fat)))
    head = SIGNATURE + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<5L", n_fat, first_dir, 0, 4096, END) + struct.pack("<3L", 0, END, 0)
    difat = [*range(first_fat, first_fat + n_fat), *[FREE] * (109 - n_fat)]
    return head + struct.pack("<109L", *difat) + data


def xls_bytes(sheets: list[tuple[str, list[list]]], **options) -> bytes:
    return ole({"Workbook": biff(sheets, **options)})
