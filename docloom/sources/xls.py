"""Workbooks in BIFF8 streams of OLE compound files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from docloom.sources.cfb import CompoundFile
from docloom.sources.workbook import EMPTY, MAX_CELLS, MAX_COLUMNS, MAX_ROWS, MAX_SHEETS, MAX_STRINGS, MAX_TEXT, Budget, Cell, Keep, Sheet, Workbook, WorkbookError, every, utf8

#: Record types.
BOF, EOF, BOUNDSHEET, FILEPASS, SST, CONTINUE = 0x0809, 0x000A, 0x0085, 0x002F, 0x00FC, 0x003C
LABELSST, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, MERGES = 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207, 0x00E5
OBJECTS = {0x005D, 0x01B6, 0x00EC, 0x00EB, 0x01B8}  # OBJ, TXO, MSODRAWING, MSODRAWINGGROUP, HLINK
GLOBALS, WORKSHEET = 0x0005, 0x0010
FORMULA_MARK = "BIFF formula"


def number_text(x: float) -> str:
    return "%.15g" % x


def rk(value: int) -> float:
    """An integer in 30 bits or the high 30 bits of a double, maybe in hundredths."""
    if value & 2:
        x = float((value if value < 1 << 31 else value - (1 << 32)) >> 2)
    else:
        x = struct.unpack("<d", struct.pack("<Q", (value & ~3) << 32))[0]
    return x / 100 if value & 1 else x


def records(data: bytes, start: int, end: int, unended: str | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, payload) up to and with the EOF record of the outermost block."""
    if not 0 <= start <= end <= len(data):
        raise WorkbookError("an XLS BIFF record range is invalid")
    at, depth = start, 0
    while at + 4 <= end:
        kind, size = struct.unpack_from("<HH", data, at)
        if at + 4 + size > end:
            raise WorkbookError("an XLS BIFF record extends beyond its stream range")
        yield at, kind, data[at + 4 : at + 4 + size]
        depth += (kind == BOF) - (kind == EOF)
        if kind == EOF and depth <= 0:
            return
        at += 4 + size
    if unended:
        raise WorkbookError(unended)


class Segments:
    """A record's payload with its continuations; characters may go on after a boundary in the other width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            self._ahead()
            step = self.parts[self.k][self.at : self.at + n]
            self.at += len(step)
            n -= len(step)
            out += step
        return out

    def _ahead(self) -> None:
        while self.at >= len(self.parts[self.k]):
            if self.k + 1 >= len(self.parts):
                raise WorkbookError("the XLS shared-string table is truncated" if len(self.parts) == 1 else "the XLS shared-string continuation is missing")
            self.k, self.at = self.k + 1, 0

    def text(self, n: int, wide: bool) -> str:
        out = []
        while n:
            if self.at >= len(self.parts[self.k]):
                self._ahead()
                wide = bool(self.take(1)[0] & 1)
                continue
            room = len(self.parts[self.k]) - self.at
            step = min(n, room // (2 if wide else 1))
            if not step:
                raise WorkbookError("an XLS shared string splits a character at a record boundary")
            out.append(self.take(step * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= step
        return "".join(out)


def shared_strings(parts: list[bytes]) -> list[str]:
    if not parts:
        return []
    s = Segments(parts)
    _, count = struct.unpack("<LL", s.take(8))
    if count > MAX_STRINGS:
        raise WorkbookError("the XLS shared-string table exceeds the supported limit")
    out = []
    for _ in range(count):
        n, flags = struct.unpack("<HB", s.take(3))
        runs = struct.unpack("<H", s.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<L", s.take(4))[0] if flags & 4 else 0
        out.append(s.text(n, bool(flags & 1)))
        s.take(4 * runs + extra)
    return out


def short_text(data: bytes, at: int, count_size: int, what: str) -> str:
    """A counted string: its length in count_size bytes, a width flag, its characters."""
    if at + count_size + 1 > len(data):
        raise WorkbookError(f"an XLS {what} is invalid")
    n = int.from_bytes(data[at : at + count_size], "little")
    wide = data[at + count_size] & 1
    raw = data[at + count_size + 1 : at + count_size + 1 + n * (2 if wide else 1)]
    if len(raw) < n * (2 if wide else 1):
        raise WorkbookError(f"an XLS {what} is truncated")
    return raw.decode("utf-16-le" if wide else "latin-1", "replace")


def _number(x: float, formula: str | None = None) -> Cell:
    return Cell("number", number_text(x), number_text(x), formula)


def _bool_or_error(value: int, is_error: bool, formula: str | None = None) -> Cell:
    if is_error:
        return Cell("string", "#ERROR", "#ERROR", formula)
    return Cell("boolean", str(bool(value)).lower(), str(bool(value)).upper(), formula)


class SheetReader:
    def __init__(self, strings: list[str], book: Workbook):
        self.strings, self.book = strings, book
        self.cells: dict[tuple[int, int], Cell] = {}
        self.pending: tuple[int, int] | None = None

    def put(self, r: int, c: int, cell: Cell) -> None:
        if r >= MAX_ROWS or c >= MAX_COLUMNS:
            raise WorkbookError("an XLS cell lies outside the supported row or column budget")
        self.cells[r, c] = cell

    def settle(self) -> None:
        """A formula whose text never came is empty, and its result is missing."""
        if self.pending is not None:
            self.put(*self.pending, Cell(formula=FORMULA_MARK))
            self.book.missing_results = True
            self.pending = None

    def read(self, kind: int, p: bytes) -> None:
        if kind != STRING and kind not in (CONTINUE, 0x04BC, 0x0221):
            self.settle()
        if kind == LABELSST:
            self.sized(p, 10, "text cell")
            r, c, _, at = struct.unpack_from("<3HL", p)
            if at >= len(self.strings):
                raise WorkbookError("an XLS shared-string index is invalid")
            self.put(r, c, Cell("string", self.strings[at], self.strings[at]))
        elif kind == NUMBER:
            self.sized(p, 14, "number cell")
            r, c, _, x = struct.unpack_from("<3Hd", p)
            self.put(r, c, _number(x))
        elif kind == RK:
            self.sized(p, 10, "RK cell")
            r, c, _, x = struct.unpack_from("<3HL", p)
            self.put(r, c, _number(rk(x)))
        elif kind == MULRK:
            if len(p) < 12 or (len(p) - 6) % 6:
                raise WorkbookError("an XLS multiple-number record is invalid")
            r, first = struct.unpack_from("<HH", p)
            last = struct.unpack_from("<H", p, len(p) - 2)[0]
            if last - first + 1 != (len(p) - 6) // 6:
                raise WorkbookError("an XLS multiple-number column range is invalid")
            for k in range(last - first + 1):
                self.put(r, first + k, _number(rk(struct.unpack_from("<L", p, 6 + 6 * k)[0])))
        elif kind == BOOLERR:
            self.sized(p, 8, "boolean cell")
            r, c, _ = struct.unpack_from("<3H", p)
            self.put(r, c, _bool_or_error(p[6], p[7] != 0))
        elif kind == FORMULA:
            self.sized(p, 14, "formula cell")
            self.formula(p)
        elif kind == STRING and self.pending is not None:
            text = short_text(p, 0, 2, "formula string")
            self.put(*self.pending, Cell("string", text, text, FORMULA_MARK))
            self.pending = None
        elif kind == MERGES:
            self.book.merges = True
        elif kind in OBJECTS:
            self.book.unsupported = True

    def sized(self, p: bytes, n: int, what: str) -> None:
        if len(p) < n:
            raise WorkbookError(f"an XLS {what} is invalid")

    def formula(self, p: bytes) -> None:
        r, c = struct.unpack_from("<HH", p)
        if p[12:14] != b"\xff\xff":
            self.put(r, c, _number(struct.unpack_from("<d", p, 6)[0], FORMULA_MARK))
        elif p[6] == 0:
            self.pending = r, c
        elif p[6] == 1:
            self.put(r, c, _bool_or_error(p[8], False, FORMULA_MARK))
        elif p[6] == 2:
            self.put(r, c, _bool_or_error(0, True, FORMULA_MARK))
        else:
            self.put(r, c, Cell(formula=FORMULA_MARK))
            self.book.missing_results = True

    def grid(self, cells: Budget, text: Budget) -> list[list[Cell]]:
        """Rows 0 to the last, each to its own last column."""
        widths: dict[int, int] = {}
        for r, c in self.cells:
            widths[r] = max(widths.get(r, 0), c + 1)
        cells.spend(sum(widths.values()))
        text.spend(sum(utf8(x.display) for x in self.cells.values()))
        return [[self.cells.get((r, c), EMPTY) for c in range(widths.get(r, 0))] for r in range(max(widths, default=-1) + 1)]


def read_xls(content: bytes, keep: Keep = every) -> Workbook:
    """All worksheets in order; those that aren't kept have their place and name, but no cells."""
    ole = CompoundFile(content)
    if (data := ole.stream("Workbook", "Book")) is None:
        raise WorkbookError("the OLE compound document contains no Excel workbook stream")
    if len(data) < 8 or struct.unpack_from("<H", data)[0] != BOF or struct.unpack_from("<H", data, 6)[0] != GLOBALS:
        raise WorkbookError("the Excel workbook-global BOF record is missing")
    book = Workbook(unsupported=ole.has("_VBA_PROJECT_CUR", "VBA", "ObjectPool"))
    directory, parts, last = [], [], None
    for _, kind, p in records(data, 0, len(data)):
        if kind == FILEPASS:
            raise WorkbookError("encrypted XLS workbooks are not supported")
        if kind == BOUNDSHEET:
            if len(p) < 8:
                raise WorkbookError("an XLS sheet directory record is invalid")
            offset = struct.unpack_from("<L", p)[0]
            if offset >= len(data):
                raise WorkbookError("an XLS sheet directory offset is invalid")
            directory.append((offset, p[5], short_text(p, 6, 1, "sheet name")))
        elif kind == SST or kind == CONTINUE and last == SST:
            parts.append(p)
            kind = SST
        elif kind in OBJECTS:
            book.unsupported = True
        last = kind
    sheets = [d for d in directory if d[1] == 0]
    book.unsupported |= len(sheets) < len(directory)
    if not sheets:
        raise WorkbookError("the XLS workbook contains no worksheets")
    if len(directory) > MAX_SHEETS:
        raise WorkbookError("the XLS workbook contains too many sheets")
    offsets = sorted(d[0] for d in directory)
    if len(set(offsets)) < len(offsets):
        raise WorkbookError("the XLS workbook contains duplicate sheet offsets")
    ends = dict(zip(offsets, [*offsets[1:], len(data)]))
    strings = shared_strings(parts)
    cells, text = Budget(MAX_CELLS, "the XLS sheet exceeds the expanded-cell budget"), Budget(MAX_TEXT, "the spreadsheet exceeds the materialized-text budget")
    for offset, _, name in sheets:
        if not keep(len(book.sheets), name):
            book.sheets.append(Sheet(name))
            continue
        book.parsed += 1
        reader = SheetReader(strings, book)
        for n, (_, kind, p) in enumerate(records(data, offset, ends[offset], "an XLS worksheet has no EOF before the next sheet")):
            if n == 0 and (kind != BOF or len(p) < 4 or struct.unpack_from("<H", p, 2)[0] != WORKSHEET):
                raise WorkbookError("an XLS worksheet BOF offset is invalid")
            reader.read(kind, p)
        reader.settle()
        book.sheets.append(Sheet(name, reader.grid(cells, text)))
    return book
