"""The workbook model that the spreadsheet readers share: ragged rows of cells with stored text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

#: Fixed limits of a workbook; beyond one the workbook is refused, never cut short.
MAX_SHEETS, MAX_ROWS, MAX_COLUMNS, MAX_CELLS, MAX_STRINGS = 256, 100_000, 16_384, 1_000_000, 1_000_000
MAX_TEXT = 134_217_728


class WorkbookError(ValueError):
    pass


class Cell(NamedTuple):
    """value_type: empty, string, number, boolean or date; numbers and dates are the stored text. formula: None or text."""

    value_type: str = "empty"
    value: str | None = None
    display: str = ""
    formula: str | None = None

    @property
    def blank(self) -> bool:
        return self.display == "" and self.formula is None


EMPTY = Cell()


@dataclass
class Sheet:
    name: str
    rows: list[list[Cell]] = field(default_factory=list)


@dataclass
class Workbook:
    sheets: list[Sheet] = field(default_factory=list)
    merges: bool = False
    missing_results: bool = False
    unsupported: bool = False
    #: Sheets whose cells were read; those that nobody asked for have none.
    parsed: int = 0

    def cells(self) -> Iterator[tuple[int, str, int, int, str, str | None, str, str | None]]:
        for n, sheet in enumerate(self.sheets):
            for r, row in enumerate(sheet.rows):
                for c, cell in enumerate(row):
                    yield (n, sheet.name, r, c, *cell)


#: Whether a sheet, by its number and name, is to be read.
Keep = Callable[[int, str], bool]


def every(number: int, name: str) -> bool:
    return True


class Budget:
    """A shared amount that is spent until it is gone."""

    def __init__(self, limit: int, message: str):
        self.left, self.message = limit, message

    def spend(self, amount: int) -> None:
        self.left -= amount
        if self.left < 0:
            raise WorkbookError(self.message)


def trimmed(row: list[Cell]) -> list[Cell]:
    end = len(row)
    while end and row[end - 1].blank:
        end -= 1
    return row[:end]


def utf8(text: str | None) -> int:
    return len(text.encode("utf-8", "surrogatepass")) if text else 0
