"""Budgets over whole workbooks: running sums in a given order, and the first place at which each goes over its limit.

A running sum is made in levels. Rows are summed by coarse blocks of the order, these by finer ones, and each level is
summed up within the one above; a row then needs its own finest block alone. So a workbook, or an order over the whole
corpus, is never brought to one task, however many rows it has, as long as a block and a level are of moderate size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a workbook, and what is said of one over them.
MAX_CELLS, MAX_SCANS, MAX_TEXT = 1_000_000, 1_000_000, 134_217_728
CELLS_ERROR = "the XLSX sheet exceeds the expanded-cell budget"
SCANS_ERROR = "the XLSX hyperlinks exceed the scan budget"
TEXT_ERROR = "the spreadsheet exceeds the materialized-text budget"


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    side = right.select(*(F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    out = left.join(side, on, "left") if on else left.crossJoin(F.broadcast(side))  # without keys the side is one row
    return out.drop(*(f"_r_{i}" for i in range(len(keys))))


def prefix_sums(rows: DataFrame, by: list[str], levels: list[Column], order: list[str], **amounts: Column) -> DataFrame:
    """rows with a column for each amount: its sum within `by` up to the row, in order, the row included.

    levels: blocks of the order, the coarsest first, each finer than the one before and rising with the order. A window
    sees the blocks of one level within one block of the level above, or the rows of one finest block.
    """
    names = [f"_b{i}" for i in range(len(levels))]
    rows = rows.withColumns({n: c for n, c in zip(names, levels)} | {f"_a_{n}": F.coalesce(c, F.lit(0)) for n, c in amounts.items()})
    before: DataFrame | None = None
    for depth in range(1, len(names) + 1):
        keys = [*by, *names[:depth]]
        totals = rows.groupBy(*keys).agg(*(F.sum(f"_a_{n}").alias(f"_t_{n}") for n in amounts))
        upto = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = totals.select(*keys, *(F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_o_{n}") for n in amounts))
        if before is not None:
            above = before.select(*keys[:-1], *(F.col(f"_o_{n}").alias(f"_p_{n}") for n in amounts))
            sums = _joined(sums, above, keys[:-1]).select(*keys, *((F.col(f"_o_{n}") + F.col(f"_p_{n}")).alias(f"_o_{n}") for n in amounts))
        before = sums
    own = Window.partitionBy(*by, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(f"_a_{n}").over(own) for n in amounts})
    if before is not None:
        rows = _joined(rows, before, [*by, *names]).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in amounts})
    return rows.drop(*names, *(f"_a_{n}" for n in amounts), *(f"_o_{n}" for n in amounts))


def first_over(sums: DataFrame, by: list[str], order: list[str], **limits: int) -> DataFrame:
    """(by, and for each amount its total and `<amount>_at`: the place of the first row over the limit, or null)."""
    place = F.struct(*order)
    aggs = [x for n, limit in limits.items() for x in (F.max(n).alias(n), F.min(F.when(F.col(n) > limit, place)).alias(f"{n}_at"))]
    return sums.groupBy(*by).agg(*aggs)


def cell_budgets(cells: DataFrame, by: list[str], max_cells: int = MAX_CELLS, max_text: int = MAX_TEXT, rows_a_block: int = 256) -> DataFrame:
    """cells(by, sheet_no, r, c, display) -> (by, cells, cells_at, bytes, bytes_at): places are (sheet_no, r).

    A row counts its cells up to its last one, before any trimming; gaps count, too. bytes: of the displays, in UTF-8.
    A hot workbook is split by sheet and blocks of rows; nothing is laid out or put together to count it.
    """
    lines = cells.groupBy(*by, "sheet_no", "r").agg((F.max("c") + 1).cast("long").alias("_w"), F.sum(F.octet_length("display")).cast("long").alias("_t"))
    levels = [F.col("sheet_no"), F.floor(F.col("r") / rows_a_block)]
    sums = prefix_sums(lines, by, levels, ["r"], cells=F.col("_w"), bytes=F.col("_t"))
    return first_over(sums, by, ["sheet_no", "r"], cells=max_cells, bytes=max_text)


def scan_budgets(links: DataFrame, by: list[str], max_scans: int = MAX_SCANS, max_cells: int = MAX_CELLS, links_a_block: int = 1024) -> DataFrame:
    """links(by, sheet_no, link, r0, c0, r1, c1) -> (by, scanned, scanned_at, large_at): places are (sheet_no, link).

    scanned: cells of all areas, in order of sheet and link; large_at: the first area over the cell budget by itself.
    """
    area = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)
    rows = links.select(*by, "sheet_no", "link", area.alias("_area"))
    large = rows.groupBy(*by).agg(F.min(F.when(F.col("_area") > max_cells, F.struct("sheet_no", "link"))).alias("large_at"))
    sums = prefix_sums(rows, by, [F.col("sheet_no"), F.floor(F.col("link") / links_a_block)], ["link"], scanned=F.col("_area"))
    return _joined(first_over(sums, by, ["sheet_no", "link"], scanned=max_scans), large, by)


def workbook_errors(cells: DataFrame, links: DataFrame, by: list[str], max_cells: int = MAX_CELLS, max_text: int = MAX_TEXT, max_scans: int = MAX_SCANS) -> DataFrame:
    """(by, cells, bytes, scanned, sheet_no, error): for each workbook its sums, and its first sheet over a budget.

    Within a sheet its cells come before its links, the number of cells before their text, and a single large area
    before the sum of areas.
    """
    found = cells.select(*by).unionAll(links.select(*by)).distinct()
    for side in (cell_budgets(cells, by, max_cells, max_text), scan_budgets(links, by, max_scans, max_cells)):
        found = _joined(found, side, by)
    sheet = lambda place: F.col(place)["sheet_no"]
    told = [(sheet("cells_at"), 0, CELLS_ERROR), (sheet("bytes_at"), 1, TEXT_ERROR), (sheet("large_at"), 2, CELLS_ERROR), (sheet("scanned_at"), 3, SCANS_ERROR)]
    first = F.array_min(F.filter(F.array(*(F.when(s.isNotNull(), F.struct(s.alias("sheet_no"), F.lit(n).alias("n"), F.lit(e).alias("error"))) for s, n, e in told)), lambda x: x.isNotNull()))
    return found.select(*by, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("cells", "bytes", "scanned")), first["sheet_no"].alias("sheet_no"), first["error"].alias("error"))
