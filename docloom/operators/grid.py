"""Cell tables: sparse to dense, run lengths, trims, link displays, budgets, lookups.

A cell table has a row for each cell: sheet columns (`by`), r, c and display; a grid has a row for each sheet row, with
an array of displays. Everything that is needed of a sheet is shuffled to it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_written(cells: DataFrame, by: list[str], order: Column) -> DataFrame:
    """One display for each cell: the last in order."""
    return cells.groupBy(*by, "r", "c").agg(F.max_by("display", order).alias("display"))


def dense_grid(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, row array<string>): rows 0 to the last, each from column 0 to its own last; gaps are empty."""
    rows = cells.groupBy(*by, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "display"))).alias("m"), F.max("c").alias("w"))
    row = F.transform(F.sequence(F.lit(0), F.col("w").cast("int")), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit("")))
    sheets = rows.select(*by, F.col("r").cast("int").alias("r"), row.alias("row")).groupBy(*by)
    sheets = sheets.agg(F.map_from_entries(F.collect_list(F.struct("r", "row"))).alias("rows"), F.max("r").alias("h"))
    empty = F.array().cast("array<string>")
    flat = sheets.select(*by, "rows", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("r"))
    return flat.select(*by, "r", F.coalesce(F.try_element_at("rows", F.col("r")), empty).alias("row"))


def trailing_trim(row: Column, solid: Column | None = None) -> Column:
    """A row without its trailing empty cells. solid: flags of the cells that aren't empty although they show nothing, as
    those with a formula."""
    flag = lambda i: F.coalesce(F.get(solid, i), F.lit(False)) if solid is not None else F.lit(False)
    last = F.array_max(F.transform(row, lambda x, i: F.when((x != "") | flag(i), i + 1).otherwise(0)))
    return F.slice(row, 1, F.coalesce(last, F.lit(0)))


def rle_expand(runs: DataFrame, by: list[str], order: str) -> DataFrame:
    """runs(by, order, display, repeat) -> (by, c, display): repeats laid out one after another.

    A trailing run of empty cells is not laid out; inner ones are, and covered cells are kept even at the end.
    """
    w = Window.partitionBy(*by).orderBy(order)
    solid = (F.col("display") != "") | F.col("covered")
    rows = runs.withColumn("_start", F.sum("repeat").over(w) - F.col("repeat")).withColumn("_end", F.max(F.when(solid, F.col(order))).over(Window.partitionBy(*by)))
    rows = rows.where(F.col(order) <= F.col("_end"))
    return rows.select(*by, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("repeat") - 1)).alias("c"), "display")


#: Rows and columns of a tile: a row of it is the 64 bits of a long.
TILE = 64


def link_fill(cells: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Cells that link displays fill: those of a link's range that hold nothing, the first link winning.

    links(by, link, r0, c0, r1, c1, display); an empty display fills nothing. cells(by, r, c, display[, formula]): a cell
    with a formula holds something even if it shows nothing.

    Ranges are cut at the borders of tiles; of ranges that cover the same part of a tile the first alone goes on. A row of
    a tile is a mask of its columns, for each range that covers any and for the cells that hold something, so ranges and
    cells meet by tile rows. There the ranges take their turns, each the bits that are left; only what they get is laid
    out as cells, and that is not shuffled any more.
    """
    row = [*by, "r", "_tc"]
    rows = links.where("display <> ''").select(*by, F.struct("link", "display").alias("_link"), *(F.col(c).cast("long").alias(c) for c in ("r0", "c0", "r1", "c1"))).where("r0 <= r1 and c0 <= c1")
    block = lambda c: F.floor(F.col(c) / TILE)
    rows = rows.withColumn("_tr", F.explode(F.sequence(block("r0"), block("r1")))).withColumn("_tc", F.explode(F.sequence(block("c0"), block("c1"))))
    edge = lambda low, high, tile: (F.greatest(F.col(low), F.col(tile) * TILE), F.least(F.col(high), F.col(tile) * TILE + TILE - 1))
    (top, bottom), (left, right) = edge("r0", "r1", "_tr"), edge("c0", "c1", "_tc")
    parts = rows.groupBy(*by, top.alias("_top"), bottom.alias("_bottom"), "_tc", left.alias("_left"), right.alias("_right")).agg(F.min("_link").alias("_link"))
    shift = lambda x, n: F.call_function("shiftleft", x, n.cast("int"))
    one, width = F.lit(1).cast("long"), F.col("_right") - F.col("_left") + 1
    mask = shift(F.when(width == TILE, F.lit(-1).cast("long")).otherwise(shift(one, width) - 1), F.col("_left") - F.col("_tc") * TILE)
    lines = parts.select(*by, F.explode(F.sequence("_top", "_bottom")).alias("r"), "_tc", mask.alias("_mask"), "_link")
    # one exchange by tile row serves both steps; of ranges with one mask the first is kept, so a list has 2,080 at most
    lines = lines.repartition(*row).groupBy(*row, "_mask").agg(F.min("_link").alias("_link")).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("_link", "_mask"))).alias("_turns"))
    holds = "display <> ''" + (" or formula is not null" if "formula" in cells.columns else "")
    place = cells.where(holds).select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    held = place.groupBy(*by, "r", block("c").alias("_tc")).agg(F.bit_or(shift(one, F.col("c") % TILE)).alias("_held"))
    got = "array<struct<display:string,mask:bigint>>"

    def turn(s: Column, x: Column) -> Column:
        new = x["_mask"].bitwiseAND(F.bitwise_not(s["taken"]))
        gets = F.concat(s["gets"], F.array(F.struct(x["_link"]["display"].alias("display"), new.alias("mask"))))
        return F.struct(s["taken"].bitwiseOR(new).alias("taken"), F.when(new != 0, gets).otherwise(s["gets"]).alias("gets"))

    met = lines.join(held, row, "left")
    start = F.struct(F.coalesce("_held", F.lit(0).cast("long")).alias("taken"), F.array().cast(got).alias("gets"))
    filled = met.select(*row, F.explode(F.aggregate("_turns", start, turn, lambda s: s["gets"])).alias("_g"))
    columns = F.filter(F.sequence(F.lit(0), F.lit(TILE - 1)), lambda b: F.getbit(F.col("_g.mask"), b) == 1)
    return filled.select(*by, "r", F.col("_tc"), F.col("_g.display").alias("display"), F.explode(columns).alias("_b")).select(*by, "r", (F.col("_tc") * TILE + F.col("_b")).alias("c"), "display")


def running_budget(rows: DataFrame, by: list[str], order: list[str], amount: str, limit: int) -> DataFrame:
    """rows with `used`, the running sum within `by`, and `over`, whether it is beyond the limit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(amount).over(w)).withColumn("over", F.col("used") > limit)


def extents(offsets: DataFrame, by: list[str], offset: str, end: Column) -> DataFrame:
    """Physical ends: the next larger offset of the same file, or the file's end."""
    w = Window.partitionBy(*by).orderBy(offset)
    return offsets.withColumn("stop", F.coalesce(F.lead(offset).over(w), end))


def shared_strings(cells: DataFrame, strings: DataFrame, by: list[str]) -> DataFrame:
    """cells(by, idx) with the text of their index, and an error where it is out of range."""
    rows = cells.join(strings, [*by, "idx"], "left")
    return rows.withColumn("error", F.when(F.col("text").isNull(), F.lit("a shared string index is out of range")))


def sheet_parts(sheets: DataFrame, rels: DataFrame, by: list[str]) -> DataFrame:
    """sheets(by, sheet_no, rel) with kind: worksheet, skipped (chart and dialog sheets) or error."""
    rows = sheets.join(rels, [*by, "rel"], "left")
    kind = (
        F.when(F.col("type").isNull(), "error")
        .when((F.col("type") == "worksheet") & (F.col("mode") == "External"), "error")
        .when(F.col("type") == "worksheet", "worksheet")
        .when(F.col("type").isin("chartsheet", "dialogsheet"), "skipped")
        .otherwise("error")
    )
    return rows.withColumn("kind", kind)


#: Entries whose presence means objects that a table cannot show.
OBJECT_PARTS = ("xl/charts/", "xl/drawings/", "xl/media/", "xl/comments", "xl/threadedComments/", "xl/vbaProject.bin")


def unsupported_parts(names: Column) -> Column:
    """Whether any entry name is of an object that cannot be shown."""
    return F.exists(names, lambda n: F.greatest(*(n.startswith(p) for p in OBJECT_PARTS)))
