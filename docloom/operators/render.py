"""Renderers: grids to Markdown tables and TSV blocks, sheets to workbooks, sections to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import fence, gfm_cell, heading, tsv_cell


def _width(rows: Column) -> Column:
    return F.greatest(F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r["row"]))), F.lit(0)), F.lit(1))


def _line(row: Column, width: Column) -> Column:
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda i: gfm_cell(F.coalesce(F.get(row, i), F.lit(""))))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _ordered(grid: DataFrame, by: list[str]) -> DataFrame:
    return grid.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "row"))).alias("rows"))


def gfm_tables(grid: DataFrame, by: list[str]) -> DataFrame:
    """(by, body): the first row is the header; rows are padded to the widest, of one column at least."""
    sheets = _ordered(grid, by).withColumn("w", _width(F.col("rows")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    lines = F.transform("rows", lambda r: _line(r["row"], F.col("w")))
    body = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n")
    return sheets.select(*by, F.when(F.size("rows") == 0, "_Empty sheet._").otherwise(body).alias("body"))


def tsv_blocks(grid: DataFrame, by: list[str]) -> DataFrame:
    """(by, body): a fenced block of tab-separated, reversible cells."""
    sheets = _ordered(grid, by).withColumn("w", _width(F.col("rows")))
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: tsv_cell(F.coalesce(F.get(r["row"], i), F.lit("")))), "\t")
    text = F.array_join(F.transform("rows", line), "\n")
    mark = fence(text)
    return sheets.select(*by, F.concat(mark, F.lit("tsv\n"), text, F.lit("\n"), mark).alias("body"))


def workbooks(bodies: DataFrame, by: list[str], title: str) -> DataFrame:
    """bodies(by, title, sheet_no, name, body) -> (by, markdown): a heading, then each sheet in order."""
    part = F.concat(F.lit("\n\n## Sheet: "), heading(F.col("name")), F.lit("\n\n"), F.col("body"))
    parts = F.array_sort(F.collect_list(F.struct("sheet_no", part.alias("part"))))
    docs = bodies.groupBy(*by, title).agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return docs.select(*by, F.concat(F.lit("# "), heading(F.col(title)), text, F.lit("\n")).alias("markdown"))


def sections(items: DataFrame, by: list[str], title: str) -> DataFrame:
    """items(by, title, pos, kind, text, name) -> (by, markdown): sections get a heading, all are joined by a blank line."""
    body = F.regexp_replace("text", r"^[\r\n]+|[\r\n]+$", "")
    part = F.when(F.col("kind") == "section", F.concat(F.lit("## Section: "), heading(F.col("name")), F.lit("\n\n"), body)).otherwise(body)
    docs = items.groupBy(*by, title).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    return docs.select(*by, F.concat(F.lit("# "), heading(F.col(title)), F.lit("\n\n"), text, F.lit("\n")).alias("markdown"))


def within_budget(text: Column, limit: int = 134_217_728) -> Column:
    """An error for a text over the output limit, else null."""
    return F.when(F.octet_length(text) > limit, F.lit(TOO_LARGE))


#: The output limit, and what is said of a workbook over it.
MAX_OUTPUT = 134_217_728
TOO_LARGE = "the spreadsheet output exceeds the supported size limit"


def table_bytes(grid: DataFrame, by: list[str], sheet: str, name: str, title: str) -> DataFrame:
    """grid(by, sheet, name, title, r, row) -> (by, n_bytes): the size of each workbook that gfm_tables() and workbooks()
    would make of it, from the sizes of its cells."""
    cells = F.aggregate("row", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(gfm_cell(x)))
    lines = grid.select(*by, sheet, F.octet_length(heading(F.col(name))).alias("_name"), F.octet_length(heading(F.col(title))).alias("_title"), cells.alias("_cells"), F.size("row").alias("_n"))
    sheets = lines.groupBy(*by, sheet).agg(F.count("*").alias("rows"), F.greatest(F.max("_n"), F.lit(1)).alias("w"), F.sum("_cells").alias("cells"), F.first("_name").alias("name"), F.first("_title").alias("title"))
    # a line is framed by 4 bytes and has 3 between cells; the rule has 3 more a cell; a sheet's heading takes 14
    body = F.col("cells") + (F.col("rows") + 1) * (3 * F.col("w") + 1) + 3 * F.col("w") + F.col("rows")
    return sheets.groupBy(*by).agg((F.sum(body + 14 + F.col("name")) + F.first("title") + 3).cast("long").alias("n_bytes"))


def bounded_workbooks(grid: DataFrame, by: list[str], sheet: str, name: str, title: str, limit: int = MAX_OUTPUT) -> DataFrame:
    """(by, n_bytes, markdown, error). A workbook over the limit has the error and is never put together."""
    sizes = table_bytes(grid, by, sheet, name, title)
    small = grid.join(sizes.where(F.col("n_bytes") <= limit).select(*by), by, "left_semi")
    bodies = gfm_tables(small, [*by, sheet, name, title]).withColumnsRenamed({sheet: "sheet_no", name: "name"})
    done = sizes.join(workbooks(bodies, by, title), by, "left")
    return done.select(*by, "n_bytes", "markdown", F.when(F.col("n_bytes") > limit, F.lit(TOO_LARGE)).alias("error"))
