"""XLSX workbooks out of the elements of their parts: sheets, cells, links and Markdown as joins, windows and aggregates.

A sheet's elements are put in order once; its rows and cells are then known by windows. Shared strings, link displays,
budgets and rendering are the operators of grid, budgets and render, applied to all workbooks together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import refs
from docloom.operators import budgets, grid, render
from docloom.operators.xmlnodes import RELATIONSHIPS, SHEET, is_element, shared_strings, sheet_list
from docloom.sources.shared import stored

#: Parts that these functions need.
PARTS = r"xl/workbook\.xml|xl/_rels/workbook\.xml\.rels|xl/sharedStrings\.xml|xl/worksheets/[^/]*\.xml"
#: Limits, and what is said of a workbook that breaks a rule.
MAX_ROWS, MAX_COLUMNS = 100_000, 16_384
ROW_ERROR = "an XLSX row index is invalid or exceeds the budget"
COLUMN_ERROR = "an XLSX cell reference exceeds the column budget"
ORDER_ERROR = "XLSX cells are not in increasing column order"
STRING_ERROR = "an XLSX shared-string index is invalid"
LINK_ROW_ERROR, LINK_COLUMN_ERROR = "an XLSX hyperlink exceeds the row budget", "an XLSX hyperlink exceeds the column budget"
LINK_ERROR = "an XLSX hyperlink cell reference is invalid"
RELATION_ERROR = "a workbook sheet relationship is missing"


def worksheets(nodes: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, part, error): the sheets that are worksheets, in order, with the part that holds each."""
    rels = nodes.where((F.col("part") == "xl/_rels/workbook.xml.rels") & is_element(RELATIONSHIPS, "Relationship"))
    attr = lambda name: F.col("attrs")[name].alias(name)
    rels = rels.select("path", attr("Id"), attr("Type"), attr("Target"), attr("TargetMode")).withColumns({"rel": F.col("Id"), "type": F.element_at(F.split("Type", "/"), -1), "mode": F.initcap("TargetMode")})
    kinds = F.col("type").isin("worksheet", "chartsheet", "dialogsheet")
    declared = sheet_list(nodes)
    met = grid.sheet_parts(declared, rels.where(kinds).select("path", "rel", "type", "mode", "Target"), ["path"]).where("kind <> 'skipped'")
    part = F.when(F.col("kind") == "worksheet", refs.part_path(F.col("Target")))
    error = F.coalesce("error", F.when(F.col("kind") == "error", F.lit(RELATION_ERROR)), F.when(part.isNull(), F.concat(F.lit("an XLSX worksheet relationship leaves the package: "), F.coalesce("Target", F.lit("")))))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("sheet_no")) - 1
    return met.select("path", nth.alias("sheet_no"), F.col("name").alias("sheet"), part.alias("part"), error.alias("error"))


def _running(given: Column, window: Window) -> Column:
    """given where it is there; else one more than the row before has."""
    nth = F.row_number().over(window)
    last = F.last(F.when(given.isNotNull(), F.struct(given.alias("v"), nth.alias("n"))), ignorenulls=True).over(window)
    return F.coalesce(last["v"], F.lit(-1)) + nth - F.coalesce(last["n"], F.lit(0))


def stored_cells(nodes: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells(path, sheet_no, sheet, r, c, pre, value_type, display, formula, error), rows(path, sheet_no, sheet, r, pre, error)).

    Rows and cells without an address come after the one before. A formula is its text, or null where there is none; an
    empty one is there. error: the rule that a row or a cell breaks.
    """
    own = nodes.join(sheets.where("error is null").select("path", "part", "sheet_no", "sheet"), ["path", "part"])
    order = Window.partitionBy("path", "sheet_no").orderBy("pre")
    latest = lambda when, *what: F.last(F.when(when, F.struct(*what)), ignorenulls=True).over(order)
    main = F.col("ns") == SHEET
    rows = own.withColumn("_top", latest(F.col("depth") == 1, "ns", "name", "last"))
    data = (F.col("_top.name") == "sheetData") & (F.col("_top.ns") == SHEET)
    rows = rows.withColumns({"_row": data & main & (F.col("depth") == 2) & (F.col("name") == "row"), "_c": data & main & (F.col("depth") == 3) & (F.col("name") == "c")})
    cell = F.struct("pre", "last", F.col("attrs")["r"].alias("r"), F.col("attrs")["t"].alias("t"))
    rows = rows.withColumns({"_in_row": latest(F.col("_row"), "pre", "last")["pre"], "_cell": latest(F.col("_c"), cell.alias("x"))["x"], "_is": latest(main & (F.col("depth") == 4) & (F.col("name") == "is"), "pre", "last")})

    given = F.when(F.col("attrs")["r"].rlike(r"\A[0-9]{1,9}\z"), F.col("attrs")["r"].cast("long") - 1)
    numbered = rows.where("_row").select("path", "sheet_no", "sheet", "pre", _running(given, order).alias("r"))
    before = F.lag("r").over(order)
    bad = (F.col("r") >= MAX_ROWS) | (F.col("r") <= F.coalesce(before, F.lit(-1)))
    numbered = numbered.withColumn("error", F.when(bad, F.lit(ROW_ERROR)))

    inner = rows.where(F.col("_cell").isNotNull() & (F.col("pre") <= F.col("_cell.last")) & main)
    piece = F.struct("pre", "text")
    direct = lambda name: (F.col("depth") == 4) & (F.col("name") == name)
    text = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, piece))), lambda p: p["text"]), "")
    inline = (F.col("name") == "t") & (F.col("pre") <= F.col("_is.last")) & (F.col("_is.pre") > F.col("_cell.pre"))
    cells = inner.groupBy("path", "sheet_no", "sheet", "_in_row", "_cell").agg(text(direct("v")).alias("raw"), F.bool_or(direct("f")).alias("_has"), text(direct("f")).alias("_f"), text(inline).alias("_t"))
    cells = cells.select("path", "sheet_no", "sheet", "_in_row", F.col("_cell.pre").alias("pre"), F.col("_cell.r").alias("address"), F.col("_cell.t").alias("t"), "raw", F.when(F.col("_has"), F.col("_f")).alias("formula"), F.col("_t").alias("inline"))
    cells = cells.join(numbered.select("path", "sheet_no", F.col("pre").alias("_in_row"), "r"), ["path", "sheet_no", "_in_row"])
    along = Window.partitionBy("path", "sheet_no", "_in_row").orderBy("pre")
    column = _running(refs.a1_column(F.col("address")), along)
    cells = cells.withColumn("c", column).withColumn("_before", F.lag("c").over(along))
    column_error = F.when((F.col("address").isNotNull() & refs.a1_column(F.col("address")).isNull()) | (F.col("c") >= MAX_COLUMNS), F.lit(COLUMN_ERROR)).when(F.col("c") <= F.col("_before"), F.lit(ORDER_ERROR))

    idx = F.when((F.col("t") == "s") & F.trim("raw").rlike(r"\A[0-9]{1,9}\z"), F.trim("raw").cast("int"))
    strings = shared_strings(nodes).select("path", "idx", F.col("text").alias("shared"))
    typed = cells.withColumn("idx", idx).join(strings, ["path", "idx"], "left")
    shared, plain = F.coalesce(F.col("t") == "s", F.lit(False)), F.coalesce("t", F.lit("n"))
    yes = (F.col("raw") == "1") | (F.lower("raw") == "true")
    kind = F.when(shared | (plain == "inlineStr"), "string").when(F.col("raw") == "", "empty").when(plain == "b", "boolean").when(plain.isin("str", "e"), "string").otherwise("number")
    display = F.when(shared, F.col("shared")).when(plain == "inlineStr", F.col("inline")).when((plain == "b") & (F.col("raw") != ""), F.when(yes, "TRUE").otherwise("FALSE")).otherwise(F.col("raw"))
    error = F.coalesce(column_error, F.when(shared & F.col("shared").isNull(), F.lit(STRING_ERROR)))
    return typed.select("path", "sheet_no", "sheet", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "pre", kind.alias("value_type"), F.coalesce(display, F.lit("")).alias("display"), "formula", error.alias("error")), numbered


def links(nodes: DataFrame, sheets: DataFrame) -> DataFrame:
    """(path, sheet_no, link, r0, c0, r1, c1, display, error): hyperlinks that show a text, in order of place."""
    own = nodes.where(is_element(SHEET, "hyperlink")).join(sheets.where("error is null").select("path", "part", "sheet_no"), ["path", "part"])
    ref = F.col("attrs")["ref"]
    rows = own.where(ref.isNotNull() & (F.coalesce(F.col("attrs")["display"], F.lit("")) != "")).select("path", "sheet_no", F.col("pre").alias("link"), refs.a1_range(ref).alias("_a"), F.col("attrs")["display"].alias("display"))
    error = F.when(F.col("_a").isNull(), LINK_ERROR).when(F.col("_a.r1") >= MAX_ROWS, LINK_ROW_ERROR).when(F.col("_a.c1") >= MAX_COLUMNS, LINK_COLUMN_ERROR)
    return rows.select("path", "sheet_no", "link", "_a.r0", "_a.c0", "_a.r1", "_a.c1", "display", error.alias("error"))


@dataclass
class Tables:
    """The workbooks of many packages: sheets, stored cells, rows and links that show a text, a table each."""

    sheets: DataFrame
    cells: DataFrame
    rows: DataFrame
    links: DataFrame

    def without(self, wrong: DataFrame) -> Tables:
        """The tables without the workbooks of wrong(path)."""
        return Tables(*(t.join(wrong.select("path"), "path", "left_anti") for t in (self.sheets, self.cells, self.rows, self.links)))


def tables(nodes: DataFrame) -> Tables:
    """The tables of NODES, each evaluated once, in the shared folder."""
    nodes = stored(nodes)
    sheets = stored(worksheets(nodes))
    cells, rows = stored_cells(nodes, sheets)
    return Tables(sheets, stored(cells), stored(rows), stored(links(nodes, sheets)))


def errors(books: Tables) -> DataFrame:
    """(path, error): workbooks that break a rule or a budget, with the first, by sheet and place; known before any is laid out."""
    said = lambda t, place: t.select("path", "sheet_no", place.alias("pre"), "error")
    broken = said(books.sheets, F.lit(-1)).unionAll(said(books.rows, F.col("pre"))).unionAll(said(books.cells, F.col("pre"))).unionAll(said(books.links, F.col("link")))
    over = budgets.workbook_errors(books.cells.where("error is null"), books.links.where("error is null").drop("error"), ["path"])
    broken = broken.unionAll(said(over, F.lit((1 << 31) - 1)))
    return broken.where("error is not null").groupBy("path").agg(F.min(F.struct("sheet_no", "pre", "error"))["error"].alias("error"))


def shown_cells(books: Tables) -> DataFrame:
    """(path, sheet_no, sheet, r, c, value_type, display, formula): stored cells, and those that link displays fill.

    For workbooks within their budgets: an area is laid out, however large it is.
    """
    by = ["path", "sheet_no"]
    filled = grid.link_fill(books.cells.select(*by, "r", "c", "display", "formula"), books.links.where("error is null"), by)
    filled = filled.join(books.sheets.select(*by, "sheet"), by).select(*by, "sheet", "r", "c", F.lit("string").alias("value_type"), "display", F.lit(None).cast("string").alias("formula"))
    stays = books.cells.join(filled.select(*by, "r", "c"), [*by, "r", "c"], "left_anti")
    return stays.select(filled.columns).unionAll(filled)


def markdown(books: Tables, limit: int = render.MAX_OUTPUT) -> DataFrame:
    """(path, markdown, error): each workbook as a document of tables, or the error that it has instead."""
    by = ["path", "sheet_no"]
    wrong = stored(errors(books))
    fine = books.without(wrong)
    good = shown_cells(fine)
    heights = fine.rows.select(*by, "r", F.lit(0).cast("long").alias("c"), F.lit("").alias("display"), F.lit(False).alias("solid"))
    every = good.select(*by, "r", "c", "display", F.col("formula").isNotNull().alias("solid")).unionAll(heights)
    # a row that holds nothing is there, too; a cell comes before the place that only says so
    every = every.groupBy(*by, "r", "c").agg(F.max_by("display", F.struct("solid", "display")).alias("display"), F.max("solid").alias("solid"))
    flagged = grid.dense_grid(every.withColumn("display", F.concat(F.when(F.col("solid"), "1").otherwise("0"), "display")), by)
    row = F.transform("row", lambda x: F.substring(x, 2, (1 << 31) - 1))
    solid = F.transform("row", lambda x: F.substring(x, 1, 1) == "1")
    dense = flagged.select(*by, "r", row.alias("row"), solid.alias("solid")).select(*by, "r", grid.trailing_trim(F.col("row"), F.col("solid")).alias("row"))
    # a sheet of rows that hold nothing is an empty one
    full = dense.groupBy(*by).agg(F.max(F.size("row")).alias("_w")).where("_w > 0").select(*by)
    named = fine.sheets.select(*by, "sheet", refs.stem(F.col("path")).alias("title"))
    laid = stored(dense.join(full, by, "left_semi").join(named, by))
    over = render.table_bytes(laid, ["path"], "sheet_no", "sheet", "title").where(F.col("n_bytes") > limit).select("path", F.lit(render.TOO_LARGE).alias("error"))
    wrong = wrong.unionAll(stored(over))
    left = lambda t: t.join(wrong.select("path"), "path", "left_anti")
    bodies = left(named).join(render.gfm_tables(left(laid), by), by, "left").withColumn("body", F.coalesce("body", F.lit("_Empty sheet._"))).withColumnRenamed("sheet", "name")
    done = render.workbooks(bodies, ["path"], "title")
    return done.withColumn("error", F.lit(None).cast("string")).unionAll(wrong.select("path", F.lit(None).cast("string").alias("markdown"), "error"))
