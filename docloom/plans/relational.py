"""Queries of the relational operators over the test tables, each with the SQL that it is held against.

The test texts hold few of the characters that escapes and markers are about, so hostile content is put into them by
rule, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalog import declared
from docloom.functions import refs, text
from docloom.functions.images import IMAGE
from docloom.operators import budgets, colours, grid, images, normalize, render, resolve
from docloom.sources.convert import DEFAULT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What is put before a text, by number modulo the length: Spark and DuckDB get the same characters.
HOSTILE = ["\\", "a```b``c ", "\t", "x\r\ny\rz", "|", "~&*_[x]", "", "# ", "12) ", "- ", "    ", "***• ***", "\\- ", "\\_\\_\\_"]


def hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*map(F.lit, HOSTILE))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.get(parts, (F.col("doc_id") % len(HOSTILE)).cast("int")), F.col("text")).alias("text"))


def _duck(value: str) -> str:
    out = value.replace("'", "''")
    for ch, name in (("\r", "chr(13)"), ("\n", "chr(10)"), ("\t", "chr(9)")):
        out = out.replace(ch, f"' || {name} || '")
    return f"('{out}')"


DUCK_HOSTILE = f"SELECT doc_id, [{', '.join(map(_duck, HOSTILE))}][doc_id % {len(HOSTILE)} + 1] || text AS text FROM documents"
GFM = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '|', '\|'), chr(13) || chr(10), '<br>'), chr(13), '<br>'), chr(10), '<br>')"
TSV = r"replace(replace(replace(replace(replace({0}, '\', '\\'), chr(13) || chr(10), '\n'), chr(13), '\n'), chr(10), '\n'), chr(9), '\t')"


@query(f"WITH h AS ({DUCK_HOSTILE}) SELECT doc_id, {TSV.format('text')} AS cell FROM h")
def tsv_cell_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostile(spark, sf_dir).select("doc_id", text.tsv_cell(F.col("text")).alias("cell"))


@query(f"WITH h AS ({DUCK_HOSTILE}) SELECT doc_id, {GFM.format('text')} AS cell FROM h")
def gfm_cell_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostile(spark, sf_dir).select("doc_id", text.gfm_cell(F.col("text")).alias("cell"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each order, at most 97 to a book: a row for each line number, a column by part; several writes may meet in a cell."""
    rows = table(spark, sf_dir, "lineitem")
    shown = F.concat(F.col("l_returnflag"), F.lit("|"), F.col("l_suppkey").cast("string"))
    return rows.select(
        F.expr("l_orderkey div 97").alias("doc_id"), F.col("l_orderkey").alias("sheet_no"), F.col("l_linenumber").alias("r"), (F.col("l_partkey") % 5).cast("int").alias("c"),
        shown.alias("display"), F.struct("l_partkey", "l_suppkey", shown).alias("written"),
    )


ORDER_CELLS = """
cell AS (SELECT l_orderkey // 97 AS doc_id, l_orderkey AS sheet_no, l_linenumber AS r, (l_partkey % 5)::INT AS c,
    max_by(l_returnflag || '|' || l_suppkey, (l_partkey, l_suppkey, l_returnflag || '|' || l_suppkey)) AS display FROM lineitem GROUP BY ALL),
high AS (SELECT doc_id, sheet_no, unnest(range(0, max(r)::BIGINT + 1))::INT AS r FROM cell GROUP BY doc_id, sheet_no),
wide AS (SELECT doc_id, sheet_no, r, max(c) AS w FROM cell GROUP BY ALL)
"""


@query(f"""WITH {ORDER_CELLS},
full_row AS (SELECT doc_id, sheet_no, r, unnest(range(0, w::BIGINT + 1))::INT AS c FROM wide),
shown AS (SELECT f.doc_id, f.sheet_no, f.r, f.c, coalesce(display, '') AS display FROM full_row f LEFT JOIN cell USING (doc_id, sheet_no, r, c))
SELECT h.doc_id, h.sheet_no, h.r, coalesce(array_to_string(list(display ORDER BY c), chr(9)), '') AS cells, count(display)::BIGINT AS n
FROM high h LEFT JOIN shown s USING (doc_id, sheet_no, r) GROUP BY ALL""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.last_written(order_cells(spark, sf_dir), ["doc_id", "sheet_no"], F.col("written"))
    dense = grid.dense_grid(cells, ["doc_id", "sheet_no"])
    return dense.select("doc_id", "sheet_no", "r", F.array_join("row", "\t").alias("cells"), F.size("row").cast("long").alias("n"))


@query(f"""WITH {ORDER_CELLS},
most AS (SELECT doc_id, sheet_no, max(c) AS w FROM cell GROUP BY ALL),
spot AS (SELECT h.doc_id, h.sheet_no, h.r, unnest(range(0, w::BIGINT + 1))::INT AS c FROM high h JOIN most USING (doc_id, sheet_no)),
line AS (SELECT s.doc_id, s.sheet_no, s.r, '| ' || string_agg({GFM.format("coalesce(display, '')")}, ' | ' ORDER BY s.c) || ' |' AS t
    FROM spot s LEFT JOIN cell USING (doc_id, sheet_no, r, c) GROUP BY ALL),
ruled AS (SELECT doc_id, sheet_no, 2 * r AS o, t FROM line UNION ALL
    SELECT doc_id, sheet_no, 1, '| ' || array_to_string(list_transform(range(0, w::BIGINT + 1), lambda i: '---'), ' | ') || ' |' FROM most),
body AS (SELECT doc_id, sheet_no, string_agg(t, chr(10) ORDER BY o) AS body FROM ruled GROUP BY ALL)
SELECT doc_id, '# orders ' || doc_id || string_agg(chr(10) || chr(10) || '## Sheet: o' || sheet_no || chr(10) || chr(10) || body, '' ORDER BY sheet_no) || chr(10) AS markdown
FROM body GROUP BY doc_id""")
def gfm_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.last_written(order_cells(spark, sf_dir), ["doc_id", "sheet_no"], F.col("written"))
    bodies = render.gfm_tables(grid.dense_grid(cells, ["doc_id", "sheet_no"]), ["doc_id", "sheet_no"])
    named = bodies.withColumn("name", F.concat(F.lit("o"), F.col("sheet_no").cast("string"))).withColumn("title", F.concat(F.lit("orders "), F.col("doc_id").cast("string")))
    return render.workbooks(named, ["doc_id"], "title")


def book_cells(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """order_cells in books of at most 64 sheets, so that no book grows with the tables; runs of backticks stand first.

    once: cells are dealt out by book, and grids, tables and books are then made where they are.
    """
    cells = order_cells(spark, sf_dir).withColumn("doc_id", F.expr("sheet_no div 64"))
    cells = cells.repartition("doc_id") if once else cells
    shown = F.concat(F.repeat(F.lit("`"), (F.col("written.l_suppkey") % 5).cast("int")), "display")
    return grid.last_written(cells.withColumn("display", shown), ["doc_id", "sheet_no"], F.col("written"))


BOOK_CELLS = """
cell AS (SELECT l_orderkey // 64 AS doc_id, l_orderkey AS sheet_no, l_linenumber AS r, (l_partkey % 5)::INT AS c,
    max_by(repeat('`', l_suppkey % 5) || l_returnflag || '|' || l_suppkey, (l_partkey, l_suppkey, l_returnflag || '|' || l_suppkey)) AS display FROM lineitem GROUP BY ALL),
size AS (SELECT doc_id, sheet_no, max(r) AS h, max(c) AS w FROM cell GROUP BY ALL),
spot AS (SELECT doc_id, sheet_no, r, unnest(range(0, w::BIGINT + 1))::INT AS c FROM (SELECT doc_id, sheet_no, w, unnest(range(0, h::BIGINT + 1))::INT AS r FROM size)),
shown AS (SELECT s.*, coalesce(display, '') AS display FROM spot s LEFT JOIN cell USING (doc_id, sheet_no, r, c))
"""
_BOOK_SQL = """SELECT doc_id, '# orders ' || doc_id || string_agg(chr(10) || chr(10) || '## Sheet: o' || sheet_no || chr(10) || chr(10) || body, '' ORDER BY sheet_no) || chr(10) AS markdown
FROM body GROUP BY doc_id"""


def _books(bodies: DataFrame) -> DataFrame:
    named = bodies.withColumn("name", F.concat(F.lit("o"), F.col("sheet_no").cast("string"))).withColumn("title", F.concat(F.lit("orders "), F.col("doc_id").cast("string")))
    return render.workbooks(named, ["doc_id"], "title")


@query(f"""WITH {BOOK_CELLS},
line AS (SELECT doc_id, sheet_no, r, '| ' || string_agg({GFM.format("display")}, ' | ' ORDER BY c) || ' |' || CASE WHEN r = 0 THEN chr(10) || '| ' || string_agg('---', ' | ') || ' |' ELSE '' END AS t FROM shown GROUP BY doc_id, sheet_no, r),
body AS (SELECT doc_id, sheet_no, string_agg(t, chr(10) ORDER BY r) AS body FROM line GROUP BY ALL)
{_BOOK_SQL}""")
def order_books_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(render.gfm_tables(grid.dense_grid(book_cells(spark, sf_dir, once=True), ["doc_id", "sheet_no"]), ["doc_id", "sheet_no"]))


@query(f"""WITH {BOOK_CELLS},
line AS (SELECT doc_id, sheet_no, r, string_agg({TSV.format("display")}, chr(9) ORDER BY c) AS t, max(length(regexp_extract(display, '^(`*)', 1))) AS k FROM shown GROUP BY ALL),
body AS (SELECT doc_id, sheet_no, repeat('`', greatest(3, max(k) + 1)) || 'tsv' || chr(10) || string_agg(t, chr(10) ORDER BY r) || chr(10) || repeat('`', greatest(3, max(k) + 1)) AS body FROM line GROUP BY ALL)
{_BOOK_SQL}""")
def order_books_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(render.tsv_blocks(grid.dense_grid(book_cells(spark, sf_dir, once=True), ["doc_id", "sheet_no"]), ["doc_id", "sheet_no"]))


@query("""WITH r AS (SELECT l_orderkey AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS nth,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS display, l_quantity::BIGINT AS repeat, l_linestatus = 'F' AND l_returnflag = 'N' AS covered FROM lineitem),
s AS (SELECT *, sum(repeat) OVER (PARTITION BY sheet ORDER BY nth) - repeat AS start, max(CASE WHEN display <> '' OR covered THEN nth END) OVER (PARTITION BY sheet) AS stop FROM r)
SELECT sheet, unnest(range(start::BIGINT, (start + repeat)::BIGINT)) AS c, display FROM s WHERE nth <= stop""")
def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    runs = rows.select(
        F.col("l_orderkey").alias("sheet"), nth.alias("nth"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("display"),
        F.col("l_quantity").cast("long").alias("repeat"), ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")).alias("covered"),
    )
    return grid.rle_expand(runs, ["sheet"], "nth")


@query(f"""WITH {ORDER_CELLS},
full_row AS (SELECT doc_id, sheet_no, r, unnest(range(0, 5))::INT AS c FROM wide),
shown AS (SELECT f.*, CASE WHEN display LIKE 'N%' THEN '' ELSE coalesce(display, '') END AS display, display LIKE 'N%3' AS formula FROM full_row f LEFT JOIN cell USING (doc_id, sheet_no, r, c)),
last AS (SELECT doc_id, sheet_no, r, coalesce(max(CASE WHEN display <> '' OR formula THEN c + 1 END), 0) AS n FROM shown GROUP BY ALL)
SELECT sheet_no, r, coalesce(string_agg(display, chr(9) ORDER BY c) FILTER (c < n), '') AS cells, any_value(n)::BIGINT AS n FROM shown JOIN last USING (doc_id, sheet_no, r) GROUP BY sheet_no, r""")
def trailing_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose display begins with N show nothing; of these, the ones that end with 3 have a formula."""
    cells = grid.last_written(order_cells(spark, sf_dir), ["sheet_no"], F.col("written"))
    shown, formula = F.when(F.col("display").startswith("N"), "").otherwise(F.col("display")), F.col("display").rlike("^N.*3$")
    rows = cells.groupBy("sheet_no", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct(shown.alias("d"), formula.alias("f")).alias("x")))).alias("m"))
    place = lambda i: F.try_element_at("m", i)
    row = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.coalesce(place(i)["d"], F.lit("")))
    solid = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: place(i)["f"])
    kept = rows.select("sheet_no", "r", row.alias("row"), solid.alias("solid")).select("sheet_no", "r", grid.trailing_trim(F.col("row"), F.col("solid")).alias("row"))
    return kept.select("sheet_no", "r", F.array_join("row", "\t").alias("cells"), F.size("row").cast("long").alias("n"))


@query("""WITH cell AS (SELECT l_suppkey % 7 AS sheet, l_linenumber AS r, (l_partkey % 9)::INT AS c FROM lineitem WHERE (l_suppkey % 7 * 5 + l_linenumber * 3 + l_partkey % 9) % 4 <> 0 OR (l_suppkey % 7 + l_linenumber + l_partkey % 9) % 3 = 0 GROUP BY ALL),
link AS (SELECT s_suppkey AS link, s_suppkey % 7 AS sheet, s_suppkey % 5 AS r0, s_suppkey % 6 AS c0, s_suppkey % 5 + s_nationkey % 4 AS r1, s_suppkey % 6 + s_nationkey % 3 AS c1,
    CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS display FROM supplier),
rows AS (SELECT *, unnest(range(r0::BIGINT, r1::BIGINT + 1)) AS r FROM link WHERE display <> ''),
area AS (SELECT *, unnest(range(c0::BIGINT, c1::BIGINT + 1)) AS c FROM rows)
SELECT sheet, a.r, a.c, min_by(display, link) AS display FROM area a ANTI JOIN cell USING (sheet, r, c) GROUP BY ALL""")
def link_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every row of lineitem; the gaps are cells whose display is blank, by their place, without a formula."""
    sheet, r, c = F.col("l_suppkey") % 7, F.col("l_linenumber").cast("long"), F.col("l_partkey") % 9
    display = F.when((sheet * 5 + r * 3 + c) % 4 == 0, "").otherwise("x")
    cells = table(spark, sf_dir, "lineitem").select(sheet.alias("sheet"), r.alias("r"), c.alias("c"), display.alias("display"), F.when((sheet + r + c) % 3 == 0, "").alias("formula")).distinct()
    s = F.col("s_suppkey")
    links = table(spark, sf_dir, "supplier").select(
        s.alias("link"), (s % 7).alias("sheet"), (s % 5).alias("r0"), (s % 6).alias("c0"), (s % 5 + F.col("s_nationkey") % 4).alias("r1"), (s % 6 + F.col("s_nationkey") % 3).alias("c1"),
        F.when(s % 11 == 0, "").otherwise(F.col("s_name")).alias("display"),
    )
    return grid.link_fill(cells, links, ["sheet"])


@query("""WITH cell AS (SELECT DISTINCT doc_id // 80 AS sheet, n_chars % 217 AS r, doc_id % 97 AS c FROM documents WHERE n_chars % 5 > 1 OR n_chars % 5 = 1),
link AS (SELECT page_id AS link, page_id // 20 AS sheet, page_id * 7 % 40 AS r0, page_id * 5 % 20 AS c0, page_id * 7 % 40 + length(html) % 178 AS r1, page_id * 5 % 20 + length(url) % 59 AS c1, CASE WHEN page_id % 11 = 3 THEN '' ELSE url END AS display FROM pages),
rows AS (SELECT *, unnest(range(r0::BIGINT, r1::BIGINT + 1)) AS r FROM link WHERE display <> ''),
area AS (SELECT *, unnest(range(c0::BIGINT, c1::BIGINT + 1)) AS c FROM rows)
SELECT sheet, a.r, a.c, min_by(display, link) AS display FROM area a ANTI JOIN cell USING (sheet, r, c) GROUP BY ALL""")
def link_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links over areas of up to 178 rows and 59 columns, twenty to a sheet, most of which overlap; some cells show nothing,
    and some of these have a formula."""
    n = F.col("n_chars")
    cells = table(spark, sf_dir, "documents").select(F.expr("doc_id div 80").alias("sheet"), (n % 217).alias("r"), (F.col("doc_id") % 97).alias("c"), F.when(n % 5 > 1, "x").otherwise("").alias("display"), F.when(n % 5 == 1, "").alias("formula")).distinct()
    p = F.col("page_id")
    r0, c0 = p * 7 % 40, p * 5 % 20
    links = table(spark, sf_dir, "pages").select(
        p.alias("link"), F.expr("page_id div 20").alias("sheet"), r0.alias("r0"), c0.alias("c0"), (r0 + F.length("html") % 178).alias("r1"), (c0 + F.length("url") % 59).alias("c1"),
        F.when(p % 11 == 3, "").otherwise(F.col("url")).alias("display"),
    )
    return grid.link_fill(cells, links, ["sheet"])


@query("""WITH cell AS (SELECT lang AS book, doc_id AS sheet, unnest(string_split(text, chr(10))) AS d, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r, n_chars % 30 AS c FROM documents),
line AS (SELECT book, sheet, r, max(c) + 1 AS w, sum(octet_length(encode(d))) AS t FROM cell GROUP BY ALL),
sums AS (SELECT book, sheet, r, sum(w) OVER o AS cells, sum(t) OVER o AS bytes FROM line WINDOW o AS (PARTITION BY book ORDER BY sheet, r ROWS UNBOUNDED PRECEDING)),
c AS (SELECT book, max(cells) AS cells, max(bytes) AS bytes, min(CASE WHEN cells > 20000 THEN sheet END) AS cells_at, min(CASE WHEN bytes > 200000 THEN sheet END) AS bytes_at FROM sums GROUP BY book),
link AS (SELECT lang AS book, doc_id AS sheet, unnest([0, 1]) AS link, (n_chars % 7 + 1) * (doc_id % 13 + 1) AS area FROM documents WHERE doc_id % 3 = 1),
run AS (SELECT book, sheet, area, sum(area) OVER (PARTITION BY book ORDER BY sheet, link ROWS UNBOUNDED PRECEDING) AS scanned FROM link),
l AS (SELECT book, max(scanned) AS scanned, min(CASE WHEN area > 20000 THEN sheet END) AS large_at, min(CASE WHEN scanned > 900 THEN sheet END) AS scanned_at FROM run GROUP BY book),
e AS (SELECT book, unnest([cells_at, bytes_at, large_at, scanned_at]) AS sheet_no, unnest([0, 1, 2, 3]) AS n FROM c LEFT JOIN l USING (book)),
f AS (SELECT book, min_by(sheet_no, (sheet_no, n)) AS sheet_no, min_by(n, (sheet_no, n)) AS n FROM e WHERE sheet_no IS NOT NULL GROUP BY book)
SELECT book, cells::BIGINT AS cells, bytes::BIGINT AS bytes, coalesce(scanned, 0)::BIGINT AS scanned, sheet_no, ['the XLSX sheet exceeds the expanded-cell budget', 'the spreadsheet exceeds the materialized-text budget', 'the XLSX sheet exceeds the expanded-cell budget', 'the XLSX hyperlinks exceed the scan budget'][n + 1] AS error
FROM c LEFT JOIN l USING (book) LEFT JOIN f USING (book)""")
def workbook_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each language, with a sheet for each text and a cell in each of its lines; every third sheet has two
    links. Limits are 20,000 cells, 200,000 bytes and 900 linked cells."""
    docs = table(spark, sf_dir, "documents").withColumnsRenamed({"lang": "book", "doc_id": "sheet_no"})
    cells = docs.select("book", "sheet_no", (F.col("n_chars") % 30).alias("c"), F.posexplode(F.split("text", "\n")).alias("r", "display"))
    ends = (F.lit(0).alias("r0"), F.lit(0).alias("c0"), (F.col("n_chars") % 7).alias("r1"), (F.col("sheet_no") % 13).alias("c1"))
    links = docs.where(F.col("sheet_no") % 3 == 1).select("book", "sheet_no", F.explode(F.array(F.lit(0), F.lit(1))).alias("link"), *ends)
    return budgets.workbook_errors(cells, links, ["book"], max_cells=20_000, max_text=200_000, max_scans=900)


@query("""SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used, (count(*) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS n FROM documents""")
def corpus_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum and a count over all documents in one order, in three levels of blocks."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return budgets.prefix_sums(rows, [], [F.floor(i / 1_000_000), F.floor(i / 1000)], ["doc_id"], used=F.col("n_chars"), n=F.lit(1)).drop("n_chars")


@query(f"""WITH {BOOK_CELLS},
line AS (SELECT doc_id, sheet_no, r, '| ' || string_agg({GFM.format("display")}, ' | ' ORDER BY c) || ' |' || CASE WHEN r = 0 THEN chr(10) || '| ' || string_agg('---', ' | ') || ' |' ELSE '' END AS t FROM shown GROUP BY doc_id, sheet_no, r),
body AS (SELECT doc_id, sheet_no, string_agg(t, chr(10) ORDER BY r) AS body FROM line GROUP BY ALL), done AS ({_BOOK_SQL})
SELECT doc_id, octet_length(encode(markdown))::BIGINT AS n_bytes, CASE WHEN octet_length(encode(markdown)) <= 6000 THEN markdown END AS markdown, CASE WHEN octet_length(encode(markdown)) > 6000 THEN 'the spreadsheet output exceeds the supported size limit' END AS error FROM done""")
def books_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of order_books_table against an output limit of 6,000 bytes, known before any book is put together."""
    dense = grid.dense_grid(book_cells(spark, sf_dir), ["doc_id", "sheet_no"])
    named = dense.withColumn("name", F.concat(F.lit("o"), F.col("sheet_no").cast("string"))).withColumn("title", F.concat(F.lit("orders "), F.col("doc_id").cast("string")))
    return render.bounded_workbooks(named, ["doc_id"], "sheet_no", "name", "title", 6_000)


@query("""SELECT o_orderkey, o_custkey, (sum(o_orderkey % 100 + 1) OVER w)::BIGINT AS used, (sum(o_orderkey % 100 + 1) OVER w) > 300 AS over
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def cumulative_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100 + 1).alias("cells"))
    return grid.running_budget(rows, ["o_custkey"], ["o_orderkey"], "cells", 300).drop("cells")


@query("""SELECT o_custkey, o_orderkey * 37 AS start, coalesce(lead(o_orderkey * 37) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 9999999999) AS stop FROM orders""")
def next_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") * 37).alias("start"))
    return grid.extents(rows, ["o_custkey"], "start", F.lit(9_999_999_999))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 3) % 5000 AS idx FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS text, CASE WHEN p_name IS NULL THEN 'a shared string index is out of range' END AS error
FROM c LEFT JOIN part ON p_partkey = idx""")
def shared_string_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 3 % 5000).alias("idx"))
    strings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    return grid.shared_strings(cells, strings, []).drop("idx")


@query("""WITH rel AS (SELECT c_custkey AS rel, CASE c_custkey % 4 WHEN 0 THEN 'chartsheet' WHEN 1 THEN 'styles' ELSE 'worksheet' END AS type, CASE WHEN c_custkey % 10 = 3 THEN 'External' END AS mode FROM customer),
sheet AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN -1 - o_custkey ELSE o_custkey END AS id FROM orders)
SELECT o_orderkey, CASE WHEN type IS NULL OR type = 'worksheet' AND mode = 'External' THEN 'error' WHEN type = 'worksheet' THEN 'worksheet' WHEN type = 'chartsheet' THEN 'skipped' ELSE 'error' END AS kind
FROM sheet LEFT JOIN rel ON id = rel""")
def sheet_rel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every customer; the gaps are orders whose relationship id is shifted to one that is not there."""
    key, cust = F.col("c_custkey"), F.col("o_custkey")
    kind = F.when(key % 4 == 0, "chartsheet").when(key % 4 == 1, "styles").otherwise("worksheet")
    rels = table(spark, sf_dir, "customer").select(key.alias("rel"), kind.alias("type"), F.when(key % 10 == 3, "External").alias("mode"))
    sheets = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, -1 - cust).otherwise(cust).alias("rel"))
    return grid.sheet_parts(sheets, rels, []).select("o_orderkey", "kind")


@query("""WITH b AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN encode('PK' || chr(3) || chr(4)) WHEN 1 THEN '\\xD0\\xCF\\x11\\xE0\\xA1\\xB1\\x1A\\xE1'::BLOB WHEN 2 THEN encode('{\\rtf1') WHEN 3 THEN encode('{\\rtf') WHEN 4 THEN encode('PK' || chr(5) || chr(6)) ELSE encode('') END || encode(html) AS x FROM pages)
SELECT page_id, CASE WHEN hex(x)[1:8] IN ('504B0304', '504B0506', '504B0708') THEN 'zip' WHEN hex(x)[1:16] = 'D0CF11E0A1B11AE1' THEN 'ole'
    WHEN regexp_matches(hex(x), '^7B5C7274663[0-9]') THEN 'rtf' ELSE 'none' END AS kind FROM b""")
def magic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [b"PK\x03\x04", bytes.fromhex(refs.OLE_SIGNATURE), b"{\\rtf1", b"{\\rtf", b"PK\x05\x06", b""]
    head = F.get(F.array(*(F.unhex(F.lit(h.hex())) for h in heads)), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", refs.signature(F.concat(head, F.col("html").cast("binary"))).alias("kind"))


DETECTIONS = """d AS (SELECT doc_id, i AS adapter_no, ['rtf', 'docx', 'doc', 'xlsx', 'odm'][i + 1] AS format, [100, 110, 105, 108, 109][i + 1] - CASE WHEN doc_id % 13 = i THEN 110 - doc_id % 3 ELSE 0 END AS priority,
    CASE (doc_id * 7 + i * i) % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'invalid' WHEN 2 THEN CASE WHEN doc_id % 4 = 0 THEN 'match' ELSE 'none' END ELSE 'none' END AS kind
    FROM documents, (SELECT unnest(range(0, 5)) AS i)),
e AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 100 ELSE priority END AS p FROM d)"""


@query(f"""WITH {DETECTIONS},
m AS (SELECT doc_id, max(p) AS best FROM e WHERE kind = 'match' GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n, string_agg(format, ', ' ORDER BY format) AS formats FROM e JOIN m USING (doc_id) WHERE kind = 'match' AND p = best GROUP BY doc_id),
b AS (SELECT doc_id, format, 'broken ' || format AS reason FROM e WHERE kind = 'invalid' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, adapter_no) = 1)
SELECT doc_id, CASE WHEN n = 1 THEN 'match' WHEN n > 1 THEN 'ambiguous' WHEN b.format IS NOT NULL THEN 'invalid' ELSE 'unsupported' END AS status,
    CASE WHEN n = 1 THEN formats WHEN n IS NULL THEN b.format END AS format, CASE WHEN n > 1 THEN formats WHEN n IS NULL THEN reason END AS reason
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, doc = F.col("adapter_no"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("adapter_no"))
    spot = (doc * 7 + i * i) % 5
    kind = F.when((spot == 0) | ((spot == 2) & (doc % 4 == 0)), "match").when(spot == 1, "invalid").otherwise("none")
    priority = F.get(F.array(*map(F.lit, (100, 110, 105, 108, 109))), i) - F.when(doc % 13 == i, 110 - doc % 3).otherwise(0)
    fmt = F.get(F.array(*map(F.lit, ("rtf", "docx", "doc", "xlsx", "odm"))), i)
    rows = rows.select("doc_id", "adapter_no", kind.alias("kind"), fmt.alias("format"), F.when(doc % 6 == 0, 100).otherwise(priority).alias("priority"), F.concat(F.lit("broken "), fmt).alias("reason"))
    return resolve.priority_pick(rows, "doc_id")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS ref, generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), 1) AS pos FROM pages),
f AS (SELECT page_id, ref, min(pos) AS first_pos FROM l GROUP BY ALL)
SELECT page_id, ref, printf('image%02d', row_number() OVER (PARTITION BY page_id ORDER BY first_pos, ref)) || '.png' AS asset FROM f""")
def first_seen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "ref")).withColumn("ext", F.lit("PNG"))
    return resolve.sequential_names(rows, "page_id", "pos", "ref", "ext")


#: Images put before a page, by number: one or several tags, safe and unsafe.
PICTURES = [
    '<img src="media/a.PNG"><img alt="x" src="./media/a.PNG"><img src=\'media//a.PNG\'>', '<IMG width=1 src = "a%20b&amp;c.jpeg">', '<img src="../up.png">', '<img src="https://h.example/x.png">', '<img src="file:///tmp/dir/c%20d.Gif"><img src="c%20d.Gif">',
    '<img src="/abs.png">', '<img src="a\\b.png">', '<img alt="no source"><p src="x.png">', '<img src="a/./b.png">', '<img src="x+y.p~g"><img src="odd.a(b">', '<img data-x="1" src="noext"><img src=".hidden"><img src="end.">',
]
_DUCK_PAGES = f"""p AS (SELECT page_id, [{", ".join(map(_duck, PICTURES))}][page_id % {len(PICTURES)} + 1] || replace(html, '<a href="/', '<IMG class=x src = "./') AS html FROM pages),
r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i){IMAGE.replace("'", "''")}', 2)) AS reference, generate_subscripts(regexp_extract_all(html, '(?i){IMAGE.replace("'", "''")}', 2), 1) - 1 AS pos FROM p),
t AS (SELECT *, replace(reference, '&amp;', '&') AS t, rtrim(regexp_replace(regexp_replace(url_decode(replace(reference, '&amp;', '&')), '^(\\./)+', ''), '/+', '/', 'g'), '/') AS f FROM r),
n AS (SELECT page_id, pos, reference, CASE WHEN starts_with(t, 'file:') THEN url_decode(regexp_extract(t, '([^/]*)$', 1)) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR f = '' OR starts_with(f, '/') OR contains(f, '\\') OR list_has_any(string_split(f, '/'), ['.', '..']) THEN NULL ELSE f END AS file FROM t)"""


def pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose own links are images, and with others before them."""
    head = F.get(F.array(*map(F.lit, PICTURES)), (F.col("page_id") % len(PICTURES)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.replace("html", F.lit('<a href="/'), F.lit('<IMG class=x src = "./'))).alias("html"))


@query(f"WITH {_DUCK_PAGES} SELECT page_id, pos::BIGINT AS pos, reference, file FROM n")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_references(pictured(spark, sf_dir), "page_id").withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_DUCK_PAGES},
e AS (SELECT page_id, arg_min(reference, pos) AS bad FROM n WHERE file IS NULL GROUP BY page_id),
first AS (SELECT page_id, file, min(pos) AS pos FROM n GROUP BY ALL),
named AS (SELECT page_id, file, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k, lower(regexp_extract(file, '[^/]\\.([^./]+)$', 1)) AS ext FROM first),
asset AS (SELECT page_id, file, 'image' || lpad(k::VARCHAR, greatest(2, length(k::VARCHAR))::INT, '0') || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS asset FROM named),
piece AS (SELECT p.page_id, unnest(string_split_regex(html, '(?i){IMAGE.replace("'", "''")}')) AS t, generate_subscripts(string_split_regex(html, '(?i){IMAGE.replace("'", "''")}'), 1) - 1 AS pos FROM p),
edge AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i){IMAGE.replace("'", "''")}', 1)) AS head, unnest(regexp_extract_all(html, '(?i){IMAGE.replace("'", "''")}', 3)) AS tail, generate_subscripts(regexp_extract_all(html, '(?i){IMAGE.replace("'", "''")}', 1), 1) - 1 AS pos FROM p),
html AS (SELECT page_id, string_agg(piece.t || coalesce(head || 'images/' || replace(replace(asset, '(', '%28'), ' ', '%20') || tail, ''), '' ORDER BY pos) AS html FROM piece LEFT JOIN edge USING (page_id, pos) LEFT JOIN n USING (page_id, pos) LEFT JOIN asset USING (page_id, file) GROUP BY page_id),
list AS (SELECT page_id, string_agg(asset || '=' || file, ',' ORDER BY asset) AS assets FROM asset GROUP BY page_id)
SELECT page_id, CASE WHEN bad IS NULL THEN html END AS html, CASE WHEN bad IS NULL THEN coalesce(assets, '') END AS assets, '{images.UNSAFE}' || bad AS error FROM html LEFT JOIN e USING (page_id) LEFT JOIN list USING (page_id)""")
def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = images.rewrite_images(pictured(spark, sf_dir), "page_id")
    listed = F.array_join(F.array_sort(F.transform("assets", lambda a: F.concat(a["asset"], F.lit("="), a["file"]))), ",")
    return done.withColumn("assets", listed)


@query(r"""WITH l AS (SELECT page_id, unnest(list_concat([url, ''], regexp_extract_all(html, '(?i)href="([^"]*)"', 1), [replace(url, '/', '\'), 'a/../b', '/abs', 'images/' || page_id || '.png', './x/..'])) AS ref FROM pages)
SELECT page_id, ref, ref = '' OR regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR starts_with(ref, '/') OR contains(ref, '\') OR regexp_matches(ref, '(^|/)\.\.(/|$)') AS unsafe FROM l""")
def unsafe_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("a/../b"), F.lit("/abs"), F.concat(F.lit("images/"), F.col("page_id").cast("string"), F.lit(".png")), F.lit("./x/.."))
    every = F.concat(F.array(F.col("url"), F.lit("")), F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1)), own)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(every).alias("ref")).withColumn("unsafe", refs.unsafe_package_reference(F.col("ref")))


@query(r"""WITH f AS (SELECT page_id, unnest([url, '.hidden', 'f' || page_id % 7 || '.png', 'g.png']) AS name FROM pages),
r AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), ['f' || page_id % 5 || '.png'])) AS name FROM pages)
SELECT f.page_id, f.name FROM f ANTI JOIN r USING (page_id, name) WHERE NOT starts_with(f.name, '.')""")
def unreferenced_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    file = lambda n: F.concat(F.lit("f"), (F.col("page_id") % n).cast("string"), F.lit(".png"))
    files = pages.select("page_id", F.explode(F.array(F.col("url"), F.lit(".hidden"), file(7), F.lit("g.png"))).alias("name"))
    links = pages.select("page_id", F.explode(F.concat(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1)), F.array(file(5)))).alias("name"))
    return resolve.unreferenced(files, links, "page_id", "name")


@query(r"""WITH s AS (SELECT page_id, html AS a, CASE WHEN page_id % 3 = 0 THEN html ELSE substr(html, 1, length(html) // (page_id % 3 + 1)) END AS b FROM pages),
w AS (SELECT page_id, unnest(string_split_regex(lower(a), '[^\p{L}\p{N}\p{M}]+')) AS w FROM s), x AS (SELECT page_id, unnest(string_split_regex(lower(b), '[^\p{L}\p{N}\p{M}]+')) AS w FROM s),
c AS (SELECT page_id, w, count(*) AS a FROM w WHERE w <> '' GROUP BY ALL), d AS (SELECT page_id, w, count(*) AS b FROM x WHERE w <> '' GROUP BY ALL),
t AS (SELECT page_id, sum(a)::BIGINT AS n_words, sum(least(a, coalesce(b, 0)))::BIGINT AS n_kept FROM c LEFT JOIN d USING (page_id, w) GROUP BY page_id)
SELECT page_id, coalesce(n_words, 0) AS n_words, coalesce(n_kept, 0) AS n_kept, coalesce(n_words, 0) = 0 OR n_kept >= greatest(1, n_words * 4 // 5) AS retained FROM pages LEFT JOIN t USING (page_id)""")
def word_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    part = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.expr("substr(html, 1, cast(length(html) div (page_id % 3 + 1) as int))"))
    return resolve.word_retention(pages.select("page_id", F.col("html").alias("t")), pages.select("page_id", part.alias("t")), "page_id", "t")


@query(rf"""WITH h AS ({DUCK_HOSTILE}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM h),
x AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 1 THEN line || '\' ELSE line END AS line FROM l),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM x)
SELECT doc_id, pos, length(regexp_extract(line, '(\\*)$', 1)) % 2 = 1 AS breaks, next IS NULL OR trim(next, ' ' || chr(9)) = '' OR regexp_matches(next, '^[ \t]*([-*+]|[0-9]{{1,9}}[.)])[ \t]+') AS dropped,
    CASE WHEN regexp_matches(line, '^[ \t]*(?:[-*+]|[0-9]{{1,9}}[.)])[ \t]+')
        THEN length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    ')) + length(regexp_extract(line, '^[ \t]*((?:[-*+]|[0-9]{{1,9}}[.)])[ \t]+)', 1)) END AS indent FROM n""")
def line_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = hostile(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.when(F.col("pos") % 3 == 1, F.concat("line", F.lit("\\"))).otherwise(F.col("line")))
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = lines.withColumn("after", after)
    dropped = F.col("after").isNull() | (F.btrim(F.col("after"), F.lit(" \t")) == "") | text.list_indent(F.col("after")).isNotNull()
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), text.hard_break(F.col("line")).alias("breaks"), dropped.alias("dropped"), text.list_indent(F.col("line")).cast("long").alias("indent"))


@query(f"""WITH h AS ({DUCK_HOSTILE}) SELECT doc_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '(`+)', 1), lambda x: length(x))), 0) + 1)) AS fence FROM h""")
def backtick_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostile(spark, sf_dir).select("doc_id", text.fence(F.col("text")).alias("fence"))


@query("""WITH n AS (SELECT DISTINCT l_partkey % 702 AS n, l_suppkey % 50 AS r FROM lineitem),
a AS (SELECT CASE WHEN n < 26 THEN chr((65 + n)::INT) ELSE chr((65 + n // 26 - 1)::INT) || lower(chr((65 + n % 26)::INT)) END || (r + 1) AS ref, n, r FROM n)
SELECT ref, n AS c, r FROM a""")
def a1_column_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 702).alias("n"), (F.col("l_suppkey") % 50).alias("r")).distinct()
    one, two = F.chr(65 + F.col("n")), F.concat(F.expr("chr(65 + n div 26 - 1)"), F.lower(F.chr(65 + F.col("n") % 26)))
    ref = F.concat(F.when(F.col("n") < 26, one).otherwise(two), (F.col("r") + 1).cast("string"))
    return rows.select(ref.alias("ref")).select("ref", refs.a1_column(F.col("ref")).alias("c"), refs.a1_row(F.col("ref")).alias("r"))


_CATALOG_SQL = "cat(format, extensions, requires) AS (VALUES " + ", ".join(f"('{f}', {e}::VARCHAR[], {r}::VARCHAR[])" for f, e, _, r in declared(DEFAULT)) + ")"
#: Extensions of documents, by number; the last two are of no format.
_ENDINGS = ["rtf", "RTFD", "docx", "dotm", "odt", "doc", "ods", "XLSX", "xls", "odm", "pdf", ""]


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, format, requires): documents with the format that the catalog has for their extension."""
    catalog = spark.createDataFrame(declared(DEFAULT), "format string, extensions array<string>, container string, requires array<string>")
    known = catalog.select("format", "requires", F.explode("extensions").alias("extension"))
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS)).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", refs.extension(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), ending)).alias("extension"))
    return files.join(F.broadcast(known), "extension")  # the catalog is the code's own, a row for each extension


_NAMED = f"named AS (SELECT doc_id, format, requires FROM (SELECT doc_id, lower({_ENDINGS}[doc_id % {len(_ENDINGS)} + 1]) AS e FROM documents) JOIN (SELECT format, requires, unnest(extensions) AS e FROM cat) USING (e))"


@query(f"""WITH {_CATALOG_SQL}, {_NAMED}, m AS (SELECT *, list_filter(requires, lambda x: x <> 'pandoc') AS missing FROM named)
SELECT doc_id, format, array_to_string(missing, ',') AS missing, len(missing) = 0 AS available, CASE WHEN len(missing) > 0 THEN 'missing required tool: ' || array_to_string(missing, ', ') END AS reason FROM m""")
def catalog_missing_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document of a known extension whether its format can be converted where only pandoc is there."""
    return resolve.availability(named_documents(spark, sf_dir), ["pandoc"]).select("doc_id", "format", F.array_join("missing", ",").alias("missing"), "available", "reason")


@query(f"""WITH {_CATALOG_SQL}, {_NAMED}, c AS (SELECT format, count(*)::VARCHAR AS n FROM named GROUP BY format)
SELECT rpad(format, (max(length(format)) OVER () + 2)::INT, ' ') || rpad(n, (max(length(n)) OVER () + 2)::INT, ' ') || 'ok' AS line FROM c""")
def catalog_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each format has, as lines of padded columns; a row for each format of the catalog at most."""
    rows = named_documents(spark, sf_dir).groupBy("format").agg(F.count("*").cast("string").alias("n")).withColumn("state", F.lit("ok"))
    return resolve.column_text(rows, ["format", "n", "state"]).select("line")


@query("""WITH f AS (SELECT doc_id, bool_or(toxic = 1) AS m, bool_or(quality = 0) AS u FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, list_concat(CASE WHEN m THEN ['spreadsheet.mergesFlattened'] ELSE [] END, CASE WHEN n_chars % 2 = 0 THEN ['spreadsheet.formulaResultMissing'] ELSE [] END, CASE WHEN u THEN ['spreadsheet.unsupportedObjects'] ELSE [] END) AS a,
    CASE WHEN doc_id % 3 = 0 THEN ['spreadsheet.unsupportedObjects', 'openDocumentMaster.flattened'] ELSE ['openDocumentMaster.flattened'] END AS b FROM documents LEFT JOIN f USING (doc_id))
SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS codes FROM w""")
def warning_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("m"), F.bool_or(F.col("quality") == 0).alias("u"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(flags, "doc_id", "left")
    own = resolve.flagged((F.col("m"), "spreadsheet.mergesFlattened"), (F.col("n_chars") % 2 == 0, "spreadsheet.formulaResultMissing"), (F.col("u"), "spreadsheet.unsupportedObjects"))
    child = resolve.flagged((F.col("doc_id") % 3 == 0, "spreadsheet.unsupportedObjects"), (F.lit(True), "openDocumentMaster.flattened"))
    return rows.select("doc_id", F.array_join(resolve.warning_union(own, child), ",").alias("codes"))


_KINDS = [*resolve.EXIT_CODES, "something_else"]


@query(f"""WITH t AS (SELECT unnest({[*resolve.EXIT_CODES]}) AS kind, unnest({[*resolve.EXIT_CODES.values()]}) AS code),
e AS (SELECT event_id, {_KINDS}[event_id % {len(_KINDS)} + 1] AS kind FROM events) SELECT event_id, e.kind, coalesce(code, 70)::INT AS code FROM e LEFT JOIN t USING (kind)""")
def exit_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind")).withColumn("code", resolve.exit_code(F.col("kind")))


@query("""WITH e AS (SELECT p_partkey % 20 AS doc, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand || '/' || p_size % 5) || '/' ELSE p_brand || '/' || p_size % 5 END AS name FROM part)
SELECT doc, lower(regexp_replace(name, '/$', '')) AS key, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1""")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(plain), F.lit("/"))).otherwise(plain)
    return resolve.name_collisions(table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("doc"), name.alias("name")), "doc", "name")


_SPELT = ["σας", "ΣΑΣ", "caf\u00e9", "cafe\u0301", "CAFE\u0301", "straße", "STRASSE", "a"]
_FOLD = "replace(replace(nfc_normalize(lower(nfc_normalize({0}))), 'ς', 'σ'), 'ß', 'ss')"


@query(f"""WITH e AS (SELECT doc_id // 40 AS doc, {_SPELT}[doc_id % 8 + 1] || '/' || n_chars % 3 || CASE WHEN doc_id % 5 = 0 THEN '/' ELSE '' END AS name, CASE WHEN doc_id % 3 = 0 THEN {_SPELT}[n_chars % 8 + 1] || n_chars % 4 END AS other FROM documents),
k AS (SELECT doc, unnest(['name', 'other']) AS reading, unnest([{_FOLD.format("regexp_replace(name, '/$', '')")}, {_FOLD.format("other")}]) AS key FROM e)
SELECT doc, reading, key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def entry_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with final sigmas, sharp s and accents in one and two characters, in two readings; keys are shown composed."""
    spelt = lambda i: F.get(F.array(*map(F.lit, _SPELT)), (i % 8).cast("int"))
    key, size = F.col("doc_id"), F.col("n_chars")
    name = F.concat(spelt(key), F.lit("/"), (size % 3).cast("string"), F.when(key % 5 == 0, "/").otherwise(""))
    entries = table(spark, sf_dir, "documents").select(F.expr("doc_id div 40").alias("doc"), name.alias("name"), F.when(key % 3 == 0, F.concat(spelt(size), (size % 4).cast("string"))).alias("other"))
    return resolve.entry_collisions(entries, "doc", "name", "other").withColumn("key", F.replace("key", F.lit("e\u0301"), F.lit("\u00e9")))


_ITEMS = ["<li><p>", '<li class="x">\n<p class="y">', "<li><p>a <b>b</b></p><p>", "<li><p><div>", "<LI><P>"]
_DUCK_LIST = text.LIST_ITEM


@query(rf"""WITH p AS (SELECT page_id, [{', '.join(map(_duck, _ITEMS))}][page_id % {len(_ITEMS)} + 1] || 'x <em>' || page_id || '</em></p></li>' || html AS html FROM pages)
SELECT page_id, regexp_replace(html, '{_DUCK_LIST}', '\1\2\3', 'g') AS html FROM p""")
def list_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.array(*map(F.lit, _ITEMS)), (F.col("page_id") % len(_ITEMS)).cast("int"))
    html = F.concat(head, F.lit("x <em>"), F.col("page_id").cast("string"), F.lit("</em></p></li>"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.unwrapped_items(html).alias("html"))


@query(rf"WITH h AS ({DUCK_HOSTILE}) SELECT doc_id, regexp_replace(text, '([\\`*_\[\]<>~&])', '\\\1', 'g') AS text FROM h")
def inline_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostile(spark, sf_dir).select("doc_id", text.inline_escape(F.col("text")).alias("text"))


@query(rf"""WITH h AS ({DUCK_HOSTILE}) SELECT doc_id, CASE WHEN starts_with(text, '    ') THEN '&nbsp;&nbsp;&nbsp;&nbsp;' || substr(text, 5) WHEN starts_with(text, chr(9)) THEN '&nbsp;&nbsp;&nbsp;&nbsp;' || substr(text, 2)
    WHEN regexp_matches(text, '^[#\-+=]') THEN '\' || text WHEN regexp_matches(text, '^\p{{N}}+[.)]') THEN regexp_replace(text, '^(\p{{N}}+)([.)])', '\1\\\2') ELSE text END AS text FROM h""")
def leading_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostile(spark, sf_dir).select("doc_id", text.leading_escape(F.col("text")).alias("text"))


@query(rf"""WITH h AS ({DUCK_HOSTILE}), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM h
    UNION ALL SELECT doc_id, -1, CASE WHEN doc_id % 2 = 0 THEN '  \_\_\_' ELSE '***• **' || chr(160) END FROM documents)
SELECT doc_id, pos, line, regexp_replace(translate(line, '*_', ''), '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g') = '•' AS bullet,
    CASE WHEN regexp_matches(line, '^[ \t]*(\\_){{3,}}$') THEN replace(line, '\_', '_') ELSE line END AS rule, regexp_replace(line, '^([ \t]*)\\-', '\1-') AS hyphen FROM l""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each text, by position; the made lines stand at -1."""
    lines = hostile(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    made = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1), F.when(F.col("doc_id") % 2 == 0, "  \\_\\_\\_").otherwise("***• **\u00a0"))
    line = F.col("line")
    return lines.unionAll(made).select("doc_id", F.col("pos").cast("long").alias("pos"), "line", text.bullet_line(line).alias("bullet"), text.plain_rule(line).alias("rule"), text.plain_hyphen(line).alias("hyphen"))


#: Markdown put before a text, by number.
MARKDOWN = [
    "```sh\na \\\n\n  \n***• ***\n````  \n\n\\- x", "1. a\n\n       code \\\n\n\n       more\n   - b\n\n         deep\n  back\\\n- c\\", "~~~\n```\n~~\n~~~ x\n~~~\n\n    in\n\ntext", "-\n\n-\n\n\n - \n\n  \n\nx\\\n\n*_*\\\ny",
    "\\_\\_\\_\n  \\_\\_\\_\\_ \n\t\\_\\_\\_\n\\_\\_", "*\ttab\n\t x\n\t\t\tcode\n+ y\n      z\\", "``` a`b\n    x\\\n\u2003**•**\u00a0\n- \\\n", "    first\n\n\tsecond\\\n\n", "123456789) n\n1234567890) n\n  \n\nend\\\\\nend\\\\\\\n1) z",
]
_MARK, _ITEM = r"^ {0,3}(`{3,}|~{3,})", r"^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+"
_DUCK_MARKDOWN = f"SELECT doc_id, replace([{', '.join(map(_duck, MARKDOWN))}][doc_id % {len(MARKDOWN)} + 1] || chr(10) || replace(replace(replace(text, ', ', ',\\' || chr(10)), '. ', '.' || chr(10) || chr(10) || '    '), 'a ', 'a' || chr(10) || '* '), chr(13) || chr(10), chr(10)) AS t FROM documents"


def converted_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the marks of a converter: hard breaks at commas, indented blocks at stops, list items, and MARKDOWN first."""
    text_ = F.col("text")
    for old, new in ((", ", ",\\\n"), (". ", ".\n\n    "), ("a ", "a\n* ")):
        text_ = F.replace(text_, F.lit(old), F.lit(new))
    head = F.get(F.array(*map(F.lit, MARKDOWN)), (F.col("doc_id") % len(MARKDOWN)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n"), text_).alias("text"))


@query(rf"""WITH RECURSIVE h AS ({_DUCK_MARKDOWN}),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS pos, ends FROM (SELECT doc_id, string_split(CASE WHEN ends_with(t, chr(10)) THEN t[:-2] ELSE t END, chr(10)) AS ls, ends_with(t, chr(10)) AS ends FROM h)),
f AS (SELECT *, regexp_matches(x, '^[ \t]*$') AS blank, length(replace(regexp_extract(x, '^([ \t]*)', 1), chr(9), '    ')) AS indent, regexp_extract(x, '{_MARK}', 1) AS mark,
    CASE WHEN regexp_matches(x, '{_ITEM}') THEN length(replace(regexp_extract(x, '^([ \t]*)', 1), chr(9), '    ')) + length(regexp_extract(x, '^[ \t]*((?:[-*+]|[0-9]{{1,9}}[.)])[ \t]+)', 1)) END AS item FROM l),
g AS MATERIALIZED (SELECT *, mark <> '' AND NOT (starts_with(mark, '`') AND contains(substr(ltrim(x, ' '), length(mark) + 1), '`')) AS opens, mark <> '' AND trim(substr(ltrim(x, ' '), length(mark) + 1), ' ' || chr(9)) = '' AS alone FROM f),
walk(doc_id, pos, fence, items, code, blank) AS (SELECT doc_id, 0::BIGINT, '', []::BIGINT[], false, false FROM h UNION ALL
    SELECT doc_id, pos, CASE WHEN fence <> '' THEN CASE WHEN alone AND mark[1] = fence[1] AND length(mark) >= length(fence) THEN '' ELSE fence END WHEN blank OR deep THEN '' WHEN opens THEN mark ELSE '' END,
        CASE WHEN fence <> '' OR blank THEN items WHEN NOT deep AND NOT opens AND item IS NOT NULL THEN list_append(open, item) ELSE open END, fence <> '' OR NOT blank AND (deep OR opens), blank AND fence = ''
    FROM (SELECT *, indent >= coalesce(list_last(open), 0) + 4 AS deep FROM (SELECT g.*, w.fence, w.items, list_filter(w.items, lambda i: i <= g.indent) AS open FROM walk w JOIN g ON g.doc_id = w.doc_id AND g.pos = w.pos + 1))),
c AS (SELECT doc_id, pos, code OR blank AND coalesce(last_value(CASE WHEN NOT blank THEN code END IGNORE NULLS) OVER b, false) AND coalesce(first_value(CASE WHEN NOT blank THEN code END IGNORE NULLS) OVER a, false) AS code FROM walk
    WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
n AS (SELECT l.*, code, lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l JOIN c USING (doc_id, pos)),
p AS (SELECT doc_id, pos, ends, code, CASE WHEN code THEN x
    WHEN regexp_replace(translate(x, '*_', ''), '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g') = '•' THEN regexp_extract(x, '^([ \t]*)', 1) || '-'
    WHEN length(regexp_extract(x, '(\\*)$', 1)) % 2 = 1 THEN CASE WHEN trim(regexp_replace(x[:-2], '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g'), '*_') = '' THEN '  '
        ELSE rtrim(x[:-2], ' ' || chr(9)) || CASE WHEN next IS NULL OR regexp_matches(next, '^[ \t]*$') OR regexp_matches(next, '{_ITEM}') THEN '' ELSE '  ' END END
    WHEN regexp_matches(x, '^[ \t]*(\\_){{3,}}$') THEN replace(x, '\', '') ELSE regexp_replace(x, '^([ \t]*)\\-', '\1-') END AS x FROM n),
q AS (SELECT *, x = '' AND NOT code AS hollow, x <> '' AND regexp_matches(x, '^[ \t]*$') AS soft, regexp_replace(x, '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g') = '-' AS lone FROM p),
r AS MATERIALIZED (SELECT *, lead(soft) OVER w AS next_soft, lead(lone) OVER w AS next_lone FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
keep(doc_id, pos, stays, soft, lone) AS (SELECT doc_id, 0::BIGINT, false, NULL::BOOLEAN, NULL::BOOLEAN FROM h UNION ALL
    SELECT doc_id, pos, NOT gone, CASE WHEN gone THEN old_soft ELSE soft END, CASE WHEN gone THEN old_lone ELSE lone END
    FROM (SELECT r.*, k.soft AS old_soft, k.lone AS old_lone, coalesce(r.hollow AND k.soft IS NOT NULL AND r.next_soft IS NOT NULL AND (k.soft OR r.next_soft OR k.lone AND r.next_lone), false) AS gone FROM keep k JOIN r ON r.doc_id = k.doc_id AND r.pos = k.pos + 1))
SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) FILTER (stays) || CASE WHEN any_value(ends) THEN chr(10) ELSE '' END AS markdown FROM keep JOIN p USING (doc_id, pos) GROUP BY doc_id""")
def normalize_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalized(converted_markdown(spark, sf_dir), "doc_id", "text")


@query("""WITH c AS (SELECT event_id, (event_id % 256) / 255.0::DOUBLE AS r, (event_id * 7 % 256) / 255.0::DOUBLE AS g, (event_id * 7 % 256 + event_id % 9) / 255.0::DOUBLE AS b, (event_id % 4) / 3.0::DOUBLE AS a FROM events)
SELECT event_id, greatest(r, g, b) - least(r, g, b) > 0.02::DOUBLE AND a > 0.01::DOUBLE AS coloured FROM c""")
def chromatic_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    part = lambda c: c.cast("double") / F.lit(255.0)
    return table(spark, sf_dir, "events").select("event_id", refs.chromatic(part(e % 256), part(e * 7 % 256), part(e * 7 % 256 + e % 9), (e % 4).cast("double") / F.lit(3.0)).alias("coloured"))


@query(r"""WITH d AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ') AS text, n_chars FROM documents), k AS (SELECT unnest(range(0, 9)) AS n),
r AS (SELECT doc_id, n, (doc_id * 37 + n * n * 211) % greatest(n_chars, 1) AS start, (doc_id * 13 + n * 29) % 90 * (n % 4) AS length, (doc_id + n) % 4 AS colour FROM d, k),
c AS (SELECT doc_id, p, max_by(colour, n) AS colour FROM (SELECT doc_id, n, colour, unnest(range(start, start + length)) AS p FROM r) GROUP BY ALL),
i AS (SELECT doc_id, colour, min(p) AS start, max(p) + 1 AS stop FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, colour ORDER BY p) AS g FROM c) WHERE colour IN (1, 3) GROUP BY doc_id, colour, g),
o AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM i),
m AS (SELECT doc_id, string_agg(substr(text, since + 1, start - since) || regexp_replace(substr(text, start + 1, stop - start), '([^\p{Zs}\t\n\r\x{FFFC}](?:[^\n\r\x{FFFC}]*[^\p{Zs}\t\n\r\x{FFFC}])?)', '==\1==', 'g'), '' ORDER BY start) AS head, max(stop) AS stop FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(head, '') || substr(text, coalesce(stop, 0) + 1) AS text FROM d LEFT JOIN m USING (doc_id)""")
def colour_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine ranges to a text, overlapping and of four colours, two of which are chromatic; lines end at stops."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n ")).alias("text"), "n_chars")
    doc, n = F.col("doc_id"), F.col("n")
    shades = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip("rgba", v))) for v in ((0.5, 0.5, 0.5, 1.0), (1.0, 0.0, 0.0, 1.0), (0.9, 0.1, 0.1, 0.0), (0.0, 0.4, 0.0, 0.5))))
    rows = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n"))
    ranges = rows.select(doc, n, ((doc * 37 + n * n * 211) % F.greatest(F.col("n_chars"), F.lit(1))).alias("start"), ((doc * 13 + n * 29) % 90 * (n % 4)).alias("length"), F.get(shades, ((doc + n) % 4).cast("int")).alias("colour"))
    return colours.marked_texts(docs.drop("n_chars"), ranges, "doc_id")


@query(r"""WITH i AS (SELECT conv_id, turn, role, regexp_replace(chr(10) || text || chr(13) || chr(10), '^[\r\n]+|[\r\n]+$', '', 'g') AS t FROM conversations)
SELECT conv_id, '# talk ' || conv_id || chr(10) || chr(10) || string_agg(CASE WHEN role = 'user' THEN '## Section: ' || role || ' ' || turn || chr(10) || chr(10) || t ELSE t END, chr(10) || chr(10) ORDER BY turn, role, t) || chr(10) AS markdown FROM i GROUP BY conv_id""")
def section_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("\n"), "text", F.lit("\r\n"))
    items = rows.select(
        "conv_id", F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title"), F.struct("turn", "role", "text").alias("pos"), F.when(F.col("role") == "user", "section").otherwise("markdown").alias("kind"),
        body.alias("text"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("name"),
    )
    return render.sections(items, ["conv_id"], "title")
