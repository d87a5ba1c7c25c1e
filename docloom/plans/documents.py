"""Queries of the document readers: files are made from the test tables, in the tasks, and read back."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import gfm, links, markdown
from docloom.operators import workbooks, xmlnodes
from docloom.plans.relational import hostile, table
from docloom.sources import build, engine, nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


FILE = "path string, length long, content binary"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over several tasks a core, by key: the tables are small in bytes, but a row of them becomes a whole file."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def made_files(rows: DataFrame, files: Callable[[dict], list[tuple[str, bytes]]], step: int = 64) -> DataFrame:
    """FILE: the files of each row, made in its task; those of `step` rows at most are held at once."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                found = [x for row in batch.slice(k, step).to_pylist() for x in files(row)]
                paths, contents = pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())
                yield pa.RecordBatch.from_arrays([paths, pa.array([len(c) for _, c in found], pa.int64()), contents], names=["path", "length", "content"])

    return rows.mapInArrow(run, FILE)


def part_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, rows): forty parts in order, a book."""
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("book"), F.struct("p_partkey", "p_name", "p_size", "p_brand").alias("x"))
    return dealt(rows, "book").groupBy("book").agg(F.array_sort(F.collect_list("x")).alias("rows"))


def part_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A workbook for every forty parts, with a row for each: name, size and brand, and a gap beside them."""
    books = part_books(spark, sf_dir)

    def make(x):
        sheet = [("Parts", [[r["p_name"], int(r["p_size"]), None, r["p_brand"]] for r in x["rows"]])]
        content = {"xlsx": lambda: build.package(build.xlsx_files(sheet)), "ods": lambda: build.package(build.ods_files(sheet)), "xls": lambda: build.xls_bytes(sheet)}[kind]()
        return [(f"/parts/book{x['book']}.{kind}", content)]

    return made_files(books, make)


def _cells_sql(kind: str) -> str:
    return f"""WITH p AS (SELECT '/parts/book' || p_partkey // 40 || '.{kind}' AS path, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS r, p_name, p_size, p_brand FROM part),
c AS (SELECT path, r, unnest([0, 1, 2, 3]) AS c, unnest([p_name, p_size::VARCHAR, '', p_brand]) AS display, unnest(['string', 'number', 'empty', 'string']) AS value_type FROM p)
SELECT path, r::BIGINT AS r, c::BIGINT AS c, display, value_type FROM c"""


def _cells(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    cells = engine.document_cells(part_files(spark, sf_dir, kind))
    return cells.select("path", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "display", "value_type")


@query(_cells_sql("xlsx"))
def workbook_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "xlsx")


@query(_cells_sql("ods"))
def ods_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "ods")


@query(_cells_sql("xls"))
def xls_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "xls")


@query("""WITH p AS (SELECT p_partkey // 40 AS book, p_partkey, '| ' || p_name || ' | ' || p_size || ' |  | ' || p_brand || ' |' AS line FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY p_partkey) AS i FROM p)
SELECT '/parts/book' || book || '.xlsx' AS path, 'xlsx' AS format, 'ok' AS status,
    '# book' || book || chr(10) || chr(10) || '## Sheet: Parts' || chr(10) || chr(10) || string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| --- | --- | --- | --- |' ELSE line END, chr(10) ORDER BY i) || chr(10) AS markdown
FROM n GROUP BY book""")
def workbook_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.convert_documents(part_files(spark, sf_dir, "xlsx")).select("path", "format", "status", "markdown")


@query("""WITH b AS (SELECT DISTINCT p_partkey // 40 AS book FROM part), n AS (SELECT book, unnest(['[Content_Types].xml', 'xl/workbook.xml', 'xl/_rels/workbook.xml.rels', 'xl/worksheets/sheet1.xml', 'xl/sharedStrings.xml']) AS name, unnest([0, 1, 2, 3, 4]) AS idx FROM b)
SELECT '/parts/book' || book || '.xlsx' AS path, idx::BIGINT AS idx, name, NULL::VARCHAR AS error FROM n""")
def package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.zip_entries(part_files(spark, sf_dir, "xlsx")).select("path", F.col("idx").cast("long").alias("idx"), "name", "error")


@query("""WITH b AS (SELECT DISTINCT p_partkey // 40 AS book FROM part), a AS (SELECT book, unnest(range(0, 5)) AS adapter_no FROM b)
SELECT '/parts/book' || book || '.xls' AS path, adapter_no, CASE WHEN adapter_no = 3 THEN 'match' ELSE 'none' END AS kind, CASE WHEN adapter_no = 3 THEN 'xls' END AS format,
    CASE WHEN adapter_no = 3 THEN 'legacySpreadsheet.potentialLoss' ELSE '' END AS codes FROM a""")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.detections(part_files(spark, sf_dir, "xls"))
    return rows.select("path", F.col("adapter_no").cast("long").alias("adapter_no"), "kind", "format", F.array_join("codes", ",").alias("codes"))


def text_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A text document for every forty parts: a heading, and a paragraph with a bold brand for each."""
    books = part_books(spark, sf_dir)

    def make(x):
        blocks = [(1, [(f"Parts {x['book']}", False)])] + [(0, [(f"{r['p_name']} of size {r['p_size']}, ", False), (r["p_brand"], True)]) for r in x["rows"]]
        content = {"docx": lambda: build.package(build.docx_files(blocks)), "odt": lambda: build.package(build.odt_files(blocks)), "rtf": lambda: build.rtf_bytes(blocks)}[kind]()
        return [(f"/parts/book{x['book']}.{kind}", content)]

    return made_files(books, make)


def _text_sql(kind: str, heading: str) -> str:
    return f"""WITH p AS (SELECT p_partkey // 40 AS book, p_partkey, p_name || ' of size ' || p_size || ', **' || p_brand || '**' AS line FROM part)
SELECT '/parts/book' || book || '.{kind}' AS path, '{kind}' AS format, 'ok' AS status, '{heading}Parts ' || book || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY p_partkey) || chr(10) AS markdown FROM p GROUP BY book"""


def _converted(files: DataFrame) -> DataFrame:
    return engine.convert_documents(files).select("path", "format", "status", "markdown")


@query(_text_sql("docx", "# "))
def docx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(text_files(spark, sf_dir, "docx"))


@query(_text_sql("odt", "# "))
def odt_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(text_files(spark, sf_dir, "odt"))


@query(_text_sql("rtf", ""))
def rtf_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(text_files(spark, sf_dir, "rtf"))


def master_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every forty parts a master document of four linked texts of ten parts each; every fifth text is missing."""
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 10").alias("text"), F.struct("p_partkey", "p_name").alias("x"))
    texts = dealt(rows, "text").groupBy("text").agg(F.array_sort(F.collect_list("x")).alias("rows"))

    def make(x):
        text, out = x["text"], []
        if text % 4 == 0:
            master = build.odm_files([(2, [(f"Volume {text // 4}", False)])], [(f"Part {k}", f"texts/t{k}.odt") for k in range(text, text + 4)])
            out.append((f"/books/volume{text // 4}.odm", build.package(master)))
        if text % 5:
            out.append((f"/books/texts/t{text}.odt", build.package(build.odt_files([(0, [(r["p_name"], False)]) for r in x["rows"]]))))
        return out

    return made_files(texts, make)


@query("""WITH t AS (SELECT p_partkey // 10 AS t, string_agg(p_name, chr(10) || chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY ALL),
v AS (SELECT DISTINCT t // 4 AS v FROM t WHERE t % 4 = 0), s AS (SELECT v, 4 * v + i AS t FROM v, (SELECT unnest(range(0, 4)) AS i)),
j AS (SELECT v, s.t, body FROM s LEFT JOIN t ON s.t = t.t AND s.t % 5 <> 0),
m AS (SELECT v, bool_and(body IS NOT NULL) AS whole, min(CASE WHEN body IS NULL THEN t END) AS missing, string_agg('## Section: Part ' || t || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY t) AS text FROM j GROUP BY v)
SELECT '/books/volume' || v || '.odm' AS path, CASE WHEN whole THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT whole THEN 'Invalid ODM input at /books/volume' || v || '.odm: linked ODM section is missing: texts/t' || missing || '.odt' END AS error,
    CASE WHEN whole THEN '# volume' || v || chr(10) || chr(10) || '## Volume ' || v || chr(10) || chr(10) || text || chr(10) END AS markdown, CASE WHEN whole THEN 'openDocumentMaster.flattened' ELSE '' END AS codes FROM m""")
def master_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = engine.convert_documents(master_files(spark, sf_dir)).where("format = 'odm'")
    return done.select("path", "status", "error", "markdown", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"))


#: What a section's text is, by number: good, with tracked changes, broken, of another format, or not there.
_TEXTS = ["plain", "changed", "plain", "broken", "plain", "word", "plain", "missing", "plain", "changed", "plain"]
#: How a section is named, by number.
_NAMES = ["t{0}.odt", "./t{0}.odt", "t{0}.odt", "t%20{0}.odt", "../t{0}.odt", "https://h.example/t{0}.odt", "t{0}.odt", "t{0}.odt?x", "t{0}.odt#top"]


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two customers of one nation and segment a master of their two texts, of several kinds and names."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")

    def make(r):
        k, title, out = r["c_custkey"], r["c_name"], []
        kind, name = _TEXTS[k % len(_TEXTS)], _NAMES[k % len(_NAMES)].format(k)
        place = name.removeprefix("./").replace("%20", " ").removesuffix("#top")
        text = build.odt_files([(0, [(title, False)])])
        if kind == "changed":
            text["content.xml"] = text["content.xml"].replace("<office:text>", "<office:text><text:tracked-changes/>")
        if kind != "missing" and "//" not in name:
            content = {"broken": lambda: b"PK", "word": lambda: build.package(build.docx_files([(0, [(title, False)])]))}.get(kind, lambda: build.package(text))()
            out.append((f"/linked/{place}", content))
        out.append((f"/linked/m{k}.odm", build.package(build.odm_files([(1, [(title, False)])], [("Own", name), ("First", "../../up.odt" if k % 10 == 9 else name)]))))
        return out

    return made_files(dealt(rows, "c_custkey"), make)


@query(f"""WITH c AS (SELECT c_custkey AS k, {_TEXTS}[c_custkey % {len(_TEXTS)} + 1] AS kind, replace({_NAMES}[c_custkey % {len(_NAMES)} + 1], '{{0}}', c_custkey::VARCHAR) AS name FROM customer),
p AS (SELECT *, CASE WHEN contains(name, '//') OR contains(name, '?') THEN 'unsafe or non-local ODM section reference: ' || name WHEN starts_with(name, '../') THEN 'ODM section reference leaves the document bundle: ' || name
    WHEN kind = 'missing' THEN 'linked ODM section is missing: ' || name WHEN kind = 'broken' THEN 'linked document is invalid (' || name || '): the ZIP package signature is missing'
    WHEN kind = 'word' THEN 'linked master-document section is not an ODT file: ' || name WHEN k % 10 = 9 THEN 'ODM section reference leaves the document bundle: ../../up.odt' END AS reason FROM c)
SELECT '/linked/m' || k || '.odm' AS path, CASE WHEN reason IS NULL THEN 'match' ELSE 'invalid' END AS kind, 109::BIGINT AS priority, reason,
    CASE WHEN reason IS NOT NULL THEN '' WHEN kind = 'changed' THEN 'openDocumentMaster.flattened,openDocument.changesNotPreserved' ELSE 'openDocumentMaster.flattened' END AS codes FROM p""")
def master_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detection says of master documents whose texts are good, changed, broken, of another format, missing or elsewhere."""
    rows = engine.detections(linked_files(spark, sf_dir)).where("format = 'odm'")
    return rows.select("path", "kind", F.col("priority").cast("long").alias("priority"), "reason", F.array_join("codes", ",").alias("codes"))


#: What stands in a made document, by number: in the body, or as an external image of one mode.
_DOCX = ["", '<w:commentRangeStart w:id="1"/>', "<w:ins><w:r/></w:ins>", '<x:del xmlns:x="urn:x"/>', "External", "Internal", "<w:p><w:moveTo/><w:commentRangeStart/></w:p>"]
_ODT = ["", "<office:annotation/>", "<text:tracked-changes/>", '<draw:image xlink:href="../b.png"/><draw:image xlink:href="http://a/x.png"/>', '<draw:image xlink:href="Pictures/p.png"/>']


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word document and an open one for each customer, with comments, changes and images of several kinds."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")

    def make(r):
        key, nation, kind = r["c_custkey"], r["c_nationkey"], _DOCX[r["c_custkey"] % len(_DOCX)]
        word = build.docx_files([(0, [(r["c_name"], False)])])
        if kind.startswith("<"):
            word["word/document.xml"] = word["word/document.xml"].replace("</w:body>", f"{kind}</w:body>")
        elif kind:
            targets = "".join(f'<Relationship Id="r{k}" Type="urn:y/image" TargetMode="{kind}" Target="http://h/{nation}-{k}.png"/>' for k in (2, 1))
            word["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{xmlnodes.RELATIONSHIPS}">{targets}<Relationship Id="l" Type="urn:y/hyperlink" TargetMode="External" Target="http://a"/></Relationships>'
        if nation % 5 == 0:
            word["word/comments.xml"] = f'<w:comments xmlns:w="{xmlnodes.WORD[0]}"><w:comment/></w:comments>'
        text = build.odt_files([(0, [(r["c_name"], False)])])
        text["content.xml"] = text["content.xml"].replace("<office:text>", f'<office:text xmlns:draw="{xmlnodes.DRAW}">{_ODT[key % len(_ODT)]}')
        return [(f"/marked/{key}.docx", build.package(word)), (f"/marked/{key}.odt", build.package(text))]

    return made_files(dealt(rows, "c_custkey"), make)


@query(f"""SELECT '/marked/' || c_custkey || '.docx' AS path, c_custkey % 7 IN (1, 6) OR c_nationkey % 5 = 0 AS comments, c_custkey % 7 IN (2, 6) AS changes, false AS odt_changes, CASE WHEN c_custkey % 7 = 4 THEN 'http://h/' || c_nationkey || '-1.png' END AS unsafe FROM customer
UNION ALL SELECT '/marked/' || c_custkey || '.odt', c_custkey % 5 = 1, false, c_custkey % 5 = 2, CASE WHEN c_custkey % 5 = 3 THEN '../b.png' END FROM customer""")
def package_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, tracked changes and images from elsewhere, as predicates on the elements of the packages' parts."""
    return xmlnodes.inspections(nodes.xml_nodes(marked_files(spark, sf_dir), xmlnodes.PARTS))


def string_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for every forty parts: its strings are the parts' names, in one or two runs, and its sheets their brands."""
    books = part_books(spark, sf_dir)

    def make(x):
        rows, files = x["rows"], build.xlsx_files([("S", [["a"]])])
        run = lambda n, k: f"<r><rPr/><t>{n[:k]}</t></r><r><t>{n[k:]}</t></r>" if k % 2 else f"<t>{n}</t>" if k % 4 else ""
        files["xl/sharedStrings.xml"] = f'<sst xmlns="{xmlnodes.SHEET}">' + "".join(f"<si>{run(r['p_name'], int(r['p_size']))}</si>" for r in rows) + "</sst>"
        sheets = "".join(f'<sheet name="{r["p_brand"]}" r:id="r{r["p_partkey"]}"/>' if r["p_size"] % 10 else f'<sheet name="{r["p_brand"]}"/>' for r in rows)
        files["xl/workbook.xml"] = f'<workbook xmlns="{xmlnodes.SHEET}" xmlns:r="{xmlnodes.OFFICE_RELATIONSHIPS}"><sheets>{sheets}</sheets></workbook>'
        return [(f"/parts/book{x['book']}.xlsx", build.package(files))]

    return made_files(books, make)


@query("""SELECT '/parts/book' || p_partkey // 40 || '.xlsx' AS path, (row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1)::BIGINT AS idx, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS text, p_brand AS sheet,
    CASE WHEN p_size % 10 <> 0 THEN 'r' || p_partkey END AS rel, CASE WHEN p_size % 10 = 0 THEN 'an XLSX sheet declaration is incomplete' END AS error FROM part""")
def workbook_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared strings and declared sheets out of the elements of workbooks' parts, side by side by number."""
    found = nodes.xml_nodes(string_files(spark, sf_dir), xmlnodes.PARTS)
    strings = xmlnodes.shared_strings(found)
    sheets = xmlnodes.sheet_list(found).select("path", F.col("sheet_no").alias("idx"), F.col("name").alias("sheet"), "rel", "error")
    return strings.join(sheets, ["path", "idx"]).withColumn("idx", F.col("idx").cast("long"))


def linked_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for every forty parts: name, size (a formula where it is odd), a truth value, and a link with the brand
    over it and the cells beside it; every seventh book has a cell out of order, and every fifth link spans five rows."""
    books = part_books(spark, sf_dir)

    def make(x):
        book, rows, body, areas = x["book"], x["rows"], "", ""
        for k, r in enumerate(rows, 1):
            size = int(r["p_size"])
            body += f'<row r="{k}"><c t="inlineStr"><is><t>{r["p_name"]}</t></is></c><c>{"<f>N()</f>" if size % 2 else ""}<v>{size}</v></c><c r="D{k}" t="b"><v>{size % 2}</v></c>{"<c r='A1'/>" if book % 7 == 3 and k == 2 else ""}</row>'
            areas += f'<hyperlink ref="C{k}:E{k + 4 if k % 5 == 0 and k + 4 <= len(rows) else k}" display="{r["p_brand"]}"/>'
        files = build.xlsx_files([("Parts", [["x"]])])
        files["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{xmlnodes.SHEET}"><sheetData>{body}</sheetData><hyperlinks>{areas}</hyperlinks></worksheet>'
        return [(f"/parts/book{book}.xlsx", build.package(files))]

    return made_files(books, make)


@query("""WITH p AS (SELECT p_partkey // 40 AS book, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_partkey // 40) AS n, p_name, p_size, p_brand FROM part),
s AS (SELECT book, p_brand AS brand, k AS first, CASE WHEN k % 5 = 0 AND k + 4 <= n THEN k + 4 ELSE k END AS last FROM p),
l AS (SELECT p.book, p.k, min_by(s.brand, s.first) AS brand FROM p JOIN s ON p.book = s.book AND p.k BETWEEN s.first AND s.last GROUP BY ALL),
t AS (SELECT book, string_agg('| ' || p_name || ' | ' || p_size || ' | ' || brand || ' | ' || CASE WHEN p_size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END || ' | ' || brand || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY k) AS body FROM p JOIN l USING (book, k) GROUP BY book)
SELECT '/parts/book' || book || '.xlsx' AS path, CASE WHEN book % 7 <> 3 THEN '# book' || book || chr(10) || chr(10) || '## Sheet: Parts' || chr(10) || chr(10) || body || chr(10) END AS markdown,
    CASE WHEN book % 7 = 3 THEN 'XLSX cells are not in increasing column order' END AS error FROM t""")
def workbook_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with formulas, truth values, inline texts, links over areas and cells out of order, read and rendered as tables of elements."""
    return workbooks.markdown(workbooks.tables(nodes.xml_nodes(linked_books(spark, sf_dir), workbooks.PARTS)))


@query("""SELECT '/notes/n' || c_custkey || '.rtfd' AS path, 'ok' AS status, c_name || ' in **' || c_mktsegment || '**' || chr(10) AS markdown,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Attachment was not represented in the generated Markdown: n' || c_nationkey || '.pdf' ELSE '' END AS messages FROM customer""")
def package_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder package of rich text for each customer; those of even nations have an attachment that nothing shows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")

    def make(r):
        home = f"/notes/n{r['c_custkey']}.rtfd"
        out = [(f"{home}/TXT.rtf", build.rtf_bytes([(0, [(f"{r['c_name']} in ", False), (r["c_mktsegment"], True)])])), (f"{home}/.hidden", b"x")]
        return out + [(f"{home}/n{r['c_nationkey']}.pdf", b"%PDF")] * (r["c_nationkey"] % 2 == 0)

    done = engine.convert_packages(made_files(dealt(rows, "c_custkey"), make))
    return done.select("path", "status", "markdown", F.array_join(F.transform("warnings", lambda w: w["message"]), ",").alias("messages"))


def _mapped(df: DataFrame, key: str, column: str, f, out: str, step: int = 64) -> DataFrame:
    """(key, out): f of each text; null stays null. Beside Spark's batch a worker holds `step` texts at most."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = [None if t is None else f(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, out])

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` string")


@query()
def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = hostile(spark, sf_dir).withColumn("text", F.concat(F.lit("![x](images/image01.png) `[](images/image01.png)` [\\](images/image01.png) "), "text", F.lit("\n\n[y](<images/image01.png>)")))
    return _mapped(texts, "doc_id", "text", lambda t: links.rewritten(t, "images/image01.png", "images/section01-image01.png"), "markdown")


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(table(spark, sf_dir, "pages"), "page_id", "html", lambda h: markdown.normalized(gfm.markdown(h)), "markdown")
