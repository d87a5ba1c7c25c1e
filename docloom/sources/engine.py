"""Documents in bulk: a scan of files, one Arrow pass that detects and converts, and tables of what was found.

    files = scan(spark, "/data/in")
    done = convert_documents(files)          # a row for each file, errors included
    cells = document_cells(files)            # a row for each stored spreadsheet cell
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import refs
from docloom.sources import convert as one
from docloom.sources.adapters import Registry
from docloom.sources.shared import stored
from docloom.sources.zipgate import PackageError, open_package

MAX_INPUT = 1 << 30

ASSET = "array<struct<path:string,bytes:binary>>"
WARNING = "array<struct<code:string,message:string>>"
RESULTS = f"path string, format string, status string, error_kind string, error string, warnings {WARNING}, markdown string, assets {ASSET}"
ITEMS = "items array<struct<kind:string,text:string,name:string,reference:string>>"
CELLS = "path string, sheet_no int, sheet string, r int, c int, value_type string, value string, display string, formula string"
ENTRIES = "path string, idx int, name string, raw_name binary, flags int, method int, crc long, csize long, usize long, is_dir boolean, error string"


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_schema(ddl))


def scan(spark: SparkSession, path: str, pattern: str = "*", limit: int = MAX_INPUT) -> DataFrame:
    """(path, length, content) of the files below path; larger ones than the limit have their row, and null for content.

    Spark passes over files of no bytes, and so does this.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return within(files, limit)


def within(files: DataFrame, limit: int) -> DataFrame:
    """(path, length, content), content null for files over the limit; of these no byte is read."""
    over = files.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= limit).select("path", "length", "content").unionAll(over)


def _unread(path: str, length: int | None) -> str:
    return f"Input of {'unknown' if length is None else length} bytes is over the size limit and was not read: {path}"


def signatures(files: DataFrame) -> DataFrame:
    """files with the kind of container that their first bytes tell, without a look at the rest."""
    return files.withColumn("signature", refs.signature(F.col("content")))


def _row(r: one.Result) -> dict:
    return {
        "path": r.path, "format": r.format, "status": r.status, "error_kind": r.error_kind, "error": r.error, "markdown": r.markdown,
        "warnings": [{"code": c, "message": m} for c, m in r.warnings], "assets": [{"path": p, "bytes": b} for p, b in sorted(r.assets.items())],
    }


def whole(value):
    """The value with each half of a surrogate pair that stands alone, in any text of it, made U+FFFD."""
    if isinstance(value, str):
        return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    if isinstance(value, dict):
        return {k: whole(v) for k, v in value.items()}
    return [whole(v) for v in value] if isinstance(value, (list, tuple)) else value


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """The rows in Arrow. Texts that no file may hold, such as half a character, are mended where Arrow refuses them."""
    try:
        return pa.RecordBatch.from_pylist(rows, schema)
    except UnicodeEncodeError:
        return pa.RecordBatch.from_pylist(whole(rows), schema)


def _pass(files: DataFrame, ddl: str, rows, unread) -> DataFrame:
    """One Arrow pass over (path, content): rows(path, content) -> dicts, a document at a time. Spark bounds a batch by bytes.

    A file without content gives unread(path, message) -> dict instead, and so does one whose rows can't be made. The rows
    of small files leave together, up to 1,000 rows or 256 KiB of input.
    """
    schema = _arrow(ddl)

    def made(path: str, content: bytes | None, length: int | None) -> list[dict]:
        if content is None:
            return [unread(path, _unread(path, length))] if unread else []
        try:
            return rows(path, content)
        except Exception as e:  # one bad file must not fail the job
            return [unread(path, f"{type(e).__name__}: {e}")] if unread else []

    def packed(held: list[tuple[str, list[dict]]]) -> Iterator[pa.RecordBatch]:
        found = [x for _, part in held for x in part]
        try:
            yield from [_batch(found[k : k + 20_000], schema) for k in range(0, len(found), 20_000)]
        except Exception as e:
            if len(held) > 1:  # one bad file must not spoil the others
                for one_ in held:
                    yield from packed([one_])
            elif unread:
                yield _batch([unread(held[0][0], f"{type(e).__name__}: {e}")], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[dict]]] = []
        size = count = 0
        for batch in batches:
            for path, content, length in zip(*batch.columns):
                name, data = path.as_py(), content.as_py()
                held.append((name, made(name, data, length.as_py())))
                size, count = size + len(data or b""), count + len(held[-1][1])
                if count >= 1_000 or size >= 1 << 18:
                    yield from packed(held)
                    held, size, count = [], 0, 0
        yield from packed(held)

    length = F.col("length") if "length" in files.columns else F.lit(None).cast("long").alias("length")
    return files.select("path", "content", length).mapInArrow(run, _schema(ddl))


def convert_documents(files: DataFrame, rendering: str = "table", registry: Registry = one.DEFAULT) -> DataFrame:
    """RESULTS, a row for each file. Master documents are put together with the ODT files of the same scan.

    Files are read and converted once, when this is called: results go to a table in the shared folder, with a folder
    each for master documents, for the ODT files that these may name, and for all others. Masters then meet ODT results,
    without their assets, in a shuffle; nothing else moves.
    """

    def rows(path: str, content: bytes) -> list[dict]:
        r = one.convert(path, content, rendering, registry)
        items = [vars(i) for i in r.items] if r.items is not None else None
        return [_row(r) | {"items": items}]

    def unread(path: str, why: str) -> dict:
        return _row(one.Result(path, status="error", error_kind="invalid_input", error=why)) | {"items": None}

    done = _pass(files, f"{RESULTS}, {ITEMS}", rows, unread)
    part = F.when(F.col("status") == "master", "master").when(F.col("format") == "odt", "odt").otherwise("other")
    done = stored(done.withColumn("part", part), "part")
    plain = done.where("part <> 'master'").drop("items", "part")
    return plain.unionByName(assemble_masters(done.where("part = 'master'"), done.where("part = 'odt'")))


_PLAN = "path string, format string, status string, error_kind string, error string, warnings " + WARNING + ", markdown string, places array<struct<path:string,child:string,source:string>>"


def assemble_masters(masters: DataFrame, children: DataFrame) -> DataFrame:
    """Master rows (with items) and the converted ODT rows -> RESULTS of the masters.

    Texts are put together first, with the place that each asset gets. The assets' bytes stay rows of their own and join
    these places; they pass through no Python worker.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    wanted = masters.select(F.col("path").alias("master"), "items", "warnings", folder.alias("folder"))
    refs_ = wanted.select("master", "folder", F.explode_outer(F.filter("items", lambda i: i["kind"] == "section")).alias("s"))
    links = refs_.select("master", F.concat("folder", refs.section_path(F.col("s.reference"))["path"]).alias("child")).distinct()
    kids = children.select(F.col("path").alias("child"), F.struct("status", "format", "error", "warnings", "markdown", F.col("assets.path").alias("names")).alias("got"))
    joined = links.join(kids, "child").groupBy("master").agg(F.collect_list(F.struct("child", "got")).alias("kids"))
    rows = wanted.join(joined, "master", "left").select("master", "items", "warnings", "folder", "kids")

    schema = _arrow(_PLAN)

    def assembled(row: dict) -> dict:
        master = one.Result(row["master"], "odm", "master", warnings=[(w["code"], w["message"]) for w in row["warnings"]], items=[one.odm.Item(**i) for i in row["items"]])
        kids = {}
        for k in row["kids"] or []:
            got = k["got"]
            assets = {name: (k["child"], name) for name in got["names"] or []}  # where the bytes are
            kids[k["child"][len(row["folder"]) :]] = one.Result(k["child"], got["format"], got["status"], None, got["error"], [(w["code"], w["message"]) for w in got["warnings"]], got["markdown"], assets)
        done = one.resolve_master(master, kids)
        out = _row(done)
        out["places"] = [{"path": p, "child": child, "source": name} for p, (child, name) in sorted(done.assets.items())]
        del out["assets"]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch([assembled(row)], schema)

    texts = stored(rows.mapInArrow(run, _schema(_PLAN)))
    places = texts.select(F.col("path").alias("master"), F.explode("places").alias("p")).select("master", "p.*")
    bytes_ = children.select(F.col("path").alias("child"), F.explode("assets").alias("a")).select("child", F.col("a.path").alias("source"), "a.bytes")
    assets = places.join(bytes_, ["child", "source"]).groupBy("master").agg(F.array_sort(F.collect_list(F.struct("path", "bytes"))).alias("assets"))
    none = F.array().cast(ASSET)
    return texts.drop("places").join(assets.withColumnRenamed("master", "path"), "path", "left").withColumn("assets", F.coalesce("assets", none))


def convert_packages(files: DataFrame) -> DataFrame:
    """RESULTS of folder packages of rich text: the files of each folder that holds a TXT.rtf, brought together."""
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    rows = files.select(folder.alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    groups = rows.groupBy("folder").agg(F.collect_list(F.struct("name", "content")).alias("files")).where("exists(files, f -> f.name = 'TXT.rtf')")

    schema = _arrow(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch([_row(one.convert_package(row["folder"], {f["name"]: f["content"] for f in row["files"]}))], schema)

    return groups.mapInArrow(run, _schema(RESULTS))


def detections(files: DataFrame, registry: Registry = one.DEFAULT) -> DataFrame:
    """(path, adapter_no, kind, format, priority, reason, codes): what each adapter says of each file.

    A file over the size limit has one row of kind invalid, without adapter and format. A master document is a match only
    if all texts that it names are: with the warnings of these, or invalid with what is wrong with the first that isn't.
    Files are read once; what is said of masters and texts then meets in joins of a few columns.
    """

    def rows(path: str, content: bytes) -> list[dict]:
        out = []
        for n, d in enumerate(one.detectors(path, content, registry)):
            sections = [i.reference for i in d.parsed if i.kind == "section"] if d.format == "odm" and d.parsed else []
            out.append({"path": path, "adapter_no": n, "kind": d.kind, "format": d.format, "priority": d.priority, "reason": d.reason, "codes": d.warnings, "sections": sections})
        return out

    def unread(path: str, why: str) -> dict:
        return {"path": path, "kind": "invalid", "priority": 0, "reason": why, "codes": [], "sections": []}

    told = stored(_pass(files, "path string, adapter_no int, kind string, format string, priority int, reason string, codes array<string>, sections array<string>", rows, unread))
    linked = F.col("format").eqNullSafe("odm") & (F.col("kind") == "match") & (F.size("sections") > 0)
    own = told.where(~linked).drop("sections")
    return own.unionByName(linked_masters(told.where(linked), told.where(F.col("adapter_no") == registry.place("odt"))))


def linked_masters(masters: DataFrame, texts: DataFrame) -> DataFrame:
    """Detections of masters (with sections), judged by what the word-processing adapter says of the files these name.

    texts: that adapter's detections of all files. A section that names no file of them is missing.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    sections = masters.select("path", folder.alias("_folder"), F.posexplode("sections").alias("_at", "_reference")).withColumn("_to", refs.section_path(F.col("_reference")))
    sections = sections.select("path", "_at", "_reference", F.col("_to.problem").alias("_problem"), F.concat("_folder", "_to.path").alias("_child"))
    words = texts.select(F.col("path").alias("_child"), F.struct("kind", "format", "reason", "codes").alias("_said"))
    met = sections.join(words, "_child", "left")
    text = F.col("_said.format").eqNullSafe("odt") & F.col("_said.kind").eqNullSafe("match")
    problem = F.coalesce("_problem", F.when(F.col("_said").isNull(), "missing").when(F.col("_said.kind") == "invalid", "invalid").when(~text, "not_odt"))
    messages = F.create_map(*(F.lit(x) for pair in one.SECTION_ERRORS.items() for x in pair))
    said = F.replace(F.replace(F.try_element_at(messages, problem), F.lit("{0}"), F.col("_reference")), F.lit("{1}"), F.coalesce("_said.reason", F.lit("")))
    judged = met.groupBy("path").agg(F.min(F.when(problem.isNotNull(), F.struct(F.col("_at"), said.alias("_why"))))["_why"].alias("_why"), F.array_sort(F.collect_list(F.struct("_at", F.col("_said.codes").alias("c")))).alias("_codes"))
    rows = masters.drop("sections").join(judged, "path")
    bad, named = F.col("_why").isNotNull(), F.lower(F.col("path")).endswith(".odm")
    every = F.array_distinct(F.concat("codes", F.flatten(F.transform("_codes", lambda x: F.coalesce(x["c"], F.array().cast("array<string>"))))))
    return rows.select(
        "path", "adapter_no", F.when(~bad, "match").when(named, "invalid").otherwise("none").alias("kind"), F.when(~bad | named, F.col("format")).alias("format"), F.when(~bad | named, F.col("priority")).otherwise(0).alias("priority"),
        F.when(named, F.col("_why")).alias("reason"), F.when(bad, F.array().cast("array<string>")).otherwise(every).alias("codes"),
    )


def document_cells(files: DataFrame) -> DataFrame:
    """CELLS: stored cells of all readable workbooks, gaps included; files that are no workbooks or over the size limit give none."""
    names = [f.name for f in _schema(CELLS)]
    office = files.where(refs.signature(F.col("content")).isin("zip", "ole"))  # a cheap look before any parse

    def rows(path: str, content: bytes) -> list[dict]:
        book = one.workbook_of(path, content)
        return [dict(zip(names, (path, *c))) for c in book.cells()] if book else []

    return _pass(office, CELLS, rows, None)  # files without content have no signature


def zip_entries(files: DataFrame) -> DataFrame:
    """ENTRIES of packages that pass the gate; of others, and of any file over the size limit, one row with the error."""
    zips = files.where((refs.signature(F.col("content")) == "zip") | F.col("content").isNull())

    def rows(path: str, content: bytes) -> list[dict]:
        try:
            package = open_package(content).verify()
        except PackageError as e:
            return [{"path": path, "error": str(e)}]
        return [{"path": path, "idx": e.idx, "name": e.name, "raw_name": e.raw_name, "flags": e.flags, "method": e.method, "crc": e.crc, "csize": e.csize, "usize": e.usize, "is_dir": e.is_dir} for e in package.entries.values()]

    return _pass(zips, ENTRIES, rows, lambda path, why: {"path": path, "error": why})


def register_functions(spark: SparkSession) -> None:
    """SQL table functions workbook_cells(content) and package_entries(content), for use with LATERAL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=CELLS.removeprefix("path string, "))
    class WorkbookCells:
        def eval(self, content: bytes):
            book = one.workbook_of("", bytes(content)) if content is not None else None
            if book:
                yield from book.cells()

    @udtf(returnType="name string, size long, is_dir boolean")
    class PackageEntries:
        def eval(self, content: bytes):
            try:
                package = open_package(bytes(content)) if content is not None else None
            except PackageError:
                package = None
            if package:
                for e in package.entries.values():
                    yield e.name, e.usize, e.is_dir

    spark.udtf.register("workbook_cells", WorkbookCells)
    spark.udtf.register("package_entries", PackageEntries)
