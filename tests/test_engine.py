"""The bulk engine on real files: errors as rows, masters, sink, stream, data source, table functions, command line."""

import json
import os

import pytest

from docloom import catalog, cli
from docloom.sources import build, datasource, engine, publish
from docloom.streaming import watch
from tests.test_text import master, odt


@pytest.fixture
def folder(tmp_path):
    inputs = tmp_path / "in"
    (inputs / "sub").mkdir(parents=True)
    (inputs / "note.rtfd").mkdir()
    section = '<text:section text:name="One"><text:section-source xlink:href="sub/a.odt"/></text:section>'
    files = {
        "book.xlsx": build.package(build.xlsx_files([("S", [["a", 1], [None, "b"]])])),
        "old.xls": build.xls_bytes([("S", [["x"]])]),
        "text.rtf": b"{\\rtf1 hello}",
        "all.odm": master("<text:p>Intro</text:p>" + section),
        "sub/a.odt": odt("<text:p>Child</text:p>"),
        "broken.docx": b"nothing",
        "empty.bin": b"?",
        "note.rtfd/TXT.rtf": b"{\\rtf1 note}",
        "note.rtfd/extra.pdf": b"pdf",
    }
    for name, data in files.items():
        (inputs / name).write_bytes(data)
    return inputs


def by_name(rows):
    return {os.path.basename(r.path): r for r in rows}


def test_convert_every_file(spark, folder):
    rows = by_name(engine.convert_documents(engine.scan(spark, str(folder))).collect())
    assert {n: (r.status, r.format, r.error_kind) for n, r in rows.items()} == {
        "book.xlsx": ("ok", "xlsx", None), "old.xls": ("ok", "xls", None), "text.rtf": ("ok", "rtf", None), "all.odm": ("ok", "odm", None), "a.odt": ("ok", "odt", None),
        "broken.docx": ("error", "docx", "invalid_input"), "empty.bin": ("error", None, "unsupported_input"), "TXT.rtf": ("ok", "rtf", None), "extra.pdf": ("error", None, "unsupported_input"),
    }
    assert rows["all.odm"].markdown == "# all\n\nIntro\n\n## Section: One\n\nChild\n"
    assert rows["book.xlsx"].markdown == "# book\n\n## Sheet: S\n\n| a | 1 |\n| --- | --- |\n|  | b |\n"
    packages = engine.convert_packages(engine.scan(spark, str(folder))).collect()
    assert [(p.format, p.markdown, p.warnings[0].code) for p in packages] == [("rtfd", "note\n", "richText.attachmentNotRepresented")]


def test_size_limit_is_pushed_to_the_scan(spark, folder):
    files = engine.scan(spark, str(folder), limit=20)
    assert "LessThanOrEqual(length,20)" in files._jdf.queryExecution().toString()
    assert engine.convert_documents(files).where("format = 'xlsx'").count() == 0


def test_files_over_the_limit_are_error_rows(spark, folder, tmp_path):
    over = {"book.xlsx", "old.xls", "all.odm", "a.odt"}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "20")  # a read of their content would fail the job
    try:
        files = engine.scan(spark, str(folder), limit=20)
        rows = by_name(engine.convert_documents(files).collect())
        assert len(rows) == 9 and {n for n, r in rows.items() if r.error_kind == "invalid_input" and "over the size limit" in r.error} == over
        assert {r.path for r in engine.detections(files).where("reason like '%over the size limit%'").collect()} == {rows[n].path for n in over}
        assert {os.path.basename(r.path) for r in engine.zip_entries(files).where("error is not null").collect()} == over
        assert engine.document_cells(files).count() == 0
        (package,) = engine.convert_packages(engine.scan(spark, str(folder), limit=12)).collect()
        assert (package.status, [w.message[-9:] for w in package.warnings]) == ("ok", ["extra.pdf"])
        (folder / "note.rtfd" / "extra.pdf").write_bytes(b"p" * 13)
        (package,) = engine.convert_packages(engine.scan(spark, str(folder), limit=12)).collect()
        assert (package.status, [w.message[-9:] for w in package.warnings]) == ("ok", ["extra.pdf"])
        (package,) = engine.convert_packages(engine.scan(spark, str(folder), limit=5)).collect()
        assert package.status == "error" and "over the size limit" in package.error
        table, marks = str(tmp_path / "table"), str(tmp_path / "marks")
        watch.convert_stream(watch.watch(spark, str(folder), limit=20), table, marks, once=True).awaitTermination()
        streamed = spark.read.parquet(table)
        assert streamed.count() == 9 and streamed.where("error like '%over the size limit%'").count() == 4
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_cells_entries_detections(spark, folder):
    files = engine.scan(spark, str(folder), "*.xls*")
    cells = engine.document_cells(files).collect()
    assert sorted((c.sheet, c.r, c.c, c.value_type, c.display) for c in cells) == [("S", 0, 0, "string", "a"), ("S", 0, 0, "string", "x"), ("S", 0, 1, "number", "1"), ("S", 1, 0, "empty", ""), ("S", 1, 1, "string", "b")]
    entries = engine.zip_entries(files)
    assert entries.count() == 5 and entries.where("error is not null").count() == 0
    assert engine.detections(files).where("kind = 'match'").count() == 2
    assert {r.signature for r in engine.signatures(engine.scan(spark, str(folder))).collect()} == {"zip", "ole", "rtf", "none"}


def test_table_functions_and_data_source(spark, folder):
    engine.register_functions(spark)
    engine.scan(spark, str(folder), "*.xlsx").createOrReplaceTempView("files_under_test")
    assert spark.sql("SELECT c.display FROM files_under_test, LATERAL workbook_cells(content) c WHERE c.r = 1 AND c.c = 1").head()[0] == "b"
    assert spark.sql("SELECT count(*) FROM files_under_test, LATERAL package_entries(content) e").head()[0] == 5
    datasource.register(spark)
    assert spark.read.format("workbook").load(str(folder / "*.xls*")).count() == 5


def test_publish_never_overwrites(spark, folder, tmp_path):
    results = engine.convert_documents(engine.scan(spark, str(folder), "*.rtf"))
    out = str(tmp_path / "out")
    os.mkdir(out)
    first = publish.publish(results, out).collect()
    assert all(r.error is None and os.path.isfile(r.markdown_file) for r in first)
    again = publish.publish(results, out).collect()
    assert {r.error_kind for r in again} == {"output_exists"}
    assert not [n for n in os.listdir(out) if n.startswith(".docloom")]
    with pytest.raises(publish.OutputError, match="must not be inside"):
        publish.check_output(str(folder / "note.rtfd" / "x"), str(folder / "note.rtfd"))
    with pytest.raises(publish.OutputError, match="parent directory does not exist"):
        publish.check_output(str(tmp_path / "no" / "x"))


def test_stream(spark, folder, tmp_path):
    table, marks = str(tmp_path / "table"), str(tmp_path / "marks")
    for added in (None, "late.rtf"):
        if added:
            (folder / added).write_bytes(b"{\\rtf1 late}")
        query = watch.convert_stream(watch.watch(spark, str(folder)), table, marks, once=True)
        query.awaitTermination()
    rows = spark.read.parquet(table)
    assert rows.count() == 10 and rows.where("markdown = 'late\n'").count() == 1


def test_command_line(folder, tmp_path, capsys):
    out = str(tmp_path / "result")
    assert cli.main([str(folder / "all.odm"), "-o", out, "--json"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["ok"] and said["outputDirectory"] == os.path.realpath(out) and open(said["markdownFile"]).read().startswith("# all")
    codes = [
        ([str(folder / "all.odm"), "-o", out], 73), ([str(folder / "none")], 66), ([str(folder / "empty.bin")], 65), ([], 64), (["--what"], 64), (["a", "b"], 64), (["-o"], 64),
        (["--formats", "a"], 64), (["--spreadsheet-format", "csv", "a"], 64), (["--formats"], 0), (["-V"], 0), (["--help"], 0), ([str(folder / "note.rtfd"), "-o", str(tmp_path / "n")], 0),
    ]
    assert [cli.main(a) for a, _ in codes] == [c for _, c in codes]
    (folder / "w.doc").write_bytes(build.ole({"WordDocument": b"x"}))
    assert cli.main([str(folder / "w.doc")]) == 69


def test_catalog(spark):
    rows = {r.format: r for r in catalog.catalog(spark, {"pandoc": "/nowhere", "textutil": "/nowhere"}).collect()}
    assert rows["doc"].reason == "missing required tool: textutil, pandoc" and rows["xlsx"].available
    listed = catalog.catalog_rows({"pandoc": "/nowhere", "textutil": "/bin/sh"})
    assert next(r for r in listed if r["format"] == "doc")["unavailableReason"] == "missing required tool: pandoc"
    assert json.loads(catalog.catalog_json(listed))["formats"][0]["unavailableReason"] is None
    lines = catalog.catalog_text(listed).split("\n")
    assert len(lines) == 9 and len({line.index("package" if "package" in line else "file") for line in lines}) == 1


def test_doc_is_never_available(spark):
    tools = {"pandoc": "/bin/sh", "textutil": "/bin/sh"}
    row = next(r for r in catalog.catalog(spark, tools).collect() if r.format == "doc")
    listed = next(r for r in catalog.catalog_rows(tools) if r["format"] == "doc")
    assert not row.available and row.reason == listed["unavailableReason"] == "DOC is detected but never converted here" and not listed["isAvailable"]
    assert cli.main(["--pandoc", "/bin/sh", "--formats"]) == 64
