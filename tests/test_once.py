"""Single-pass conversion, bad files, images and Markdown as columns, tiles, budgets and folded names."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.functions import image_columns, images as one_image, markdown
from docloom.operators import budgets, colours, grid, images, normalize, render, resolve, workbooks, xmlnodes
from docloom.plans import relational
from docloom import catalog
from docloom.sources import build, convert, datasource, engine, nodes, publishing, rtf, shared
from docloom.sources.adapters import Detection, Format, Registry
from tests.test_text import master, odt

IMAGE = '<text:p>see <draw:frame><draw:image xlink:href="Pictures/p.PNG"/></draw:frame></text:p>'
SECTION = '<text:section text:name="%s"><text:section-source xlink:href="%s"/></text:section>'


def files_of(spark, files):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files.items()], "path string, length long, content binary")


def test_each_file_is_converted_once(spark):
    files = {
        "/d/all.odm": master("<text:p>Intro</text:p>" + SECTION % ("One", "sub/a.odt")), "/d/sub/a.odt": odt("<text:p>Child</text:p>"),
        "/d/book.xlsx": build.package(build.xlsx_files([("S", [["a"]])])), "/d/bad.docx": b"nothing",
    }
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = files_of(spark, files).coalesce(1).mapInPandas(counted, "path string, length long, content binary")
    done = engine.convert_documents(rows)
    for _ in range(2):  # however often the results are used
        found = {r.path: r for r in done.collect()}
    assert read.value == len(files) == len(found)
    assert found["/d/all.odm"].markdown == "# all\n\nIntro\n\n## Section: One\n\nChild\n" and found["/d/bad.docx"].status == "error"


def test_master_assets_are_rows_until_the_end(spark):
    files = {"/d/all.odm": master(SECTION % ("A", "a.odt") + SECTION % ("B", "a.odt")), "/d/a.odt": odt(IMAGE, {"Pictures/p.PNG": b"png"})}
    found = {r.path: r for r in engine.convert_documents(files_of(spark, files)).collect()}
    book, child = found["/d/all.odm"], found["/d/a.odt"]
    assert [a.path for a in book.assets] == ["images/section01-image01.png", "images/section02-image01.png"]
    assert {bytes(a.bytes) for a in book.assets} == {bytes(child.assets[0].bytes)} == {b"png"}
    assert "images/section02-image01.png" in book.markdown


def test_half_characters_fail_no_job(spark):
    assert rtf.rtf_html(b"{\\rtf1 a\\u-10179?\\u-8704?b}")[0] == "<p>a\U0001f600b</p>"
    assert rtf.rtf_html(b"{\\rtf1 a\\u-10179?b\\u-8704?}")[0] == "<p>a�b�</p>"
    files = {"/d/e.rtf": b"{\\rtf1 \\u-10179?\\u-8704?}", "/d/half.rtf": b"{\\rtf1 \\u-10179?}", "/d/ok.rtf": b"{\\rtf1 fine}"}
    found = {r.path: (r.status, r.markdown) for r in engine.convert_documents(files_of(spark, files)).collect()}
    assert found == {"/d/e.rtf": ("ok", "\U0001f600\n"), "/d/half.rtf": ("ok", "�\n"), "/d/ok.rtf": ("ok", "fine\n")}


def test_rows_that_cannot_be_made_are_an_error_row(spark):
    def rows(path, content):
        if content == b"bad":
            raise KeyError("x")
        return [{"path": path, "error": "\ud83d" if content == b"half" else None}]

    files = files_of(spark, {"/a": b"bad", "/b": b"half", "/c": b"good"})
    done = engine._pass(files, "path string, error string", rows, lambda path, why: {"path": path, "error": why})
    assert {r.path: r.error for r in done.collect()} == {"/a": "KeyError: 'x'", "/b": "�", "/c": None}


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())
    Context.master = "local[2]"
    assert shared.shared_folder(Session()).startswith("/")


SOURCES = [
    "a.png", "./././a.png", "a//b.PNG", "a/b.PNG", "media/x%20y.jpeg", "x+y.png", "a&amp;b.gif", "%zz.png", "%ff.png", "noext", ".hidden", "dir.d/file", "é.PÑG", "a/", "file:///t/m%20n.bmp", "FILE:q.tif",
    "", ".", "..", "../a", "a/../b", "a/./b", "/a", "a\\b", "http://h/x.png", "mailto:x", "data:image/png;base64,AA", "./", ".//a", "file:///", "%2e%2e/a", "%2Fetc",
]


def test_image_sources(spark):
    got = {r.s: r.f for r in spark.createDataFrame([(s,) for s in SOURCES], "s string").select("s", image_columns.resolved(F.col("s")).alias("f")).collect()}
    want = {
        "a.png": "a.png", "./././a.png": "a.png", "a//b.PNG": "a/b.PNG", "a/b.PNG": "a/b.PNG", "media/x%20y.jpeg": "media/x y.jpeg", "x+y.png": "x+y.png", "a&amp;b.gif": "a&b.gif", "%zz.png": "%zz.png",
        "%ff.png": "%ff.png", "noext": "noext", ".hidden": ".hidden", "dir.d/file": "dir.d/file", "é.PÑG": "é.PÑG", "a/": "a", "file:///t/m%20n.bmp": "m n.bmp",
    }
    assert {s: f for s, f in got.items() if f} == want | {"FILE:q.tif": got["FILE:q.tif"]}


def test_images_of_many_documents(spark):
    docs = [
        (1, '<img src="b%20c.PNG"><IMG alt="" src=\'./d.jpg\'><img src="b%20c.PNG">', ["b c.PNG", "d.jpg"]), (2, "none", []), (3, None, None), (4, '<img src="../up"><img src="gone.png">', []),
        (5, '<img src="m/gone.png">', ["x"]), (6, '<img src="">', []), (7, "<img data-src='x.png' src='y.p(g'>", ["y.p(g"]), (1, '<img src="b.a">', ["b.a"]),
    ]
    df = spark.createDataFrame(docs, "doc int, html string, files array<string>")
    got = sorted(((r.doc, r.html, [(a.asset, a.file) for a in r.assets] if r.assets is not None else None, r.error) for r in images.rewrite_images(df, "doc", files="files").collect()), key=repr)
    assert got == sorted([
        (1, '<img src="images/image01.png"><IMG alt="" src=\'images/image02.jpg\'><img src="images/image01.png">', [("image01.png", "b c.PNG"), ("image02.jpg", "d.jpg")], None), (2, "none", [], None), (3, None, None, None),
        (4, None, None, images.UNSAFE + "../up"), (5, None, None, images.MISSING + "gone.png"), (6, '<img src="">', [], None), (7, "<img data-src='x.png' src='images/image01.p%28g'>", [("image01.p(g", "y.p(g")], None),
        (1, '<img src="images/image01.a">', [("image01.a", "b.a")], None),
    ], key=repr)
    for _, html, files in docs[:2]:
        assert one_image.rewrite(html, dict.fromkeys(files, b""))[0] in {r[1] for r in got}
    assert images.rewrite_images(df.limit(0), "doc").count() == 0 and images.image_references(df, "doc").count() == 8


def test_folds_equal_the_state_machine(spark):
    rnd = random.Random(5)
    lines = ["", "", "  ", "\t", "a\\", "a\\\\", "*_*\\", "- b", "1. c\\", "   d", "    e", "        f\\", "```", "```` x", "~~~", "``` `", "-", "***•**", "  • ", "\\_\\_\\_", "\\_\\_\\_ ", "\\-x", "\t\\- y", "*\tz", " ", "\r", "x \\", "`````"]
    texts = [None, "", "\n", "\n\n", "  \n\n", "a\r\n\r\nb\r\n"] + ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 25))) + rnd.choice(["", "\n"]) for _ in range(1500)] + ["- a\\\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {r.id: r.markdown for r in normalize.normalized(df, "id", "text").collect()}
    assert got == {i: None if t is None else markdown.normalized(t) for i, t in enumerate(texts)}
    assert got[4] == "  \n\n" and got[5] == "a\n\nb\n"


def brute_fill(cells, links):
    held = {(s, r, c) for s, r, c, d, f in cells if d or f is not None}
    out = {}
    for s, _, r0, c0, r1, c1, d in sorted(links, key=lambda x: x[:2]):
        if d:
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    if (s, r, c) not in held:
                        out.setdefault((s, r, c), d)
    return out


def test_links_fill_areas_by_tiles(spark):
    rnd = random.Random(2)
    links = [(s, k, r0 := rnd.randrange(150), c0 := rnd.randrange(100), r0 + rnd.randrange(90), c0 + rnd.randrange(90), rnd.choice(["", f"d{k}", f"d{k}"])) for s in range(3) for k in range(25)]
    cells = [(rnd.randrange(3), rnd.randrange(200), rnd.randrange(150), rnd.choice(["", "x"]), rnd.choice([None, None, "", "=1"])) for _ in range(3000)]
    df = spark.createDataFrame(cells, "s int, r int, c int, display string, formula string")
    ldf = spark.createDataFrame(links, "s int, link int, r0 int, c0 int, r1 int, c1 int, display string")
    got = {(x.s, x.r, x.c): x.display for x in grid.link_fill(df, ldf, ["s"]).collect()}
    assert got == brute_fill(cells, links)
    assert grid.link_fill(df.limit(0), ldf.limit(0), ["s"]).count() == 0


def test_a_million_cells_and_many_like_areas(spark):
    """2,000 links over one area of a million cells: brute force would scan two thousand million."""
    links = spark.range(2000).select(F.lit(0).alias("s"), (2000 - F.col("id")).alias("link"), F.lit(5).alias("r0"), F.lit(3).alias("c0"), F.lit(5 + 9999).alias("r1"), F.lit(102).alias("c1"), F.concat(F.lit("d"), 2000 - F.col("id")).alias("display"))
    cells = spark.createDataFrame([(0, 7, 5, "x", None), (0, 8, 5, "", "=1"), (0, 9, 5, "", None), (0, 1, 1, "y", None)], "s int, r int, c int, display string, formula string")
    filled = grid.link_fill(cells, links, ["s"])
    assert [tuple(r) for r in filled.groupBy("display").count().collect()] == [("d1", 999_998)]
    assert {(r.r, r.c) for r in filled.where("c = 5 and r between 7 and 9").collect()} == {(9, 5)}


def test_trim_keeps_formulas(spark):
    df = spark.createDataFrame([(["a", "", ""], [None, None, True]), (["a", "", ""], [False, None, None]), (["", ""], [True, False]), ([], [])], "row array<string>, solid array<boolean>")
    assert [r[0] for r in df.select(grid.trailing_trim(F.col("row"), F.col("solid"))).collect()] == [["a", "", ""], ["a"], [""], []]
    assert [r[0] for r in df.select(grid.trailing_trim(F.col("row"))).collect()] == [["a"], ["a"], [], []]


def test_prefix_sums_in_levels(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(6), i, rnd.choice([None, 1, 7, -2])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, sheet int, n int, v int")
    got = {(r.k, r.sheet, r.n): (r.used, r.seen) for r in budgets.prefix_sums(df, ["k"], [F.col("sheet"), F.floor(F.col("n") / 100)], ["n"], used=F.col("v"), seen=F.lit(1)).collect()}
    want, used, seen = {}, defaultdict(int), defaultdict(int)
    for k, s, n, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        used[k] += v or 0
        seen[k] += 1
        want[k, s, n] = used[k], seen[k]
    assert got == want
    flat = budgets.prefix_sums(df.drop("k"), [], [], ["sheet", "n"], seen=F.lit(1))
    assert max(r.seen for r in flat.collect()) == 2000
    plan = budgets.prefix_sums(df, [], [F.floor(F.col("n") / 100)], ["n"], seen=F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_budgets_name_the_first_place(spark):
    cells = spark.createDataFrame([("w", 1, 0, 9, "ab"), ("w", 1, 3, 1, "é"), ("w", 2, 0, 0, None), ("v", 1, 0, 0, "x"), ("u", 4, 0, 0, "z" * 9)], "book string, sheet_no int, r int, c int, display string")
    found = {r.book: r for r in budgets.cell_budgets(cells, ["book"], max_cells=11, max_text=3).collect()}
    assert (found["w"].cells, tuple(found["w"].cells_at), found["w"].bytes, tuple(found["w"].bytes_at)) == (13, (1, 3), 4, (1, 3)) and found["v"].cells_at is None
    links = spark.createDataFrame([("w", 2, 1, 0, 0, 3, 4), ("w", 2, 2, 0, 0, 0, 0), ("v", 1, 1, 0, 0, 99, 0), ("x", 1, 1, 0, 0, 0, 0)], "book string, sheet_no int, link int, r0 int, c0 int, r1 int, c1 int")
    errors = {r.book: (r.scanned, r.sheet_no, r.error) for r in budgets.workbook_errors(cells, links, ["book"], max_cells=50, max_text=8, max_scans=20).collect()}
    assert errors == {"w": (21, 2, budgets.SCANS_ERROR), "v": (100, 1, budgets.CELLS_ERROR), "u": (0, 4, budgets.TEXT_ERROR), "x": (1, None, None)}
    assert budgets.workbook_errors(cells.limit(0), links.limit(0), ["book"]).count() == 0


def test_output_budget_is_known_before_assembly(spark):
    rows = [(1, 0, "a\nb", "té", 0, ["x|y", "é"]), (1, 0, "a\nb", "té", 1, []), (1, 1, "s", "té", 0, ["\r\n"]), (2, 0, "big", "t", 0, ["z" * 500])]
    df = spark.createDataFrame(rows, "doc int, sheet int, name string, title string, r int, row array<string>")
    done = {r.doc: r for r in render.bounded_workbooks(df, ["doc"], "sheet", "name", "title", 300).collect()}
    assert len(done[1].markdown.encode()) == done[1].n_bytes and done[1].error is None
    assert done[2].markdown is None and done[2].error == render.TOO_LARGE and done[2].n_bytes > 500
    assert {r.error for r in relational.QUERIES["books_within_budget"](spark, "/root/testdata/sf0.001").collect()} == {None, render.TOO_LARGE}


def test_names_fold_fully(spark):
    names = ["σας/", "ΣΑΣ", "café", "CAFÉ/", "straße", "STRASSE", "I", "i", "ı", None, "a­b", "ab"]
    df = spark.createDataFrame([(1, n, None) for n in names] + [(2, "x", "Y"), (2, "z", "y"), (2, None, "é"), (2, None, "É")], "doc int, name string, other string")
    got = {(r.doc, r.reading, r.n) for r in resolve.entry_collisions(df, "doc", "name", "other").collect()}
    assert got == {(1, "name", 2), (2, "other", 2)}
    assert {r.key for r in resolve.name_collisions(df.where("name is not null"), "doc", "name").collect()} == {"σασ", "café", "strasse", "i"}


def test_masters_are_judged_by_their_texts(spark):
    changed = odt("<text:tracked-changes/><text:p>x</text:p>")
    files = {
        "/d/good.odm": master(SECTION % ("A", "./sub//a%20b.odt#part") + SECTION % ("B", "c.odt")), "/d/sub/a b.odt": odt("<text:p>x</text:p>"), "/d/c.odt": changed, "/d/plain.odm": master("<text:p>x</text:p>"),
        "/d/first.odm": master(SECTION % ("A", "gone.odt") + SECTION % ("B", "../up.odt")), "/d/second.odm": master(SECTION % ("A", "c.odt") + SECTION % ("B", "../up.odt")), "/d/empty.odm": master(SECTION % ("A", "")),
        "/d/renamed.zip": master(SECTION % ("A", "gone.odt")), "/d/broken.odm": master(SECTION % ("A", "bad.odt")), "/d/bad.odt": b"PK\x03\x04", "/d/other.odm": master(SECTION % ("A", "good.odm")), "/up.odt": changed,
    }
    rows = {r.path: (r.kind, r.reason, r.codes) for r in engine.detections(files_of(spark, files)).where("adapter_no = 4").collect() if r.path.startswith("/d/") and not r.path.endswith(".odt")}
    flat = "openDocumentMaster.flattened"
    bad = rows.pop("/d/broken.odm")
    assert bad[0] == "invalid" and bad[1].startswith("linked document is invalid (bad.odt): ")
    assert rows == {
        "/d/good.odm": ("match", None, [flat, "openDocument.changesNotPreserved"]), "/d/plain.odm": ("match", None, [flat]), "/d/first.odm": ("invalid", "linked ODM section is missing: gone.odt", []),
        "/d/second.odm": ("invalid", "ODM section reference leaves the document bundle: ../up.odt", []), "/d/empty.odm": ("invalid", "unsafe or non-local ODM section reference: ", []), "/d/renamed.zip": ("none", None, []),
        "/d/other.odm": ("invalid", "linked master-document section is not an ODT file: good.odm", []),
    }
    done = {r.path: (r.status, r.error) for r in engine.convert_documents(files_of(spark, files)).collect()}
    assert done["/d/good.odm"] == ("ok", None) and done["/d/first.odm"] == ("error", "Invalid ODM input at /d/first.odm: linked ODM section is missing: gone.odt")


class Notes:
    """A format from outside: texts that begin with NOTE."""

    formats = (Format("note", ("note", "nt"), 120, requires=("no-such-tool",)),)

    def detect(self, probe):
        if probe.content.startswith(b"NOTE "):
            return Detection("match", "note", 120, warnings=["note.plain"])
        return Detection("invalid", "note", 120, "no NOTE") if probe.wanted == "note" else Detection()

    def convert(self, probe, found, result, rendering):
        result.markdown = probe.content[5:].decode() + "\n"
        return result


def test_a_format_from_outside(spark):
    registry = convert.DEFAULT.with_adapter(Notes())
    files = {"/d/a.note": b"NOTE hello", "/d/b.NT": b"other", "/d/c.rtf": b"{\\rtf1 x}", "/d/all.odm": master(SECTION % ("A", "a.odt")), "/d/a.odt": odt("<text:p>Child</text:p>")}
    found = {r.path: (r.format, r.status, r.markdown, [w.code for w in r.warnings], r.error) for r in engine.convert_documents(files_of(spark, files), registry=registry).collect()}
    assert found["/d/a.note"] == ("note", "ok", "hello\n", ["note.plain"], None) and found["/d/b.NT"] == ("note", "error", None, [], "Invalid NOTE input at /d/b.NT: no NOTE")
    assert found["/d/c.rtf"][2] == "x\n" and found["/d/all.odm"][1] == "ok"
    told = engine.detections(files_of(spark, files), registry)
    assert [(r.path, r.adapter_no, r.reason) for r in told.where("format = 'note'").orderBy("path").collect()] == [("/d/a.note", 5, None), ("/d/b.NT", 5, "no NOTE")]
    assert engine.convert_documents(files_of(spark, {"/d/a.note": b"NOTE x"})).first().status == "error"
    row = next(r for r in catalog.catalog(spark, registry=registry).collect() if r.format == "note")
    assert (row.extensions, row.available, row.reason) == (["note", "nt"], False, "missing required tool: no-such-tool") and catalog.catalog_rows(registry=registry)[-1]["format"] == "note"


def test_a_format_has_one_adapter():
    with pytest.raises(ValueError, match="More than one adapter handles note"):
        convert.DEFAULT.with_adapter(Notes()).with_adapter(Notes())
    clash = type("Clash", (), {"formats": (Format("other", ("docx",), 1),)})()
    with pytest.raises(ValueError, match="extension docx"):
        convert.DEFAULT.with_adapter(clash)
    assert Registry([]).detect(Registry([]).probe("/x", b"")) == [] and convert.DEFAULT.place("odt") == 1


def test_elements_of_parts(spark):
    xml = b'<a xmlns="urn:1" xmlns:x="urn:2" k="v" x:k="w">t<b><c/>in</b>u<x:b/></a>'
    rows = {r["pre"]: r for r in nodes.elements(xml, "p")}
    assert [(r["ns"], r["name"], r["last"], r["depth"], r["text"]) for _, r in sorted(rows.items())] == [("urn:1", "a", 3, 0, "tu"), ("urn:1", "b", 2, 1, "in"), ("urn:1", "c", 2, 2, ""), ("urn:2", "b", 3, 1, "")]
    assert rows[0]["attrs"] == {"k": "v", "{urn:2}k": "w"}
    assert [r.get("error", "")[:5] for r in nodes.elements(b"<a><b></a>", "p")][-1] == "p is " and list(nodes.elements(b'<!DOCTYPE a [<!ENTITY e "x">]><a/>', "p"))[0]["error"] == "p declares XML entities"
    files = {"/a.zip": build.package({"one.xml": "<r><s><t>1</t></s><t>2</t><s><t>3</t><t>4</t></s></r>", "two.xml": "<r/>", "no.txt": "x"}), "/b.zip": b"PK\x03\x04", "/c.txt": b"x"}
    found = nodes.xml_nodes(files_of(spark, files), r".*\.xml").cache()
    assert found.where("path = '/a.zip'").count() == 8 and found.where("path = '/b.zip' and error is not null").count() == 1 and found.where("path = '/c.txt'").count() == 0
    tree = found.where("part = 'one.xml'")
    above = {r.text: r.above for r in xmlnodes.inside(tree, F.col("name") == "s").where("name = 't'").collect()}
    assert above == {"1": 1, "2": None, "3": 4, "4": 4}
    met = sorted((r.above, r.text) for r in xmlnodes.descendants(tree.where("name in ('s', 'r')"), tree.where("name = 't'")).collect())
    assert met == [(0, "1"), (0, "2"), (0, "3"), (0, "4"), (1, "1"), (4, "3"), (4, "4")]
    assert xmlnodes.shared_strings(found.limit(0)).count() == xmlnodes.inspections(found.limit(0)).count() == 0


def test_inspections_agree_with_the_reader(spark):
    """The same packages, looked at by the reader of one document at a time."""
    from docloom.plans import documents

    files = documents.marked_files(spark, "/root/testdata/sf0.001").limit(60).collect()
    rows = {r.path: r for r in xmlnodes.inspections(nodes.xml_nodes(spark.createDataFrame(files), xmlnodes.PARTS)).collect()}
    for f in files:
        d = convert.detectors(f.path, bytes(f.content))[convert.DEFAULT.place("odt")]
        r = rows[f.path]
        if d.kind == "match":
            codes = [c for on, c in ((r.comments, "wordProcessing.commentsNotPreserved"), (r.changes, "wordProcessing.changesAccepted"), (r.odt_changes, "openDocument.changesNotPreserved")) if on]
            assert (sorted(d.warnings), r.unsafe) == (sorted(codes), None), f.path
        else:
            assert r.unsafe and d.reason.endswith(r.unsafe), f.path


def test_colour_runs(spark):
    red, dark, gone, blue = (1.0, 0.0, 0.0, 1.0), (0.2, 0.2, 0.2, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)
    kind = "colour struct<r:double,g:double,b:double,a:double>"
    text = "ab cd\n ef \r\n\ufffcgh"
    cases = {
        1: [(0, 0, 2, red)], 2: [(0, 0, 2, red), (1, 2, 3, red)], 3: [(0, 0, 2, red), (1, 2, 3, blue)], 4: [(0, 0, 99, red)], 5: [(0, 0, 5, red), (1, 1, 2, dark)], 6: [(0, 2, 1, red), (1, 3, 0, red)], 7: [(0, 0, 5, gone), (1, 0, 5, dark), (2, 0, 1, None)],
        8: [(1, 0, 2, red), (0, 0, 5, blue)], 9: [],
    }
    want = {1: "==ab== cd", 2: "==ab cd==", 3: "==ab== ==cd==", 4: "==ab cd==\n ==ef== \r\n\ufffc==gh==", 5: "==a==b ==cd==", 6: "ab cd", 7: "ab cd", 8: "==ab== ==cd==", 9: "ab cd"}
    ranges = spark.createDataFrame([(k, *r) for k, rs in cases.items() for r in rs], f"k int, n int, start int, length int, {kind}")
    texts = spark.createDataFrame([(k, text) for k in cases] + [(10, None)], "k int, text string")
    got = {r.k: r.text for r in colours.marked_texts(texts, ranges, "k").collect()}
    assert got == {k: w if k == 4 else w + text[5:] for k, w in want.items()} | {10: None}
    long = spark.createDataFrame([(1, 0, 5, 20000, red), (1, 1, 4090, 10, red), (1, 2, 9000, 1, dark)], f"k int, n int, start int, length int, {kind}")
    assert [(r.start, r.stop) for r in colours.merged_runs(long, "k").where("colour.r = 1").orderBy("start").collect()] == [(5, 9000), (9001, 20005)]
    assert colours.merged_runs(long.limit(0), "k").count() == 0


def test_a_sheet_filter_reaches_the_parser(spark, tmp_path):
    sheets = [("A", [["a", 1]]), ("B", [["b"], ["c"]]), ("C", [[3]])]
    made = {"x": build.package(build.xlsx_files(sheets)), "y": build.package(build.ods_files(sheets)), "z": build.xls_bytes(sheets)}
    for content in made.values():
        book = convert.workbook_of("", content, lambda n, name: name == "B")
        assert (book.parsed, [s.name for s in book.sheets], [c[6] for c in book.cells()]) == (1, ["A", "B", "C"], ["b", "c"])
        assert convert.workbook_of("", content).parsed == 3
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    broken = build.xlsx_files(sheets)
    broken["xl/worksheets/sheet1.xml"] = "<not"
    (tmp_path / "w").write_bytes(build.package(broken))
    datasource.register(spark)
    rows = lambda: spark.read.format("workbook").load(str(tmp_path))
    assert rows().count() == 15  # the broken workbook has none
    assert sorted((r.path[-1], r.sheet_no, r.display) for r in rows().where("sheet = 'B'").collect()) == [(f, 1, d) for f in "wxyz" for d in "bc"]  # its first sheet is not even parsed
    assert rows().where("sheet_no in (1, 2) and sheet <> 'B'").count() == 4 and rows().where("sheet = 'B' and sheet_no = 0").count() == 0
    one = str(tmp_path / "x")
    assert rows().where(F.col("path") == one).select("path").distinct().count() == 1
    narrow = spark.read.format("workbook").schema("display string, r int").load(one)
    assert [tuple(r) for r in narrow.orderBy("display").collect()] == [("1", 0), ("3", 0), ("a", 0), ("b", 0), ("c", 1)]
    reader = datasource.Reader(str(tmp_path), ["display"], 1)
    left = [*reader.pushFilters([datasource.EqualTo(("path",), one), datasource.EqualTo(("r",), 0)])]
    assert [f.attribute for f in left] == [("r",)] and [p.paths for p in reader.partitions()] == [[one]]


def test_partitions_are_packed_by_bytes():
    sizes = {f"f{k}": 10 for k in range(20)} | {"big": 1000}
    parts = datasource.packed(sizes, 100)
    assert len(parts) == 12 and sorted(p for own in parts for p in own) == sorted(sizes) and ["big"] in parts
    assert datasource.packed({}, 100) == [] and datasource.packed({"a": 0}, 100) == [["a"]]


RESULT = "path string, status string, markdown string, assets array<struct<path:string,bytes:binary>>, more int"


def told(folder):
    return [json.loads(x) for f in sorted(os.listdir(f"{folder}/_published")) for x in open(f"{folder}/_published/{f}")]


def test_results_are_published_by_a_commit(spark, tmp_path):
    publishing.register(spark)
    inputs = tmp_path / "in"
    (inputs / "sub").mkdir(parents=True)
    (inputs / "sub" / "old-markdown").mkdir()
    rows = [(f"{inputs}/a.docx", "ok", "A", [("images/x.png", b"png")], 1), (f"{inputs}/a.odt", "ok", "other", [], 1), (f"file:{inputs}/sub/old.rtf", "ok", "O", [], 1), (f"{inputs}/bad.rtf", "error", None, None, 1), ("/else/where.rtf", "ok", "W", [], 1), (f"{inputs}/sub/p.rtfd", "ok", "P", [("../x", b"")], 1)]
    df = spark.createDataFrame(rows, RESULT).repartition(3)
    df.write.format("markdown").mode("append").option("adjacent", "true").save(str(inputs))
    assert (inputs / "a-markdown" / "a.md").read_text() == "A" and (inputs / "a-markdown" / "images" / "x.png").read_bytes() == b"png"
    assert sorted(os.listdir(inputs)) == ["_published", "a-markdown", "sub"] and os.listdir(inputs / "sub") == ["old-markdown"] and not os.listdir(inputs / "sub" / "old-markdown")
    kinds = {t["path"].rpartition("/")[2]: t.get("error_kind") for t in told(inputs)}
    assert kinds == {"a.docx": None, "a.odt": "output_exists", "old.rtf": "output_exists", "where.rtf": "io", "p.rtfd": "io"}
    assert publishing.published(spark, str(inputs)).where("error is null").count() == 1
    flat = tmp_path / "out"
    flat.mkdir()
    df.write.format("markdown").mode("append").save(str(flat))
    assert len([n for n in os.listdir(flat) if n.endswith("-markdown")]) == 4
    df.write.format("markdown").mode("append").save(str(flat))
    assert len([n for n in os.listdir(flat) if n.endswith("-markdown")]) == 4 and sum(t.get("error_kind") == "output_exists" for t in told(flat)) == 4
    with pytest.raises(Exception, match="never overwritten"):
        df.write.format("markdown").mode("overwrite").save(str(flat))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    publishing.register(spark)

    def fails(batches):
        for pdf in batches:
            yield pdf.iloc[:1]
            raise RuntimeError("lost")

    rows = spark.createDataFrame([(f"/in/{k}.rtf", "ok", "x", [], k) for k in range(20)], RESULT).repartition(2).mapInPandas(fails, RESULT)
    with pytest.raises(Exception, match="lost"):
        rows.write.format("markdown").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_attempts_that_do_not_count(tmp_path):
    writer = publishing.FolderWriter(str(tmp_path), False, {c: k for k, c in enumerate(publishing.COLUMNS)})
    row = ("/in/a.rtf", "ok", "text", [])
    writer.write(iter([row]))  # an attempt whose executor is lost afterwards
    second = writer.write(iter([row, ("/in/b.rtf", "ok", "b", [])]))
    assert len(os.listdir(writer.staging)) == 2
    writer.commit([second, None])
    made = sorted(n for n in os.listdir(tmp_path) if n != "_published")
    assert len(made) == 2 and not os.path.exists(writer.staging) and open(tmp_path / made[0] / "a.md").read() == "text"
    third = publishing.FolderWriter(str(tmp_path), False, writer.at)
    message = third.write(iter([("/in/c.rtf", "ok", "c", []), row]))
    message.done.append(("/in/z.rtf", "/no/such/folder", str(tmp_path / "z-markdown"), "z.md", []))
    with pytest.raises(OSError):
        third.commit([message])  # all of it, or none
    third.abort([message])
    assert sorted(n for n in os.listdir(tmp_path) if n != "_published") == made
    inside = publishing.FolderWriter(str(tmp_path), False, writer.at)
    assert inside.write(iter([(str(tmp_path), "ok", "x", [])])).failed[0][1] == "output_inside_input"
    with pytest.raises(publishing.OutputError, match="parent directory"):
        publishing.FolderWriter(str(tmp_path / "none"), False, writer.at)


def rich_book(sheets, strings="", links=True):
    """An XLSX package of raw sheet XML by name."""
    files = build.xlsx_files([(n, [["x"]]) for n in sheets])
    for k, xml in enumerate(sheets.values(), 1):
        files[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{xmlnodes.SHEET}">{xml}</worksheet>'
    files["xl/sharedStrings.xml"] = f'<sst xmlns="{xmlnodes.SHEET}">{strings}</sst>'
    return build.package(files)


STRINGS = "<si><t>one</t></si><si><r><t>t</t></r><r><t>wo|\\</t></r><rPh><t>!</t></rPh></si><si/>"
BOOKS = {
    "plain": {"S": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.50</v></c></row><row r="3"><c t="s"><v>1</v></c><c t="b"><v>1</v></c><c t="b"><v>no</v></c><c t="e"><v>#N/A</v></c></row><row/></sheetData>'},
    "kinds": {"S": '<sheetData><row><c t="inlineStr"><is><r><t>a</t></r><t>b</t></is></c><c r="D1" t="str"><f>X()</f><v>r</v></c><c><f/></c><c><f>A1</f></c><c t="s"><v> 2 </v></c><c t="b"/></row></sheetData>'},
    "links": {"S": '<sheetData><row r="2"><c r="B2"><f></f></c><c r="C2"><v>7</v></c><c r="D2"/></row></sheetData><hyperlinks><hyperlink ref="A1:D3" display="in"/><hyperlink ref="E5" display="far"/><hyperlink ref="A1:F1" display="late"/><hyperlink ref="A9"/></hyperlinks>'},
    "empty": {"A": "<sheetData/>", "B": '<sheetData><row r="2"/><row r="4"><c r="B4"/></row></sheetData>', "C\nD": '<sheetData><row><c><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells>'},
    "rows": {"S": '<sheetData><row r="2"/><row r="1"/></sheetData>'}, "order": {"S": '<sheetData><row><c r="B1"/><c r="A1"/></row></sheetData>'}, "index": {"S": '<sheetData><row><c t="s"><v>9</v></c></row></sheetData>'},
    "wide": {"S": '<sheetData><row><c r="XFE1"/></row></sheetData>'}, "tall": {"S": '<sheetData><row r="100001"/></sheetData>'}, "area": {"S": '<sheetData/><hyperlinks><hyperlink ref="A1:XFD100000" display="x"/></hyperlinks>'},
    "low": {"S": '<sheetData/><hyperlinks><hyperlink ref="A100001" display="x"/></hyperlinks>'}, "right": {"S": '<sheetData/><hyperlinks><hyperlink ref="XFE1" display="x"/></hyperlinks>'}, "no_ref": {"S": '<sheetData/><hyperlinks><hyperlink ref="A0" display="x"/></hyperlinks>'},
    "many": {"S": "<sheetData>" + "".join(f'<row r="{k}"><c r="XFD{k}"><v>1</v></c></row>' for k in range(1, 63)) + "</sheetData>"},
    "scans": {"S": '<sheetData/><hyperlinks><hyperlink ref="A1:CV6000" display="x"/><hyperlink ref="A1:CV6000" display="x"/></hyperlinks>'},
}


def test_workbooks_out_of_elements_equal_the_reader(spark):
    """Cells, Markdown and errors, relationally over all books and by the reader of one."""
    files = {f"/d/{name}.xlsx": rich_book(sheets, STRINGS) for name, sheets in BOOKS.items()}
    books = workbooks.tables(nodes.xml_nodes(files_of(spark, files), workbooks.PARTS))
    done = {r.path: (r.markdown, r.error) for r in workbooks.markdown(books).collect()}
    cells = {}
    for r in workbooks.shown_cells(books.without(workbooks.errors(books))).collect():
        if r.display or r.formula is not None:
            cells.setdefault(r.path, set()).add((r.sheet_no, r.sheet, r.r, r.c, r.value_type, r.display, r.formula))
    assert set(done) == set(files)
    for path, content in files.items():
        one = convert.convert(path, content)
        if one.status == "ok":
            assert done[path] == (one.markdown, None), path
            assert cells.get(path, set()) == {(n, s, r, c, k, d, f) for n, s, r, c, k, _, d, f in one.book.cells() if d or f is not None}, path
        else:
            assert done[path] == (None, one.error.partition(f"{path}: ")[2]), path
    assert sum(m is not None for m, _ in done.values()) == 4
    tight = {r.path: r.error for r in workbooks.markdown(books, 60).collect()}
    assert tight["/d/plain.xlsx"] == render.TOO_LARGE and tight["/d/rows.xlsx"] == workbooks.ROW_ERROR
