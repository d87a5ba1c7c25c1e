"""Steps whose time or memory once grew faster than the input, or that ran in one task however large it was."""

import os
import random
import time

import pytest

from docloom.functions import markdown
from docloom.operators import normalize, xmlnodes
from docloom.plans import documents, relational
from docloom.sources import build, engine, nodes

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def dealt(spark, files) -> bool:
    return files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@tables
def test_inspections_go_through_the_elements_once(spark):
    assert dealt(spark, documents.marked_files(spark, DATA))
    text = plan(documents.QUERIES["package_inspections"](spark, DATA))
    assert text.count("MapInArrow") == 2 and "Join" not in text  # one makes the files, one reads them


def test_inspections_count_marks_in_the_namespace_of_the_root(spark):
    rows = []
    for path, root, mark in (("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 0), ("e", None, 0)):
        name = "document" if root is not None else "other"
        rows += [(path, "word/document.xml", 0, 1, 0, xmlnodes.WORD[root or 0], name, {}, "", None), (path, "word/document.xml", 1, 1, 1, xmlnodes.WORD[mark], "ins", {}, "", None)]
    rows.append(("f", None, None, None, None, None, None, None, None, "broken"))
    got = {r.path: (r.comments, r.changes, r.odt_changes, r.unsafe) for r in xmlnodes.inspections(spark.createDataFrame(rows, nodes.NODES)).collect()}
    assert got == {p: (False, p in "ac", False, None) for p in "abcdef"}


def test_small_files_leave_together_and_a_bad_one_spoils_no_other(spark):
    files = spark.createDataFrame([(f"p{k}", bytes([k])) for k in range(50)], "path string, content binary").coalesce(1)

    def rows(path, content):
        if content == b"\x05":
            raise ValueError("no")
        return [{"path": path, "n": "text" if content == b"\x07" else content[0]}]

    out = engine._pass(files, "path string, n long", rows, lambda path, why: {"path": f"{path} {why.split(':')[0]}", "n": -1})
    got = {r.path: r.n for r in out.collect()}
    assert got.pop("p5 ValueError") == -1 and got.pop(next(p for p in got if p.startswith("p7 "))) == -1
    assert got == {f"p{k}": k for k in range(50) if k not in (5, 7)}
    sizes = lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches)
    plain = engine._pass(files, "path string, n long", lambda path, content: [{"path": path, "n": 0}], None)
    assert [r.n for r in plain.mapInArrow(sizes, "n long").collect()] == [50]


@tables
def test_files_of_small_tables_are_made_in_several_tasks_a_core(spark):
    makers = [documents.linked_files, documents.master_files, documents.string_files, documents.linked_books]
    assert all(dealt(spark, f(spark, DATA)) for f in makers)
    assert all(dealt(spark, documents.part_files(spark, DATA, kind)) for kind in ("xlsx", "ods", "xls"))
    assert all(dealt(spark, documents.text_files(spark, DATA, kind)) for kind in ("docx", "odt", "rtf"))


@tables
def test_texts_are_mapped_a_few_at_a_time(spark):
    for name in ("link_rewrite", "html_markdown"):
        text = plan(documents.QUERIES[name](spark, DATA))
        assert "MapInArrow" in text and "ArrowEvalPython" not in text
    frame = spark.createDataFrame([(k, None if k == 3 else f"t{k}") for k in range(9)], "k long, t string").coalesce(1)
    got = documents._mapped(frame, "k", "t", lambda t: t + "!", "out", step=2)
    assert {r.k: r.out for r in got.collect()} == {k: None if k == 3 else f"t{k}!" for k in range(9)}


@tables
def test_books_are_dealt_out_once(spark):
    for name in ("order_books_tsv", "order_books_table"):
        text = relational.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in text, name


def test_normaliser_takes_time_by_length_and_copies_no_lines(spark):
    """Runs of blanks and backslashes inside a line took time by their square; arrays of lines were columns of four steps."""
    k = 60_000
    texts = ["a" + " " * k + "b\\\nc", "a" + "\\" * k + "b\nc", "a" + "\\" * k + "\nc", "•" + " " * k + "b\nc", " " * k + "b\\\nc", "- a\\\n" * k]
    df = normalize.normalized(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    assert plan(df).count("Project") == 1
    normalize.normalized(spark.createDataFrame([(0, "a\\\nb")], "id int, text string"), "id", "text").collect()
    start = time.time()
    got = dict(df.collect())
    assert time.time() - start < 20
    assert got == {i: markdown.normalized(t) for i, t in enumerate(texts)}


def test_normaliser_without_a_second_fold(spark):
    """Items that close several at once, marks that open nothing or stand too deep, other line ends and runs of empty lines."""
    rnd = random.Random(8)
    lines = ["", "", "", "  - x", "    - y\\", "      * z", " -　", " -", "~~~~ x", "   ~~~ \t", "    ```", "\t```", "``` a`b", "```a", " \t", "\t \t1) q", "12345678901. r", "\x85", " - s", "a\x0b\\", "b\\\\\\", " •*\\", "* •_ ", "\\-\\", "\\_\\_\\_\\", " u", "v", "        w", "é\\", "😀 \t\\", "-", "\ta", "1.\t\t"]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 40))) + rnd.choice(["", "\n", "\r\n", "\n\n"]) for _ in range(1500)]
    texts += ["\n".join(rnd.choice(lines) for _ in range(9000)), " \n" + "\n" * 5000, "x" + "\n" * 5000 + "  \ny", "    a" + "\n" * 5000 + "    b"]
    got = dict(normalize.normalized(spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4), "id", "text").collect())
    assert got == {i: markdown.normalized(t) for i, t in enumerate(texts)}
