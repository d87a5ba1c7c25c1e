"""Every relational query against its SQL, on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__
from docloom.plans import documents, relational

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**relational.QUERIES, **documents.QUERIES}
ORACLES = {**relational.ORACLES, **documents.ORACLES}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hostile_content_reaches_every_rule(spark):
    changed = {n: relational.hostile(spark, DATA).exceptAll(relational.QUERIES[n](spark, DATA).toDF("doc_id", "text")).count() for n in ("tsv_cell_escape", "gfm_cell_escape", "inline_escape", "leading_escape")}
    assert all(v > 0 for v in changed.values()), changed


def test_line_rules_reach_every_line(spark):
    want = sorted((r.doc_id, pos, line) for r in relational.hostile(spark, DATA).where("text is not null").collect() for pos, line in enumerate(r.text.split("\n")))
    got = relational.QUERIES["line_rules"](spark, DATA).where("pos >= 0")
    assert sorted((r.doc_id, r.pos, r.line) for r in got.collect()) == want
    assert any(pos > 0 for _, pos, _ in want)


def test_gaps_are_made_without_a_filter(spark, monkeypatch):
    seen = {}
    fill, parts = relational.grid.link_fill, relational.grid.sheet_parts
    monkeypatch.setattr(relational.grid, "link_fill", lambda cells, links, by: seen.update(cells=cells) or fill(cells, links, by))
    monkeypatch.setattr(relational.grid, "sheet_parts", lambda sheets, rels, by: seen.update(rels=rels) or parts(sheets, rels, by))
    filled = {(r.sheet, r.r, r.c) for r in relational.QUERIES["link_fill"](spark, DATA).collect()}
    places = {(r[0] % 7, r[1], r[2] % 9) for r in relational.table(spark, DATA, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey").collect()}
    assert {(r.sheet, r.r, r.c) for r in seen["cells"].collect()} == places
    assert filled & places and all((5 * s + 3 * r + c) % 4 == 0 for s, r, c in filled & places)
    kinds = dict(relational.QUERIES["sheet_rel_join"](spark, DATA).collect())
    customers = {r[0] for r in relational.table(spark, DATA, "customer").select("c_custkey").collect()}
    assert {r.rel for r in seen["rels"].collect()} == customers
    ninth = [r[0] for r in relational.table(spark, DATA, "orders").where("o_custkey % 9 = 0 and o_orderkey % 9 <> 0 and o_custkey % 4 = 0").select("o_orderkey").collect()]
    assert ninth and {kinds[k] for k in ninth} == {"skipped"}
