"""Operators over many documents, against brute force: near dedup, substring dedup, sharding, mixing, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import common, mixing, near_dedup, queries, secrets, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, rnd, size=4000):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def linked(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def near_rows():
    rnd = random.Random(11)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for size in (5, 40, 200):
        for _ in range(4):
            base = words(size, rnd)
            for edits in (0, 1, 1, 2, 5, 12):
                copy = [*base]
                for _ in range(edits):
                    copy[rnd.randrange(size)] = f"e{rnd.randrange(9999)}"
                add(" ".join(copy))
    base = words(120, rnd)
    for _ in range(80):  # one large group of near copies, some under the threshold
        copy = [*base]
        for _ in range(rnd.randrange(8)):
            copy[rnd.randrange(120)] = f"g{rnd.randrange(9999)}"
        add(" ".join(copy).upper() if n % 3 == 0 else "  ".join(copy))
    for text in ("", None, " \n", "one", "ONE", "one two", "one  two", "two one", "x " * 50, "x " * 80):
        add(text)
    return rows


@pytest.mark.parametrize("size, num", [(3, 85), (5, 80)])
def test_near_components(docs, near_rows, size, num):
    sets, root = linked(near_rows, size, num, 100)
    df = docs(near_rows + [(0, near_rows[0][1]), (None, near_rows[1][1]), (None, "nothing like the others here")])
    got = near_dedup.near_components(df, size, num, 100).collect()
    assert len(got) == len(near_rows) + 3
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], r.doc_id == root[r.doc_id])
        else:
            assert r.kept and r.component_id in (root[1], None)


def test_near_dedup_in_small_blocks(docs, near_rows, monkeypatch):
    """The same answer when nodes branch, and when blocks of a node meet in pairs."""
    _, root = linked(near_rows, 3, 85, 100)
    for name, value in (("SMALL", 8), ("FEW", 2), ("BLOCK", 6), ("DEEPEST", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    df = docs(near_rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_components(df, 3, 85, 100).collect()} == root
    kept = near_dedup.near_dedup(df, 3, 85, 100)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*root.values()})
    assert near_dedup.near_components(docs([])).count() == 0


def test_links_are_named_for_what_they_count(docs):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(4)]
    rows = near_dedup.near_components(docs(list(enumerate(texts)))).collect()
    assert {r.component_id for r in rows} == {0}
    assert all(1 <= r.n_joining_links <= 3 for r in rows) and sum(r.n_joining_links for r in rows) < 4 * 3


def test_components_never_end_unfinished(spark, monkeypatch):
    calls, stars = [], common._stars
    monkeypatch.setattr(common, "_stars", lambda edges: calls.append(1) or (len(calls) > 41 and stars(edges)))
    got = {r.id: r.component for r in common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} and len(calls) == 42


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(500):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


@pytest.mark.parametrize("length", [50, 8, 120])
def test_substring_dedup(docs, length):
    rnd = random.Random(length)
    passage, rows = words(length + 20, rnd), []
    for i in range(25):
        own = words(rnd.randrange(200), rnd)
        at = rnd.randrange(len(own) + 1)
        part = passage[rnd.randrange(15) : len(passage) - rnd.randrange(15)] if i % 2 else passage[: length - 1]
        rows.append((i, rnd.choice([" ", "\n"]).join(own[:at] + part + own[at:])))
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, "same " * (length + 5)), (43, "same " * (length + 9)), (44, None), (45, ""), (46, " \t"), (41, rows[3][1]), (None, rows[3][1])]
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - length + 1):
            if i is not None:
                first[tuple(w[k : k + length])] = min(i, first.get(tuple(w[k : k + length]), i))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup.substring_dedup(docs(rows), length)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert substring_dedup.substring_dedup(docs([]), length).count() == 0


def test_least_places():
    rng = np.random.default_rng(0)
    for n, span in ((100, 7), (26, 26), (500, 26), (64, 8), (5, 9)):
        values = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert substring_dedup.least_places(values, span).tolist() == [i + int(np.argmin(values[i : i + span])) for i in range(n - span + 1)]


def test_sharding(docs):
    rnd = random.Random(6)
    rows = [(i, " ".join(words(rnd.randrange(60), rnd)), rnd.choice(["en", "de", None]), f"src{rnd.choice([0, 0, 0, 1, 2, 3])}") for i in range(1500)]
    rows += [(2000 + i, "the same text in many rows") for i in range(200)] + [(3000, None), (3001, ""), (None, "x"), (5, rows[5][1]), (3002, "y" * 20_000)]
    got = sharding.kd_shards(docs(rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].add(r.shard)
    assert sorted(load) == [*range(8)] and all(sorted(s) == [*range(len(s))] for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    rest = [load[s] for s in load if load[s] < 1.5 * sum(load.values()) / 8]
    assert max(rest) - min(rest) < 0.1 * sum(load.values()) / 8
    assert sharding.kd_shards(docs([])).count() == 0
    hot = sharding.kd_shards(docs([(i, "hot " * 20 if i % 3 else f"cold {i} " * 9) for i in range(900)])).collect()
    loads = Counter()
    for r in hot:
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) < 1.25 * min(loads.values())


def test_mixing(docs):
    rnd = random.Random(8)
    rows = [(i, " ".join(words(rnd.randrange(1, 80), rnd)), "en", "big" if i % 3 else rnd.choice(["a", "b", "c", "é", "zz", None])) for i in range(600)]
    rows += [(1000, None, "en", "void"), (1001, "", "en", "void"), (1002, "alone", "en", "tiny")]
    got = {r.doc_id: r for r in mixing.mixed(docs(rows)).collect()}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source_size, taken, target = Counter(), Counter(), {}
    for i, _, _, s in rows:
        source_size[s] += size[i]
        taken[s] += got[i].taken
        target[s] = got[i].target
        assert got[i].size == size[i] and got[i].taken == size[i] * got[i].copies and got[i].copies <= 3
    order = sorted((s for s in source_size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, capped, total = {}, set(), sum(source_size.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * source_size[s] for s in capped)
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        if not (over := {s for s in free if want[s] > 3 * source_size[s]}):
            break
        capped |= over
    want |= {s: 3.0 * source_size[s] for s in capped}
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 5, s
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in mixing.mixed(docs(rows).repartition(7)).collect()}
    df = docs(rows)
    copies = mixing.mix_documents(df)
    assert copies.columns == df.columns and Counter(r.doc_id for r in copies.collect()) == {i: r.copies for i, r in got.items() if r.copies}
    assert mixing.mixed(docs([])).count() == 0


def test_mixing_includes_by_its_probabilities(docs):
    """30 sources of like documents: how often each length is taken, against the copies that were expected of it."""
    lengths = [1, 2, 3, 5, 9, 20, 40, 70, 130, 300]
    rows = [(10000 * s + 100 * k + j, "w " * n, "en", f"s{s:03}") for s in range(30) for k, n in enumerate(lengths) for j in range(50)]
    got = mixing.mixed(docs(rows, extra=False)).toPandas()
    for _, part in got.groupby("source"):
        want = np.minimum(3, part.expected)
        assert abs((want * part["size"]).sum() - part.target.iloc[0]) < 1e-6 * part.target.iloc[0] and (part.copies - part.expected).abs().max() < 1
        digits = part["size"].map(lambda n: n.bit_length())
        free = part[part.expected < 3]
        assert np.allclose(free.expected / digits[free.index], (free.expected / digits[free.index]).iloc[0])
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 150
    got["weight"] = got.source.str[1:].astype(int) % 3
    rates = got.groupby(["weight", "size"]).agg(expected=("expected", "mean"), copies=("copies", "mean"))
    assert (rates.expected - rates.copies).abs().max() < 0.08 and (rates.expected - rates.copies).abs().mean() < 0.025
    assert rates.expected.groupby("weight").nunique().min() > 3  # the odds do differ within a source


def test_queries_with_sql(spark, docs, tmp_path):
    rnd = random.Random(12)
    passage = words(70, rnd)
    rows = [(i, " ".join(words(rnd.randrange(90), rnd) + (passage if i % 4 == 0 else [])), "en", rnd.choice(["s1", "s2", "s3", None])) for i in range(120)] + [(500 + i, t) for i, t in enumerate(["", None, "Dup", "dUP"])]
    body = "x7" * 15
    token = f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()), 6)}"
    hidden = [token, f"{token}0", token[:-1] + "~", f"é {token}\n-----BEGIN RSA PRIVATE KEY-----", "PassWord = 'abcdef12' tokentoken: secret=short", "AKIA" + "B" * 16, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "0123456789abcdef" * 2 + "x", "api_key=\"é"]
    rows += [(600 + i, t) for i, t in enumerate(hidden)]
    rows += [(700 + i, " ".join([*passage[:60], *passage[:12], f"tail{i % 3}", "#|$"]) + "\nsame line\nsame line") for i in range(6)]
    docs(rows, extra=False).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, str(tmp_path)), duck.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[k] for k in at) for r in want.fetchall()), name


def test_pipeline(spark, docs, tmp_path):
    rnd = random.Random(21)
    vocabulary = [f"v{k}" for k in range(400)]
    clean = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 160))) for _ in range(60)]
    near = [t.replace(t.split()[30], "changed", 1) for t in clean[:10]]
    rows = [*clean, *[t[0].upper() + t[1:] for t in clean[10:20]], *near, *["x$$$ " * 100, "short", "", None]]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(rows)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        table = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert table.where("_key <> 7 or _row <> 7 or size <> 7 or _sha <> 7").isEmpty(), name
        kept.append(sorted(r.doc_id for r in table.collect()))
    assert kept[0] == [*range(80)]
    assert kept[1] == [*range(10), *range(20, 80)]  # of equal texts the larger id
    _, root = linked([(i, t) for i, t, *_ in rows if i in set(kept[1])], 5, 80, 100)
    assert kept[2] == sorted({*root.values()}) == [*range(10), *range(20, 70)]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(kept[3])
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
