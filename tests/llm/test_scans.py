"""Whitening, license scans and periodic runs, against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from docloom.llm import license_rules, license_scan, periodic_runs, queries, whitening

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------------------------------------------------------------
# 11


def whole(rows):
    """(ids, x) of the usable rows, in Python integers."""
    good = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**55 for c in v)]
    sizes = Counter(len(v) for _, v in good)
    size = max(sizes, key=lambda d: (sizes[d], d))
    good = [(k, [math.floor(64 * c) + 1000000 for c in v]) for k, v in good if len(v) == size]
    return [k for k, _ in good], [x for _, x in good]


def exact(xs):
    """(n, S, V) with V as fractions, over distinct rows."""
    fit = [list(x) for x in {tuple(x) for x in xs}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    y = [[n * x[i] - s[i] for i in range(d)] for x in fit]
    return n, s, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 7, 7, 7) for k, v in rows], f"vec_id long, embedding array<{kind}>, _x int, component int, n int")


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1e11)])
def test_whitening(spark, kind, scale):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(400, 20)) @ rnd.normal(size=(20, 20)) * scale
    base[:, 3] += 5e4 * scale  # a large offset
    if kind == "float":
        base = base.astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(k + 1000, rows[0][1]) for k in range(300)] + [(None, rows[1][1]), (1500, rows[2][1])]  # repeats weigh nothing
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("-inf")] * 20), (2004, []), (2005, [1.0]), (2006, [1e30] * 20)]
    out = whitening.whitened(vectors(spark, rows, kind), most=16).collect()
    ids, xs = whole(rows)
    n, s, v = exact(xs)
    assert len(out) == 16 * len(ids) and {r.n for r in out} == {n} == {400}
    trace = sum(v[i][i] for i in range(20))
    e, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    want = np.array([[float(Fraction(n * c - s[i], n)) for i, c in enumerate(x)] for x in xs]) @ q / np.sqrt(e)
    deviation = [sum((n * c - s[i]) ** 2 for i, c in enumerate(x)) for x in xs]
    assert Counter((r.vec_id, int(r.deviation)) for r in out if r.component == 1) == Counter(zip(ids, deviation))
    mine = {(r.vec_id, r.component): r.whitened for r in out}
    got = np.array([[mine[k, c] for c in range(1, 17)] for k in ids[:400]])
    sign = np.sign((got * want[:400]).sum(0))
    assert np.abs(got * sign - want[:400]).max() < 1e-6
    for r in out[:16]:
        assert math.isclose(r.explained, e[r.component - 1] / float(trace), rel_tol=1e-9) and r.identity_error < 1e-6


def test_digits_are_exact():
    rnd = random.Random(1)
    z = np.array([[rnd.randrange(-(2**62), 2**62) for _ in range(5)] for _ in range(50)] + [[-1, 1, 4096, -4096, 0]])
    parts = whitening.digits(z)
    assert max(np.abs(p).max() for p in parts) <= 2**12
    assert all(sum(int(p[i, j]) << whitening.DIGIT * k for k, p in enumerate(parts)) == int(z[i, j]) for i in range(51) for j in range(5))
    want = z.astype(object).T @ z.astype(object)
    assert (whitening.gram(z) == want).all() and (whitening.gram(z[:0]) == 0).all()


def test_whitening_without_spread(spark):
    flat = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in flat} == {(k, c, 1, 0, None, 0.0, 0.0) for k in (1, 2) for c in (1, 2)}
    line = whitening.whitened(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (None, [5.0, 2.0, 0.0])])).collect()
    assert sorted((r.component, round(abs(r.whitened), 6)) for r in line if r.component == 1) == [(1, 0.0), (1, 1.224745), (1, 1.224745)]
    assert {r.whitened for r in line if r.component > 1} == {None} and {r.explained for r in line} == {1.0, 0.0}
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_op11(spark, tmp_path):
    vectors(spark, [(i, [float(i % 7), float(i % 5), float(i * i % 11)]) for i in range(60)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES["op11_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.toPandas()
    w = rows.drop_duplicates(["component", "whitened"])
    assert len(rows) == 180 and rows.identity_error.max() < 1e-9 and len(w)


# ---------------------------------------------------------------------------------------------------------------------
# 12


def scanned(text):
    """(words, spans, base) by trying every rule at every word."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    found = []
    for i, word in enumerate(words):
        before, after = "".join(w + " " for w in words[max(0, i - 24) : i]), "".join(" " + w for w in words[i + 1 : i + 25])
        for r in license_rules.rules():
            if r.keyword == word:
                a, b = re.search(rf"(?:^| )({r.before})\Z", before), re.match(rf"({r.after})(?: |\Z)", after)
                if a and b:
                    found.append((i - a[1].count(" "), i + 1 + b[1].count(" "), r))
    stays = []
    for a, b, r in found:
        over = [1 for c, d, o in found if not o.base and c <= a and d >= b and o.level <= r.level and ((c, d) != (a, b) or (o.level, o.number) < (r.level, r.number))]
        if r.base or not over:
            stays.append((a, b, r.level, r.number, r.label))
    return words, [(a, b, n, label) for a, b, _, n, label in sorted(stays, key=lambda s: (s[0], -s[1], *s[2:]))], found


LICENSED = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "GNU General Public License v3 or later",
    "gnu lesser general public license version 2.1", "SPDX-License-Identifier: MPL-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0", "cc by sa 4.0, CC-BY 4.0; http://creativecommons.org/licenses/by-nc-nd/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "the mit, license mit license mit licence", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "All rights reserved. Copyright (c) 2020 X",
    "MIT License and mit–license and mıt license", "under the terms of the GNU Affero General Public License", "", None, "   \n", "license", "unlicense", "3-Clause BSD License; BSD", "Kcc by K",
    "Neither the name of X nor the names of its contributors may be used to endorse", "Creative Commons Attribution-NonCommercial-ShareAlike", "mozilla public license 2.0 apache license 2.0 eclipse public license v1.0", "released into the public domain",
]


def test_license_spans(spark, docs):
    rnd = random.Random(3)
    parts = [t for t in LICENSED if t]
    texts = LICENSED + [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))) for _ in range(60)] + ["mit license " * 5000, "word " * 50000 + "Apache License 2.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[1])]
    got = sorted(((r.doc_id, r.n_words, [(s.start, s.end, s.number, s.label) for s in r.spans]) for r in license_scan.license_spans(docs(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        if t and len(t) > 30000:
            continue
        words, spans, _ = scanned(t)
        want.append((i, len(words), spans))
    long = [g for g in got if g[1] > 5000]
    assert [(len(g[2]), {s[3] for s in g[2]}) for g in long if g[1] == 10000] == [(10000, {"mit"})] and any(s[3] == "apache-2.0" for g in long if g[1] > 50000 for s in g[2])
    assert [g for g in got if g[1] <= 5000] == sorted(want, key=repr)
    assert license_scan.license_spans(docs([])).count() == 0


def test_every_rule_can_be_met(spark):
    """Each license's name alone is found as such, by a rule of its own; no two rules have one number."""
    made = license_rules.rules()
    assert len(made) > 300 and len({r.number for r in made}) == len(made)
    tags = [line.split(" | ")[2].strip() for line in license_rules.LICENSES.strip().splitlines()]
    texts = [(i, f"SPDX-License-Identifier: {re.sub(r'\[(.).*?\]', r'\1', t)}") for i, t in enumerate(tags)]
    labels = [line.split(" | ")[0].strip() for line in license_rules.LICENSES.strip().splitlines()]
    rows = {r.doc_id: r for r in license_scan.digest(license_scan.license_spans(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert all(labels[i] in rows[i].labels.split(",") and rows[i].score == 1.0 for i in range(len(texts)))


def test_op12_digest_and_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(LICENSED)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op12_licenses"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = out.columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in out.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op12_licenses']})").fetchall()))
    found = {r.doc_id: r for r in out.collect()}
    assert (found[8].n_base, found[8].first_word, found[8].last_word) == (2, 1, 3)  # "the mit license mit license mit licence"
    assert found[13].labels == "" and found[13].first_word is None and found[11].n_base == 0 and found[19].n_base == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------------------------------------------------------------
# 13


def brute_runs(words):
    best, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def made_words(rnd, kind, n):
    if kind == 0:
        return [str(rnd.randrange(2)) for _ in range(n)]
    if kind == 1:
        block = [str(rnd.randrange(4)) for _ in range(rnd.randrange(1, 14))]
        return [f"l{k}" for k in range(rnd.randrange(9))] + [block[i % len(block)] for i in range(n)] + [f"r{k}" for k in range(rnd.randrange(9))]
    if kind == 2:
        return [w for _ in range(n // 6 + 1) for w in [str(rnd.randrange(3))] * rnd.randrange(1, 12)]
    inner = [str(rnd.randrange(2)) for _ in range(rnd.randrange(1, 5))] * rnd.randrange(1, 6) + ["x"]
    return inner * rnd.randrange(1, 8)


def test_runs_equal_brute_force():
    rnd = random.Random(9)
    seen = 0
    for t in range(3000):
        words = [w.encode() for w in made_words(rnd, t % 4, rnd.randrange(90))]
        want = brute_runs(words)
        assert periodic_runs.runs_of(periodic_runs.numbered(words)) == want, words
        seen += len(want)
    assert seen > 3000


def test_runs_of_long_texts():
    runs = lambda w: periodic_runs.runs_of(periodic_runs.numbered([x.encode() for x in w]))
    assert runs(["a"] * 30000) == [(0, 30000, 1)]
    block = [f"w{i}" for i in range(3000)]
    assert runs(["x", *block * 5, "w0", "y"]) == [(1, 15001, 3000)]
    assert runs(block * 3) == [] and runs((["a"] * 100 + ["b"]) * 5)[0] == (0, 100, 1) and (0, 505, 101) in runs((["a"] * 100 + ["b"]) * 5)


def test_periodic_runs(spark, docs):
    rnd = random.Random(4)
    texts = [None, "", " \n", "a b c", "a a a a a a", "a a a a a", "x y x y x y x y z", "é é é é é é é é é é é é", "p " * 20000] + [" \t".join(made_words(rnd, k % 4, 60)) for k in range(40)]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, texts[6])]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        words = SPACED.findall(t or "")
        runs = [(0, 20000, 1)] if len(words) == 20000 else brute_runs(words)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs([])).count() == 0


def test_op13(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(120)))) for i in range(150)] + [(150, None), (151, ""), (152, "a b a b a b a b c c c c c c c c d e d e d e d e"), (None, "a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in rows:
        words = SPACED.findall(t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        gone = {k for a, m, q in runs for k in range(a + q, a + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
        assert tuple(got[i])[1:] == want, i
    assert planted > 5 and got[152].n_runs == 3
