"""The classifier learns from all labelled rows, and its threshold is that of all of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import quality_classifier as q


def test_every_labelled_row_is_in_a_block_with_both_classes(spark, docs):
    rows = [(i, f"text {i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(3000)], "doc_id long, quality int")
    got, blocks = q.dealt(q.labelled_rows(docs(rows), labels, "text", "doc_id", "quality"), 2700, 300, 200)
    seen = got.collect()
    assert blocks == 14 and {r.id for r in seen} == set(range(3000))
    good = [r for r in seen if r.y]
    assert len(good) == 2700 and all({r.y for r in seen if r.block == k} == {0, 1} for k in range(blocks))
    assert max(np.unique([(r.block, r.y) for r in seen], axis=0, return_counts=True)[1]) < 400


def test_weights_are_of_all_rows(spark, docs, monkeypatch):
    """A trait that only rows beyond the first block's size show is learned."""
    monkeypatch.setattr(q, "PAIRS", 3000)
    rows = [(i, "plain river house " * 5 + ("zzzz" if i % 4 == 0 else "walk")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    seen = []
    fit = q.fitted
    monkeypatch.setattr(q, "fitted", lambda rows, blocks: seen.append((rows.select("id").distinct().count(), blocks)) or fit(rows, blocks))
    got = {r.doc_id: r.predicted for r in q.quality_scores(docs(rows), labels, block=50).collect()}
    assert seen == [(400, 6)] and got == {i: int(i % 4 > 0) for i, _ in rows}


@pytest.mark.parametrize("few", [3, 10_000])
def test_threshold_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(q, "FEW", few)
    rnd = random.Random(3)
    for values in ([rnd.random() ** 9 for _ in range(300)], [rnd.randrange(6) / 2 for _ in range(300)], [1.0] * 20):
        rows = [(s, int(rnd.random() < 0.8)) for s in values]
        y = [y for _, y in rows]
        for good, bad in ((sum(y), len(y) - sum(y)), (70, 30)):
            ranked = sorted(rows)  # of equals the better class is last
            total, at = 0, None
            for k, (_, label) in enumerate(ranked):
                total += good * (len(y) - sum(y)) if label else bad * sum(y)
                if at is None and total >= bad * sum(y) * (len(y) - sum(y)):
                    at = k
            want = (ranked[at][0] + ranked[min(at + 1, len(ranked) - 1)][0]) / 2
            frame = spark.createDataFrame(rows, "s double, y int")
            assert q.threshold(frame, good, bad) == want
    assert abs(q.spread(frame.select((F.col("s") + F.col("y")).alias("s"))) - np.std([s + y for s, y in rows])) < 1e-8
    assert q.threshold(frame.where("y = 1"), 5, 0) == 0.0 and q.spread(frame.limit(0)) == 0.0
