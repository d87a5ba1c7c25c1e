"""Quality classifier: Bradley-Terry pairwise ranking.

Of preference pairs (a better and a worse document) the weights are learned by logistic loss on the difference of
their features. A document's strength is the weighted sum of its features; the threshold is the quantile of the
training strengths at the share of worse documents, and the score is the logistic function of the distance to it.

All labelled rows are learned from. They are dealt into blocks of bounded size, each task learns the weights of its
blocks, and the model is the mean of these, each counted by its rows; with few labels there is one block. The threshold
and the spread of the strengths are those of all labelled rows, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, store, struct_of, text_buffer
from docloom.llm.features import gram_buckets, inside, shape

BITS = 10
DENSE = 8
#: Labelled rows of each class in a block, about.
BLOCK = 3000
#: Distinct strengths that the driver sorts to find the threshold, at most.
FEW = 10_000
PAIRS, ROUNDS, BATCH, RATE, DECAY = 120_000, 6, 512, 0.02, 1e-5


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Roots of the shares of hashed byte 4-grams, and dense features, of each row."""
    n = len(offsets) - 1
    buckets = gram_buckets(raw, bits)
    row = np.repeat(np.arange(n), np.diff(offsets))[: len(buckets)]
    ok = inside(offsets, len(buckets))
    counts = np.bincount((row[ok] << bits) + buckets[ok], minlength=n << bits).reshape(n, 1 << bits)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.concatenate([np.sqrt(share), shape(raw, offsets)], axis=1).astype(np.float32)


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    raw, offsets = text_buffer(batch.column(1))
    for a, b in slices(offsets, 1 << 18):
        yield features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` rows of each class, for a look at them: of rows repeated with one key, one.
    The model is not fitted on these but on all labelled rows."""
    first = labels.where(f"`{key}` is not null and `{label}` is not null").groupBy(key).agg(F.max(label).alias("_y"))
    order = [F.xxhash64(key), F.col(key)]
    ids = first.where("_y = 1").orderBy(*order).limit(sample).unionAll(first.where("_y <> 1").orderBy(*order).limit(sample))
    ids = ids.select(F.col(key).alias("_id"), "_y")
    rows = docs.select(F.col(key), F.col(text)).join(F.broadcast(ids), F.col(key) == F.col("_id")).select("_y", text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([*_blocks(batch)]) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(run, struct_of(f"id {kind}, y int, x binary")).groupBy("id", "y").agg(F.min("x").alias("x"))
    got = found.toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, (1 << BITS) + DENSE), np.float32)
    return x, np.array(got["y"].to_pylist(), dtype=int)


def bradley_terry(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: tuple[int, int, int] | None = None) -> np.ndarray:
    """Weights by stochastic descent (Adam) over random pairs of a better and a worse row; steps: PAIRS, ROUNDS, BATCH."""
    pairs, rounds, size = steps or (PAIRS, ROUNDS, BATCH)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    w, m, v, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    if not len(good) or not len(bad):
        return w
    for r in range(rounds):
        a, b = rng.choice(good, pairs // rounds), rng.choice(bad, pairs // rounds)
        for k in range(0, len(a), size):
            d = x[a[k : k + size]] - x[b[k : k + size]]
            g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / len(d) + DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (1 - r / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """(id, y 0 or 1, text) of all labelled rows: of rows repeated with one key the largest label and the least text."""
    first = labels.where(f"`{key}` is not null and `{label}` is not null").groupBy(F.col(key).alias("id")).agg((F.max(label) == 1).cast("int").alias("y"))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(first, "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def dealt(rows: DataFrame, good: int, bad: int, block: int) -> tuple[DataFrame, int]:
    """(rows with `block`, number of blocks). Rows of the larger class are in one block each, about `block` of them; the
    other class is dealt into parts of that size, and each block has one of these. So every row is in a block with both."""
    blocks, parts = max(1, -(-max(good, bad) // block)), max(1, -(-min(good, bad) // block))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    homes = F.when(F.col("y") == int(good >= bad), F.array(place(blocks))).otherwise(F.sequence(place(parts), F.lit(blocks - 1), F.lit(parts)))
    return rows.withColumn("block", F.explode(homes)), blocks


def fitted(rows: DataFrame, blocks: int) -> np.ndarray:
    """The mean of the blocks' weights, each counted by its rows. Sums are decimals, so their order changes nothing."""
    steps = PAIRS, ROUNDS, BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, xs, ys = None, [], []

        def learned() -> Iterator[pa.RecordBatch]:
            y = np.array(ys, dtype=int)
            if len(set(y.tolist())) == 2:
                w = bradley_terry(np.concatenate(xs), y, steps=steps)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w), pa.array(np.full(len(w), len(y)))], names=["i", "w", "n"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if ids[a] != at:
                    yield from learned()
                    at, xs, ys = ids[a], [], []
                part = batch.slice(a, b - a)
                xs += _blocks(part.select([0, 2]))
                ys += part.column(1).to_pylist()
        yield from learned()

    # a block's rows come in order of their ids, so that its weights don't depend on how rows arrive
    ordered = rows.repartition(blocks, "block").sortWithinPartitions("block", "id").select("block", "y", "text")
    sums = ordered.mapInArrow(run, struct_of("i int, w double, n long")).groupBy("i").agg(F.sum((F.col("w") * F.col("n")).cast("decimal(38,12)")).alias("w"), F.sum("n").alias("n"))
    weights = np.zeros((1 << BITS) + DENSE)
    for r in sums.collect():
        weights[r.i] = float(r.w) / r.n
    return weights


def threshold(strengths: DataFrame, good: int, bad: int) -> float:
    """The quantile of strengths(s, y) at the share that `bad` has of good + bad, each class weighted to its share of
    these; half way to the next strength. Of equal strengths the better class comes last.

    Histograms of 1,024 bins narrow down where it lies until FEW distinct strengths are left; all counts are whole numbers.
    """
    per, drop = store(strengths.groupBy("s").agg(F.sum("y").alias("g"), F.sum(1 - F.col("y")).alias("b")))
    try:
        total = per.agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).first()
        if not total.g or not total.b:
            return 0.0
        weigh = lambda g, b: g * good * total.b + b * bad * total.g
        want, below, low, high, n = bad * total.g * total.b, 0, total.low, total.high, total.n
        inside_ = lambda: F.col("s").between(low, high)
        while n > FEW:
            bin_ = F.least(F.lit(1023), F.floor((F.col("s") - low) / ((high - low) / 1024)))
            found = per.where(inside_()).groupBy(bin_.alias("bin")).agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).orderBy("bin").collect()
            for r in found:
                if below + weigh(r.g, r.b) >= want:
                    low, high, n = r.low, r.high, r.n
                    break
                below += weigh(r.g, r.b)
        for r in per.where(inside_()).orderBy("s").collect():
            if below + weigh(r.g, r.b) >= want:
                break
            below += weigh(r.g, r.b)
        last = weigh(1, 0) if r.g else weigh(0, 1)  # whether more rows of this strength follow the quantile
        after = r.s if below + weigh(r.g, r.b) - last >= want else per.where(F.col("s") > r.s).agg(F.min("s")).first()[0]
        return (r.s + (r.s if after is None else after)) / 2
    finally:
        drop()


def spread(strengths: DataFrame) -> float:
    """The standard deviation of all strengths; of whole billionths, so that the order of the rows changes nothing."""
    whole = lambda c: c.cast("decimal(38,9)")
    n, total, squares = strengths.agg(F.count("*"), F.sum(whole(F.col("s"))), F.sum(whole(F.col("s") * F.col("s")))).first()
    return float(max(0, n * squares - total * total)) ** 0.5 / n if n else 0.0


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", block: int = BLOCK) -> DataFrame:
    """(key, score double in 0 to 1, predicted int): one row per row of docs.

    labels: (key, label) of the rows to learn from, all of them; null keys or labels are ignored, of rows repeated with one
    key the largest label holds, and the least text is fitted. block: rows of each class that are fitted together. Features
    come from the text alone. Null and empty texts have the features of an empty text. With one class or none in the labels
    every score is 0.5. Labelled rows are shuffled; the driver has the weights, counts and a few strengths, no rows.
    """
    rows, drop = store(labelled_rows(docs, labels, text, key, label))
    try:
        sizes = dict(rows.groupBy("y").count().collect())
        weights = fitted(*dealt(rows, sizes.get(1, 0), sizes.get(0, 0), block))
        classes = dict(labels.where(f"`{key}` is not null and `{label}` is not null").groupBy((F.col(label) == 1).alias("y")).count().collect())

        def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = np.concatenate([np.zeros(0), *(b @ weights for b in _blocks(batch))])
                yield pa.RecordBatch.from_arrays([pa.array(np.round(s, 9) + 0.0), batch.column(0)], names=["s", "y"])

        strength, drop_strength = store(rows.select("y", "text").mapInArrow(strengths, struct_of("s double, y int")))
        try:
            middle, scale = threshold(strength, classes.get(True, 0), classes.get(False, 0)), spread(strength) or 1.0
        finally:
            drop_strength()
    finally:
        drop()
    shared = docs.sparkSession.sparkContext.broadcast((weights, middle, scale))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mid, wide = shared.value
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(b @ w for b in _blocks(batch))])
            score = 1 / (1 + np.exp(-np.clip((s - mid) / wide * 4, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, struct_of(f"`{key}` {kind}, score double, predicted int"))


def held_out(key: str = "doc_id"):
    """Rows on which the classifier is judged: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
