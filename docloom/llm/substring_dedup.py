"""Substring dedup by level-wise doubling.

Level by level, the windows that repeat at one length alone are extended to twice that length, until the wanted length
is reached or no candidate survives. The first level is thinned without loss: of the short windows inside each window
of the wanted length only the one with the least hash is counted, so two documents that share a long window count the
same short one in it, and one window in a dozen is shuffled instead of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, signed, slices, small, store, struct_of, text_buffer, window_hashes, word_hashes

#: Rows of short structs (a key and lists of places) that may be broadcast.
PLACES = 500_000


def ladder(length: int, first: int = 25) -> list[int]:
    """Lengths that end at `length`, each at most twice the one before, the first at most `first`."""
    steps = [length]
    while steps[0] > first:
        steps.insert(0, -(-steps[0] // 2))
    return steps


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values, the place of its least (the rightmost of equals): van Herk's two scans."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # order by value, then by later place; the low bits hold the place within a block of two spans
    size = -(-len(values) // span) * span
    rank = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    bits = int(2 * span).bit_length()
    place = np.arange(len(values), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    rank[: len(values)] = (values & ~mask) | (mask - (place & mask))
    blocks = rank.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
    at = (mask - (low & mask)).astype(np.int64)
    start = np.arange(n, dtype=np.int64)
    return start + (at - start & int(mask))


def _docs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = text_buffer(batch.column(column))
    for a, b in slices(offsets):
        words, at = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(a, b):
            yield i, words[at[i - a] : at[i - a + 1]]


def first_level(docs: DataFrame, length: int, first: int, text: str, key: str) -> DataFrame:
    """(hash, key, pos): the least `first`-word window in each window of `length` words, each place once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, hashes = [], [], []
            for i, words in _docs(batch, 1):
                if len(words) >= length:
                    grams = window_hashes(words, first)
                    at = least_places(grams, length - first + 1)
                    at = at[np.append(True, at[1:] != at[:-1])]
                    row.append(np.full(len(at), i))
                    pos.append(at)
                    hashes.append(grams[at])
            row, pos = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (row, pos))
            keys = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *hashes]))), keys, pa.array(pos.astype(np.int32))], names=["hash", key, "pos"])

    return docs.select(F.col(key), F.col(text)).where(F.col(key).isNotNull()).mapInArrow(run, struct_of(f"hash long, `{key}` {kind}, pos int"))


def next_level(docs: DataFrame, alive: DataFrame, length: int, size: int, text: str, key: str, from_least: int | None) -> DataFrame:
    """(hash, key, pos): windows of `size` words that grow from the places alive(key, places).

    From the first level (windows of from_least words that are least in a window of `length`) these are all windows of
    `size` inside the windows of `length` whose least window is alive; from a later one, those both of whose ends, of
    the size before, are alive.
    """
    kind = docs.schema[key].dataType.simpleString()
    half = -(-size // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, hashes = [], [], []
            places = batch.column(2)
            for i, words in _docs(batch, 1):
                old = np.unique(places[i].values.to_numpy())
                if from_least is not None:
                    least = least_places(window_hashes(words, from_least), length - from_least + 1)
                    ok = np.isin(least, old)
                    flags = np.zeros(len(words) + 1, np.int32)
                    starts = np.flatnonzero(ok)
                    np.add.at(flags, starts, 1)
                    np.add.at(flags, starts + length - size + 1, -1)
                    at = np.flatnonzero(np.cumsum(flags[: max(0, len(words) - size + 1)]) > 0)
                else:
                    at = old[np.isin(old + size - half, old)]
                grams = window_hashes(words, size)
                at = at[at < len(grams)]
                row.append(np.full(len(at), i))
                pos.append(at)
                hashes.append(grams[at])
            row, pos = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (row, pos))
            keys = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *hashes]))), keys, pa.array(pos.astype(np.int32))], names=["hash", key, "pos"])

    return with_places(docs.select(F.col(key), F.col(text)), alive, key, "inner").mapInArrow(run, struct_of(f"hash long, `{key}` {kind}, pos int"))


def with_places(docs: DataFrame, alive: DataFrame, key: str, how: str) -> DataFrame:
    """docs with the places of their key. Few documents with places are broadcast, more are joined by a shuffle."""
    side = alive.select(F.col(key).alias("_key"), "places")
    count, total = alive.agg(F.count("*"), F.sum(F.size("places"))).head()
    return docs.join(small(side, count + (total or 0) // 8, PLACES), F.col(key) == F.col("_key"), how).select(*docs.columns, "places")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, places): where windows start that also start in another document."""
    both = cut(rows.groupBy("hash").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select(F.col("hash").alias("_hash")))
    found = rows.join(small(both.hint("rebalance"), both.count()), F.col("hash") == F.col("_hash"), "left_semi")
    return found.groupBy(key).agg(F.collect_list("pos").alias("places"))


def later(rows: DataFrame, key: str) -> DataFrame:
    """(key, places): runs of windows that also start in a document with a smaller key, as start and end in turn."""
    least = rows.groupBy("hash").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).where("_lo <> _hi").select(F.col("hash").alias("_hash"), "_lo")
    found = rows.join(least.hint("rebalance"), F.col("hash") == F.col("_hash")).where(F.col("_lo") < F.col(key))
    gathered = found.groupBy(key).agg(F.collect_list("pos").alias("places"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(1):
                at = np.unique(places.values.to_numpy())
                first = np.flatnonzero(np.append(True, np.diff(at) > 1))
                out.append(np.stack([at[first], at[np.append(first[1:], len(at)) - 1] + 1], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=[key, "places"])

    kind = rows.schema[key].dataType.simpleString()
    return gathered.mapInArrow(runs, struct_of(f"`{key}` {kind}, places array<int>"))


def removed_words(docs: DataFrame, length: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, places array<int>): runs of windows of `length` words that also start in a smaller document."""
    steps = ladder(length)
    rows, discard = store(first_level(docs, length, steps[0], text, key))
    alive = cut(repeated(rows, key) if len(steps) > 1 else later(rows, key))
    for k, size in enumerate(steps[1:], 1):
        discard()
        rows, discard = store(next_level(docs, alive, length, size, text, key, steps[0] if k == 1 else None))
        alive = cut(later(rows, key) if size == length else repeated(rows, key))
    discard()
    return alive


def substring_dedup(docs: DataFrame, length: int = 50, text: str = "text", key: str = "doc_id", texts: bool = True) -> DataFrame:
    """(key, n_words long, n_removed long, kept_sha256 string, kept_text string): one row per row of docs.

    texts: whether to return kept_text, too.

    Words are runs of other than ASCII white space, unchanged, of the whole text. Each word is removed that is covered
    by a window of `length` words whose sequence also starts in a document with a smaller key; windows are judged on
    the input. kept_text has the other words, joined by one space. Null and empty texts have no words. A document with
    a null key neither removes nor loses words. Rows repeated with one key and the same text lose nothing to each
    other; rows of one key with different texts are judged by the union of their places, each on its own words.
    """
    alive = removed_words(docs, length, text, key)
    own = docs.select(F.col(key), F.col(text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            places = batch.column(2)
            n, gone, shas, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].tobytes().split()
                total = len(words)
                if places[i].is_valid:
                    flags = np.zeros(total + 1, np.int32)
                    runs = places[i].values.to_numpy().reshape(-1, 2)
                    runs = runs[runs[:, 0] + length <= total]
                    np.add.at(flags, runs[:, 0], 1)
                    np.add.at(flags, np.minimum(runs[:, 1] - 1 + length, total), -1)
                    words = [w for w, c in zip(words, np.cumsum(flags[:-1]).tolist()) if not c]
                kept = b" ".join(words)
                n.append(total)
                gone.append(total - len(words))
                shas.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_texts, pa.string())] * texts, names=names)

    names = [key, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts
    schema = struct_of(f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return with_places(own, alive, key, "left").mapInArrow(run, schema)
