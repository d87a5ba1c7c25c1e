"""Quality rules: plain counts, then the hashed n-gram log-likelihood ratio of a text.

Two multinomials over hashed byte n-grams, one of the trusted documents and one of the whole raw corpus, give each
n-gram a log ratio. A text's score is the mean ratio of its n-grams, so length does not matter, and a text is kept if
its score reaches the score that all but a small share of the trusted documents reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, slices, small, struct_of, text_buffer
from docloom.llm.features import gram_buckets, inside, rule_counts

BITS = 14
#: Share of the trusted documents whose score may lie below the threshold, and the slack below that score.
SHARE, SLACK = 0.005, 0.25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def gram_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all rows and of those whose `_trusted` holds, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_sum, own_sum = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            trusted = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                buckets = gram_buckets(raw[offsets[a] : offsets[b]], bits)
                ok = inside(own, len(buckets))
                raw_sum += np.bincount(buckets[ok], minlength=1 << bits)
                ok &= np.repeat(trusted[a:b], np.diff(own))[: len(ok)]
                own_sum += np.bincount(buckets[ok], minlength=1 << bits)
        at = np.flatnonzero(raw_sum)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw_sum[at]), pa.array(own_sum[at])], names=["bucket", "raw", "trusted"])

    parts = docs.mapInArrow(run, struct_of("bucket int, raw long, trusted long"))
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """log(p_trusted / p_raw) by bucket, with one more of each; 2**bits rows at most come to the driver."""
    raw, own = np.ones(1 << bits), np.ones(1 << bits)
    for bucket, r, t in counts.collect():
        raw[bucket] += r
        own[bucket] += t
    return np.log(own / own.sum()) - np.log(raw / raw.sum())


def measured(column: pa.Array, table: np.ndarray, bits: int = BITS) -> dict[str, np.ndarray]:
    """The rule counts and the mean log ratio (llr) of each text."""
    raw, offsets = text_buffer(column)
    parts = []
    for a, b in slices(offsets):
        own, data = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
        buckets = gram_buckets(data, bits)
        value = np.zeros(len(data) + 1)
        np.cumsum(np.append(table[buckets] * inside(own, len(buckets)), np.zeros(len(data) - len(buckets))), out=value[1:])
        llr = (value[own[1:]] - value[own[:-1]]) / np.maximum(np.diff(own) - 3, 1)
        parts.append(rule_counts(data, own) | {"llr": np.round(llr, 6)})
    empty = dict.fromkeys(COUNTS, np.zeros(0, np.int64)) | {"llr": np.zeros(0)}
    return {c: np.concatenate([p[c] for p in parts]) if parts else empty[c] for c in empty}


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def scored(docs: DataFrame, ratios: np.ndarray, text: str, key: str) -> DataFrame:
    """(key, the counts, llr, base_failed): one row per row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measured(batch.column(1), shared.value)
            cols = [pa.array(m[c]) for c in (*COUNTS, "llr")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(failed(m))], names=[key, *COUNTS, "llr", "base_failed"])

    schema = struct_of(f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", llr double, base_failed boolean")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def fitted(docs: DataFrame, trusted: DataFrame, text: str, key: str) -> tuple[np.ndarray, DataFrame]:
    """The log ratios, and the ids of the trusted documents, marked for broadcast if they are few."""
    ids = cut(trusted.select(F.col(key).alias("_id")).where("_id is not null").distinct())
    ids = small(ids, ids.count())
    own = docs.select(F.col(key), F.col(text))
    marked = own.join(ids.withColumn("_trusted", F.lit(True)), F.col(key) == F.col("_id"), "left")
    return log_ratios(gram_counts(marked.select(text, F.coalesce("_trusted", F.lit(False)).alias("_trusted")))), ids


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr): one row per row.

    trusted: a table whose column `key` holds the ids of trusted documents. base_failed: fewer than 50 words, or more
    than half of the words in three-word windows that the text repeats. kept: not base_failed, and llr no less than
    the score that all but `share` of the trusted rows reach, less SLACK; with no trusted row, base rules alone.
    Counts cover all rows. Null and empty texts have no words and fail. Null ids are never trusted; repeated rows are
    counted and judged each for itself. The driver holds 2**BITS counts, and a histogram of trusted scores by steps.
    """
    ratios, ids = fitted(docs, trusted, text, key)
    rows = cut(scored(docs, ratios, text, key))
    level = threshold(rows.join(ids, F.col(key) == F.col("_id"), "left_semi"), share)
    return rows.select(key, *COUNTS, "base_failed", F.expr(f"not base_failed and llr >= {level!r}D").alias("kept"), "llr")


def quality_filter(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with their own columns; rows are judged as they stream, unshuffled.

    For the threshold only trusted rows are scored first. Other columns of docs may have any names.
    """
    ratios, ids = fitted(docs, trusted, text, key)
    own = docs.select(F.col(key), F.col(text)).join(ids, F.col(key) == F.col("_id"), "left_semi")
    level = threshold(scored(own, ratios, text, key), share)
    shared, at = docs.sparkSession.sparkContext.broadcast(ratios), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measured(batch.column(at), shared.value)
            yield batch.filter(pa.array(~failed(m) & (m["llr"] >= level)))

    return docs.mapInArrow(run, docs.schema)


def threshold(rows: DataFrame, share: float) -> float:
    """The score below which at most `share` of the rows that pass the base rules lie, less SLACK; by steps of 0.001."""
    steps = sorted((r[0], r[1]) for r in rows.where("not base_failed").groupBy(F.floor(F.col("llr") * 1000).alias("step")).count().collect())
    left = share * sum(n for _, n in steps)
    for step, n in steps:
        left -= n
        if left < 0:
            return step / 1000 - SLACK
    return -1e9
