"""Shared parts: lineage cuts, size-checked broadcasts and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.shared import shared_folder

#: A side with at most this many rows of ids or small structs may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

#: Rows in an Arrow batch. Texts are long, so batches are short.
ARROW_ROWS = 256

WORD = r"[^\x20\x09-\x0D]+"


def session(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, so that a Python worker holds few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage in the shared folder that the session names (see shared_folder())."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Evaluate once into a Parquet table in the shared folder: (the table, a call that deletes it).

    For tables of many rows, which take a fraction of a checkpoint's space. What is left goes when the session ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder), lambda: files.delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows are within the limit; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column of such a name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/documents.parquet")


def struct_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


# ---------------------------------------------------------------------------------------------------------------------
# Arrow text buffers

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and odd powers for each place in a word.
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = np.ones(1 << 12, dtype=np.uint64)
_POWERS[1:] = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `most` bytes; a longer row is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def text_runs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, and n + 1 offsets of the rows into them. lower: A-Z as a-z."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = offsets[:-1]
    begin = begin[begin < len(raw)]
    first[begin] = solid[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(solid)
    counts = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    place = at - np.repeat(starts, counts)
    values = (_BYTE[_LOWER[raw[at]]] if lower else _BYTE[raw[at]]) * _powers(int(counts.max()))[place]
    hashes = np.add.reduceat(values, np.cumsum(counts) - counts)
    return mix(hashes + counts.astype(np.uint64)), np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        longer = np.full(n, np.uint64(0xD1342543DE82EF95))
        longer[0] = 1
        return np.cumprod(longer, dtype=np.uint64)
    return _POWERS


_STEP = np.uint64(0x9FB21C651E98DF25)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words (order counts); len(words) - size + 1 of them. Doubling: log2(size) passes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, block, out, done = _STEP, 1, words, None, 0
    left = size
    # out covers `done` words; block covers `span` words
    while left:
        if left & 1:
            if out is None:
                out, done = block, span
            else:
                m = min(len(out), len(block) - done)
                shift = np.uint64(pow(int(_STEP), done, 1 << 64))
                out = out[:m] + block[done : done + m] * shift
                done += span
        left >>= 1
        if left:
            block = block[: len(block) - span] + block[span:] * power
            power = np.uint64(int(power) * int(power) & (1 << 64) - 1)
            span *= 2
    return mix(out[:n].copy())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


# ---------------------------------------------------------------------------------------------------------------------
# Connected components


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id reachable, for each id in a link between different ids.

    Large-star and small-star steps in turn; each sums per key before it shuffles and joins edges back to the minimum
    of their key, so one very large star is split by Spark's skew join. Nulls and self-links are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = cut(edges)
    while not _stars(edges):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        star = star.select("v", "m").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut(star.where("u > v").distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each id that points to another points to one that points to none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionAll(edges.select(F.col("v").alias("id"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    return ends.groupBy("id").agg(F.sum("from").alias("n"), F.max("to").alias("to")).where("n > 1 or n > 0 and to > 0").isEmpty()
