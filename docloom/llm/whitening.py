"""Embedding whitening by digit-slice matrix products.

Entries become whole numbers. Whole numbers less a common shift are split into signed digits small enough that a float64
BLAS product of two digit matrices is exact; the products are put together again as big integers, which Spark sums. So
the covariance is exact until its one division, whatever the offset of the entries and however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import session, store, struct_of

#: Bits of a digit, and rows of a product: digits are at most 2**12 in size, so sums of 2**15 products stay under 2**40.
DIGIT, BLOCK = 13, 1 << 15
#: Entries are scaled by SCALE, rounded down, and moved by OFFSET. Scaled entries of 2**LARGEST or more aren't whole longs.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 61
#: Components with at most this share of the greatest eigenvalue have no spread to divide by.
FLAT = 1e-13


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite and in the range of scaled longs."""
    off = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= float(1 << LARGEST) / SCALE)
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, off), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 for each entry c, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def digits(z: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits, lowest first, as float64: z is the sum of digit k times 2**(DIGIT k)."""
    half, out = 1 << DIGIT - 1, []
    while z.any():
        low = ((z + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> DIGIT
    return out


def gram(z: np.ndarray) -> np.ndarray:
    """The exact product of z transposed and z as Python integers: BLAS products of digits, put together again."""
    parts, total = digits(z), np.zeros((z.shape[1],) * 2, object)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts[a:], a):
            product = np.rint(left.T @ right).astype(np.int64).astype(object)
            total += (product if a == b else product + product.T) * (1 << DIGIT * (a + b))
    return total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The first columns of the batches as matrices of at most about BLOCK rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(matrix(batch.column(0)))
            rows += batch.num_rows
        if rows >= BLOCK // 2:
            yield np.concatenate(held)
            held, rows = [], 0
    if held:
        yield np.concatenate(held)


#: Big integers travel as high and low parts, which Spark sums without overflow.
_LOW = 62
_PARTS = "i int, j int, n long, high decimal(38,0), low long"


def _parts(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    i, j, n, v = zip(*rows)
    high = pa.array([Decimal(x >> _LOW) for x in v], pa.decimal128(38, 0))
    low = pa.array([x & (1 << _LOW) - 1 for x in v], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64()), high, low], names=["i", "j", "n", "high", "low"])


def _summed(parts: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(i, j) -> (rows, sum). As many rows as the matrix has entries, however many vectors there are."""
    rows = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    return {(r["i"], r["j"]): (r["n"], (int(r["high"]) << _LOW) + int(r["low"])) for r in rows}


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S): the rows of fit(x) and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            high, low = (x >> 31).sum(0), (x & (1 << 31) - 1).sum(0)
            yield _parts([(d, 0, len(x), (int(h) << 31) + int(v)) for d, (h, v) in enumerate(zip(high, low))])

    found = _summed(fit.mapInArrow(run, struct_of(_PARTS)))
    return (found[0, 0][0], [found[d, 0][1] for d in range(len(found))]) if found else (0, [])


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of fit(x), divisor n. Rows are centred by the whole part of the mean; what that leaves is exact, too."""
    shift = np.array([s // n for s in sums], np.int64)
    left = [s - n * (s // n) for s in sums]
    upper = [(i, j) for i in range(len(sums)) for j in range(i, len(sums))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            total = gram(x - shift)
            yield _parts([(i, j, len(x), total[i, j]) for i, j in upper])

    out = np.zeros((len(sums),) * 2)
    for (i, j), (_, total) in _summed(fit.mapInArrow(run, struct_of(_PARTS))).items():
        out[i, j] = out[j, i] = (n * total - left[i] * left[j]) / (n * n)
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in longs where they fit, else in Python integers."""
    bound = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) * 2
    if bound < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if y.dtype == np.int64 and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    return (y.astype(object) ** 2).sum(1).tolist()


class Whitening:
    """Components of a fit list: eigenvalues in falling order, the projection that whitens, and its measured error."""

    def __init__(self, fit: DataFrame, most: int):
        self.n, self.sums = column_sums(fit)
        if not self.n:
            return
        v = covariance(fit, self.n, self.sums)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:most]
        self.values = np.maximum(values[order], 0.0)
        flat = self.values <= FLAT * self.values[0]
        self.flat, trace = flat, np.trace(v)
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))
        self.project = np.where(flat, np.nan, vectors[:, order] / np.sqrt(np.where(flat, 1.0, self.values)))
        self.error = self.identity_error(fit)

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(deviation, whitened) of each row of x."""
        y = _centred(x, self.n, self.sums)
        return _squares(y), (y / self.n).astype(np.float64) @ self.project

    def identity_error(self, fit: DataFrame) -> float:
        """The greatest entry of the covariance of the whitened fit list less the identity, summed over the list itself."""
        width, plan = len(self.values), (self.n, self.sums, self.project)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, project = plan
            for x in _blocks(batches):
                w = (_centred(x, n, sums) / n).astype(np.float64) @ np.nan_to_num(project)
                total = np.vstack([w.T @ w, w.sum(0)])
                i, j = np.divmod(np.arange(total.size), width)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

        total = np.zeros((width + 1, width))
        for r in fit.mapInArrow(run, struct_of("i int, j int, v double")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            total[r["i"], r["j"]] = r["v"] / self.n
        mean = total[width]
        off = np.abs(total[:width] - np.outer(mean, mean) - np.eye(width))
        spread = ~self.flat
        return float(off[np.ix_(spread, spread)].max(initial=0.0))


def whitened(vectors: DataFrame, most: int = 16, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component int, n long, deviation decimal, whitened double, explained double, identity_error double).

    One row per usable row and component, in falling order of eigenvalues, at most `most` (or as many as there are
    dimensions). Rows are left out whose vector is null or empty, or holds a null, a non-finite entry or one of
    2**55 and more in size, or has another number of dimensions than the most usable rows (ties: the greater number).
    An entry c becomes x = floor(64 c) + 1000000. Each distinct x vector counts once in the fit, so repeated rows weigh
    nothing; every repeated row and every null or repeated key has its own result. deviation: exact sum of (n x - S)**2,
    null beyond 38 digits.
    A component without spread (fewer distinct vectors than dimensions, equal entries) has explained 0 and whitened
    null, and isn't part of the identity error. Without usable rows there are none. Signs are free but the same for all.
    """
    spark = session(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("_key"), F.when(usable(F.col(vector)), F.col(vector)).alias("_v")).where("_v is not null")
    lengths = rows.groupBy(F.size("_v").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()["d"]
    rows = rows.where(F.size("_v") == F.lit(lengths or 0)).select("_key", whole(F.col("_v")).alias("_x"))
    fit, drop = store(rows.select("_x").distinct())
    plan = Whitening(fit, most)
    drop()
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not plan.n:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, w = plan.apply(matrix(batch.column(1)))
            flat, width = pa.array(w.ravel(), from_pandas=True), w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(x) if x < 10**38 else None for x in deviation], pa.decimal128(38, 0)), lists], names=["_key", "_deviation", "_w"])

    found = rows.mapInArrow(run, struct_of(f"_key {kind}, _deviation decimal(38,0), _w array<double>"))
    explained = F.element_at(F.array(*map(F.lit, plan.explained.tolist())), F.col("_c") + 1)
    return found.select("_key", "_deviation", F.posexplode("_w").alias("_c", "_one")).select(
        F.col("_key").alias(key), (F.col("_c") + 1).alias("component"), F.lit(plan.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
        F.col("_one").alias("whitened"), explained.alias("explained"), F.lit(plan.error).alias("identity_error"),
    )
