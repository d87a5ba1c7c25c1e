"""Periodic runs of words: block matching with integer-sequence keys, then exact extension both ways.

A run of period q holds, at the scale 2**k with 2**k <= q < 2**(k + 1), a block of 2**k words at a place divisible by 2**k
that occurs again q words later. So for each scale the aligned blocks are the keys of a pyahocorasick automaton over word
numbers, the document is searched for them, and each occurrence at a distance of the scale, 2**k to 2**(k + 1) - 1, is a
seed. A seed is extended both ways as far as words that distance apart are identical.

The search is kept to stretches in which every word comes again within the scale's distances, for at least as many words
as a run of the scale has before its last period. Every run lies in such a stretch and the period after it, so nothing is
lost, and ordinary prose has next to none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import struct_of

#: A run has at least LEAST words and at least POWER periods. The search relies on POWER being 4.
LEAST, POWER = 6, 4


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words alone."""
    names = dict(zip(distinct := dict.fromkeys(words), range(len(distinct))))
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def recurrences(ids: np.ndarray) -> np.ndarray:
    """Words from each word to the next that is identical; the number of words where there is none."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    gap = np.full(n, n, np.int64)
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def stretches(gap: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """[start, end) in which a run of a period from scale to 2 scale - 1 may lie, its last period included."""
    n = len(gap)
    near = np.zeros(n + 2, np.int8)
    near[1:-1] = gap < 2 * scale
    edges = np.flatnonzero(np.diff(near))
    starts, ends = edges[::2], edges[1::2]
    # of max(LEAST, POWER q) words all but the last q come again
    long = ends - starts >= max(LEAST - scale, (POWER - 1) * scale)
    return [(int(a), min(int(b) + 2 * scale - 1, n)) for a, b in zip(starts[long], ends[long])]


def seeds(ids: np.ndarray, start: int, end: int, scale: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of aligned blocks in [start, end) that occur again at a distance from scale to 2 scale - 1."""
    import ahocorasick

    first = -(-start // scale) * scale
    part = ids[start:end].tolist()
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    block_of = {}
    for at in range(first, end - scale + 1, scale):
        key = tuple(part[at - start : at - start + scale])
        block_of[at] = key
        found.add_word(key, key)
    if not block_of:
        return
    found.make_automaton()
    places = defaultdict(list)
    for last, key in found.iter(tuple(part)):
        places[key].append(start + last - scale + 1)
    places = {key: np.array(at) for key, at in places.items()}
    for at, key in block_of.items():
        again = places[key]
        for other in again[np.searchsorted(again, at + scale) : np.searchsorted(again, at + 2 * scale)].tolist():
            yield at, other - at


def reach(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """[start, end) of the longest stretch around `at` in which words a period apart are identical. Steps double."""
    start, step = at, 32
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(ids[low:start] != ids[low + period : start + period])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    end, step, most = at, 32, len(ids) - period
    while end < most:
        high = min(most, end + step)
        differ = np.flatnonzero(ids[end:high] != ids[end + period : high + period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, 2 * step
    return start, end + period


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n = len(ids)
    if n < LEAST:
        return []
    gap, scale = recurrences(ids), 1
    # the smallest period of each stretch; scales come in rising order, so a multiple of a period finds it known
    known: dict[tuple[int, int], int] = {}
    while POWER * scale <= n:
        # Two periodic stretches that share as many words as both periods together have a common period. So a run of
        # this scale shares fewer with any known run, which has a smaller one; `over` is where the known ones end.
        over = np.zeros(n, np.int64)
        for a, b in known:
            np.maximum(over[a:b], b, out=over[a:b])
        for start, end in stretches(gap, scale):
            if over[start] >= end - 2 * scale + 1 and end < n or over[start] >= n:
                continue
            done: dict[int, list[int]] = defaultdict(lambda: [-1, -1])  # distance -> the last stretch that it has
            for at, period in seeds(ids, start, end, scale):
                if at < done[period][1] - period or over[at] >= at + period + scale:
                    continue
                a, b = reach(ids, at, period)
                done[period] = [a, b]
                if b - a >= max(LEAST, POWER * period):
                    known[a, b] = min(period, known.get((a, b), period))
        scale *= 2
    return sorted((a, b - a, q) for (a, b), q in known.items())


def collapsed_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: words after the first period of a run go."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words long, runs array<struct<start, length, period>>, collapsed string), one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0. A run is a stretch of words with smallest period q, of at
    least max(6, 4 q) words, that can't be longer; all are listed, by start and then period. collapsed: the words that
    no run covers after its first q words, joined by a space. Null, empty and blank texts have no words and no runs, and
    collapse to an empty text. Repeated rows and null keys are rows like any other; other columns are ignored. Nothing
    is shuffled, and a worker holds one batch of texts and the automaton of one stretch.
    """
    kind = docs.schema[key].dataType.simpleString()
    form = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, kept = [], [], []
            for value in batch.column(1).cast(pa.large_binary()):
                words = (value.as_py() or b"").split()
                runs = runs_of(numbered(words))
                if runs:
                    stay = collapsed_places(len(words), runs)
                    kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
                else:
                    kept.append(b" ".join(words))
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, form), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    schema = struct_of(f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first by start and then period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and digests of periodic_runs() rows."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        key, F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text): in a tenth of the documents, by the CRC-32 h of the key, the words from g % n on repeat, g = h // 10.

    Word i >= a becomes word a + (i - a) % p of the text, with a = g % n and p = 1 + (n - a) // (3 + g % 8). Other texts,
    those without words and those of null keys stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    rows = docs.select(F.col(key), F.col(text), h.alias("_h")).withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    rows = rows.withColumn("_a", (g % n).cast("int")).withColumn("_p", (F.lit(1) + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    again = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1)))
    return rows.select(key, F.when(F.col("_w").isNotNull(), F.array_join(again, " ")).otherwise(F.col(text)).alias(text))
