"""Sharding by K-d tree partitioning.

Units (groups of rows with equal texts) have metadata dimensions. A node of the tree is split along the dimension in
which it is widest, at the median weighted by bytes, until there are as many leaves as shards. Medians are found by
histograms that narrow down on the place where half of the bytes are reached; only these come to the driver. Units so
large that no split between others could be even are dealt to the lighter side first, and are few by their size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut
from docloom.llm.packing import numbered

#: Buckets of a histogram, and bits of a place along a dimension: its value in 20 bits, then a hash.
BINS, VALUE, HASH = 1024, 20, 42
#: Units over this share of a shard's bytes are dealt one by one; those over a whole shard's are taken apart.
LARGE = 1 / 64
DIMENSIONS = ("d_size", "d_first", "d_lang", "d_source")


def units(rows: DataFrame) -> DataFrame:
    """rows(unit, size, dimensions) -> a row for each unit: bytes, and the least value of each dimension."""
    return rows.groupBy("unit").agg(F.sum("size").alias("bytes"), *(F.min(d).alias(d) for d in DIMENSIONS))


def place(dimension: str, low: float, high: float) -> Column:
    """Where a unit is along a dimension: a whole number under 2 ** (VALUE + HASH); equal values differ by hash."""
    share = (F.col(dimension) - F.lit(low)) / F.lit((high - low) or 1.0)
    return F.floor(share * ((1 << VALUE) - 1)).cast("long") * (1 << HASH) + F.pmod(F.xxhash64("unit"), F.lit(1 << HASH))


def split_at(node: DataFrame, spot: Column, want: float, total: float) -> int:
    """The place below which the units have about `want` bytes."""
    lo, width, below = 0, 1 << (VALUE + HASH), 0.0
    slack = max(1.0, total * 1e-4)
    while width > 1:
        step = max(1, width // BINS)
        bucket = F.floor((F.col("_at") - lo) / step).cast("long")
        inside = node.withColumn("_at", spot).where((F.col("_at") >= lo) & (F.col("_at") < lo + width))
        sums = inside.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n")).collect()
        edge = lo
        for b, s, n in sorted((r[0], float(r[1]), r[2]) for r in sums):
            if below + s > want:
                edge = lo + b * step
                break
            below += s
            edge = lo + (b + 1) * step
        else:
            return edge
        if want - below <= slack or step == 1 or n == 1:  # near enough, or no more than one unit is left to place
            return edge if want - below <= below + s - want else edge + step
        lo, width = edge, step
    return lo


def leaves(table: DataFrame, shards: int) -> DataFrame:
    """table(unit, bytes, dimensions) -> (unit, shard)."""
    total = float(table.agg(F.sum("bytes")).head()[0] or 0)
    most = total / shards
    large = table.where(F.col("bytes") > most * LARGE)
    heavy = {r["unit"]: float(r["bytes"]) for r in large.select("unit", "bytes").collect()}  # fewer than shards / LARGE
    whole = table.agg(*(F.min(d).alias(f"lo_{d}") for d in DIMENSIONS), *(F.max(d).alias(f"hi_{d}") for d in DIMENSIONS)).head()
    nodes = [(table.where(F.col("bytes") <= most * LARGE), sorted(heavy, key=lambda u: (-heavy[u], u)), shards, F.lit(True))]
    done: list[tuple[Column, list[int]]] = []
    while nodes:
        node, big, n, where = nodes.pop(0)
        if n == 1:
            done.append((where, big))
            continue
        stats = node.agg(F.sum("bytes").alias("bytes"), *(F.min(d).alias(f"lo_{d}") for d in DIMENSIONS), *(F.max(d).alias(f"hi_{d}") for d in DIMENSIONS)).head()
        left_n = n // 2
        light, sides, load = float(stats["bytes"] or 0), ([], []), [0.0, 0.0]
        want = (light + sum(heavy[u] for u in big)) * left_n / n
        for u in big:  # the largest first, to the side with more room
            side = 0 if want - load[0] >= (light + sum(heavy[x] for x in big)) - want - load[1] else 1
            sides[side].append(u)
            load[side] += heavy[u]
        spread = {}
        for d in DIMENSIONS:
            lo, hi = stats[f"lo_{d}"], stats[f"hi_{d}"]
            full = (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0)
            spread[d] = (hi - lo) / full if full and lo is not None else 0.0
        widest = max(DIMENSIONS, key=lambda d: spread[d])
        lo, hi = float(stats[f"lo_{widest}"] or 0), float(stats[f"hi_{widest}"] or 0)
        spot = place(widest, lo, hi)
        cut_at = split_at(node, spot, max(0.0, want - load[0]), light)
        nodes.append((node.where(spot < cut_at), sides[0], left_n, where & (spot < cut_at)))
        nodes.append((node.where(spot >= cut_at), sides[1], n - left_n, where & (spot >= cut_at)))
    # each leaf is a conjunction of comparisons of a row with constants: one pass gives every unit its shard
    shard = F.lit(None).cast("int")
    for k, (where, _) in enumerate(done):
        shard = F.when(where, F.lit(k)).otherwise(shard)
    dealt = {u: k for k, (_, big) in enumerate(done) for u in big}
    if dealt:
        pairs = F.create_map(*(F.lit(x) for u, k in dealt.items() for x in (u, k)))
        shard = F.coalesce(F.element_at(pairs, F.col("unit")).cast("int"), shard)
    return table.select("unit", shard.alias("shard"))


def kd_shards(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, size long, text_crc32 long, law string, shard int, slot long, grown_shard int): one row per row of docs.

    size: UTF-8 bytes of the text and 1 (null texts are empty). Law `bytes`: the shards have nearly the same sum of
    sizes. Rows with equal texts go to one shard, unless they have more bytes than a shard should; then each row of
    theirs is a unit of its own. Dimensions: size, first key, language and source (by hash; null is a value of its
    own). Null keys have the least place; rows alike in everything are split only if their group is. slot: 0, 1, 2 ...
    within the shard. grown_shard is null, for this law has no stable growth. An empty table stays empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    share = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit("\0"))), F.lit(1 << 20)).cast("double")
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body, F.octet_length(body)).alias("unit"),
        F.log1p(F.octet_length(body)).alias("d_size"), F.coalesce(F.col(key).cast("double"), F.lit(-1.0)).alias("d_first"), share(lang).alias("d_lang"), share(source).alias("d_source"),
    )
    rows = cut(rows)
    table = cut(units(rows))
    total = float(table.agg(F.sum("bytes")).head()[0] or 0)
    apart = [r[0] for r in table.where(F.col("bytes") > total / shards).select("unit").collect()]  # fewer than shards
    if apart:
        rows = cut(rows.withColumn("unit", F.when(F.col("unit").isin(apart), F.xxhash64("unit", key, F.rand(7))).otherwise(F.col("unit"))))
        table = cut(units(rows))
    placed = leaves(table, shards).withColumnRenamed("unit", "_unit")
    rows = rows.join(placed.hint("rebalance"), F.col("unit") == F.col("_unit")).select(key, "size", "text_crc32", "shard")
    rows = cut(rows)
    return numbered(rows, rows.count(), "shard", [key, "text_crc32", "size"], "slot").select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
