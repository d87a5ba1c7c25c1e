"""Exact dedup by content-defined chunk recipes.

Each text, A-Z lower-cased, is cut where a rolling hash of its last bytes says so. A chunk moves as two independent
hashes and a length, never as text: the first is its identifier, and it is verified against the second and the length
over all chunks; an identifier that stands for different chunks is replaced by one of its own for each. A document is
then the ordered list of its identifiers, and equal lists are equal documents.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import _BYTE, _LOWER, cut, slices, small, struct_of, text_buffer

#: Bytes of a chunk: at least, by the mask on average beyond that, and at most.
LEAST, MOST, MASK = 1024, 16384, np.uint64(0x7FF << 40)


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text. A place is a cut by the 32 bytes before it alone, so edits move few cuts."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    gear = _BYTE[raw]
    span = 1
    while span < 32:  # doubling: sum of gear[i - k] << k over the last 32 bytes
        wider = gear.copy()
        wider[span:] += gear[:-span] << np.uint64(span)
        gear, span = wider, span * 2
    ends, last = [], 0
    for at in np.flatnonzero((gear & MASK) == 0) + 1:
        at = int(at)
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            last = at
            ends.append(last)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [n] if last < n else ends


def chunk_recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_sha256, chunks array<struct<id, check, size>>) of each normalised text; null counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    form = pa.struct([("id", pa.int64()), ("check", pa.int64()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            shas, ids, checks, sizes, at = [], [], [], [], [0]
            for a, b in slices(offsets):
                lower = _LOWER[raw[offsets[a] : offsets[b]]]
                for i in range(a, b):
                    own = lower[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]]
                    whole = own.tobytes()
                    shas.append(hashlib.sha256(whole).hexdigest())
                    start = 0
                    for end in cuts(own):
                        part = whole[start:end]
                        ids.append(xxhash.xxh3_64_intdigest(part))
                        checks.append(xxhash.xxh64_intdigest(part, 7))
                        sizes.append(end - start)
                        start = end
                    at.append(len(ids))
            parts = pa.StructArray.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.array(checks, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32))], fields=list(form))
            chunks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), chunks], names=[key, "text_sha256", "chunks"])

    schema = struct_of(f"`{key}` {kind}, text_sha256 string, chunks array<struct<id:bigint,check:bigint,size:int>>")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def verified_recipes(recipes: DataFrame) -> DataFrame:
    """recipes with `recipe array<long>`: identifiers that stand for one chunk each.

    All chunks are summed by identifier before the shuffle. Identifiers with differing checks or sizes get, in the
    documents that hold them, the two hashes folded into one; without any (the usual case) nothing is joined.
    """
    parts = recipes.select(F.explode("chunks").alias("c")).select("c.*")
    clash = parts.groupBy("id").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("size").alias("short"), F.max("size").alias("long"))
    clash = cut(clash.where("lo <> hi or short <> long").select("id"))
    plain = F.transform("chunks", lambda c: c["id"])
    if clash.isEmpty():
        return recipes.withColumn("recipe", plain)
    rows = recipes.withColumn("_row", F.xxhash64("text_sha256"))
    bad = rows.select("_row", F.explode("chunks").alias("c")).select("_row", F.col("c.id").alias("id")).join(clash, "id", "left_semi")
    bad = bad.groupBy("_row").agg(F.collect_set("id").alias("_bad"))
    own = F.transform("chunks", lambda c: F.when(F.array_contains("_bad", c["id"]), F.xxhash64(c["id"], c["check"], c["size"])).otherwise(c["id"]))
    return rows.join(bad, "_row", "left").withColumn("recipe", F.when(F.col("_bad").isNull(), plain).otherwise(own)).drop("_row", "_bad")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, keep_id, group_size long, kept boolean, text_sha256): one row per input row.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the largest key stays.
    Null texts count as empty, and empty texts are one group. A null key is smaller than any other. Rows repeated with
    the same key are copies of each other: group_size counts each, and each that has the largest key is kept.
    Group sizes are summed before the shuffle; the join back to rows is one that Spark splits where a group is large.
    """
    recipes = cut(verified_recipes(chunk_recipes(docs, text, key)).select(key, "text_sha256", F.xxhash64("recipe").alias("_at"), "recipe"))
    groups = recipes.groupBy("_at", "recipe").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    # dealt anew, so that both sides of the join are shuffled for it and Spark can split a large group
    rows = recipes.join(groups.withColumnRenamed("recipe", "_recipe").hint("rebalance"), "_at").where("recipe = _recipe")
    return rows.select(key, "keep_id", "group_size", F.expr(f"`{key}` <=> keep_id").alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts the one with the largest key, once.

    What goes is decided on keys and hashes alone. Keys of which all rows go are broadcast if they are few, so that no
    text moves; beyond, texts are shuffled once. Only rows that share their key with others, null keys included, are
    told apart by their texts. Other columns of docs may have any names.
    """
    marks = cut(exact_groups(docs, text, key).select(F.col(key).alias("_key"), "kept", "text_sha256"))
    keys = marks.groupBy("_key").agg(F.count("*").alias("_rows"), F.bool_or("kept").alias("_any"))
    other = cut(keys.where("_rows > 1 or not _any"))
    gone = small(other, other.count())
    stay = docs.join(gone, docs[key].eqNullSafe(gone["_key"]), "left_anti")
    shared = cut(other.where("_any").select("_key"))
    count = shared.count()
    if not count:
        return stay
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    side = small(shared, count)
    rows = docs.join(side, docs[key].eqNullSafe(side["_key"]), "left_semi")
    rows = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_at"), F.sha2(lower, 256).alias("_sha"))
    first = marks.where("kept").join(side.withColumnRenamed("_key", "_shared"), F.col("_key").eqNullSafe(F.col("_shared")), "left_semi").select("_key", "text_sha256")
    rows = rows.join(first, F.col("_at").eqNullSafe(F.col("_key")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return stay.unionAll(rows.dropDuplicates(["_at", "_sha"]).select("_row.*"))
