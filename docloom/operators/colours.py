"""Coloured runs of text as marks: ranges become runs of one colour, and their visible lines stand between == marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import refs

#: Places of a tile: ranges meet within tiles, so a long text with many ranges is not one comparison of all with all.
TILE = 4096
#: Fixed value: the mark.
MARK = "=="
_VISIBLE = r"([^\p{Zs}\t\n\r￼](?:[^\n\r￼]*[^\p{Zs}\t\n\r￼])?)"


def merged_runs(ranges: DataFrame, key: str) -> DataFrame:
    """ranges(key, n, start, length, colour) -> (key, start, stop, colour): longest runs of one colour, which don't overlap.

    Where ranges overlap the one of the greatest n holds; neighbours of equal colour are one run. colour is any type that
    can be compared; a null colour is one of its own. Empty ranges count for nothing. A text is cut at all edges of its
    ranges, each piece takes its colour from the ranges that cover it, and pieces that follow one another without a change
    of colour are islands that come together again.
    """
    rows = ranges.where("length > 0").select(key, "n", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("stop"), F.col("colour"))
    tile = lambda c: F.floor(F.col(c) / TILE)
    rows = rows.withColumn("_tile", F.explode(F.sequence(tile("start"), F.floor((F.col("stop") - 1) / TILE))))
    first, last = F.greatest(F.col("start"), F.col("_tile") * TILE), F.least(F.col("stop"), (F.col("_tile") + 1) * TILE)
    rows = rows.select(key, "_tile", "n", first.alias("start"), last.alias("stop"), "colour")
    edges = rows.select(key, "_tile", F.explode(F.array("start", "stop")).alias("at")).distinct()
    pieces = edges.withColumn("to", F.lead("at").over(Window.partitionBy(key, "_tile").orderBy("at"))).where("to is not null")
    cover = rows.select(F.col(key).alias("_k"), F.col("_tile").alias("_t"), "n", "start", "stop", F.struct("colour").alias("_c"))
    met = pieces.join(cover, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_tile") == F.col("_t")) & (F.col("start") <= F.col("at")) & (F.col("stop") >= F.col("to")))
    coloured = met.groupBy(key, "at", "to").agg(F.max_by("_c", "n").alias("_c"))
    order = Window.partitionBy(key).orderBy("at")
    begins = ~(F.lag("to").over(order).eqNullSafe(F.col("at")) & F.lag("_c").over(order).eqNullSafe(F.col("_c")))
    islands = coloured.withColumn("_new", begins.cast("int")).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(key, "_island").agg(F.min("at").alias("start"), F.max("to").alias("stop"), F.first("_c").alias("_c")).select(key, "start", "stop", "_c.colour")


def marked_lines(text: Column) -> Column:
    """Each line of a run between marks, without the blanks at its ends; attachments end a line as line ends do."""
    return F.regexp_replace(text, _VISIBLE, f"{MARK}$1{MARK}")


def marked_texts(texts: DataFrame, ranges: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): texts with the runs of chromatic colours marked. Keys of texts are distinct.

    ranges(key, n, start, length, colour struct<r, g, b, a>), places in code points from 0. Grey and invisible colours, and
    a null colour, are not marked. Ranges beyond a text's end are cut there. A text is joined once, with all its runs.
    """
    runs = merged_runs(ranges, key).where(F.coalesce(refs.chromatic(*(F.col(f"colour.{c}") for c in "rgba")), F.lit(False)))
    every = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_runs"))
    rows = texts.select(F.col(key), F.col(text).alias("_text")).join(every, key, "left")
    part = lambda a, b: F.substring(F.col("_text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("_runs", lambda r: r["stop"]))
    pieces = F.transform(F.arrays_zip(F.col("_runs").alias("run"), before.alias("from")), lambda z: F.when(z["run"].isNull(), part(z["from"], F.lit((1 << 31) - 1).cast("long"))).otherwise(F.concat(part(z["from"], z["run"]["start"]), marked_lines(part(z["run"]["start"], z["run"]["stop"])))))
    return rows.select(key, F.when(F.col("_runs").isNull() | F.col("_text").isNull(), F.col("_text")).otherwise(F.array_join(pieces, "")).alias(text))
