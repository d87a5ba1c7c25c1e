"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Sources get target words by weight, at most `most` times their own; what is above that is shared again by weight. Within
a source the expected copies of a document rise with its length: they are the source's level times the binary digits of
its number of words, at most `most`, and the level is such that the expected words are the target. The whole part of the
copies is certain, and the rest is the document's inclusion probability p. Documents are ranked by the random odds
u / (1 - u) over the inclusion odds p / (1 - p), and are taken in that order while the words stay within what is left of
the target. Of the documents after these, the one that brings the source nearest to its target is taken, too.

No source is brought together: ranks are bucketed, words are summed by bucket, and only the bucket in which the target
is reached is bucketed again and, at last, put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, cut

#: Buckets of ranks at each of the two steps.
BUCKETS = 4096
#: Weights of the sources in order of code points, repeating.
WEIGHTS = (1, 2, 3)


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) by the key as text: 52 bits of an MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(salt))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, most: int, weights: tuple[int, ...]) -> DataFrame:
    """sizes(source, source_size) -> with target double. Sources are few: a row each.

    A source is at its cap if the common level (words for each unit of weight) is above cap / weight. In order of
    cap / weight the capped ones come first, so one running sum finds how many there are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * most).alias("cap"))
    every = Window.partitionBy()
    rows = rows.withColumn("level_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("level_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, held = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("w").over(every) - held))
    nth = F.row_number().over(Window.orderBy("level_at", F.col("source").asc_nulls_last()))
    rows = rows.withColumn("nth", nth)
    free = F.when(F.col("level") <= F.col("level_at"), F.struct("nth", "level"))
    rows = rows.withColumn("common", F.min(free).over(every)["level"])
    target = F.least(F.col("w") * F.coalesce("common", F.lit(float("inf"))), F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


#: Tables with a row for each source that have at most this many are broadcast.
SOURCES = 10_000


def by_source(rows: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """rows with the columns of their source's row of table(_s, ...), if it has one."""
    side = F.broadcast(table) if count <= SOURCES else table
    return rows.join(side, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def measured(docs: DataFrame, text: str, source: str, key: str, *others: Column) -> DataFrame:
    """(_key, source, _crc, size) of each row, and others; size: words of the whole text."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("_crc"), size.alias("size"), *others)


def favour(size: Column) -> Column:
    """How much a document of some words is favoured: the binary digits of their number, a whole number so that sums are exact."""
    return F.length(F.bin(size)).cast("long")


def levels(lengths: DataFrame, targets: DataFrame, count: int, most: int) -> DataFrame:
    """lengths(source, size, n) -> (source, source_size, target, level, rest): a row for each source.

    Expected copies are least(most, level * favour(size)). From the longest documents on, some are at `most`; the others
    share what is left, so one running sum over a source's lengths finds where that ends. A null level: all are at
    `most`. rest: the target's words beyond whole copies. A source has at most as many lengths as its longest document
    has words, however many documents there are.
    """
    rows = by_source(lengths.where("size > 0"), targets.withColumnRenamed("source", "_s"), count)
    longer = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    words, drawn = F.col("size") * F.col("n"), favour(F.col("size")) * F.col("size") * F.col("n")
    full, before = F.coalesce(F.sum(words).over(longer), F.lit(0)), F.coalesce(F.sum(drawn).over(longer), F.lit(0))
    level = (F.col("target") - most * full) / (F.sum(drawn).over(Window.partitionBy("source")) - before)
    fits = level * favour(F.col("size")) <= most
    found = rows.withColumn("_level", F.when(fits, level)).groupBy("source").agg(F.max_by("_level", F.when(F.col("_level").isNotNull(), F.col("size"))).alias("level"))
    rows = by_source(rows, found.withColumnRenamed("source", "_s"), count)
    whole = rows.groupBy("source").agg(F.sum(F.floor(expected(most)) * words).alias("_whole"))
    out = by_source(targets, found.withColumnRenamed("source", "_s"), count)
    out = by_source(out, whole.withColumnRenamed("source", "_s"), count)
    return out.withColumn("rest", F.greatest(F.col("target") - F.coalesce("_whole", F.lit(0)), F.lit(0.0))).drop("_whole")


def expected(most: int) -> Column:
    """Expected copies of a row of some size with its source's level."""
    return F.least(F.coalesce(F.col("level") * favour(F.col("size")), F.lit(float(most))), F.lit(float(most)))


def ordered(rows: DataFrame, plan: DataFrame, sources: int, salt: str, most: int) -> DataFrame:
    """measured rows with their source's plan, their expected and whole copies, their odds, and the buckets of their ranks."""
    rows = by_source(rows, plan, sources)
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, expected(most)).otherwise(0.0)).withColumn("whole", F.floor("expected"))
    u, p = uniform(F.col("_key"), salt), F.col("expected") - F.col("whole")
    odds = F.when(p > 0, u / (1 - u) / (p / (1 - p)))
    rows = rows.withColumn("odds", odds).withColumn("place", F.when(F.col("odds").isNotNull(), F.col("odds") / (1 + F.col("odds"))))
    fine = F.col("place") * BUCKETS
    return rows.withColumn("b1", F.least(F.floor(fine), F.lit(BUCKETS - 1))).withColumn("b2", F.least(F.floor((fine - F.floor(fine)) * BUCKETS), F.lit(BUCKETS - 1)))


#: The order in which documents are taken: odds, then key, then the text's CRC-32.
ORDER = ["odds", "_key", "_crc"]


def chosen() -> Column:
    """Whether an ordered row comes before its source's border."""
    at, stop = F.struct("b1", "b2"), F.struct("b1_", "b2_")
    mine, theirs = F.struct(*ORDER), F.struct(*(F.col(f"stop.{c}") for c in ORDER))
    within = (at < stop) | ((at == stop) & (F.col("stop").isNull() | (mine < theirs)))
    return F.coalesce(F.col("odds").isNotNull() & (F.col("b1_").isNull() | within), F.lit(False))


class Mix:
    """A mix of sources: for each source its target, the border in the order of its documents, and the filler after it.

    Made from the narrow rows of all documents, and applied to rows with or without texts by joins with these tables
    of one row for each source.
    """

    def __init__(self, rows: DataFrame, weights: tuple[int, ...], most: int, salt: str):
        lengths = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
        targets = cut(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most, weights))
        self.salt, self.most, self.sources = salt, most, targets.count()
        self.plan = cut(levels(lengths, targets, self.sources, most)).withColumnRenamed("source", "_s")
        rows = cut(ordered(rows, self.plan, self.sources, salt, most))
        self.rows = rows
        able = rows.where("odds is not null")

        first = cut(_reached(able.groupBy("source", "b1").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "b1", F.lit(0)))
        inside = able.join(first.select(F.col("source").alias("_s"), F.col("b1").alias("_b"), F.col("before").alias("_before")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("b1") == F.col("_b"))).drop("_s", "_b")
        second = cut(_reached(inside.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("_before").alias("_before")), "b2", F.col("_before")))
        last = inside.drop("_before").join(second.select(F.col("source").alias("_s"), F.col("b2").alias("_b"), F.col("before").alias("_before")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("b2") == F.col("_b"))).drop("_s", "_b")
        ranked = Window.partitionBy("source").orderBy(*ORDER)
        last = last.withColumn("nth", F.row_number().over(ranked)).withColumn("upto", F.col("_before") + F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
        last = last.withColumn("short", F.col("upto") > F.col("rest"))
        # the border: the last bucket, and in it the first row that no longer fits
        border = last.groupBy("source").agg(F.first("b1").alias("b1_"), F.first("b2").alias("b2_"), F.min(F.when(F.col("short"), F.struct(*ORDER, "nth"))).alias("stop"), F.max(F.when(~F.col("short"), F.col("upto"))).alias("got"), F.first("_before").alias("_before"), F.first("rest").alias("gap"))
        border = border.withColumn("gap", F.col("gap") - F.coalesce("got", "_before")).drop("got", "_before").withColumnRenamed("source", "_s")
        self.border = cut(border)
        # the row after these that fills the gap best, if it brings the source nearer
        rest = by_source(rows, self.border, self.sources).where(~chosen()).where("odds is not null and gap > 0 and size < 2 * gap")
        filler = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), *ORDER)).alias("f"))
        self.filler = cut(filler.select(F.col("source").alias("_s"), *(F.col(f"f.{c}").alias(f"f_{c}") for c in ORDER)))

    def applied(self, rows: DataFrame) -> DataFrame:
        """ordered rows with `copies`, how often the mix takes each."""
        rows = by_source(by_source(rows, self.border, self.sources), self.filler, self.sources)
        fills = F.coalesce(F.struct(*ORDER) == F.struct(*(F.col(f"f_{c}") for c in ORDER)), F.lit(False))
        copies = (F.col("whole") + (chosen() | fills).cast("long")).cast("long")
        return rows.withColumn("copies", copies)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, salt: str = ":mix", text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, source, size long, source_size long, target double, expected double, copies long, taken long, text_crc long).

    One row per row of docs. size: words of the whole text (null: 0). Sources in order of code points, null last, weigh
    1, 2, 3, repeating, and share the words of all rows; a source's target is at most `most` times its size. expected: the
    row's copies as expected, which rise with the binary digits of its size. copies: how often the mix takes the row
    whole, at most `most` times; taken: copies times size. A source without words has
    the target 0, and rows without words are never taken. Ties of the key are broken by the text's CRC-32;
    rows alike in both are taken or left together. A null key is a key like any other. An empty table gives none. Reruns agree: chance comes from the key alone.
    """
    mix = Mix(cut(measured(docs, text, source, key)), weights, most, salt)
    rows = mix.applied(mix.rows)
    return rows.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("_crc").alias("text_crc"))


def _reached(sums: DataFrame, bucket: str, base: Column) -> DataFrame:
    """The bucket of each source in which the words, with those of the buckets before, go over the rest."""
    order = Window.partitionBy("source").orderBy(bucket)
    rows = sums.withColumn("upto", base + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words")).where("upto > rest")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, salt: str = ":mix", text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of docs as often as mixed() takes them, with their own columns.

    Texts are not shuffled: each row is judged where it is, by its words and its source's level, border and filler. Other columns
    of docs may have any names.
    """
    mix = Mix(cut(measured(docs, text, source, key)), weights, most, salt)
    rows = measured(docs, text, source, key, F.struct("*").alias("_row"))
    rows = mix.applied(ordered(rows, mix.plan, mix.sources, salt, most)).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
