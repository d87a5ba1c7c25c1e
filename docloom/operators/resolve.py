"""Detection, diagnostics and references as set operations."""

from __future__ import annotations

from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import words


def priority_pick(detections: DataFrame, doc: str) -> DataFrame:
    """detections(doc, adapter_no, kind, format, priority, reason) -> (doc, status, format, reason): one row for each.

    The match of the highest priority is taken; several there are ambiguous, and their formats are named in order.
    Without a match the invalid detection of the highest priority gives the reason, at ties the first adapter's.
    """
    match, invalid = F.col("kind") == "match", F.col("kind") == "invalid"
    best = F.max(F.when(match, F.col("priority"))).over(Window.partitionBy(doc))
    rows = detections.withColumn("_best", best).groupBy(doc).agg(
        F.array_sort(F.collect_list(F.when(match & (F.col("priority") == F.col("_best")), F.col("format")))).alias("formats"),
        F.max(F.when(invalid, F.struct("priority", (-F.col("adapter_no")).alias("n"), "format", "reason"))).alias("bad"),
    )
    status = F.when(F.size("formats") == 1, "match").when(F.size("formats") > 1, "ambiguous").when(F.col("bad").isNotNull(), "invalid").otherwise("unsupported")
    fmt = F.when(F.size("formats") == 1, F.col("formats")[0]).when(F.size("formats") == 0, F.col("bad.format"))
    reason = F.when(F.size("formats") > 1, F.array_join("formats", ", ")).when(F.size("formats") == 0, F.col("bad.reason"))
    return rows.select(doc, status.alias("status"), fmt.alias("format"), reason.alias("reason"))


def availability(catalog: DataFrame, tools: list[str]) -> DataFrame:
    """catalog(format, extensions, requires) with missing tools, in declared order, and the reason."""
    missing = F.array_except("requires", F.array(*map(F.lit, tools)).cast("array<string>"))
    rows = catalog.withColumn("missing", missing).withColumn("available", F.size("missing") == 0)
    return rows.withColumn("reason", F.when(~F.col("available"), F.concat(F.lit("missing required tool: "), F.array_join("missing", ", "))))


def column_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `line`: columns padded to the longest value and two blanks, the last as it is."""
    every = Window.partitionBy()
    parts = [F.rpad(F.col(c), F.max(F.length(c)).over(every) + 2, " ") for c in columns[:-1]]
    return rows.withColumn("line", F.concat(*parts, F.col(columns[-1])))


def warning_union(*lists: Column) -> Column:
    """Warnings of several sources, each once, in order of first occurrence."""
    return F.array_distinct(F.concat(*lists))


def flagged(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)), lambda x: x.isNotNull())


def folded(name: Column) -> Column:
    """The name without case, alike for texts that are canonically equivalent: full case folding of decomposed text.

    Names of ASCII are folded where they are; others go through Python, a batch at a time.
    """
    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda x: normalize("NFD", normalize("NFD", x).casefold()), na_action="ignore")

    plain = name.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, F.lower(name)).otherwise(fold(F.when(~plain, name)))


def name_collisions(entries: DataFrame, doc: str, name: str) -> DataFrame:
    """(doc, key, n): names that are equal without a trailing slash and without case, more than once."""
    key = folded(F.regexp_replace(name, r"/\z", ""))
    return entries.select(doc, key.alias("key")).groupBy(doc, "key").agg(F.count("*").alias("n")).where("n > 1")


def entry_collisions(entries: DataFrame, doc: str, *readings: str) -> DataFrame:
    """(doc, reading, key, n): collisions of each reading of the entries' names by itself.

    A package's entry has a name as its bytes are decoded and one that an extra field may give; a reader of either must
    not see one file overwrite another. A null name is no name.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("reading"), F.col(r).alias("name")) for r in readings)))
    names = entries.select(doc, each.alias("_e")).select(doc, "_e.*").where("name is not null")
    keys = names.select(doc, "reading", folded(F.regexp_replace("name", r"/\z", "")).alias("key"))
    return keys.groupBy(doc, "reading", "key").agg(F.count("*").alias("n")).where("n > 1")


def sequential_names(refs: DataFrame, doc: str, pos: str, ref: str, ext: str) -> DataFrame:
    """(doc, ref, asset): image01.ext, image02.ext ... by first occurrence; each reference once."""
    first = refs.groupBy(doc, ref).agg(F.min(pos).alias("_first"), F.first(ext).alias("_ext"))
    n = F.row_number().over(Window.partitionBy(doc).orderBy("_first", ref))
    return first.select(doc, ref, F.concat(F.format_string("image%02d", n), F.when(F.col("_ext") == "", "").otherwise(F.concat(F.lit("."), F.lower("_ext")))).alias("asset"))


def unreferenced(files: DataFrame, refs: DataFrame, doc: str, name: str) -> DataFrame:
    """Files of a document that nothing refers to, without hidden ones."""
    return files.where(~F.col(name).startswith(".")).join(refs.select(doc, name).distinct(), [doc, name], "left_anti")


def word_retention(source: DataFrame, result: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n_words, n_kept, retained): at least four fifths of the source's words, as a bag, are in the result."""
    bag = lambda df, n: df.select(doc, F.explode(words(F.col(text))).alias("w")).groupBy(doc, "w").agg(F.count("*").alias(n))
    both = bag(source, "a").join(bag(result, "b"), [doc, "w"], "left")
    sums = both.groupBy(doc).agg(F.sum("a").alias("n_words"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("n_kept"))
    rows = source.select(doc).join(sums, doc, "left").fillna(0, ["n_words", "n_kept"])
    return rows.withColumn("retained", (F.col("n_words") == 0) | (F.col("n_kept") >= F.greatest(F.lit(1), F.expr("n_words * 4 div 5"))))


#: Exit codes by kind of error.
EXIT_CODES = {
    "usage": 64, "unsupported_input": 65, "invalid_input": 65, "ambiguous_input": 65, "unsafe_reference": 65, "missing_input": 66, "missing_tool": 69,
    "tool_failed": 70, "output_exists": 73, "output_parent_missing": 73, "output_inside_input": 73, "io": 74,
}


def exit_code(kind: Column) -> Column:
    """The exit code of a kind of error; 70 for kinds without one."""
    table = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(70))
