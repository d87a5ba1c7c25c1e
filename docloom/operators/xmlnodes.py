"""Questions about XML parts as predicates, joins and windows over a table of elements (docloom.sources.nodes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import refs

#: Namespaces and names of what inspections look for.
WORD = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main")
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE_RELATIONSHIPS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
OFFICE, TEXT, DRAW = (f"urn:oasis:names:tc:opendocument:xmlns:{x}:1.0" for x in ("office", "text", "drawing"))
XLINK = "http://www.w3.org/1999/xlink"
CHANGES = ("ins", "del", "moveFrom", "moveTo")
#: Parts that inspections() and the workbook functions need.
PARTS = r"word/document\.xml|word/comments\.xml|content\.xml|.*\.rels|xl/workbook\.xml|xl/sharedStrings\.xml"


def is_element(ns: str, *names: str) -> Column:
    return (F.col("ns") == ns) & F.col("name").isin(*names)


def descendants(ancestors: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes that lie within an ancestor of the same part, each with `above`, the ancestor's place.

    A structural join: parts meet by equality, and a place lies in an interval. Ancestors may lie within each other.
    """
    up = ancestors.select(F.col("path").alias("_path"), F.col("part").alias("_part"), F.col("pre").alias("above"), F.col("last").alias("_last"))
    on = (F.col("path") == F.col("_path")) & (F.col("part") == F.col("_part")) & (F.col("pre") > F.col("above")) & (F.col("pre") <= F.col("_last"))
    return nodes.join(up, on).drop("_path", "_part", "_last")


def inside(nodes: DataFrame, anchor: Column) -> DataFrame:
    """nodes with `above`: the place of the anchor that an element is, or lies in; null for those in none.

    For anchors that don't lie within each other: the last one that began decides, so a window over a part is enough.
    """
    began = F.last(F.when(anchor, F.struct("pre", "last")), ignorenulls=True).over(Window.partitionBy("path", "part").orderBy("pre"))
    return nodes.withColumn("_a", began).withColumn("above", F.when(F.col("pre") <= F.col("_a.last"), F.col("_a.pre"))).drop("_a")


def inspections(nodes: DataFrame) -> DataFrame:
    """(path, comments, changes, odt_changes, unsafe): what each text document holds that Markdown can't show.

    Comments and tracked changes count only in the namespace of a part's own root. unsafe: the first, by order of text, of
    the images that lead out of the package: external image relationships, and references of drawn images. Packages of
    another kind, and those with none of this, have a row with no and null.
    """
    word, comment = F.col("part") == "word/document.xml", F.col("part") == "word/comments.xml"
    content, rels = F.col("part") == "content.xml", F.col("part").endswith(".rels")
    marked = word & F.col("ns").isin(*WORD) & F.col("name").isin("commentRangeStart", *CHANGES)
    mode, kind = F.lower(F.coalesce(F.col("attrs")["TargetMode"], F.lit(""))), F.coalesce(F.col("attrs")["Type"], F.lit(""))
    outside = rels & is_element(RELATIONSHIPS, "Relationship") & (mode == "external") & kind.endswith("/image")
    href = F.coalesce(F.col("attrs")["{%s}href" % XLINK], F.lit(""))
    image = content & is_element(DRAW, "image") & (refs.unsafe_package_reference(href) | F.split_part(href, F.lit("/"), F.lit(1)).contains(":"))
    told = F.when(outside, F.coalesce(F.col("attrs")["Target"], F.lit(""))).when(image, href)
    root = word & (F.col("depth") == 0) & (F.col("name") == "document")
    # marks and roots are counted by namespace side by side, so the elements are gone through once and nothing is joined
    own = lambda when, k: F.coalesce(F.bool_or(when & (F.col("ns") == WORD[k])), F.lit(False))
    found = lambda when: F.greatest(*(own(root, k) & own(when, k) for k in range(len(WORD))))
    any_ = lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    commented = (comment & (F.col("name") == "comment")) | (content & is_element(OFFICE, "annotation"))
    return nodes.groupBy("path").agg(
        (any_(commented) | found(marked & (F.col("name") == "commentRangeStart"))).alias("comments"), found(marked & F.col("name").isin(*CHANGES)).alias("changes"),
        any_(content & is_element(TEXT, "tracked-changes")).alias("odt_changes"), F.min(told).alias("unsafe"),
    )


def sheet_list(nodes: DataFrame) -> DataFrame:
    """(path, sheet_no from 0, name, rel, error): the sheets that a workbook declares, in order."""
    rows = nodes.where((F.col("part") == "xl/workbook.xml") & is_element(SHEET, "sheet"))
    name, rel = F.col("attrs")["name"], F.col("attrs")["{%s}id" % OFFICE_RELATIONSHIPS]
    nth = (F.row_number().over(Window.partitionBy("path").orderBy("pre")) - 1).alias("sheet_no")
    return rows.select("path", nth, name.alias("name"), rel.alias("rel"), F.when(name.isNull() | rel.isNull(), F.lit("an XLSX sheet declaration is incomplete")).alias("error"))


def shared_strings(nodes: DataFrame) -> DataFrame:
    """(path, idx from 0, text): the items of shared-string tables; the texts of an item's runs, joined in order."""
    part = nodes.where(F.col("part") == "xl/sharedStrings.xml")
    item = is_element(SHEET, "si") & (F.col("depth") == 1)
    rows = inside(part.where(is_element(SHEET, "si", "t")), item).where("above is not null")
    runs = F.array_sort(F.collect_list(F.when(F.col("name") == "t", F.struct("pre", "text"))))
    items = rows.groupBy("path", "above").agg(F.array_join(F.transform(runs, lambda r: r["text"]), "").alias("text"))
    return items.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("above")) - 1).alias("idx"), "text")
