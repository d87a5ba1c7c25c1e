"""Image references of a table of HTML: each document's references, its assets, and its text with references rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import image_columns as images

#: What is wrong with a document's images.
UNSAFE = "The generated document contains an unsafe image reference: "
MISSING = "generated image resource is missing: "


def image_references(docs: DataFrame, doc: str, html: str = "html") -> DataFrame:
    """(doc, pos, reference, file): a row for each image source; file is null where the reference leads elsewhere."""
    rows = docs.select(doc, F.posexplode(images.references(F.col(html))).alias("pos", "reference"))
    return rows.withColumn("file", images.resolved(F.col("reference")))


def rewrite_images(docs: DataFrame, doc: str, html: str = "html", files: str | None = None) -> DataFrame:
    """(doc, html, assets array<struct<asset, file>>, error): references become images/image01.ext and so on.

    A file gets one name, by its first place, however often and in whatever writing it is referred to. files: a column
    with the names that a document has; a reference to any other is an error. A document with an unsafe or missing
    reference has the error of its first such place, no html and no assets. A null html stays null, without an error.
    Documents are rewritten in place: the only rows that meet are a document's own references, inside its row.
    """
    rows = docs.select(doc, F.col(html).alias("_html"), (F.col(files) if files else F.lit(None).cast("array<string>")).alias("_files"))
    rows = rows.withColumn("_refs", F.transform(images.references(F.col("_html")), lambda r: F.struct(r.alias("reference"), images.resolved(r).alias("file"))))
    missing = lambda r: F.when(r["file"].isNull(), F.concat(F.lit(UNSAFE), r["reference"])).when(~F.array_contains("_files", r["file"]), F.concat(F.lit(MISSING), F.element_at(F.split(r["file"], "/"), -1)))
    rows = rows.withColumn("error", F.get(F.filter(F.transform("_refs", missing), lambda e: e.isNotNull()), F.lit(0)))
    rows = rows.withColumn("_named", F.array_distinct(F.transform("_refs", lambda r: r["file"]))).withColumn("_assets", images.asset_names(F.col("_named")))
    place = lambda r: F.concat(F.lit("images/"), images.encoded(F.element_at("_assets", F.array_position("_named", r["file"]).cast("int"))))
    good = F.col("error").isNull()
    return rows.select(
        doc, F.when(good, images.replaced(F.col("_html"), F.transform("_refs", place))).alias("html"),
        F.when(good, F.transform(F.arrays_zip("_assets", "_named"), lambda z: F.struct(z["_assets"].alias("asset"), z["_named"].alias("file")))).alias("assets"), "error",
    )
