"""Image references of HTML as column functions: found by position, resolved, named, and put back, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.images import IMAGE

_ALONE = "\N{REPLACEMENT CHARACTER}"


def references(html: Column) -> Column:
    """The sources of all images, in order."""
    return F.regexp_extract_all(html, F.lit(f"(?i){IMAGE}"), F.lit(2))


def decoded(c: Column) -> Column:
    """Percent signs resolved; a text in which they don't stand for UTF-8 stays as it is. A plus is a plus."""
    found = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = found.isNull() | (found.contains(_ALONE) & ~c.contains(_ALONE) & ~F.upper(c).contains("%EF%BF%BD"))
    return F.when(broken, c).otherwise(found)


def resolved(reference: Column) -> Column:
    """The file below the document's own folder that a reference names; null for what leads elsewhere.

    An address of a file names the last part of its path, as its folder is not kept. Any other scheme, an absolute path,
    a backslash and a part . or .. (but for ./ in front) lead elsewhere.
    """
    plain = F.replace(reference, F.lit("&amp;"), F.lit("&"))
    path = F.regexp_replace(decoded(plain), r"\A(?:\./)+", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(?<=[^/])/\z", "")
    bad = (path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"(?:\A|/)\.\.?(?:/|\z)")
    file = decoded(F.regexp_extract(F.regexp_replace(plain, r"(?i)\Afile:(?://[^/]*)?", ""), r"([^/?#]*)/*(?:[?#].*)?\z", 1))
    return F.when(F.lower(plain).startswith("file:"), F.when(~file.isin("", ".", ".."), file)).when(plain.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), None).otherwise(F.when(~bad, path))


def encoded(c: Column) -> Column:
    """One part of a path: letters, marks, digits and -._~ as they are, all else as percent signs."""
    one = lambda x: F.when(x.rlike(r"\A[\p{L}\p{M}\p{N}\-._~]\z"), x).otherwise(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    return F.when(c.rlike(r"\A[A-Za-z0-9\-._~]*\z"), c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def asset_names(files: Column) -> Column:
    """image01.ext, image02.ext ... for files in order; the extension is the file's in lower case."""

    def name(file: Column, i: Column) -> Column:
        suffix = F.lower(F.regexp_extract(file, r"[^/]\.([^./]+)\z", 1))
        return F.concat(F.lit("image"), F.lpad((i + 1).cast("string"), F.greatest(F.lit(2), F.length((i + 1).cast("string"))), F.lit("0")), F.when(suffix == "", "").otherwise(F.concat(F.lit("."), suffix)))

    return F.transform(files, name)


def replaced(html: Column, places: Column) -> Column:
    """html with the source of its image number i replaced by places[i]: cut at the images, and joined again."""
    pattern = F.lit(f"(?i){IMAGE}")
    heads, tails = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(3))
    between = F.split(html, f"(?i){IMAGE}", -1)
    parts = F.transform(F.arrays_zip(heads.alias("head"), places.alias("place"), tails.alias("tail"), F.slice(between, 2, 1 << 30).alias("rest")), lambda p: F.concat(p["head"], p["place"], p["tail"], p["rest"]))
    return F.concat(F.get(between, F.lit(0)), F.array_join(parts, ""))
