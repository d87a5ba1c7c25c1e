"""Column functions on references: cell addresses, paths, links, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def a1_column(ref: Column) -> Column:
    """Column of a cell address, from 0: letters in base 26 up to the first other character; null if none or too many."""
    letters = F.regexp_extract(F.upper(ref), "^([A-Z]+)", 1)
    number = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, x: a * 26 + F.ascii(x) - 64)
    return F.when((letters != "") & (F.length(letters) <= 12), number - 1)


def a1_row(ref: Column) -> Column:
    """Row of a cell address, from 0."""
    digits = F.regexp_extract(ref, "^[A-Za-z]+([1-9][0-9]{0,17})$", 1)
    return F.when(digits != "", digits.cast("long") - 1)


def a1_range(ref: Column) -> Column:
    """struct(r0, c0, r1, c1) of an address or of two joined by a colon, corners in order; null if malformed."""
    first, last = F.split_part(ref, F.lit(":"), F.lit(1)), F.when(F.instr(ref, ":") > 0, F.split_part(ref, F.lit(":"), F.lit(2))).otherwise(ref)
    r, c, s, d = a1_row(first), a1_column(first), a1_row(last), a1_column(last)
    ok = r.isNotNull() & c.isNotNull() & s.isNotNull() & d.isNotNull() & (F.length(F.regexp_replace(ref, "[^:]", "")) <= 1)
    return F.when(ok, F.struct(F.least(r, s).alias("r0"), F.least(c, d).alias("c0"), F.greatest(r, s).alias("r1"), F.greatest(c, d).alias("c1")))


def has_scheme(ref: Column) -> Column:
    return ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def unsafe_package_reference(ref: Column) -> Column:
    """Whether a reference in a package may lead out of it."""
    return (ref == "") | has_scheme(ref) | ref.startswith("/") | F.contains(ref, F.lit("\\")) | ref.rlike(r"(^|/)\.\.(/|$)")


def part_path(target: Column, base: str = "xl/") -> Column:
    """A relationship's target as a part name under base; null if it is empty, leaves base or names a scheme."""
    bad = (target == "") | F.contains(target, F.lit("\\")) | has_scheme(target) | target.rlike(r"(^|/)\.\.(/|$)")
    full = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.lit(base), F.regexp_replace(target, r"^(\./)+", "")))
    return F.when(~bad & full.startswith(base), full)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/?$", 1), r"(?<=.)\.[^.]*$", "")


#: The first bytes of ZIP packages and of OLE compound files.
ZIP_SIGNATURES = ("504B0304", "504B0506", "504B0708")
OLE_SIGNATURE = "D0CF11E0A1B11AE1"


def signature(content: Column) -> Column:
    """zip, ole, rtf or none, from the first bytes alone."""
    head = F.hex(F.substring(content, 1, 8))
    rtf = F.decode(F.substring(content, 1, 32), "ISO-8859-1").rlike(r"^\{\\rtf[0-9]")
    return F.when(F.substring(head, 1, 8).isin(*ZIP_SIGNATURES), "zip").when(head == OLE_SIGNATURE, "ole").when(rtf, "rtf").otherwise("none")


def chromatic(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Whether a colour (0 to 1) is visible and not grey."""
    return (F.greatest(r, g, b) - F.least(r, g, b) > 0.02) & (a > 0.01)


def section_path(reference: Column) -> Column:
    """struct(path, problem): a master document's section as a path below the master's folder, or unsafe or leaves."""
    raw = F.regexp_replace(reference, r"(?s)#.*\z", "")
    plain = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    unsafe = raw.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:") | raw.contains("?") | plain.isNull() | (plain == "") | plain.startswith("/") | plain.contains("\\")
    parts = F.split(plain, "/")
    path = F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/")
    problem = F.when(F.coalesce(unsafe, F.lit(True)), "unsafe").when(F.array_contains(parts, ".."), "leaves")
    return F.struct(F.when(problem.isNull(), path).alias("path"), problem.alias("problem"))
