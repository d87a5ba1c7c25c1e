"""Column functions on text: escapes, fences, trims, list markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def gfm_cell(c: Column) -> Column:
    """A table cell: backslash first, then the pipe, then CRLF, CR and LF as a break."""
    return _replaced(c, ("\\", "\\\\"), ("|", "\\|"), ("\r\n", "<br>"), ("\r", "<br>"), ("\n", "<br>"))


def tsv_cell(c: Column) -> Column:
    """A reversible cell: backslash first, then line ends and tabs as escapes."""
    return _replaced(c, ("\\", "\\\\"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t"))


def heading(c: Column) -> Column:
    """One line: line ends become spaces, nothing else is escaped."""
    return _replaced(c, ("\r\n", " "), ("\r", " "), ("\n", " "))


def longest_run(c: Column, mark: str = "`") -> Column:
    """Length of the longest run of a character."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"({mark}+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence(c: Column) -> Column:
    """A fence that no run of backticks in the text can close."""
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(c) + 1))


def inline_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>~&])", r"\\$1")


def leading_escape(c: Column) -> Column:
    """A paragraph that would start a block: markers are escaped, four spaces or a tab become non-breaking spaces."""
    four = "&nbsp;" * 4
    return (
        F.when(c.startswith("    "), F.concat(F.lit(four), F.substring(c, 5, 1 << 30)))
        .when(c.startswith("\t"), F.concat(F.lit(four), F.substring(c, 2, 1 << 30)))
        .when(c.rlike(r"^[#\-+=]"), F.concat(F.lit("\\"), c))
        .when(c.rlike(r"^\p{N}+[.)]"), F.regexp_replace(c, r"^(\p{N}+)([.)])", r"$1\\$2"))
        .otherwise(c)
    )


def is_blank(c: Column) -> Column:
    """Whether a line has nothing but spaces and tabs."""
    return c.rlike(r"\A[ \t]*\z")


def list_indent(c: Column) -> Column:
    """Where a list item's content begins: the width of its indentation, and the marker and the blanks after it, a
    column each; null without a marker."""
    marker = r"\A([ \t]*)((?:[-*+]|[0-9]{1,9}[.)])[ \t]+)"
    return F.when(c.rlike(marker), indent_width(F.regexp_extract(c, marker, 1)) + F.length(F.regexp_extract(c, marker, 2)))


def indent_width(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("\t"), F.lit("    ")))


def bullet_line(c: Column) -> Column:
    """Whether a line is an emphasised bullet and nothing else but Unicode spaces and tabs."""
    return c.rlike(r"\A[\p{Zs}\t*_]*+•[\p{Zs}\t*_]*+\z")


def hard_break(c: Column) -> Column:
    """Whether a line ends with an odd number of backslashes, which are counted from the end only."""
    return c.endswith("\\") & (~c.endswith("\\\\") | ((F.length(c) - F.length(F.rtrim(c, F.lit("\\")))) % 2 == 1))


def plain_rule(c: Column) -> Column:
    r"""A line of three or more escaped underscores, and nothing after them, becomes plain underscores."""
    return F.when(c.rlike(r"\A[ \t]*(\\_){3,}\z"), F.replace(c, F.lit("\\_"), F.lit("_"))).otherwise(c)


def plain_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, r"^([ \t]*)\\-", "$1-")


def unwrapped_items(html: Column) -> Column:
    """List items whose only content is one paragraph of inline elements lose the paragraph."""
    return F.regexp_replace(html, LIST_ITEM, "$1$2$3")


#: Elements that may stand inside an unwrapped list item.
INLINE_ELEMENTS = "a abbr b br cite code del em i ins kbd mark q s samp small span strong sub sup u var".split()
LIST_ITEM = rf"(?is)(<li(?:\s[^>]*)?>)\s*<p(?:\s[^>]*)?>((?:[^<]|</?(?:{'|'.join(INLINE_ELEMENTS)})(?:\s[^>]*)?/?>)*)</p>\s*(</li>)"


def words(c: Column) -> Column:
    """Lower-case words of letters, marks and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
