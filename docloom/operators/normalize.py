"""Markdown as a converter writes it, made plain: a fold over the lines of each text, inside its row.

What the rules need of a line's start is taken from the whole text by one pattern, so most lines meet no other. The fold
then knows which lines are code: its state is the open fence, the open list items' indents, the blanks seen since the last
other line, and whether that was code. It writes one character a line. Which empty lines go is told by a pattern over one
character a line as well, and only for texts that have something to lose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text

#: A line's start: its blanks, then a list marker and the blanks after it, or a whole line with a fence's mark, or a character.
_START = r"\G([ \t]*+(?:(?:[-*+]|[0-9]{1,9}[.)])[ \t]++|(?:`{3}|~{3})[^\n]*+|[^\n])?)[^\n]*+\n"
_FENCE = r"\A {0,3}(`{3,}|~{3,})"
_BLANK, _OTHER, _ITEM, _OPENS, _ALONE = range(5)
#: What the fold has written is put away in pieces of this many lines, so that a step never copies all of it.
_PIECE = 2048


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which the value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _feature(start: Column) -> Column:
    """Of a line's start: what it is, its indent, where an item's content begins, and a fence's mark. A mark that opens
    nothing is as any other text; one that stands alone may close a fence."""
    fields = ("kind", "indent", "item", "mark")
    told = lambda kind, indent, item=0, mark="": F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in zip(fields, (kind, indent, item, mark))))
    n, lead = F.length(start), F.length(start) - F.length(F.ltrim(start))
    indent = text.indent_width(F.regexp_extract(start, r"\A[ \t]*", 0))
    mark = F.regexp_extract(start, _FENCE, 1)
    opens = F.when(start.rlike(r"\A {0,3}(?:`{3,}|~{3,})[ \t]*+\z"), _ALONE).when((mark != "") & ~start.rlike(r"\A {0,3}`{3,}+[^`]*`"), _OPENS)
    return (
        F.when(start == "", told(_BLANK, 0))
        .when(start.contains("```") | start.contains("~~~"), told(F.coalesce(opens, F.lit(_OTHER)), indent, 0, mark))
        .when(start.contains("\t"), told(F.when(text.is_blank(start), _BLANK).when(text.list_indent(start).isNotNull(), _ITEM).otherwise(_OTHER), indent, F.coalesce(text.list_indent(start), F.lit(0))))
        .when(~start.endswith(" "), told(_OTHER, n - 1))
        .otherwise(_bound(lead, lambda i: F.when(i == n, told(_BLANK, n)).otherwise(told(_ITEM, i, n))))
    )


def code_flags(features: Column) -> Column:
    """A text of 1 for each line of code and 0 for each other: fenced lines, lines indented by four beyond their list
    item, and the blank lines between two lines of code."""
    fields = ("mark", "items", "last", "run", "code", "flags", "done")
    state = lambda *values: F.struct(*(v.alias(c) for c, v in zip(fields, values)))
    nothing, none, zero = F.lit(""), F.array().cast("array<int>"), F.lit(0)
    start = state(nothing, none, zero, zero, F.lit(False), nothing, F.array().cast("array<string>"))

    def step(s: Column, f: Column) -> Column:
        def moved(mark: Column, items: Column, last: Column, code: bool) -> Column:
            flag = F.lit("1" if code else "0")
            flags = F.when(s["run"] == 0, F.concat(s["flags"], flag)).otherwise(F.concat(s["flags"], F.repeat(F.when(s["code"], flag).otherwise("0"), s["run"]), flag))
            return F.when(F.octet_length(s["flags"]) < _PIECE, state(mark, items, last, zero, F.lit(code), flags, s["done"])).otherwise(
                state(mark, items, last, zero, F.lit(code), nothing, F.concat(s["done"], F.array(flags)))
            )

        def within(items: Column, last: Column) -> Column:
            told = F.when(f["indent"] >= last + 4, moved(nothing, items, last, True)).when(f["kind"] >= _OPENS, moved(f["mark"], items, last, True))
            return told.when(f["kind"] == _ITEM, moved(nothing, F.concat(items, F.array(f["item"])), f["item"], False)).otherwise(moved(nothing, items, last, False))

        ends = (f["kind"] == _ALONE) & (F.substring(f["mark"], 1, 1) == F.substring(s["mark"], 1, 1)) & (F.length(f["mark"]) >= F.length(s["mark"]))
        held = state(s["mark"], s["items"], s["last"], s["run"] + 1, s["code"], s["flags"], s["done"])
        # items grow inwards: while the last one stays, all do
        fewer = F.filter(s["items"], lambda x: x <= f["indent"])
        return (
            F.when(s["mark"] != "", moved(F.when(ends, "").otherwise(s["mark"]), s["items"], s["last"], True))
            .when(f["kind"] == _BLANK, held)
            .when(s["last"] <= f["indent"], within(s["items"], s["last"]))
            .when(f["indent"] < 2, within(none, zero))
            .otherwise(_bound(fewer, lambda items: _bound(F.coalesce(F.try_element_at(items, F.lit(-1)), zero), lambda last: within(items, last))))
        )

    return F.aggregate(features, start, step, lambda s: F.concat(F.array_join(s["done"], ""), s["flags"], F.repeat(F.lit("0"), s["run"])))


def plain_line(line: Column, following: Column) -> Column:
    """One line that is not code, by the first rule that fits: bullet, hard break, rule, hyphen. following is what the
    next line is, blank after the last. Plain tests go first, as few lines need a pattern."""
    body = F.substring(line, F.lit(1), F.length(line) - 1)
    bare = F.when(body.endswith(" ") | body.endswith("\t"), F.rtrim(body, F.lit(" \t"))).otherwise(body)
    broken = F.when(line.rlike(r"\A[\p{Zs}\t]*+[*_]*+[\p{Zs}\t]*+\\\z"), "  ").when(following.isin(_BLANK, _ITEM), bare).otherwise(F.concat(bare, F.lit("  ")))
    return (
        F.when(text.hard_break(line), broken)
        .when(line.contains("\\"), text.plain_hyphen(text.plain_rule(line)))
        .when(line.contains("•") & text.bullet_line(line), F.concat(F.regexp_extract(line, r"\A[ \t]*", 0), F.lit("-")))
        .otherwise(line)
    )


def kept_flags(lines: Column, code: Column) -> Column:
    """A text of k for each line that stays, g for each that goes. An empty line that is no code goes beside a line of
    blanks alone, and between two lone hyphens; the line before it is the last that stayed, and the last line of all stays.

    So behind a line of blanks (s) all empty lines (e) go, before one the last goes unless it is the first line of all, and
    between hyphens (l) only a single one: no other state is carried on."""
    kind = lambda x: F.when(x.rlike(r"\A[ \t]++\z"), "s").when(x.contains("-") & x.rlike(r"\A[\p{Zs}\t]*+-[\p{Zs}\t]*+\z"), "l").otherwise("k")
    kinds = F.transform(F.arrays_zip(lines.alias("x"), code.alias("code")), lambda z: F.when(z["x"] != "", kind(z["x"])).when(z["code"] == "1", "k").otherwise("e"))
    return F.regexp_replace(F.array_join(kinds, ""), r"(?:(?<=s)|(?!\A)\G)e(?!\z)|(?<!\A)e(?=s)|(?<=l)e(?=l)", "g")


def _plain_text(lines: Column, features: Column) -> Column:
    def joined(plain: Column, code: Column) -> Column:
        losing = lambda t: t.rlike(r"(?md)^(?:[ \t]++|[\p{Zs}\t]*+-[\p{Zs}\t]*+)$")
        left = F.filter(F.zip_with(plain, F.split(kept_flags(plain, code), ""), lambda x, k: F.when(k != "g", x)), lambda x: x.isNotNull())
        return _bound(F.array_join(plain, "\n"), lambda t: F.when(losing(t), F.array_join(left, "\n")).otherwise(t))

    def ruled(code: Column) -> Column:
        each = F.arrays_zip(lines.alias("x"), code.alias("code"), F.slice(features, 2, 1 << 30).alias("next"))
        plain = F.transform(each, lambda z: F.when(z["code"] == "1", z["x"]).otherwise(plain_line(z["x"], z["next"]["kind"])))
        return _bound(plain, lambda p: joined(p, code))

    return _bound(F.slice(F.split(code_flags(features), ""), F.lit(1), F.size(lines)), ruled)


def normalized(docs: DataFrame, key: str, text_column: str, out: str = "markdown") -> DataFrame:
    """(key, out): hard breaks as two spaces, plain bullets, rules and hyphens, compact blanks; code stays as it is.

    CRLF counts as LF; a final line end stays. A null text stays null. Nothing is shuffled and no Python runs. Arrays that
    go with the lines are bound inside one expression: as columns they would be copied from row to row, texts and all.
    """

    def plain(whole: Column) -> Column:
        final = whole.endswith("\n")
        body = F.when(final, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
        return F.concat(_bound(body, of_lines), F.when(final, "\n").otherwise(""))

    def of_lines(body: Column) -> Column:
        # with a blank line at the end, so that the last line has a next one
        starts = F.regexp_extract_all(F.concat(body, F.lit("\n\n")), F.lit(_START), F.lit(1))
        return _bound(F.split(body, "\n"), lambda lines: _bound(F.transform(starts, _feature), lambda features: _plain_text(lines, features)))

    return docs.select(F.col(key), _bound(F.replace(F.col(text_column), F.lit("\r\n"), F.lit("\n")), plain).alias(out))
