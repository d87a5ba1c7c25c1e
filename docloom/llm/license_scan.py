"""License scans by ordered signature rules, in DataFrame functions alone.

A document's words are looked up among the rules' keywords. Only near hits are a rule's patterns tried: the one before the
keyword must end at it, the one after must begin there. Detections are put in order of place, and one sweep drops those
that another of the same or a stronger level contains. All of it happens inside the row: nothing is joined or shuffled.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.license_rules import Rule, rules

#: What lies between words, for lower-cased texts.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words before and after a hit that its rules see; every pattern is shorter.
NEAR = 24
#: Detections that are put together before they join the longer list.
PIECE = 64

_RULE = "number int, before string, after string, need string, label string, level int, confidence double, base boolean"
_SPAN = "start int, `end` int, number int, label string, level int, confidence double, base boolean"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@cache
def table() -> tuple[tuple[str, ...], str]:
    """(keywords, the rules of each keyword as JSON)."""
    by_word: dict[str, list[dict]] = {}
    for rule in rules():
        by_word.setdefault(rule.keyword, []).append(shown(rule))
    return tuple(by_word), json.dumps(by_word)


def shown(rule: Rule) -> dict:
    """A rule with patterns that hold the place of the keyword: its end on the left, its start on the right."""
    return {**asdict(rule), "before": rf"(?:^| )({rule.before})\z", "after": rf"\A({rule.after})(?: |\z)"}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _count(spaced: Column) -> Column:
    """Words of a text in which each has one space beside it."""
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))


def _near(words: Column, keywords: tuple[str, ...]) -> Column:
    """(at, word, before, after) of each word that is a keyword."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*keywords), i)), lambda i: i.isNotNull())

    def around(i: Column) -> Column:
        first = F.greatest(i - NEAR, F.lit(0))
        before = F.array_join(F.transform(F.slice(words, first + 1, i - first), lambda w: F.concat(w, F.lit(" "))), "")
        after = F.array_join(F.transform(F.slice(words, i + 2, F.lit(NEAR)), lambda w: F.concat(F.lit(" "), w)), "")
        return F.struct(i.alias("at"), F.element_at(words, i + 1).alias("word"), before.alias("before"), after.alias("after"))

    return F.transform(at, around)


def _found(near: Column, ruled: Column) -> Column:
    """Detections, by start, the longer first, then the stronger level and the rule's number."""

    def tried(h: Column) -> Column:
        fits = lambda r: (
            ((r["need"] == "") | F.contains(h["before"], r["need"]) | F.contains(h["after"], r["need"])) & F.rlike(h["before"], r["before"]) & F.rlike(h["after"], r["after"])
        )
        start = lambda r: h["at"] - _count(F.call_function("regexp_extract", h["before"], r["before"], F.lit(1)))
        end = lambda r: h["at"] + 1 + _count(F.call_function("regexp_extract", h["after"], r["after"], F.lit(1)))
        span = lambda r: F.struct(
            start(r).alias("start"), (-end(r)).alias("back"), r["level"].alias("level"), r["number"].alias("number"), r["label"].alias("label"), r["confidence"].alias("confidence"), r["base"].alias("base"),
        )
        return F.transform(F.filter(F.element_at(ruled, h["word"]), fits), span)

    return F.array_sort(F.flatten(F.transform(near, tried)))


def _kept(found: Column) -> Column:
    """What the sweep leaves: base detections, and those that none before them of their level or a stronger one contains.

    In this order a detection comes after all that contain it, so the furthest ends so far, by level, decide. Kept ones
    gather in short pieces, which keeps the sweep's work in proportion to the detections.
    """
    span = lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), *(d[c].alias(c) for c in ("number", "label", "level", "confidence", "base")))
    pieces, piece = f"array<array<struct<{_ddl(_SPAN)}>>>", f"array<struct<{_ddl(_SPAN)}>>"
    none = F.array().cast(piece)
    start = F.struct(*(F.lit(-1).alias(f"e{k}") for k in (1, 2, 3)), F.array().cast(pieces).alias("done"), none.alias("open"))

    def step(s: Column, d: Column) -> Column:
        end = -d["back"]
        over = F.when(d["level"] == 1, s["e1"]).when(d["level"] == 2, s["e2"]).otherwise(s["e3"])
        stays = d["base"] | (over < end)
        full = F.size(s["open"]) >= PIECE
        ends = [F.when(~d["base"] & (d["level"] <= k), F.greatest(s[f"e{k}"], end)).otherwise(s[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3)]
        done = F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        held = F.when(full, none).otherwise(s["open"])
        return F.struct(*ends, done.alias("done"), F.when(stays, F.concat(held, F.array(span(d)))).otherwise(held).alias("open"))

    return F.aggregate(found, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["open"]))))


def _ddl(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in fields.split(", ")))


def license_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words long, spans array<struct<start, end, number, label, level, confidence, base>>), a row per row of docs.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the whole text with A-Z in lower case, numbered from 0; spans are of words, end
    exclusive, in order of start, the longer first. Base spans always stay. Of the others, one goes if another of its
    level or a stronger one contains it; alike spans of one level leave the rule of the lower number. Null and empty texts
    have no words. Repeated rows and null keys are rows like any other; other columns are ignored.
    """
    keywords, spec = table()
    k, t, gate, words, near, found = "_key", "_text", "_gate", "_words", "_near", "_found"
    rows = docs.select(F.col(key).alias(k), F.coalesce(F.col(text), F.lit("")).alias(t))
    # lower() differs from A-Z alone on letters beyond ASCII, which end no word: it does for counts and the first look
    rows = rows.withColumn(words, F.split(F.lower(t), GAP))
    blank = lambda at: (F.element_at(words, at) == "").cast("int")
    n = F.size(words) - F.when(F.size(words) == 1, blank(1)).otherwise(blank(1) + blank(-1))
    rows = rows.select(k, t, n.cast("long").alias("n_words"), F.arrays_overlap(words, F.array(*map(F.lit, keywords))).alias(gate))
    rows = rows.withColumn(words, F.when(F.col(gate), _words(F.translate(t, _UPPER, _LOWER))).otherwise(F.array().cast("array<string>"))).drop(t)
    rows = rows.withColumn(near, _near(F.col(words), keywords)).drop(words)
    ruled = F.from_json(F.lit(spec), f"map<string, array<struct<{_ddl(_RULE)}>>>")
    rows = rows.withColumn(found, _found(F.col(near), ruled)).drop(near)
    return rows.select(F.col(k).alias(key), "n_words", _kept(F.col(found)).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, places of base phrases, labels and the greatest confidence of license_spans() rows."""
    base = F.filter("spans", lambda s: s["base"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["confidence"])), F.lit(0.0)).alias("score"),
    )
