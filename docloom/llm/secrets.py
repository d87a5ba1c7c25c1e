"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns near hits only, then embedded checksums."""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import struct_of

#: Kinds in the order in which spans with the same start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "checked_token", "private_key", "web_token")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_SAMPLE = re.compile(r"[0-9a-f]{4,}")
_TOKEN = re.compile(r"(?:gh[opsru]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_WEB = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")

#: keyword (ASCII lower case) -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "checked_token", "gho_": "checked_token", "ghu_": "checked_token", "ghs_": "checked_token", "ghr_": "checked_token", "npm_": "checked_token",
    "-----begin": "private_key",
    "eyj": "web_token",
}

_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def base62(value: int, width: int) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out.rjust(width, "0")


def checked(match: re.Match) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before them, in base 62."""
    return base62(zlib.crc32(match[1].encode()), 6) == match[2]


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 24 or more. Such a run holds at least four sampled characters in a row, so only these places are read."""
    for hit in _HEX_SAMPLE.finditer(text[5::6]):
        start, end = 6 * hit.start(), 6 * hit.end() + 5
        for m in _HEX.finditer(text, start, end):
            yield m.span()


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str, keywords) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; leftmost and not overlapping within a kind."""
    spans = [("hex", a, b) for a, b in hex_runs(text)]
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_ASCII_LOWER)
    over = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in keywords.iter(lower))
    for start, kind in hits:
        if start < over[kind]:
            continue
        pattern = {"assign": _ASSIGN, "access": _ACCESS, "checked_token": _TOKEN, "private_key": _KEY, "web_token": _WEB}[kind]
        if not (m := pattern.match(text, start)):
            continue
        if kind == "checked_token" and not checked(m):
            continue
        over[kind] = m.end()
        if kind == "assign" and len(m[1]) < 6 or kind == "access" and m.end() - start < 20:
            continue
        spans.append((kind, start, m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, secrets array<struct<kind, start, end>>): code points, end exclusive, by start and then by KINDS.

    Kinds: assigned passwords, access key ids, long lower-case hexadecimal runs, service tokens whose embedded CRC-32
    holds, private key headers, signed web tokens. Whole texts are read; null and empty texts have no spans. One row
    per input row, repeated and null keys included; other columns are ignored. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t, keywords)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, form)], names=[key, "secrets"])

    schema = struct_of(f"`{key}` {kind}, secrets array<struct<kind:string,start:int,end:int>>")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of secret_spans() rows."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )
