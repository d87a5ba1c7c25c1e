"""Token counts by heap-and-linked-list byte-pair merging.

A text is split into pieces as the tokenizer's own splitter does; each distinct piece starts as one symbol for each
byte, and the adjacent pair of lowest rank is popped from a heap and merged in a linked list until no pair has a rank.
A text's count is the sum over its pieces of symbols minus merges. No identifiers are emitted.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import _SPACE, byte_alphabet, struct_of, text_buffer, text_runs

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
#: Texts of these characters alone are split here; other texts by the library, whose Unicode tables may differ.
_PLAIN = re.compile("[\t-\r -~¡-ɏ]*")
_PIECE = re.compile(
    rf" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r {_LETTER}{_NUMBER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

#: Units, and pieces, kept in each of two generations of a worker's caches; those of over LONG characters are not kept.
UNITS, PIECES, LONG = 100_000, 300_000, 64


def units(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each run of white space, and n + 1 offsets of the texts into these units.

    No piece of the splitter goes from other characters over to white space, so units are split on their own.
    """
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    blank = _SPACE[raw]
    cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    ends = np.sort(np.concatenate([cuts, offsets]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    column = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return column, np.searchsorted(ends, offsets)


class Kept(dict):
    """A cache of bounded size: the older of two generations is dropped, entries in use are carried over."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key: str) -> int:
        n = self.older.get(key)
        if n is None:
            n = self.compute(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = n
        return n


class Counts:
    """Tokens of texts by their units, and of units by their pieces."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.byte = [vocab[c] for c in byte_alphabet()]
        self.letter = {c: vocab[c] for c in byte_alphabet()}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces = Kept(lambda piece: merged([self.byte[b] for b in piece.encode()], self.ranks), PIECES)
        self.units = Kept(lambda unit: sum(map(self.pieces.__getitem__, _PIECE.findall(unit))), UNITS)

    def totals(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Arrow tells equal units apart, so Python sees each once in a run of texts."""
        column, offsets = units(texts)
        column = column.dictionary_encode()
        distinct = column.dictionary.to_pylist()
        tokens = np.fromiter(map(self.units.__getitem__, distinct), np.int64, len(distinct))
        upto = np.append(0, np.cumsum(tokens[column.indices.to_numpy()]))
        return np.diff(upto[offsets])


def merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Tokens that are left of the symbols: the lowest rank is merged first, at ties the leftmost."""
    n = len(symbols)
    if n < 2:
        return n
    after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.get
    heap = []
    for i in range(n - 1):
        if hit := get((symbols[i], symbols[i + 1])):
            heap.append((hit[0], i, hit[1]))
    heapq.heapify(heap)
    count = n
    while heap:
        rank, i, made = heapq.heappop(heap)
        if symbols[i] < 0 or (j := after[i]) >= n:
            continue
        hit = get((symbols[i], symbols[j]))
        if hit is None or hit[0] != rank:
            continue
        symbols[i], symbols[j] = made, -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if hit := get((made, symbols[k])):
                heapq.heappush(heap, (hit[0], i, hit[1]))
        if (p := before[i]) >= 0 and (hit := get((symbols[p], made))):
            heapq.heappush(heap, (hit[0], p, hit[1]))
    return count


_LOADED: dict[str, tuple] = {}


def _loaded(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED.clear()
        _LOADED[path] = Counts(path), Tokenizer.from_file(path).pre_tokenizer
    return _LOADED[path]


def count_texts(texts: list[str], counts: Counts, splitter) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for a, b in text_runs(texts):
        plain = []
        for i, text in enumerate(texts[a:b], a):
            if special := next((s for s in counts.special if s in text), None):
                parts = text.split(special)  # an added token is one token, and the parts beside it are texts of their own
                out[i] = len(parts) - 1 + count_texts(parts, counts, splitter).sum()
            elif _PLAIN.fullmatch(text):
                plain.append(i)
            else:
                out[i] = sum(merged([counts.letter[c] for c in piece], counts.ranks) for piece, _ in splitter.pre_tokenize_str(text))
        out[plain] = counts.totals([texts[i] for i in plain])
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes long, n_tokens long, over_limit boolean): the tokens of each whole text.

    path: a byte-level BPE file in the JSON form of the tokenizers library, readable on every executor. No begin, end
    or added tokens are counted but those whose strings stand in the text. Null and empty texts have 0 bytes and 0
    tokens. One row per input row, repeated and null keys included; other columns are ignored. Nothing is shuffled. A
    worker keeps at most 2 * (UNITS + PIECES) distinct parts of texts, and a very long piece costs n log n.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, splitter = _loaded(path)
        for batch in batches:
            texts = batch.column(1)
            n = count_texts([t or "" for t in texts.to_pylist()], counts, splitter)
            size = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    schema = struct_of(f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
