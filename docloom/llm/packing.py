"""Best-fit packing by minimum bin slack.

Only the numbers of pieces of each length (at most `capacity` of them) reach the driver. Per bin, a subset-sum bitset
over the lengths at hand finds the fullest feasible combination; it is removed as often as the counts allow, so the plan
grows with the number of lengths, not with the corpus. Pieces are then numbered within their length, in blocks, and
each finds its place in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_alphabet, cut, fresh, struct_of, text_runs

#: Words, and pieces of at most LONG characters, that a worker keeps with their identifiers before it starts anew.
CACHE, CHARS, LONG = 300_000, 6_000_000, 64
#: Blocks in which the rows of one group are numbered, at least, and rows of a table for each block more.
BLOCKS, BLOCK_ROWS = 64, 100_000

_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Texts of these characters alone are split here; other texts go to the library whole.
_PLAIN = re.compile("[\t-\r -~¡-įı-ſ]*")
_PIECE = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r {_LETTER}{_NUMBER}]+")


class Words:
    """Identifiers of texts as the library gives them; those of each distinct word are kept, within a bound.

    Words of a run of texts are told apart by Arrow, so Python sees each distinct one once, and the library's model
    each distinct piece of a new one. The identifiers of all known words lie in one array, from which texts are gathered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_alphabet()))
        self.pieces: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.pool, self.ends, self.chars = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
            if len(piece) <= LONG:
                self.pieces[piece] = ids
        return ids

    def learn(self, words: list[str]) -> np.ndarray:
        """The place of each word: its identifiers are pool[ends[place] : ends[place + 1]]."""
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > CACHE or self.chars > CHARS:
            self.clear()
            new = words
        held, piece, split = self.pieces.get, self.piece, _PIECE.findall
        own = [held(w) or b"".join([held(p) or piece(p) for p in split(w)]) for w in new]
        known = len(self.rows)
        self.rows.update(zip(new, range(known, known + len(new))))
        self.chars += sum(map(len, new))
        self.ends = np.append(self.ends, len(self.pool) + np.cumsum([len(x) // 4 for x in own], dtype=np.int64))
        self.pool = np.append(self.pool, np.frombuffer(b"".join(own), "<u4"))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit identifiers of each text."""
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string())))
        words = lists.values.dictionary_encode()
        places = self.learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        start = self.ends[places]
        size = self.ends[places + 1] - start
        upto = np.append(0, np.cumsum(size))
        flat = self.pool[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        at = (4 * upto[lists.offsets.to_numpy()]).tolist()
        return [flat[at[i] : at[i + 1]] if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, (t, p) in enumerate(zip(texts, plain))]


_LOADED: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Words(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): identifiers of the text and then end_id, cut into pieces of `capacity`."""
    kind = docs.schema[key].dataType.simpleString()
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_numpy(zero_copy_only=False)]
            row, piece, start, length, crc = [], [], [], [], []
            for a, b in text_runs(texts):
                for i, ids in enumerate(words.encode(texts[a:b]), a):
                    ids += last
                    for k, p in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[p : p + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(p // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            out = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(out, names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, struct_of(f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"))


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of at most counts[l] pieces of each length that fits.

    The longest piece is always in it (it has to go somewhere, and the rest fits best around it). Bit s of the bitset
    says whether sum s can be reached; long pieces come first, and the search ends when the capacity is reached.
    """
    first = lengths[0]
    room = capacity - first
    whole = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, lump = min(counts[length] - (length == first), room // length), 1
        while left > 0:  # counts in powers of two
            take = min(lump, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & whole
            left -= take
            lump *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    picked = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            picked[length] = picked.get(length, 0) + take
    return picked


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, first rank, end rank, first bin, pieces a bin, offset) rows, and the number of bins."""
    counts = {n: c for n, c in counts.items() if c}
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(lengths, 0)
    plan, bins = [], 0
    while lengths:
        picked = fullest(lengths, counts, capacity)
        times = min(counts[n] // k for n, k in picked.items())
        offset = 0
        for n, k in picked.items():
            plan.append((n, used[n], used[n] + k * times, bins, k, offset))
            used[n] += k * times
            counts[n] -= k * times
            offset += n * k
        bins += times
        lengths = [n for n in lengths if counts[n]]
    return plan, bins


def numbered(rows: DataFrame, total: int, group: str, order: list[str], name: str) -> DataFrame:
    """rows, of which there are `total`, with `name`: 0, 1, 2 ... within each group, without bringing a group together.

    Rows are dealt into blocks by hash; each block is numbered on its own and starts after the rows of the blocks
    before it. There are so many blocks that one has about BLOCK_ROWS rows at most, even if all are of one group.
    """
    from pyspark.sql import Window

    block, nth, of, at, first = fresh(rows, "_block", "_nth", "_group", "_at", "_first")
    blocks = max(BLOCKS, -(-total // BLOCK_ROWS))
    dealt = rows.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(group, block).agg(F.count("*").alias(nth))
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias(of), F.col(block).alias(at), F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(first))
    inner = Window.partitionBy(group, block).orderBy(*order)
    out = dealt.withColumn(nth, F.row_number().over(inner) - 1)
    out = out.join(starts, (F.col(group) == F.col(of)) & (F.col(block) == F.col(at)))
    return out.withColumn(name, (F.col(first) + F.col(nth)).cast("long")).drop(block, nth, of, at, first)


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: list[str] | None = None) -> DataFrame:
    """pieces with sequence_id and offset: places in sequences of at most `capacity`, gapless from 0.

    Lengths are 1 to capacity; other columns are kept, but for a sequence_id and an offset that are there. Rows that are alike in every ordering column are interchangeable. An empty table stays
    empty. The driver holds one count for each length; the plan that is broadcast has a few rows for each length.
    """
    own = pieces.columns
    pieces = cut(pieces)
    counts = dict(pieces.groupBy(length).count().collect())
    plan, _ = packing_plan(counts, capacity)
    plan.sort()
    table = np.array(plan, dtype=np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    names = [n for n in own if n not in ("sequence_id", "offset")]
    (rank_name,) = fresh(pieces, "_rank")
    ranked = numbered(pieces.select(*names), sum(counts.values()), length, order or names, rank_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        width = np.int64(1) << 40
        keys = t[:, 0] * width + t[:, 1]
        for batch in batches:
            cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            n, rank = cols[length].to_numpy(), cols[rank_name].to_numpy()
            at = np.searchsorted(keys, n * width + rank, side="right") - 1
            p = t[at]
            nth = rank - p[:, 1]
            bins, within = p[:, 3] + nth // p[:, 4], p[:, 5] + nth % p[:, 4] * n
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in names), pa.array(bins), pa.array(within)], names=[*names, "sequence_id", "offset"])

    form = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names)
    return ranked.mapInArrow(run, struct_of(f"{form}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): all documents in as few sequences as can be found.

    A document is its text's identifiers and then end_id; null texts count as empty (end_id alone). Only longer ones
    are cut, into pieces of `capacity`. One row per piece; repeated rows and null keys are packed each for itself.
    """
    return pack(token_pieces(docs, path, capacity, end_id, text, key), capacity, order=[key, "piece", "ids_crc32"])
