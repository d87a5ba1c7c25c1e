"""Numbers of whole texts, computed over Arrow buffers: rule counts and hashed byte n-grams."""

from __future__ import annotations

import numpy as np

from docloom.llm.common import _SPACE, mix, window_hashes, word_hashes

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LEAD = np.ones(256, bool)  # bytes that begin a code point
_LEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def rule_counts(raw: np.ndarray, offsets: np.ndarray, window: int = 3) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    words, at = word_hashes(raw, offsets)
    n = len(offsets) - 1
    solid = ~_SPACE[raw]
    text = raw.tobytes()
    dup = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in text[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    repeat = np.zeros(n, np.int64)
    grams = window_hashes(words, window)
    if len(grams):
        row = np.repeat(np.arange(n), np.diff(at))
        whole = row[: len(grams)] == row[window - 1 : window - 1 + len(grams)]
        place = np.flatnonzero(whole)
        keys = grams[place] ^ mix(row[place].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        covered = np.zeros(len(words), bool)
        first = place[order[again]]
        for k in range(window):
            covered[first + k] = True
        repeat = per_row(covered, at)
    return {"n_words": np.diff(at), "word_chars": per_row(_LEAD[raw] & solid, offsets), "n_symbols": per_row(_SYMBOL[raw], offsets), "n_dup_lines": dup, "n_repeat_words": repeat}


def gram_buckets(raw: np.ndarray, bits: int, size: int = 4) -> np.ndarray:
    """Bucket of the `size` bytes from each place on; len(raw) - size + 1 of them."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint32)
    for k in range(size):
        key |= raw[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA6B)
    return (key >> np.uint32(32 - bits)).astype(np.int64)


def inside(offsets: np.ndarray, grams: int, size: int = 4) -> np.ndarray:
    """Whether the gram from each place on ends in the row in which it starts."""
    ok = np.ones(grams, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - size + 1) : end] = False
    return ok


def shape(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense features of each row: logarithm of the words, and shares of kinds of characters, words and lines."""
    c = rule_counts(raw, offsets)
    words, size = np.maximum(c["n_words"], 1), np.maximum(np.diff(offsets), 1)
    cols = [
        np.log1p(c["n_words"]), c["word_chars"] / words / 10, c["n_symbols"] / words, c["n_repeat_words"] / words,
        c["n_dup_lines"] / (1 + per_row(raw == 10, offsets)), per_row(_UPPER[raw], offsets) / size * 3, per_row(_MARK[raw], offsets) / words, per_row(raw == 10, offsets) / words,
    ]
    return np.stack(cols, axis=1).astype(np.float32)
