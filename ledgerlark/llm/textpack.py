"""Hashing of all words of many texts at once, over the packed UTF-8 bytes of an Arrow column.

A batch of texts is one byte array with offsets. Word boundaries come from a table of byte classes, word hashes from
running sums of a polynomial modulo 2**64, so that the cost is a few numpy passes over the bytes and no Python
loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

#: Bytes of text handled at once.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 1 for what a word of ``[^\x20\x09-\x0D]+`` holds.
SPACED = np.ones(256, dtype=np.uint8)
SPACED[[32, 9, 10, 11, 12, 13]] = 0

#: 1: letters, digits and all beyond ASCII; 2: other printing characters; 0: space and controls.
TYPED = np.full(256, 1, dtype=np.uint8)
TYPED[:33] = 0
TYPED[127] = 0
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    TYPED[_a:_b] = 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n + 1:
        size = 1 << max(20, int(n).bit_length())
        for name, root in (("up", _ROOT), ("down", _INVERSE)):
            table = np.full(size, root, dtype=U64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=U64)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; a null counts as empty. A run has at most
    ``limit`` bytes unless it is one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of the words: maximal runs of bytes of one class other than 0, none across texts.
    ``first[i]:first[i + 1]`` are the words of text ``i``."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none, none, np.zeros(len(offsets), dtype=np.int64)
    kind = classes[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], n)
    keep = kind[at] > 0
    starts, ends = at[keep], ends[keep]
    hashes, at = np.empty(len(starts), dtype=U64), 0
    while at < len(starts):  # one turn, unless a text is longer than a chunk
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
        lo, size = starts[at], ends[to - 1] - starts[at]
        up, down = _powers(int(size))
        part = data[lo : lo + size]
        run = np.empty(size + 1, dtype=U64)
        run[0] = 0
        np.cumsum(((LOWER[part] if lower else part).astype(U64) + U64(1)) * up[:size], out=run[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = (run[b] - run[a]) * down[a]
        at = to
    return mix(hashes), starts, ends, np.searchsorted(starts, offsets)


def prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The hash of the first ``length`` bytes of each word, ASCII lower-cased; 0 for a word that isn't longer."""
    out, at = np.zeros(len(starts), dtype=U64), np.flatnonzero(ends - starts > length)
    value = np.full(len(at), length, dtype=U64)
    for i in range(length):
        value = value * U64(_ROOT) + LOWER[data[starts[at] + i]]
    out[at] = mix(value)
    return out


def per_text(first: np.ndarray) -> np.ndarray:
    """The number of the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the runs of ``width`` words of each text; a text with fewer words has one: all its words."""
    n_words = np.diff(first)
    short = (n_words > 0) & (n_words < width)
    count = np.where(short, 1, np.maximum(n_words - width + 1, 0))
    out_first = np.concatenate(([0], np.cumsum(count)))
    odd = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    by = [odd[i % 5] + U64(2 * (i // 5)) for i in range(width)]
    out = np.zeros(int(out_first[-1]), dtype=U64)
    full = np.flatnonzero(n_words >= width)
    if len(full):
        total = int(count[full].sum())
        begin = np.repeat(first[full] - np.concatenate(([0], np.cumsum(count[full])[:-1])), count[full]) + np.arange(total)
        to = np.repeat(out_first[full] - np.concatenate(([0], np.cumsum(count[full])[:-1])), count[full]) + np.arange(total)
        sums = np.zeros(total, dtype=U64)
        for i in range(width):
            sums += hashes[begin + i] * by[i]
        out[to] = mix(sums)
    for i in np.flatnonzero(short):
        own = hashes[first[i] : first[i + 1]]
        value = np.array([len(own)], dtype=U64)
        for k in range(len(own)):
            value = value * U64(_ROOT) + own[k : k + 1] * by[k]
        out[out_first[i]] = mix(value)[0]
    return out, out_first
