"""Word sequences of texts as hashes, many texts at a time.

A word is a longest run of ASCII letters, digits and `_`, letter case ignored. All functions work on
the UTF-8 bytes of a slice of an Arrow column, in blocks of bounded size, so a worker's memory does not grow
with its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text taken together; a longer text makes a block of its own.
BLOCK_BYTES = 3 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 1024

_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """The words of a block of texts: hash of each, and the first word of each text (with an end mark)."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string or binary column; nulls count as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray) -> Words:
    folded = np.zeros(len(data) + 16, np.uint8)
    np.take(_FOLD, data, out=folded[: len(data)])
    inside = folded[: len(data) + 1] != 0
    edge = np.empty(len(inside), bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    # a text's end also ends its word
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    size = ends - starts
    eight = np.ndarray((len(folded) - 7,), "<u8", folded, strides=(1,))
    h = eight[starts] & _KEEP[np.minimum(size, 8)]
    h = mixed(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(size > 8)
    done = 8
    while len(left) and done < LONG_WORD:
        more = eight[starts[left] + done] & _KEEP[np.minimum(size[left] - done, 8)]
        h[left] = mixed((h[left] * np.uint64(0xA0761D6478BD642F)) ^ more)
        done += 8
        left = left[size[left] > done]
    for k in left:
        h[k] = xxhash.xxh64_intdigest(folded[starts[k] : ends[k]].tobytes())
    return Words(h, np.searchsorted(starts, at).astype(np.int64))


def shingles(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `length` words that lie in one text, and the first run of each text."""
    n = len(w.hashes) - length + 1
    per = np.maximum(w.counts - length + 1, 0)
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(per)))
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(w.first), np.int64)
    h = w.hashes[:n].copy()
    for k in range(1, length):
        h *= np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(29)
        h += w.hashes[k : n + k]
    h = mixed(h)
    # drop the runs that start among the last length-1 words of a text
    keep = np.zeros(n + 1, np.int32)
    some = per > 0
    np.add.at(keep, w.first[:-1][some], 1)
    np.add.at(keep, w.first[:-1][some] + per[some], -1)
    return h[np.cumsum(keep[:-1]) > 0], first


def text_prints(w: Words, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """One hash for each text's whole sequence of words (as int64)."""
    n = len(w.hashes)
    place = np.arange(n, dtype=np.uint64) - np.repeat(w.first[:-1], w.counts).astype(np.uint64)
    h = mixed(w.hashes ^ mixed(place + np.uint64(salt)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
    return mixed(total[w.first[1:]] - total[w.first[:-1]] + w.counts.astype(np.uint64)).view(np.int64)


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and the first of each text."""
    out, at = [], np.zeros(len(first), np.int64)
    for k in range(len(first) - 1):
        part = np.sort(h[first[k] : first[k + 1]])
        if len(part) > 1:
            part = part[np.concatenate((np.ones(1, bool), part[1:] != part[:-1]))]
        out.append(part)
        at[k + 1] = at[k] + len(part)
    return (np.concatenate(out) if out else h[:0]), at


def binary_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of the given items, `at` counting items."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
