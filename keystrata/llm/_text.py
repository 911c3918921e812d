"""Whole-batch text kernels in numpy: words, their hashes and hashes of word runs.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All functions work on the flat
UTF-8 bytes of many texts at once; hashes are 64-bit and the same in every process."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
MAX_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Spans of more bytes are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: eight bytes at a time, every step mixed before the next, so that
    no algebra of the bytes carries through; long spans by xxHash."""
    size = ends - starts
    window = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xA0761D6478BD642F))
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[todo], size[todo]
    while len(todo):
        h[todo] = mix(h[todo] ^ (window[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 0x5851F42D)
    return h


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i+1]`` are the words of text i."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(_LOWER[self.data] if lower else self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes with their bytes and bounds; a longer text stands alone."""
    data, bounds = flat(column)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begin)
    return Words(data, bounds, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def run_hashes(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """Hash of the elements ``starts : starts + sizes`` of ``h``, which depends on them alone.

    Runs of 1, 2, 4, ... elements are hashed from their halves, each mixed; a run is put together from
    those that its size in binary names."""
    sizes = np.broadcast_to(np.asarray(sizes, np.int64), len(starts))
    out = mix(sizes.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1))
    at, level, bit, most = starts.copy(), h, 1, int(sizes.max(initial=0))
    while bit <= most:
        on = np.flatnonzero(sizes & bit)
        if len(on) == len(out):
            out, at = _join(out, level[at]), at + bit
        elif len(on):
            out[on] = _join(out[on], level[at[on]])
            at[on] += bit
        if 2 * bit <= most:
            level = _join(level[:-bit], level[bit:])
        bit *= 2
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def slices(first: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = first.tolist()
    return zip(edges, edges[1:])


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 and where they are not null."""
    known = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)).astype(np.int64), known


def list_column(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
