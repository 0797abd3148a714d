"""Arrow and numpy helpers of the Python stages: blocks of text, lists of ids, hashing of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step holds; a longer document forms a block of its own.
BLOCK_BYTES = 1 << 18
#: Rows of one step at most, whatever their texts.
BLOCK_ROWS = 1 << 14


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about block_bytes of text each, BLOCK_ROWS rows at most, with the text column as
    large_string, null as empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
            to = min(max(to, at + 1), at + BLOCK_ROWS, len(text))
            yield batch.slice(at, to - at), text.slice(at, to - at)
            at = to


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array, and where each value begins (one more entry than values)."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list<int32> array without nulls, and where each list begins."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int32)
    return values, (offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def list_crc32(column: pa.Array) -> np.ndarray:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    values, offsets = lists(column)
    data = memoryview(np.ascontiguousarray(values, "<u4").tobytes())
    return np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64, len(column))


def int_lists(parts: list[bytes]) -> pa.ListArray:
    """A list<int32> array of ids given as little-endian 32-bit integers."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PERIOD = 4096
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1, _PERIOD + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Which bytes separate: the white space of [^\\x20\\x09-\\x0D]+, or spaces and line ends only.
WHITE, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
PLAIN[[0x20, 10]] = True


def word_hashes(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+) in order, and per document where its words begin."""
    return word_spans(text, lower)[:2]


def word_spans(text: pa.Array, lower: bool = False, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, per document where its words begin, and each word's first byte and length in bytes.

    The hash is a function of the word's bytes alone, alike in every process. lower: A-Z are read as a-z. A long text is
    taken span by span, so that what it needs beside the result doesn't grow with it.
    """
    data, offsets = raw(text)
    if len(text) > 1 or len(data) <= 2 * BLOCK_BYTES:
        return _word_spans(data, offsets, lower, separators)
    parts = [(a, *_word_spans(data[a:z], np.array([0, z - a]), lower, separators)) for a, z in spans(data, separators)]
    hashes, begins, lengths = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4))
    return hashes, np.array([0, len(hashes)]), np.concatenate([p[3] + p[0] for p in parts]), lengths


def spans(data: np.ndarray, separators: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of bytes of about `size`, each but the last ending with a separator."""
    at = 0
    while at < len(data):
        to = at + size
        while to < len(data) and not separators[data[to - 1]]:
            found = np.flatnonzero(separators[data[to : to + size]])
            to += int(found[0]) + 1 if len(found) else size
        to = min(to, len(data))
        yield at, to
        at = to


def _word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if lower:
        data = _LOWER[data]
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = inside[at]  # where a document begins, a word never goes on
    letters = data[inside]
    if not len(letters):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(begin)
    starts = np.flatnonzero(begin[inside])
    lengths = np.diff(np.append(starts, len(letters)))
    return span_hashes(letters, starts, lengths), np.searchsorted(begins, offsets).astype(np.int64), begins, lengths


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes that follow one another without gaps; none is 0."""
    rank = np.arange(len(data), dtype=np.int32)
    rank -= np.repeat(starts.astype(np.int32), lengths)
    term = _BYTE[data]
    if lengths.max() < _PERIOD:
        term *= _PLACE[rank]
    else:
        term *= _PLACE[rank % _PERIOD]
        term = np.where(rank >= _PERIOD, mix(term + (rank // _PERIOD).astype(np.uint64)), term)
    hashes = np.add.reduceat(term, starts)
    hashes += lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = mix(hashes)
    hashes[hashes == 0] = np.uint64(1)
    return hashes


class HashTable:
    """An open-addressed table from 64-bit hashes other than 0 to small integers, for whole arrays at a time."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where there is none."""
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        key = self.keys[at]
        same = key == hashes
        found = np.where(same, self.values[at], -1)
        left = np.flatnonzero(~same & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            key = self.keys[at[left]]
            hit = key == hashes[left]
            found[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return found

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct hashes that the table lacks."""
        self.n += len(hashes)
        if 2 * self.n > len(self.keys):
            old, kept = self.keys, self.values
            size = len(old)
            while 2 * self.n > size:
                size *= 2
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(old[old != 0], kept[old != 0])
        self._place(hashes, values)

    def _place(self, hashes: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            won = free & (self.keys[at] == hashes)
            self.values[at[won]] = values[won]
            hashes, values, at = hashes[~won], values[~won], (at[~won] + 1) & mask


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each document's windows of that many consecutive words, each window's document and first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    joined = np.zeros(n, np.uint64)
    for k in range(size):
        joined += hashes[k : k + n] * _PLACE[k]
    own = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(joined[own]), doc[own], own


def within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that also tell documents apart."""
    return mix(hashes + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of flags are set in each of the ranges that offsets bound."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])[offsets])


def gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[b : b + n] of all begins and lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)]
