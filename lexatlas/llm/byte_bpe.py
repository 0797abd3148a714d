"""Byte-level BPE by a file of ranks: texts to ids and back, exactly as repeated merges of the lowest rank give them.

Each match of the pattern is encoded by itself; one that is an entry of the vocabulary is that entry. Others are read as
Latin-1, a character per byte, so that pyahocorasick's automaton of all entries finds, in one pass, the longest entry
that begins at each byte. From there the encoding is found by backtracking: the longest entry is tried first, then the
entries that it begins with, from the longest to the shortest; where none fits, the entry before is taken back, and the
place where it ended is never tried again. An entry fits if merging the bytes of its predecessor and its own gives just
these two: a row of entries is the encoding of its bytes exactly if all neighbours fit, and a text has one such row. So
every byte is left behind at most once, and the time is linear in the text. Which neighbours fit is remembered.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.arrays import text_blocks
from lexatlas.sources.workspace import map_arrow

#: Matches of the pattern that a worker remembers, twice over: those seen since the memo was last full, and those of the
#: time before. Pairs of entries that it remembers; when full, it starts anew.
MEMO, MEMO_PAIRS = 250_000, 500_000
#: A longer match isn't remembered. A text of more characters is split into so many matches at a time.
MEMO_CHARS, LONG_TEXT, MATCHES = 64, 1 << 18, 1 << 15
#: Bytes of ids that one step of decoding holds; a longer row forms a step of its own.
DECODE_BYTES = 1 << 20


class BytePairEncoder:
    """Encodes and decodes by the ranks of a file (base64 of an entry's bytes, and its rank, which is its id)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, f)}
        if len({e for e in self.ids if len(e) == 1}) < 256:
            raise ValueError("each byte must be an entry of the vocabulary")
        self.entries = {i: e for e, i in self.ids.items()}
        self.lengths = {i: len(e) for e, i in self.ids.items()}
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for entry, i in self.ids.items():
            self.automaton.add_word(entry.decode("latin-1"), (i, len(entry)))
        self.automaton.make_automaton()
        self.begins_with: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by plain merges, the lowest rank first."""
        rank, last = self.ids.get, 1 << 60
        parts = [data[n : n + 1] for n in range(len(data))]
        ranks = [rank(a + b, last) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < last:
            at = ranks.index(least)
            parts[at : at + 2] = [self.entries[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], last)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], last)
        return [self.ids[p] for p in parts]

    def shorter(self, entry: int) -> int:
        """The longest entry that an entry begins with, itself excluded; -1 if there is none."""
        found = self.begins_with.get(entry)
        if found is None:
            data = self.entries[entry]
            found = next((self.ids[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ids), -1)
            self.begins_with[entry] = found
        return found

    def fits(self, before: int, entry: int) -> bool:
        """Whether an entry may follow another; before is -1 at the start of a match."""
        found = self.pairs.get((before, entry))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            row = [entry] if before < 0 else [before, entry]
            found = self.merged(b"".join(self.entries[i] for i in row)) == row
            self.pairs[before, entry] = found
        return found

    def encode_match(self, data: bytes) -> array:
        """Ids of one match of the pattern, of any length."""
        if data in self.ids:
            return array("I", [self.ids[data]])
        n, lengths, pairs = len(data), self.lengths, self.pairs
        longest = array("I", bytes(4 * n))
        for last, (entry, length) in self.automaton.iter(data.decode("latin-1")):
            longest[last - length + 1] = entry  # matches come by their last byte, so the longest of a start comes last
        path, at, dead = array("I"), 0, bytearray(n + 1)
        entry, before = longest[0], -1
        while at < n:
            end = at + lengths[entry]
            if not dead[end]:
                fits = pairs.get((before, entry))
                if self.fits(before, entry) if fits is None else fits:
                    path.append(entry)
                    before, at = entry, end
                    if at < n:
                        entry = longest[at]
                    continue
            entry = self.shorter(entry)
            if entry < 0:
                dead[at] = 1
                entry = path.pop()
                at -= lengths[entry]
                before = path[-1] if path else -1
        return path

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        known = self.memo.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(known, self.split.findall(text)))
        matches, parts = self.split.finditer(text), []
        while part := b"".join(known(m[0]) for m in islice(matches, MATCHES)):
            parts.append(part)
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id that isn't in the file is a KeyError."""
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


class _Memo(dict):
    """From matches of the pattern to their ids; short ones are kept, and those in use outlast the others."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = np.asarray(self.encoder.encode_match(match.encode()), "<u4").tobytes()
        if len(match) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[match] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One per file and worker process; workers are reused, so what they remember lasts over tasks."""
    return BytePairEncoder(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch, text in text_blocks(batches):
        own = encoder(path, pattern)
        ids = pa.array((own.encode(t) for t in text.to_pylist()), pa.binary(), size=len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pc.divide(pc.binary_length(ids).cast(pa.int64()), 4)), ids], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of each document (doc_id, text).

    One map over the scan, nothing is shuffled; a worker holds one block of texts, or one longer text, at a time. A null
    text counts as empty (no ids). doc_id may be null or repeat: each row is encoded by itself. Strings of special
    tokens are text like other text. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(own, lambda it: _encode(it, ranks, pattern), "doc_id long, n_tokens long, ids binary")


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for batch in batches:
        ids, at = batch.column("ids"), 0
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(ids), 0), np.int64))
        while at < len(ids):
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODE_BYTES, "right")), at + 1)
            part = (None if v is None else own.decode(np.frombuffer(v, "<u4")) for v in ids.slice(at, to - at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns), pa.array(part, pa.binary(), size=to - at)], names=[*batch.schema.names, "decoded"])
            at = to


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows of (doc_id, n_tokens, ids) with `decoded`, the bytes of their ids; null ids give null."""
    own = encoded.select("doc_id", "n_tokens", "ids")
    return map_arrow(own, lambda it: _decode(it, ranks, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and sha256 (lowercase hex) of the ids and of the decoded bytes."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
