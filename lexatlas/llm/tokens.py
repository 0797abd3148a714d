"""Token ids by a public tokenizer file, computed in Python tasks."""

from __future__ import annotations

import os
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

import pyarrow as pa  # noqa: E402

from lexatlas.llm.arrays import BLOCK_BYTES, PLAIN, HashTable, gather, raw, span_hashes, spans  # noqa: E402

#: Distinct pieces and ids of pieces that a worker remembers; when full, it starts anew.
MEMO_PIECES, MEMO_IDS = 400_000, 1_600_000

# By byte: signs that may close a word; letters of ASCII and what letters of Latin-1 beyond it consist of; lower case.
_SIGN, _LETTER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_SIGN[[ord(c) for c in ".,;:!?"]] = True
_LETTER[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
_LOWER[65:91] += 32


def _bytes_as_chars() -> dict[int, str]:
    """How byte-level tokenizers write the code points 128-255: each UTF-8 byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    as_char = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    return {c: "".join(as_char[b] for b in chr(c).encode()) for c in range(128, 256)}


class PieceEncoder:
    """Ids of whole texts for a tokenizer whose pre-tokenizer never joins text across a space.

    Such a tokenizer encodes a text as its space-separated pieces one after the other. Each distinct piece goes
    through the library once and is remembered, which gives the library's ids for the whole text at a fraction of
    the time. A piece of letters (ASCII, or U+00C0-U+00FF) and closing signs counts as two pieces: the lower-cased
    word, which is one pre-token, and the signs. Whether a file is of this kind is read from it (spaced); with any
    other, whole texts go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = spaced(path)
        self.as_chars = _bytes_as_chars()
        self.clear()

    def clear(self) -> None:
        self.table = HashTable()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.n = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32), 0

    def add(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        lengths = np.array([len(p) // 4 for p in parts], np.int32)
        flat = np.frombuffer(b"".join(parts), "<u4")
        while self.n + len(parts) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        own = slice(self.n, self.n + len(parts))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.length[own] = lengths
        self.begin[own] = self.n_ids + np.cumsum(lengths, dtype=np.int32) - lengths
        self.table.put(hashes, np.arange(own.start, own.stop, dtype=np.int32))
        self.n, self.n_ids = own.stop, self.n_ids + len(flat)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str], words: list[bool]) -> list[bytes]:
        """Ids of pieces that are not remembered yet. words: which are lower-cased words, a pre-token each."""
        out: list[bytes] = [b""] * len(pieces)
        model = self.library.model
        for n, piece in enumerate(pieces):
            if words[n]:
                out[n] = np.array([t.id for t in model.tokenize(piece if piece.isascii() else piece.translate(self.as_chars))], "<u4").tobytes()
        rest = [n for n, word in enumerate(words) if not word]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for n, ids in zip(part, self.whole([pieces[n] for n in part])):
                out[n] = ids
        return out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a large_string array without nulls), and where each text's ids begin."""
        if not self.by_piece:
            parts = self.whole(text.to_pylist())
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
            return np.frombuffer(b"".join(parts), "<u4"), offsets
        data, offsets = raw(text)
        if len(text) == 1 and len(data) > 2 * BLOCK_BYTES:  # a long text: span by span
            flat = np.concatenate([self.ids_of(data[a:z], np.array([0, z - a]))[0] for a, z in spans(data, PLAIN)])
            return flat, np.array([0, len(flat)])
        return self.ids_of(data, offsets)

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, lengths, word, low = _pieces(data, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        inside = ~PLAIN[data]
        hashes = span_hashes(low[inside], np.cumsum(lengths) - lengths, lengths)
        hashes ^= word.astype(np.uint64) << np.uint64(63)
        hashes[hashes == 0] = np.uint64(1)
        if self.n > MEMO_PIECES or self.n_ids > MEMO_IDS:
            self.clear()
        found = self.table.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            own, low = missing[first], low.tobytes()
            self.add(new, self.learn([low[a : a + n].decode() for a, n in zip(begins[own].tolist(), lengths[own].tolist())], word[own].tolist()))
            found[missing] = self.table.find(hashes[missing])
        counts = self.length[found].astype(np.int64)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        return gather(self.ids, self.begin[found], counts), ends[np.searchsorted(begins, offsets)]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces between spaces and line ends: first bytes, lengths, which are words without their closing signs, and the
    bytes with those words in lower case."""
    n = len(data)
    inside = ~PLAIN[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    begin[at] = inside[at]  # where a document begins, a piece never goes on
    begins = np.flatnonzero(begin)
    starts = np.flatnonzero(begin[inside])
    lengths = np.diff(np.append(starts, int(inside.sum())))
    after_c3 = np.zeros(n, bool)
    after_c3[1:] = data[:-1] == 0xC3
    letters = np.concatenate([np.zeros(1, np.int32), np.cumsum(_LETTER[data] & ~(after_c3 & ((data == 0x97) | (data == 0xB7))), dtype=np.int32)])
    last = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(n, dtype=np.int32)))
    stops = begins + lengths
    core = np.maximum(last[stops - 1] + 1, begins)  # where the closing signs begin
    word = (core > begins) & (letters[core] - letters[begins] == core - begins)
    split = word & (core < stops)
    cased = np.zeros(n, bool)
    cased[inside] = np.repeat(word, lengths)
    low = np.where(cased, np.where(after_c3 & (data >= 0x80) & (data <= 0x9E), data + np.uint8(0x20), _LOWER[data]), data)
    order = np.argsort(np.concatenate([begins, core[split]]), kind="stable")
    return (
        np.concatenate([begins, core[split]])[order],
        np.concatenate([np.where(split, core - begins, lengths), (stops - core)[split]])[order],
        np.concatenate([word, np.zeros(int(split.sum()), bool)])[order],
        low,
    )


@lru_cache
def spaced(path: str) -> bool:
    """Whether the file's pre-tokenizer drops white space and splits at it, so that pieces are independent."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s\\p{L}\\p{N}]+" in pattern and " ?" not in pattern
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"]) for t in spec["added_tokens"])
    lower = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    byte_level = (steps.get("pretokenizers") or [{}])[-1].get("type") == "ByteLevel" and not (steps.get("pretokenizers") or [{}])[-1].get("add_prefix_space")
    return bool(dropped and plain and lower and byte_level)


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One per tokenizer file and worker process; workers are reused, so their memos last over tasks."""
    return PieceEncoder(path)
