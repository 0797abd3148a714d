"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers form a cascade.

* The splitter reads classes of code points and marks where pre-tokens begin. It has 13 states. A block of texts is cut
  into chunks of equal width; each chunk yields its state map (entry state -> exit state), all chunks stepping together;
  a parallel prefix scan composes the maps, so that every chunk learns its entry state; then the marks are emitted.
* The counter reads the bytes of a pre-token. Its states hold the end of the bytes read so far that may still grow into
  a vocabulary entry, with the last token and the count of each prefix there; a transition is annotated with the change
  of the token count. It rests on a property of BPE: a token sequence is the encoding of its text exactly if each pair
  of neighbours is the encoding of its own text, so a prefix's last token follows from those of shorter prefixes.
  Transitions are compiled when first needed; pre-tokens take them together, a byte at a time. A long pre-token is cut
  into chunks that run together, each from the state that the bytes before it lead to; where a chunk's exit is the next
  one's entry, their maps compose and their counts add up, and the others run again from the exit found.

The splitter's classes come from the library itself: it is asked how it splits each code point.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.arrays import HashTable, mix, raw, span_hashes, text_blocks
from lexatlas.sources.workspace import map_arrow

# Classes of code points.
LETTER, STMD, E, R, V, LL, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, END = range(12)
# States of the splitter: at the start; in letters, numbers, other signs; in white space of one character or more, the
# last a space or another; after an apostrophe that begins a pre-token, and r, v or l after it; after a contraction.
START, L, N, O, S1, W1, S2, W2, Q, QR, QV, QL, C = range(13)
# Marks: a pre-token begins at this character, at the one before, or at both.
NONE, HERE, BEFORE, BOTH = range(4)
#: Code points from here on are neither letters, numbers nor white space.
_LAST = 0x34000
#: Width of a chunk in code points; steps after which state maps are checked for having become constant.
CHUNK, CHECK = 256, 16
#: Pre-tokens and transitions that a worker keeps; when full, it starts anew.
MEMO, MEMO_TRANSITIONS = 1_000_000, 800_000
#: Bytes of a pre-token that is not cut, of a chunk of a longer one, and of chunks that run together; rounds in which
#: chunks with a wrong entry run again together, before they do one after the other.
WHOLE, PIECE, SLAB, ROUNDS = 64, 256, 1 << 16, 4


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark of each state and class, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white(?!not white)|white."""
    after, mark = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    kind = {LETTER: L, STMD: L, E: L, R: L, V: L, LL: L, NUMBER: N, OTHER: O, APOSTROPHE: O, SPACE: S1, WHITE: W1, END: START}
    for state in range(13):
        for c in range(12):
            begin = Q if c == APOSTROPHE else kind[c]  # the state if a pre-token begins here
            if c == END:
                to, out = START, BEFORE if state in (QR, QV, QL) else NONE
            elif state in (START, C):
                to, out = begin, HERE
            elif state in (L, N, O):
                to, out = (state, NONE) if kind[c] == state else (begin, HERE)
            elif state in (S1, W1, S2, W2):
                if c in (SPACE, WHITE):
                    to, out = (S2 if c == SPACE else W2), NONE
                else:
                    joined = state in (S1, S2)
                    to = kind[c] if joined else begin
                    out = (BEFORE if state in (S2, W2) else NONE) | (NONE if joined else HERE)
            elif state == Q:
                if c in (STMD, R, V, LL):
                    to, out = {STMD: C, R: QR, V: QV, LL: QL}[c], NONE
                elif c in (OTHER, APOSTROPHE):
                    to, out = O, NONE
                else:
                    to, out = begin, HERE
            elif (state in (QR, QV) and c == E) or (state == QL and c == LL):
                to, out = C, NONE
            else:  # no contraction: the letter before began a pre-token
                to, out = (L, BEFORE) if kind[c] == L else (begin, BOTH)
            after[state, c], mark[state, c] = to, out
    return after, mark


NEXT, MARK = _splitter()
_NEXT, _MARK = NEXT.ravel(), MARK.ravel()


def entry_states(classes: np.ndarray) -> np.ndarray:
    """The state in which each chunk (a column of classes) begins: chunk state maps, composed by a prefix scan."""
    width, n = classes.shape
    at = np.repeat(np.arange(13, dtype=np.uint8)[:, None], n, axis=1)
    for j in range(width):
        at = _NEXT[at * np.uint8(12) + classes[j]]
        if j % CHECK == CHECK - 1 and len(at) > 1 and (at == at[0]).all():
            at = at[:1]
    maps = np.broadcast_to(at, (13, n)) if len(at) == 1 else at
    step = 1
    while step < n:
        if (maps == maps[0]).all():  # constant maps: composing them changes nothing
            break
        maps = np.concatenate([maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)], axis=1)
        step *= 2
    return np.concatenate([np.array([START], np.uint8), maps[START, :-1]])


def begins(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a row of classes that ends with END."""
    n = len(classes)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    at = entry_states(columns)
    marks = np.empty_like(columns)
    for j in range(CHUNK):
        index = at * np.uint8(12) + columns[j]
        marks[j] = _MARK[index]
        at = _NEXT[index]
    marks = marks.T.ravel()[:n]
    out = (marks & HERE).astype(bool)
    out[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return out


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Counter:
    """The transducer over the bytes of a pre-token."""

    def __init__(self, vocab: dict[str, int], merges: list):
        as_byte = _byte_chars()
        of = lambda token: bytes(as_byte[c] for c in token)
        self.tokens = {x: x for x in (of(t) for t in vocab if all(c in as_byte for c in t))}
        self.ranks = {tuple(map(of, m.split(" ") if isinstance(m, str) else m)): n for n, m in enumerate(merges)}
        self.stems = {t[:n] for t in self.tokens for n in range(len(t))}
        self.longest = max(map(len, self.tokens))
        self.clear()

    def clear(self) -> None:
        #: A state: the stem, and for its beginning and the end of each of its bytes the last token (None at the start
        #: of a pre-token) and the count less the count at the end.
        self.state_of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.pairs: dict[tuple, tuple] = {}
        self.first = self.intern((b"", ((None, 0),)))
        self.table, self.n = HashTable(), 0
        self.next, self.change = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16)

    def moves(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and changes of the counts; transitions that are not there yet are compiled."""
        keys = mix((state.astype(np.uint64) << np.uint64(8) | byte) + np.uint64(1))
        found = self.table.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            own = missing[at]
            made = np.array([self.compile(s, b) for s, b in zip(state[own].tolist(), byte[own].tolist())], np.int32)
            while self.n + len(made) > len(self.next):
                self.next, self.change = np.resize(self.next, 2 * len(self.next)), np.resize(self.change, 2 * len(self.change))
            self.next[self.n : self.n + len(made)], self.change[self.n : self.n + len(made)] = made[:, 0], made[:, 1]
            self.table.put(new, np.arange(self.n, self.n + len(made), dtype=np.int32))
            self.n += len(made)
            found[missing] = self.table.find(keys[missing])
        return self.next[found], self.change[found]

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of spans of bytes, from given states; all spans step together."""
        order = np.argsort(-lengths, kind="stable")
        at, own, size = starts[order], state[order].astype(np.int32), -lengths[order]
        count = np.zeros(len(order), np.int64)
        for j in range(int(lengths.max()) if len(lengths) else 0):
            n = int(np.searchsorted(size, -j, "left"))
            own[:n], change = self.moves(own[:n], data[at[:n] + j])
            count[:n] += change
        exits, counts = np.empty_like(own), np.empty_like(count)
        exits[order], counts[order] = own, count
        return exits, counts

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        if self.n > MEMO_TRANSITIONS:
            self.clear()
        data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(len(texts), np.int64)
        short = np.flatnonzero(lengths <= WHOLE)
        out[short] = self.run(data, starts[short], lengths[short], np.full(len(short), self.first))[1]
        for n in np.flatnonzero(lengths > WHOLE).tolist():
            state = self.states[self.first]
            for at in range(0, len(texts[n]), SLAB):
                if self.n > MEMO_TRANSITIONS:
                    self.clear()
                more, state = self.long(texts[n], at, state)
                out[n] += more
        return out

    def long(self, text: bytes, at: int, state: tuple) -> tuple[int, tuple]:
        """The count and the last state of up to SLAB bytes of a pre-token, from a state on."""
        data = np.frombuffer(text, np.uint8)[max(0, at - PIECE) : at + SLAB]
        here = min(at, PIECE)
        starts = np.arange(here, len(data), PIECE)
        lengths = np.minimum(PIECE, len(data) - starts)
        ahead = np.minimum(starts, self.longest)
        entry = self.run(data, starts - ahead, ahead, np.full(len(starts), self.first))[0]
        entry[0] = self.intern(state)
        exits, counts = self.run(data, starts, lengths, entry)
        for _ in range(ROUNDS):
            wrong = 1 + np.flatnonzero(entry[1:] != exits[:-1])
            if not len(wrong):
                break
            entry[wrong] = exits[wrong - 1]
            exits[wrong], counts[wrong] = self.run(data, starts[wrong], lengths[wrong], entry[wrong])
        known: dict[tuple, tuple] = {}
        for k in range(1, len(starts)):
            if entry[k] != exits[k - 1]:
                entry[k] = exits[k - 1]
                piece = data[starts[k] : starts[k] + lengths[k]].tobytes()
                if (int(entry[k]), piece) not in known:
                    done, n = self.run(data, starts[k : k + 1], lengths[k : k + 1], entry[k : k + 1])
                    known[int(entry[k]), piece] = int(done[0]), int(n[0])
                exits[k], counts[k] = known[int(entry[k]), piece]
        return int(counts.sum()), self.states[int(exits[-1])]

    def intern(self, state: tuple) -> int:
        found = self.state_of.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def encode(self, text: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts = [text[n : n + 1] for n in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), n) for n, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: bytes | None, token: bytes) -> bool:
        expected = [token] if last is None else [last, token]
        return self.encode(b"".join(expected)) == expected

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: next state, and the change of the token count."""
        stem, ends = self.states[state]
        read = stem + bytes((byte,))
        for at in range(len(read)):  # the longest token first
            token = read[at:]
            if token in self.tokens and self.follows(ends[at][0], token):
                token, change = self.tokens[token], ends[at][1] + 1
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        open_ = [n for n in range(len(read) + 1) if read[n:] in self.stems]
        at = open_[0]  # where a token may have begun that goes on; nothing else of the past matters
        kept = [None] * (len(read) - at + 1)
        for n in open_:
            pair = (token, 0) if n == len(read) else (ends[n][0], ends[n][1] - change)
            kept[n - at] = self.pairs.setdefault(pair, pair)
        return self.intern((read[at:], tuple(kept))), change


class TokenCounter:
    """Both transducers, compiled from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("the transducers are for byte-level BPE files with the usual pattern")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.counter = Counter(spec["model"]["vocab"], spec["model"]["merges"])
        self.classes = classes(Tokenizer.from_file(path).pre_tokenizer)
        self.memo = HashTable()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            own = [text]
            for s in self.special:
                if s in text:
                    own = [y for x in own for y in x.split(s)]
            extra[n] = len(own) - 1
            parts += own
            owner += [n] * len(own)
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = self.classes[np.minimum(codes, _LAST)]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        starts = np.flatnonzero(begins(kinds))
        part = np.searchsorted(ends, starts)
        stops = np.minimum(np.append(starts[1:], len(codes)), ends[part]) if len(starts) else starts
        if not len(starts):
            return extra
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        ahead = np.cumsum(width) - width  # bytes before each code point
        first, after = ahead[starts], ahead[stops]
        data = np.frombuffer(joined.encode(), np.uint8)
        inside = np.ones(len(data), bool)
        inside[ahead[ends]] = False
        lengths = after - first
        hashes = span_hashes(data[inside], np.cumsum(lengths) - lengths, lengths)
        if self.memo.n > MEMO:
            self.memo.clear()
        counts = self.memo.find(hashes)
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            own, text = missing[at], data.tobytes()
            self.memo.put(new, self.counter.count([text[a:b] for a, b in zip(first[own].tolist(), after[own].tolist())]).astype(np.int32))
            counts[missing] = self.memo.find(hashes[missing])
        return extra + np.bincount(np.array(owner, np.int64)[part], counts.astype(np.float64), len(texts)).astype(np.int64)


def classes(pre) -> np.ndarray:
    """The class of each code point up to _LAST (itself for all above), as the library's pre-tokenizer sees it."""
    out = np.full(_LAST + 1, OTHER, np.uint8)
    codes = [c for c in range(_LAST) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 1 << 14):
        part = codes[at : at + (1 << 14)]
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            text = "".join(f"{probe}{chr(c)}\n" for c in part)
            first = np.zeros(len(text), bool)
            first[[span[0] for _, span in pre.pre_tokenize_str(text)]] = True
            joined = ~first[1::3]
            if kind == OTHER:
                white = ~joined & (out[part] == OTHER)
                out[np.array(part)[white]] = WHITE
            else:
                out[np.array(part)[joined]] = kind
    for chars, kind in (("stmd", STMD), ("e", E), ("r", R), ("v", V), ("l", LL), ("'", APOSTROPHE), (" ", SPACE)):
        out[[ord(c) for c in chars]] = kind
    return out


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch, text in text_blocks(batches):
        n_bytes = np.diff(raw(text)[1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(token_counter(path).count(text.to_pylist()))], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each document (doc_id, text).

    One map over the scan, nothing is shuffled. A null text counts as empty (0 tokens); doc_id may be null or repeat,
    each row is counted by itself; other columns are ignored; an empty table gives no rows. Special strings inside
    texts are one token each, as the library has them by default.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(own, lambda it: _count(it, tokenizer), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
