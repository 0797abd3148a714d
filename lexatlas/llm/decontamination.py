"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are folded: lower case, and one space for each run of anything but letters, marks and digits.
An item of m characters occurs in a text if some stretch of the text is within k edits of the whole item, k a percentage
of m. By the q-gram lemma such a stretch shares at least m + 1 - q - k q q-grams with the item, on diagonals (place in the
text less place in the item) that lie within k of each other. So shared q-grams are counted in diagonal bands of k + 1;
two neighbouring bands together are one of the overlapping bands of the filter. Where they reach the bound, the region
is verified by an alignment of the whole item within the band. Items too short for the lemma to ask for one q-gram are cut
into k + 1 pieces, one of which such a stretch holds unchanged; the text around each is aligned likewise.

The benchmark goes to every task in blocks of bounded size, GROUP of them at a time; each group is one map over the texts,
which are folded once for it, without a shuffle. Beyond one group, results are written group by group, so that never more
than GROUP blocks are held by the driver or a task, however large the benchmark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.arrays import BLOCK_ROWS, gather, mix, text_blocks
from lexatlas.llm.columns import aside
from lexatlas.sources.workspace import map_arrow, materialize

Q = 8
#: Edits allowed, in percent of an item's folded length.
EDIT_PERCENT = 10
#: Characters of a block of items (its index takes about 30 bytes for each), and blocks that are sent to the tasks at once.
BLOCK_CHARS, GROUP = 1 << 20, 4
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 22
#: Bits of a band's number, and of an item's, in a packed key.
_BAND_BITS, _ITEM_BITS = 30, 18
MATCHES = "doc_id long, item_id long, edits long, start long, end long"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Each code point in lower case, or a space if it is neither letter, mark nor digit."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts, where each text's begin, and each one's place in its own text."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
    codes = _fold_table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    space = codes == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[starts[starts < len(codes)]] = ~space[starts[starts < len(codes)]]  # none at the beginning of a text
    kept = np.flatnonzero(keep)
    cut = np.searchsorted(kept, np.append(starts, ends[-1:]))
    return codes[kept], cut, kept - np.repeat(starts, np.diff(cut))


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, across texts too."""
    h, width = codes.astype(np.uint64), 1
    while 2 * width <= q:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(pow(int(_FACTOR), width, 1 << 64)) + h[width:]
        width *= 2
    one = codes.astype(np.uint64)
    while width < q:
        h, width = h[:-1] * _FACTOR + one[width : width + len(h) - 1], width + 1
    return mix(h)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items, folded, and the index of their q-grams."""

    ids: tuple
    texts: tuple[np.ndarray, ...]
    edits: np.ndarray
    least: np.ndarray
    hashes: np.ndarray  # distinct, ascending
    begins: np.ndarray  # of their places, with one entry more
    item: np.ndarray
    place: np.ndarray
    short: tuple[int, ...]  # items that are looked for by pieces, not by q-grams

    @staticmethod
    def of(rows: list[tuple[int | None, str]], percent: int) -> Items:
        """Items without a folded character are left out."""
        kept = {}
        for item_id, text in rows:
            codes = fold([text or ""])[0]
            codes = codes[:-1] if len(codes) and codes[-1] == 0x20 else codes
            if len(codes):
                kept.setdefault((item_id, codes.tobytes()), codes)
        order = sorted(kept, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
        texts = tuple(kept[k] for k in order)
        m = np.array([len(t) for t in texts], np.int64)
        edits = m * percent // 100
        least = m + 1 - Q - edits * Q
        h = np.concatenate([np.zeros(0, np.uint64), *[grams(t) for t, bound in zip(texts, least) if bound > 0]])
        n = np.where(least > 0, m - Q + 1, 0)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        place = (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        by = np.argsort(h, kind="stable")
        hashes, begins = np.unique(h[by], return_index=True)
        return Items(tuple(k[0] for k in order), texts, edits, least, hashes, np.append(begins, len(h)), item[by], place[by], tuple(np.flatnonzero(least <= 0).tolist()))

    def filter(self) -> np.ndarray:
        """Which slots some q-gram of the items falls into."""
        slots = np.zeros(_SLOTS, bool)
        slots[(self.hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        return slots


#: Rows of an alignment after which regions that can no longer succeed are given up.
_ROWS = 12


def align(regions: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> list[tuple[int, int, int] | None]:
    """For regions (item, text, low, high, most): the fewest edits that turn a stretch of text into the whole item on
    diagonals low..high, and the stretch's start and end; None beyond `most` edits. Ties: the earliest end, then the
    latest start. All regions take their rows together; those that exceed `most` everywhere drop out."""
    out: list[tuple[int, int, int] | None] = [None] * len(regions)
    if not regions:
        return out
    who = np.array(sorted(range(len(regions)), key=lambda k: -len(regions[k][0])))
    own = [regions[k] for k in who]
    m, low, most = (np.array([f(r) for r in own], np.int64) for f in (lambda r: len(r[0]), lambda r: r[2], lambda r: r[4]))
    length, width = np.array([len(r[1]) for r in own], np.int64), np.array([r[3] - r[2] + 1 for r in own], np.int64)
    w = int(width.max())
    item, text = np.full((len(own), int(m[0])), -2, np.int64), np.full((len(own), int(m[0]) + w + 1), -1, np.int64)
    for k, (i, t, lo, hi, _) in enumerate(own):
        item[k, : len(i)] = i
        a, z = max(0, lo), min(len(t), hi + len(i) + 1)
        if z > a:
            text[k, a - lo : z - lo] = t[a:z]
    scale, big = np.int64(1 << 32), np.int64(1 << 52)  # cost and start are packed, so that of equal costs the latest start wins
    b = np.arange(w)
    at = low[:, None] + b
    row = np.where((at >= 0) & (at <= length[:, None]) & (b < width[:, None]), scale - 1 - np.maximum(at, 0), big)
    slope = b * scale
    for i in range(int(m[0])):
        n = int(np.searchsorted(-m, -i, "left"))  # those of more than i characters
        if n < len(m):
            m, low, most, length, width, item, text, who, row = m[:n], low[:n], most[:n], length[:n], width[:n], item[:n], text[:n], who[:n], row[:n]
        if not n:
            break
        step = row + np.where(text[:, i : i + w] == item[:, i : i + 1], 0, scale)
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + scale)
        row = np.minimum.accumulate(step - slope, axis=1) + slope
        place = low[:, None] + (i + 1) + b
        row[(place < 0) | (place > length[:, None]) | (b >= width[:, None])] = big
        cost = row >> 32
        for k in np.flatnonzero(m == i + 1).tolist():
            least = int(cost[k].min())
            if least <= most[k]:
                best = int(np.flatnonzero(cost[k] == least)[0])
                out[int(who[k])] = least, int(scale - 1 - row[k, best] % scale), int(low[k]) + i + 1 + best
        if i % _ROWS == _ROWS - 1:
            alive = cost.min(axis=1) <= most
            if not alive.all():
                m, low, most, length, width, item, text, who, row = (x[alive] for x in (m, low, most, length, width, item, text, who, row))
    return out


def _pieces(codes: np.ndarray, cut: np.ndarray, items: Items, n: int) -> Iterator[tuple[tuple[int, int], tuple]]:
    """(text, item) and a region to align for each place that holds a piece of a short item unchanged; of items without
    edits only the first place."""
    if not items.short:
        return
    for d in range(n):
        own = codes[cut[d] : cut[d + 1]]
        text = own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for i in items.short:
            item, most = items.texts[i], int(items.edits[i])
            whole = item.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ends = [len(whole) * k // (most + 1) for k in range(most + 2)]
            diagonals = set()
            for x, z in zip(ends, ends[1:]):
                at = text.find(whole[x:z])
                while at >= 0:
                    diagonals.add(at - x)
                    at = text.find(whole[x:z], at + 1) if most else -1
            for diagonal in sorted(diagonals):
                yield (d, i), (item, own, diagonal - most, diagonal + most, most)


def search(texts: list[str], blocks: list[tuple[Items, np.ndarray]]) -> list[tuple[int, int | None, int, int, int]]:
    """(text, item_id, edits, start, end) of each item of the blocks (items and their filter) in each text, with the fewest
    edits, then the earliest start; places in code points of the text as it is."""
    if len(texts) > BLOCK_ROWS:
        raise ValueError(f"at most {BLOCK_ROWS} texts at a time")
    codes, cut, origin = fold(texts)
    out = []
    for items, slots in blocks:
        found: dict[tuple[int, int], tuple] = {}
        _verify(_by_grams(codes, cut, items, slots), found)
        _verify(_pieces(codes, cut, items, len(texts)), found)
        for (d, i), (edits, start, end) in sorted(found.items()):
            places = origin[cut[d] : cut[d + 1]]
            first = int(places[start]) if start < len(places) else len(texts[d])
            out.append((d, items.ids[i], edits, first, int(places[end - 1]) + 1 if end > start else int(places[min(start, len(places) - 1)])))
    return out


def _verify(regions: Iterator[tuple[tuple[int, int], tuple]], found: dict[tuple[int, int], tuple]) -> None:
    """Aligns regions in groups; found keeps the best place of each text and item."""
    while group := list(islice(regions, 256)):
        for (owner, _), hit in zip(group, align([region for _, region in group])):
            if hit and (owner not in found or hit < found[owner]):
                found[owner] = hit


def _by_grams(codes: np.ndarray, cut: np.ndarray, items: Items, slots: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple]]:
    """(text, item) and a region to align wherever bands share enough q-grams."""
    h = grams(codes)
    if not len(h) or not len(items.hashes):
        return
    near = np.flatnonzero(slots[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.hashes, h[near]), len(items.hashes) - 1)
    true = items.hashes[at] == h[near]
    near, at = near[true], at[true]
    doc = np.searchsorted(cut, near, "right") - 1
    inside = near + Q <= cut[doc + 1]
    near, at, doc = near[inside], at[inside], doc[inside]
    n = items.begins[at + 1] - items.begins[at]
    item, place = gather(items.item, items.begins[at], n), gather(items.place, items.begins[at], n)
    longest = max(len(t) for t in items.texts)
    item, place = item.astype(np.int64), place.astype(np.int64)
    band = (np.repeat(near - cut[doc], n) - place + longest) // (items.edits[item] + 1)
    key = (np.repeat(doc, n) << (_BAND_BITS + _ITEM_BITS)) | (item << _BAND_BITS) | band
    key, count = np.unique(key, return_counts=True)
    item = (key >> _BAND_BITS) & ((1 << _ITEM_BITS) - 1)
    following = np.zeros(len(key), np.int64)
    following[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    for k in np.flatnonzero(count + following >= items.least[item]).tolist():
        d, i, j = int(key[k] >> (_BAND_BITS + _ITEM_BITS)), int(item[k]), int(key[k] & ((1 << _BAND_BITS) - 1))
        most = int(items.edits[i])
        low = j * (most + 1) - longest
        # the q-grams lie in the band; ends of the stretch without a q-gram may leave it by as many places as edits
        yield (d, i), (items.texts[i], codes[cut[d] : cut[d + 1]], low - most, low + 2 * most + 1 + most, most)


def contaminations(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """doc_id, item_id, edits, start, end (code points of the text) of each benchmark item (item_id, text) in each
    document (doc_id, text), whole texts throughout.

    One row per document row and item, with its best place: the fewest edits, then the earliest start and end. A null text holds nothing; a null item, or one without
    a letter or digit, is looked for in vain; equal items with one item_id are one. doc_id may be null or repeat: rows are searched one by
    one. Other columns are ignored; an empty table on either side gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = _groups(benchmark, percent)
    found = []
    for number, shared in groups:
        hits = map_arrow(own, lambda it, b=shared: _search(it, b), MATCHES)
        if number == 1:
            return hits
        found.append(materialize(hits, "contaminations"))
        _drop(shared)
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item occurs; cases as in contaminations."""
    names, docs = docs.columns, aside(docs)
    for number, shared in _groups(benchmark, percent):
        docs = map_arrow(docs, lambda it, b=shared: _clean(it, b), docs.schema)
        if number > 1:
            docs = materialize(docs, "clean")
            _drop(shared)
    return docs.toDF(*names)


def _groups(benchmark: DataFrame, percent: int) -> Iterator[tuple[int, list]]:
    """How many groups there are, and a group's blocks of items, indexed and broadcast when it is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars, rows = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-chars // BLOCK_CHARS), -(-rows // (1 << (_ITEM_BITS - 1))))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for at in range(0, n, GROUP):
        yield -(-n // GROUP), [spark.sparkContext.broadcast(Items.of([tuple(r) for r in items.where(block == k).collect()], percent)) for k in range(at, min(at + GROUP, n))]


def _drop(shared: list) -> None:
    for block in shared:
        block.destroy()


def _indexed(shared: list) -> list[tuple[Items, np.ndarray]]:
    return [(b.value, b.value.filter()) for b in shared]


def _clean(batches: Iterator[pa.RecordBatch], shared: list) -> Iterator[pa.RecordBatch]:
    blocks = _indexed(shared)
    for batch, text in text_blocks(batches):
        keep = np.ones(len(text), bool)
        keep[[row[0] for row in search(text.to_pylist(), blocks)]] = False
        yield batch.filter(pa.array(keep))


def _search(batches: Iterator[pa.RecordBatch], shared: list) -> Iterator[pa.RecordBatch]:
    blocks = _indexed(shared)
    for batch, text in text_blocks(batches):
        rows = search(text.to_pylist(), blocks)
        if rows:
            doc, item, edits, start, end = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (item, edits, start, end))], names=[x.split()[0] for x in MATCHES.split(", ")])
