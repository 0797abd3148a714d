"""Learned decision lists over document statistics.

Sequential covering: from labelled statistics, rules that recognise bad documents are learned one after the other. A rule
is a conjunction of thresholds, grown greedily by information gain on two thirds of the rows and pruned from its end on
the other third; documents that it covers are taken away, and the next rule is learned. The list stops when a rule is no
longer precise. It is applied as ordered Spark conditional expressions (when ... when ... otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.arrays import raw, sums, text_blocks, windows, within, word_spans
from lexatlas.sources.workspace import map_arrow

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
#: Words of a window whose repetition counts.
REPEAT = 5


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, text in text_blocks(batches):
        data, ends = raw(text)
        in_word = ~_WHITE[data]
        chars = sums(in_word & ((data & 0xC0) != 0x80), ends)
        symbols = sums(_SYMBOL[data], ends)

        hashes, lines, at, size = word_spans(text, separators=_LINE_END)
        doc = np.repeat(np.arange(len(text)), np.diff(lines))
        told = np.concatenate([np.zeros(1, np.int64), np.cumsum(in_word)])
        with_word = told[at + size] > told[at]
        _, first = np.unique(within(hashes, doc)[with_word], return_index=True)
        twice = np.bincount(doc[with_word], minlength=len(text)) - np.bincount(doc[with_word][first], minlength=len(text))

        hashes, words, _, _ = word_spans(text)
        window, doc, at = windows(hashes, words, REPEAT)
        _, which, count = np.unique(within(window, doc), return_inverse=True, return_counts=True)
        at = at[count[which] > 1]
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + REPEAT, -1)
        repeated = sums(np.cumsum(step)[:-1] > 0, words)
        columns = [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in (np.diff(words), chars, symbols, twice, repeated))]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in STATS.split(", ")])


def statistics(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier line), n_repeat_words (words in five-word windows found twice or more in the text).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. A null text has none; each row is measured by itself, so that doc_id
    may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _stats, STATS)


#: Features of the rules: each is a statistic, or a hundredfold ratio of two (0 where the divisor is 0).
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "chars_per_100_words": ("word_chars", "n_words"),
    "symbols_per_100_words": ("n_symbols", "n_words"),
    "symbols": ("n_symbols", None),
    "dup_lines": ("n_dup_lines", None),
    "repeat_per_100_words": ("n_repeat_words", "n_words"),
}


def feature(name: str) -> Column:
    top, below = FEATURES[name]
    if below is None:
        return F.col(top).cast("double")
    return F.when(F.col(below) > 0, F.col(top) * 100.0 / F.col(below)).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = feature(self.feature)
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(rows.values()))), bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _candidates(rows: dict[str, np.ndarray], inside: np.ndarray, cuts: int) -> list[Condition]:
    out = []
    for name, x in rows.items():
        seen = np.unique(x[inside])
        if len(seen) > cuts:
            seen = np.unique(np.quantile(seen, np.linspace(0, 1, cuts)))
        for t in (seen[1:] + seen[:-1]) / 2:
            out += [Condition(name, True, float(t)), Condition(name, False, float(t))]
    return out


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (bad & inside).any() and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for c in _candidates(rows, inside, cuts):
            now = inside & c.holds(rows)
            q, m = (bad & now).sum(), (~bad & now).sum()
            if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(rows)
    return rule


def _prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        own = covers(r, rows)
        return ((bad & own).sum() - (~bad & own).sum()) / max(1, own.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 5, rules: int = 16, longest: int = 4, cuts: int = 32) -> list[Rule]:
    """An ordered list of rules for bad rows; each is right on at least `precision` of the rows that reach it, in the
    growing and in the pruning part, and covers at least `support` bad rows. Ties go to the earlier candidate."""
    found: list[Rule] = []
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(found) < rules and (bad & left).sum() >= support:
        pick = lambda keep: ({k: v[keep] for k, v in rows.items()}, bad[keep])
        rule = _grow(*pick(left & ~part), cuts, longest)
        rule = _prune(rule, *pick(left & part)) if rule else rule
        own = left & covers(rule, rows) if rule else np.zeros(len(bad), bool)
        if not rule or (bad & own).sum() < support or any((bad & own & s).sum() < precision * (own & s).sum() for s in (part, ~part)):
            break
        found.append(rule)
        left &= ~own
    return found


def verdict(rules: list[Rule]) -> Column:
    """The decision list: false where one of the rules holds, tried in their order, else true."""
    out = None
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Learns from labels (doc_id, quality: 0 bad, 1 good) of documents; rows with a null in either are left out.

    At most `sample` labelled rows are taken, those with the smallest hash of doc_id: this bounds what reaches the
    driver, at any size of the corpus. Without labels, the list is empty and keeps everything.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    stats = statistics(docs.join(F.broadcast(own.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = stats.join(F.broadcast(own), "doc_id").select("doc_id", "quality", *[feature(n).alias(n) for n in FEATURES])
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(sample).toPandas()
    table = table.sort_values(["doc_id", "quality", *FEATURES], kind="stable")
    order = np.random.default_rng(7).permutation(len(table))
    return learn({n: table[n].to_numpy()[order] for n in FEATURES}, (table["quality"] == 0).to_numpy()[order])


def apply(docs: DataFrame, rules: list[Rule], least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """The statistics of each document, base_failed (fewer than least_words words, or more than most_repeated percent
    of them in repeated windows), and kept: not base_failed, and not rejected by the rules."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
