"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; what isn't a letter separates. The n-grams of one to three letters of each word, with the space
before and after it, are hashed into a fixed number of buckets. Training counts buckets by language; the model is the
matrix of log probabilities, in blocks of a fixed number of languages, each of which goes to every task. Scoring sums the
rows of a document's buckets: the product of the sparse count matrix and the model, for many documents at a time; where
there are several blocks, a document's best language and the sum of its likelihoods are carried from one to the next.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexatlas.llm.arrays import text_blocks
from lexatlas.llm.columns import aside
from lexatlas.sources.workspace import map_arrow, materialize

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages of one block of the model: 16 MB are broadcast at a time, however many languages there are.
LANGUAGES = 64
#: Languages whose counts a training task holds at once; beyond that, it passes on what it has.
HELD = 16
#: Characters of a text that are taken at once.
STEP = 1 << 17
#: A document's evidence counts as that of so many n-grams at most: else each score would be 0 or 1.
EVIDENCE = 50
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def _segments(texts: list[str]) -> Iterator[list[tuple[int, str, bool]]]:
    """Lists of (text, segment, whether it is the text's last) of about STEP characters: n-grams begin at each place of a
    segment but the last two, which begin the next segment; in the last one, at every place."""
    group, size = [], 0
    for k, text in enumerate(texts):
        padded = f" {text.lower()} "
        for at in range(0, max(1, len(padded) - 2), STEP):
            group.append((k, padded[at : at + STEP + 2], at + STEP + 2 >= len(padded)))
            size += len(group[-1][1])
            if size >= STEP:
                yield group
                group, size = [], 0
    if group:
        yield group


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The buckets of all n-grams, the text of each, ascending, and by text whether it has a letter, part by part."""
    for group in _segments(texts):
        joined = "".join(s for _, s, _ in group)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.array([k for k, _, _ in group])
        ends = np.cumsum([len(s) for _, s, _ in group])
        text = np.repeat(owner, np.diff(ends, prepend=0))
        letter = _letters()[codes]
        codes = np.where(letter, codes, 0x20).astype(np.uint32)
        begins = np.ones(len(codes), bool)
        for end, (_, _, last) in zip(ends.tolist(), group):
            if not last:
                begins[end - 2 : end] = False
        grams, places = [], []
        for n in ORDERS:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            some = np.zeros(len(h), bool)
            inner = np.zeros(len(h), bool)
            for k in range(n):
                h = (h ^ codes[k : k + len(h)]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                some |= letter[k : k + len(h)]
                if 0 < k < n - 1:
                    inner |= ~letter[k : k + len(h)]  # never across words, nor texts, as spaces surround each
            h *= np.uint32(0x9E3779B1)
            at = np.flatnonzero(some & ~inner & begins[: len(h)])
            grams.append((h[at] >> np.uint32(16)).astype(np.int64))
            places.append(text[at])
        doc = np.concatenate(places)
        order = np.argsort(doc, kind="stable")
        yield np.concatenate(grams)[order], doc[order], np.bincount(text, letter, len(texts)) > 0


@dataclass(frozen=True)
class Block:
    """Some languages in order, with log probabilities of buckets by language (a row each), and log priors."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihoods by language and text, the n-grams of each text, and whether it has a letter."""
        total, n, letters = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for flat, doc, some in buckets(texts):
            letters |= some
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            n += np.diff(cut)
            for k, weights in enumerate(self.weights):
                run = np.concatenate([np.zeros(1), np.cumsum(weights[flat], dtype=np.float64)])
                total[k] += np.diff(run[cut])
        return total, n, letters


@dataclass(frozen=True)
class Model:
    """Broadcast blocks of languages; together they are in alphabetical order."""

    blocks: tuple


#: What is known of a text after some blocks: the best language and its likelihood, the same with the evidence held, and
#: the sum of all held likelihoods relative to the largest.
_KNOWN = (("_lang", pa.string()), ("_best", pa.float64()), ("_own", pa.float64()), ("_most", pa.float64()), ("_sum", pa.float64()))


def _score(block: Block, texts: list[str], known: tuple | None) -> tuple:
    total, n, letters = block.sums(texts)
    full = total + block.priors[:, None]
    held = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1)) + block.priors[:, None]
    at = np.argmax(full, axis=0)  # a tie goes to the first in alphabetical order
    here = np.arange(len(texts))
    lang = np.array([block.languages[b] if some else UNDETERMINED for b, some in zip(at, letters)], object)
    best, own, most = full[at, here], held[at, here], held.max(axis=0)
    share = np.exp(held - most).sum(axis=0)
    if known is not None:
        lang0, best0, own0, most0, share0 = known
        better = best > best0
        lang, own, best = np.where(better, lang, lang0), np.where(better, own, own0), np.maximum(best, best0)
        top = np.maximum(most, most0)
        most, share = top, share * np.exp(most - top) + share0 * np.exp(most0 - top)
    return lang, best, own, most, share


def _count(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    number = {x: k for k, x in enumerate(languages)}
    counts: dict[int, np.ndarray] = {}  # by language; the last entry counts documents

    def send() -> pa.RecordBatch:
        rows = [(np.full(len(at), k), at, own[at]) for k, own in counts.items() for at in [np.flatnonzero(own)]]
        counts.clear()
        lang, bucket, n = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    for batch, text in text_blocks(batches):
        own = np.array([number[x] for x in batch.column("lang").to_pylist()])
        texts = text.to_pylist()
        for k in np.unique(own):
            if k not in counts:
                if len(counts) == HELD:
                    yield send()
                counts[k] = np.zeros(BUCKETS + 1, np.int64)
            mine = np.flatnonzero(own == k)
            counts[k][BUCKETS] += len(mine)
            for flat, _, _ in buckets([texts[i] for i in mine]):
                counts[k] += np.bincount(flat, minlength=BUCKETS + 1)
    if counts:
        yield send()


def fit(docs: DataFrame, train: Column, sample: int = 60_000) -> Model:
    """Learns from text and lang of the rows where `train` holds, null in neither.

    At most about `sample` rows are used (all where there are fewer), chosen by a hash of doc_id: a classifier needs no
    more, and the cost of training then doesn't grow with the corpus. Every language of these rows is learned. Counts are
    summed in each task and then by Spark; they reach the driver by blocks of LANGUAGES languages, BUCKETS sums each.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    part = min(1.0, sample / max(1, own.count()))
    if part < 1:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    languages = tuple(sorted(r["lang"] for r in own.select("lang").distinct().collect()))  # as many as sampled rows at most
    counted = map_arrow(own, lambda it: _count(it, languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(languages) > LANGUAGES:
        counted = materialize(counted, "language-counts")
    documents, blocks = 0, []
    for at in range(0, len(languages), LANGUAGES):
        names = languages[at : at + LANGUAGES]
        rows = counted.where(F.col("lang").between(at, at + len(names) - 1)).toPandas()
        counts = np.zeros((len(names), BUCKETS + 1))
        counts[rows["lang"] - at, rows["bucket"]] = rows["n"]
        grams = counts[:, :BUCKETS] + 0.5
        weights = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        blocks.append((names, weights, counts[:, BUCKETS] + 1))
        documents += int(blocks[-1][2].sum())
    share = docs.sparkSession.sparkContext.broadcast
    return Model(tuple(share(Block(names, weights, np.log(seen / documents))) for names, weights, seen in blocks))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to each row of docs (all its columns stay, with lang_pred or score replaced if there).

    score is the language's share of the posterior, with a text's evidence held to that of EVIDENCE n-grams. Of equally
    likely languages the first in alphabetical order is taken. A text that is null or has no letter, and every text if
    the model knows no language, gets `und` and score 0. The text alone decides; doc_id may be null, rows may repeat; an
    empty table gives no rows. A long text is taken STEP characters at a time.
    """
    docs = docs.drop("lang_pred", "score")
    own, shown = aside(docs), [*docs.columns, "lang_pred", "score"]
    kept, names = own.schema.fields, own.columns
    if not model.blocks:
        return own.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)}).toDF(*shown)

    def run(batches: Iterator[pa.RecordBatch], block, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        for batch, text in text_blocks(batches):
            before = None if first else tuple(batch.column(c).to_numpy(zero_copy_only=False) for c, _ in _KNOWN)
            known = _score(block.value, text.to_pylist(), before)
            columns = [batch.column(c) for c in names]
            if last:
                score = np.where(known[0] == UNDETERMINED, 0.0, np.exp(known[2] - known[3]) / known[4])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(known[0], pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, kind) for x, (_, kind) in zip(known, _KNOWN))], names=[*names, *(c for c, _ in _KNOWN)])

    passing = StructType([*kept, *(StructField(c, StringType() if c == "_lang" else DoubleType()) for c, _ in _KNOWN)])
    scored = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    count = len(model.blocks)
    for k, block in enumerate(model.blocks):
        own = map_arrow(own, lambda it, b=block, f=k == 0, z=k == count - 1: run(it, b, f, z), scored if k == count - 1 else passing)
    return own.toDF(*shown)
