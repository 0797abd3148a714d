"""Hard negatives of anchor vectors: rows of another label, less similar than a positive, but not by much.

Components are scaled and rounded down to integers, so that scores are exact inner products. For an anchor, rows stand in
order of score, the highest first, ties by id. Rows are dealt to tasks in blocks; anchors come in blocks of bounded size,
broadcast one after the other. A task sorts all scores of an anchor in its block of rows (lexsort by score and id); each
positive's upper limit is found by binary search in the sorted scores of other labels, and from there the first rows
down to the lower limit are read. First among the first of all blocks are first of all: the few rows that blocks keep of
an anchor are merged by Spark. Two passes: the first finds each anchor's positives, the second their negatives. No task
ever holds all scores of an anchor, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.sources.workspace import map_arrow, materialize

#: Components of the anchors of a block (8 bytes each); rows whose scores are sorted together; scores held at once.
ANCHOR_COMPONENTS, ROWS, SCORES = 1 << 20, 1 << 14, 1 << 20
#: A scaled component of this size or more could make a score that doesn't fit in 64 bits.
LARGEST = 2.0**31

_VECTOR = "uid long, id long, label long, size int, vector binary"
_FOUND = "anchor long, rank_key long, id long, score long, uid long"


def _rounded(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Vectors as int64 bytes; rows with a null or non-finite component go."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = np.asarray(pc.list_value_length(vectors), np.int64)
        flat = pc.list_flatten(vectors)
        values = np.asarray(pc.fill_null(flat, float("nan")), np.float64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        good = np.ones(len(sizes), bool)
        good[row[~np.isfinite(values)]] = False
        keep = good[row]
        with np.errstate(over="ignore"):
            scaled = np.floor(values[keep] * scale)
        if len(scaled) and np.abs(scaled).max() >= LARGEST:
            raise ValueError(f"a component times {scale} is {LARGEST:.0f} or more in size")
        data, at = scaled.astype("<i8"), np.concatenate([[0], np.cumsum(sizes[good])])
        packed = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        own = [c.filter(pa.array(good)) for c in (batch.column("uid"), batch.column("id"), batch.column("label"))]
        yield pa.RecordBatch.from_arrays([*own, pa.array(sizes[good], pa.int32()), pa.array(packed, pa.binary())], names=["uid", "id", "label", "size", "vector"])


def rounded(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """Rows that take part, from (id, embedding, label): uid (a number of its own for each), id, label, size, vector."""
    whole = vectors.where("id is not null and label is not null and embedding is not null").select(
        F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(whole, lambda it: _rounded(it, scale), _VECTOR)


def _matrix(vectors: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Vectors as rows of one width, zeros behind the shorter ones."""
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(vectors), "<i8")
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exactly: in doubles where all sums stay below 2**53, else in 64-bit integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise ValueError("scores need more than 64 bits")
    return a @ b.T


class Anchors:
    """A block of anchors: what tasks need of them, sent to each executor once."""

    def __init__(self, rows: list):
        self.uid, self.id, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("uid", "id", "label"))
        sizes = np.array([r["size"] for r in rows], np.int64)
        self.width = int(sizes.max(initial=0))
        self.matrix = _matrix([bytes(r["vector"]) for r in rows], sizes, self.width)
        #: Positives' scores of an anchor, with the number that says which (anchor, positive) they are; second pass.
        self.wanted: dict[int, list[tuple[int, int]]] = {}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """uid, id, label, size and vectors of about ROWS rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _joined(held)
            held, n = [], 0
    if n:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple:
    columns = pa.Table.from_batches(batches)
    return (*(np.asarray(columns.column(c), np.int64) for c in ("uid", "id", "label", "size")), columns.column("vector").to_pylist())


def _sorted_scores(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple]:
    """For each anchor (its place in the block) and block of rows: uid, id, label and score of all rows, in order."""
    for uid, ids, label, size, vectors in _blocks(batches):
        width = max(anchors.width, int(size.max(initial=0)))
        rows = _matrix(vectors, size, width)
        own = np.pad(anchors.matrix, ((0, 0), (0, width - anchors.width)))
        step = max(1, SCORES // len(uid))
        for at in range(0, len(own), step):
            for n, scores in enumerate(_products(own[at : at + step], rows), at):
                order = np.lexsort((uid, ids, -scores))
                yield n, uid[order], ids[order], label[order], scores[order]


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "rank_key", "id", "score", "uid"])


def _positives(batches: Iterator[pa.RecordBatch], shared, count: int) -> Iterator[pa.RecordBatch]:
    """Of each anchor the first `count` other rows of its label in a block of rows."""
    anchors, parts = shared.value, []
    for n, uid, ids, label, scores in _sorted_scores(batches, anchors):
        first = np.flatnonzero((label == anchors.label[n]) & (uid != anchors.uid[n]))[:count]
        k = len(first)
        parts.append((np.full(k, anchors.uid[n]), np.full(k, -1), ids[first], scores[first], uid[first]))
        if len(parts) >= 4096:
            yield _batch(parts)
            parts = []
    if parts:
        yield _batch(parts)


def _negatives(batches: Iterator[pa.RecordBatch], shared, count: int, lower: int, upper: int) -> Iterator[pa.RecordBatch]:
    """Of each anchor and positive the first `count` rows of other labels between the limits in a block of rows."""
    anchors, parts = shared.value, []
    for n, uid, ids, label, scores in _sorted_scores(batches, anchors):
        other = np.flatnonzero(label != anchors.label[n])
        rising = -scores[other]
        for key, score in anchors.wanted.get(int(anchors.uid[n]), ()):
            begin = int(np.searchsorted(rising, -(upper * score // 100), "left"))
            end = int(np.searchsorted(rising, lower * -score // 100, "right"))  # -ceil(lower * score / 100)
            first = other[begin : min(end, begin + count)]
            k = len(first)
            if k:
                parts.append((np.full(k, anchors.uid[n]), np.full(k, key), ids[first], scores[first], uid[first]))
        if len(parts) >= 4096:
            yield _batch(parts)
            parts = []
    if parts:
        yield _batch(parts)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` other rows of the same label, the first `negatives` rows of other labels whose score is between `lower`
    and `upper` percent of the positive's; fewer where there are fewer.

    vectors: (id, embedding, label). anchors: a condition on them (a Column of booleans over id and label).
    Scores are inner products of components floor(scale * x). Order: score from the highest, then id, then rows of one
    id in the order they were read in. Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Of vectors of different lengths the shorter one counts as filled up with zeros; an empty one scores 0. Each
    row counts by itself, also if its id repeats: a repeated anchor gives its rows again, and its other row may be its
    positive. Where a positive's score is negative no row lies between the limits; where it is 0 rows of score 0 do.
    Other columns are ignored; an empty table gives no rows. Components of 2**31 or more after scaling are a ValueError.
    """
    spark = vectors.sparkSession
    rows = materialize(rounded(vectors.select("id", "embedding", "label"), scale), "vectors")
    chosen = materialize(rows.where(anchors), "anchors")
    n, width = chosen.agg(F.count("*"), F.max("size")).first()
    n_rows = rows.count()
    dealt = materialize(rows.repartition(max(1, -(-n_rows // ROWS)), "uid"), "dealt") if n else rows
    blocks = max(1, -(-n * max(width or 1, 1) // ANCHOR_COMPONENTS))
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "uid")
    by_pair = Window.partitionBy("anchor", "rank_key").orderBy(F.desc("score"), "id", "uid")
    out = []
    for block in range(blocks):
        own = Anchors(chosen.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).collect())
        sent = spark.sparkContext.broadcast(own)
        best = map_arrow(dealt, lambda it, b=sent: _positives(it, b, positives), _FOUND)
        best = materialize(best.withColumn("rank_key", F.row_number().over(by_anchor).cast("long")).where(F.col("rank_key") <= positives), "positives")
        for r in best.select("anchor", "rank_key", "score").collect():
            own.wanted.setdefault(r["anchor"], []).append((r["rank_key"], r["score"]))
        again = spark.sparkContext.broadcast(own)
        near = map_arrow(dealt, lambda it, b=again: _negatives(it, b, negatives, lower, upper), _FOUND)
        near = near.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
        pairs = best.select("anchor", "rank_key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        near = near.select("anchor", "rank_key", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = chosen.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
        out.append(near.join(pairs, ["anchor", "rank_key"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return reduce(DataFrame.unionByName, out)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10"""
