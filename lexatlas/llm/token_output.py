"""Token ids as Parquet list columns, in doc_id order, for selective reads.

A token table is a folder of Parquet files whose names follow the order of doc_id. Each row is a document: bucket (the
file's number), doc_id, n_tokens, ids. doc_id and n_tokens are delta encoded, ids dictionary encoded with delta
encoding where the dictionary gets too large (Parquet writer version 2), with small pages, a page index and row groups
of a set size; a reader of a few documents or of metadata alone skips the other pages and the id column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.llm.arrays import list_crc32, text_blocks
from lexatlas.llm.tokens import encoder
from lexatlas.sources.workspace import map_arrow

SCHEMA = "bucket int, doc_id long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page, and rows of a page at most.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, text in text_blocks(batches):
        flat, offsets = encoder(path).encode(text)
        n = len(text)
        ids = np.insert(flat, offsets[1:], end_id).astype(np.int32)
        ends = (offsets + np.arange(n + 1)).astype(np.int32)
        doc_id = batch.column("doc_id")
        bucket = np.searchsorted(bounds, doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), doc_id, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["bucket", "doc_id", "n_tokens", "ids"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None) -> None:
    """Encodes the documents (doc_id, text) and writes a token table at path, in ascending doc_id order.

    A null text is empty (end_id alone); a null doc_id comes first; rows with equal doc_id follow one another by
    n_tokens, then by a hash of their ids. Other columns are ignored. Texts are encoded where they are scanned, so that ids are shuffled, not text;
    each bucket is a range of doc_id of about equal size, cut at approximate quantiles of doc_id alone.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = [i / files for i in range(1, files)]
    row = own.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)) if at else F.array(F.lit(0.5)), F.lit(20 * files))).first()
    bounds = np.array(sorted(set(row[0] or [])) if at else [], np.int64)
    ids = map_arrow(own, lambda it: _encode(it, tokenizer, end_id, bounds), SCHEMA)
    ids.repartitionById(files, F.col("bucket")).sortWithinPartitions("doc_id", "n_tokens", F.xxhash64("ids")).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The token table, or its documents from doc_id first to last; select columns to read no others."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def with_starts(meta: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before each, to rows with bucket, doc_id, n_tokens (one per document).

    Buckets are few (one per file); their totals are summed over the buckets, then a running sum goes within each.
    """
    totals = meta.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    own = Window.partitionBy("bucket").orderBy("doc_id", "n_tokens", *[c for c in meta.columns if c == "tie"])
    running = F.sum("n_tokens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    return meta.join(F.broadcast(before), "bucket").withColumn("start", F.col("base") + running).drop("base")


def digest(rows: DataFrame) -> DataFrame:
    """bucket, doc_id, n_tokens, ids_crc32 of rows of a token table, and tie, by which the file orders documents of equal
    doc_id and n_tokens."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("doc_id"), b.column("n_tokens"), pa.array(list_crc32(b.column("ids"))), b.column("tie")], names=["bucket", "doc_id", "n_tokens", "ids_crc32", "tie"])

    return map_arrow(rows.withColumn("tie", F.xxhash64("ids")), crc, "bucket int, doc_id long, n_tokens long, ids_crc32 long, tie long")
