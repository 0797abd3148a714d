"""Incremental state: the counter of search terms as a stream.

The counter is a folder of what each batch adds: a batch writes the terms it holds, no others, under its own number, so
that one that runs again replaces its own rows and changes nothing. A fold sums what all batches so far have added into
one table, which later reads begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexatlas.operators.loading import search_terms

_COUNTS = "term string, times long, last_seen timestamp_ntz"


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events, as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_terms(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Terms (event_type) counted in windows of event time (ts); events later than the watermark are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width), F.lower(F.trim("event_type")).alias("term")).agg(F.count("*").alias("times"))


def add_batch(batch: DataFrame, number: int, target: str) -> None:
    """Writes what a batch of searches (term, ts) adds to the counter: its own terms, once, whenever it runs. A batch that
    a fold has taken in already is left out."""
    if number > _folded(batch.sparkSession, target):
        counts = search_terms(batch).select("term", "times", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))
        counts.write.mode("overwrite").parquet(f"{target}/added/batch={number}")


def _folded(spark: SparkSession, target: str) -> int:
    """The last batch that the counter's folds hold; -1 before any."""
    return max([-1, *(int(n) for n in _names(spark, f"{target}/folded", "upto="))])


def _names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows prefix in the names of the parts of a folder that are written whole."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    whole = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(s.getPath().getName()[len(prefix) :] for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix) and whole(s.getPath()))


def counted_terms(spark: SparkSession, target: str) -> DataFrame:
    """The counter: term, times, last_seen. The last fold, and what batches since have added."""
    upto = _folded(spark, target)
    parts = [f"{target}/folded/upto={upto}"] if upto >= 0 else []
    parts += [f"{target}/added/batch={n}" for n in _names(spark, f"{target}/added", "batch=") if int(n) > upto]
    rows = spark.read.schema(_COUNTS).parquet(*parts) if parts else spark.createDataFrame([], _COUNTS)
    return rows.groupBy("term").agg(F.sum("times").alias("times"), F.max("last_seen").alias("last_seen"))


def fold_batches(spark: SparkSession, target: str) -> None:
    """Sums all batches so far into one table; their own files stay for readers that began before."""
    numbers = [int(n) for n in _names(spark, f"{target}/added", "batch=")]
    if numbers and max(numbers) > _folded(spark, target):
        counted_terms(spark, target).write.mode("overwrite").parquet(f"{target}/folded/upto={max(numbers)}")


def start_counter(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counter of terms (event_type) at target: each batch adds its own; read it by counted_terms."""
    own = events.select(F.col("event_type").alias("term"), "ts")
    return own.writeStream.foreachBatch(lambda batch, n: add_batch(batch, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
