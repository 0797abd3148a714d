"""The stream of search terms gives what the batch gives."""

from __future__ import annotations

from lexatlas.operators import loading
from lexatlas.sources.workspace import table
from lexatlas.streaming import counters
from pyspark.sql import functions as F


def test_counter_equals_batch(spark, small, tmp_path):
    events = table(spark, small, "events")
    folder = tmp_path / "in"
    events.repartition(3).write.parquet(str(folder))
    stream = counters.read_events(spark, str(folder), events.schema)
    counters.start_counter(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {tuple(r) for r in counters.counted_terms(spark, str(tmp_path / "out")).collect()}
    batch = loading.search_terms(events.select(F.col("event_type").alias("term"), "ts"))
    assert got == {tuple(r) for r in batch.collect()}


def test_a_batch_counts_once_and_writes_its_own_terms(spark, tmp_path):
    target = str(tmp_path / "out")
    batch = lambda *terms: spark.createDataFrame([(t, 0) for t in terms], "term string, at int").select("term", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("ts"))
    read = lambda: {r["term"]: r["times"] for r in counters.counted_terms(spark, target).collect()}
    assert read() == {}
    counters.add_batch(batch("IVA ", "renta", "x", None, "iva"), 0, target)
    counters.add_batch(batch("iva", "casa"), 1, target)
    want = {"iva": 3, "renta": 1, "casa": 1}
    assert read() == want
    counters.add_batch(batch("iva", "casa"), 1, target)
    assert read() == want and {r["term"] for r in spark.read.parquet(f"{target}/added/batch=1").collect()} == {"iva", "casa"}
    counters.fold_batches(spark, target)
    counters.add_batch(batch("iva", "casa"), 1, target)
    counters.add_batch(batch("casa"), 2, target)
    counters.fold_batches(spark, target)
    counters.fold_batches(spark, target)
    counters.add_batch(batch("nuevo"), 10, target)
    assert read() == want | {"casa": 2, "nuevo": 1}


def test_windows_hold_all_events_in_time(spark, small, tmp_path):
    events = table(spark, small, "events")
    folder = tmp_path / "in"
    events.coalesce(1).write.parquet(str(folder))
    counted = counters.windowed_terms(counters.read_events(spark, str(folder), events.schema), late="1000 days")
    query = counted.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windowed").agg(F.sum("times")).first()[0] == events.count()
