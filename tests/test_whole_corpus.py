"""The corpus over all orders and line items, its gaps, and its numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.plans import QUERIES
from lexatlas.sources.corpus import load
from lexatlas.sources.ranking import numbered
from lexatlas.sources.workspace import table


def test_every_order_and_line_item(spark, small):
    c = load(spark, small)
    assert c.articles.where("id < 900000000000").count() == table(spark, small, "orders").count()
    assert c.paragraphs.count() == table(spark, small, "lineitem").count()
    assert load(spark, small) is c


def test_gaps_are_added(spark, small):
    assert {r["id"] for r in QUERIES["capitulos_vacios"](spark, small).collect()} >= {2000 + k for k in range(5)}
    c = load(spark, small)
    bare = c.articles.join(c.paragraphs, c.articles.id == c.paragraphs.article_id, "left_anti")
    assert {r["id"] for r in bare.collect()} >= {900000000000 + k for k in range(25)}
    assert c.articles.where("position = 10").count() == 0


def test_numbered(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"))
    got = {(r["g"], r["id"]): r["n"] for r in numbered(rows.repartition(5), ["g"], ["id"]).collect()}
    want, seen = {}, {}
    for r in rows.orderBy("id").collect():
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        want[r["g"], r["id"]] = seen[r["g"]]
    assert got == want
    assert numbered(rows.limit(0), ["g"], ["id"]).count() == 0
