"""An extraction against the map: each side is computed once; odd rows; numbers that need no rule but the first."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions import numbering
from lexatlas.operators.quality import place_differences

EXPECTED = [("LA", "1", "2", None, "14"), ("LA", "1", "2", None, "14"), ("LA", "1", "3", "4", "14"), ("LA", None, None, None, "7  bis"), ("LA", "1", "2", "9", "29-BIS"), (None, "1", "2", None, "5"), ("LB", "1", "2", None, None), ("LB", "1", "2", None, "3 A"), ("LB", "1", "2", None, "")]
EXTRACTED = [("LA", "7 Bis"), ("LA", "29 bis"), ("LA", "8-A"), ("LA", "8-A"), ("LA", "8 A"), (None, "5"), ("LB", None), ("LB", None), ("LB", " "), ("LC", "14")]
MISSING = {("LA", "1", "2", None, "14", "missing"), ("LA", "1", "3", "4", "14", "missing"), (None, "1", "2", None, "5", "missing"), ("LB", "1", "2", None, None, "missing"), ("LB", "1", "2", None, "3-A", "missing")}
EXTRA = {("LA", "?", None, None, "8-A", "extra"), (None, "?", None, None, "5", "extra"), ("LB", "?", None, None, None, "extra"), ("LC", "?", None, None, "14", "extra")}


def _sides(spark):
    return spark.createDataFrame(EXPECTED, "law string, title string, chapter string, section string, number string"), spark.createDataFrame(EXTRACTED, "law string, number string")


def test_nulls_repeats_and_other_writings(spark):
    """A null law or number equals none; a place or number that comes twice is one row."""
    rows = [tuple(r) for r in place_differences(*_sides(spark)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == MISSING | EXTRA


def test_empty_sides_and_bare_nulls(spark):
    e, a = _sides(spark)
    assert {r["state"] for r in place_differences(e.limit(0), a).collect()} == {"extra"}
    assert place_differences(e.limit(0), a.limit(0)).count() == 0
    no_sections = place_differences(e.withColumn("section", F.lit(None)), a.limit(0))
    assert dict(no_sections.dtypes)["section"] == "string" and no_sections.count() == 8


def test_each_side_is_computed_once(spark):
    """Before, each side's numbers were made for the missing and again for the extra, and once more to see which are null."""
    read = spark.sparkContext.accumulator(0)

    def written(k):
        read.add(1)
        return f"{k}-BIS"

    number = F.udf(written, "string")
    ids = spark.range(0, 300, 1, 3)
    place = [F.lit("LA").alias("law"), *(F.lit("1").alias(c) for c in ("title", "chapter", "section"))]
    expected = ids.where("id % 7 > 0").select(*place, number("id").alias("number"))
    extracted = ids.where("id % 5 > 0").select(place[0], number("id").alias("number"))
    rows = place_differences(expected, extracted).collect()
    assert {(r["state"], r["number"]) for r in rows} == {("missing", f"{k} Bis") for k in range(300) if k % 7 and not k % 5} | {("extra", f"{k} Bis") for k in range(300) if k % 5 and not k % 7}
    assert read.value == sum(k % 7 > 0 for k in range(300)) + sum(k % 5 > 0 for k in range(300))


def test_canonical_numbers_by_all_rules(spark):
    """What is done after one look is what all rules give, other cases and letters of suffixes included."""
    numbers = ["14", "14-A", "2.1.1", "4o", "", " ", "\t14\t", "14 A", None, "Único", "29-BIS", "29bis", "29-bıs", "3-ſexies", "QUÁTER", "quater", "5 QUINTUS-2", "137-Bis-1", "14 A", "4o A BIS", "4O A", "Terna", "Bis-A", "-Ter-", "x-Bis", "12-TER 3", "8\nA"]

    def all_rules(number):
        out = F.trim(F.regexp_replace(number, r"\s+", " "))
        for s in numbering.SUFFIXES:
            out = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){s}(?![\p{{L}}\p{{N}}_])", s)
        out = F.regexp_replace(out, rf"(\d+[oa]?) ([A-Z])( (?:{numbering.JOINED_SUFFIXES})|$)", "$1-$2$3")
        out = F.regexp_replace(out, rf"-(?={numbering.JOINED_SUFFIXES})", " ")
        return F.regexp_replace(out, rf"({numbering.JOINED_SUFFIXES})-(\d)", "$1 $2")

    rows = spark.createDataFrame([(n,) for n in numbers], "number string").select("number", numbering.canonical(F.col("number")).alias("got"), all_rules(F.col("number")).alias("want")).collect()
    assert [(r["number"], r["got"]) for r in rows] == [(r["number"], r["want"]) for r in rows]
