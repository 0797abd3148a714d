"""Operators that keep the caller's columns keep their values, whatever their names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexatlas.llm import decontamination, language_id, line_dedup, ngram_join

NAMES = ["at", "_at", "_gone", "_lines", "_hash", "_doc", "_text", "_th", "_n", "_one", "_r", "score", "lang_pred", "n_lines", "n_removed", "lines", "text_hash", "pos", "a", "b", "n", "d", "t", "p", "first", "last", "id", "th", "root", "size", "prefix", "keep", "_lang", "lang", "source", "label", "column 3", "Score", "N_Lines", "with space", "with.dot"]


def docs(spark, names):
    lines = [f"the quick brown fox number {n} jumps over the lazy dog and runs away\nsecond line of text {n} here\nand a third one {n}" for n in range(24)]
    texts = [*lines, lines[0] + "\nx", "a b", None, "", lines[1]]
    rows = [(n, t, "en" if t else None, *(f"{c}-{n}" for c in names)) for n, t in enumerate(texts)]
    columns = ["doc_id long", "text string", "language string", *(f"`{c}` string" for c in names)]
    return spark.createDataFrame(rows, ", ".join(columns))


def kept(before, after, names) -> int:
    want = {r["doc_id"]: [r[c] for c in names] for r in before.collect()}
    got = after.collect()
    for r in got:
        assert [r[c] for c in names] == want[r["doc_id"]]
    return len(got)


def few(all_names: list[str]) -> list[list[str]]:
    """Names that differ by more than case, in two tables."""
    one = [c for n, c in enumerate(all_names) if c.lower() not in [x.lower() for x in all_names[:n]]]
    return [one, ["Score", "N_Lines", "AT", "_TH", "N_chars"]]


@pytest.mark.parametrize("names", few(NAMES))
def test_values_stay(spark, small, names):
    own = docs(spark, names)
    assert kept(own, line_dedup.dedup_lines(own), [c for c in names if c.lower() not in ("n_lines", "n_removed")]) == 29
    assert kept(own, ngram_join.one_of_each(own), names) > 0
    benchmark = spark.createDataFrame([(1, "second line of text 7 here")], "item_id long, text string")
    assert 0 < kept(own, decontamination.clean(own, benchmark), names) < 29
    model = language_id.fit(own.withColumnRenamed("lang", "_other").withColumnRenamed("language", "lang") if "lang" in names else own.withColumnRenamed("language", "lang"), F.lit(True))
    assert kept(own, language_id.predict(own, model), [c for c in names if c.lower() not in ("lang_pred", "score")]) == 29


@pytest.mark.parametrize("stage", ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination"])
def test_stages(spark, small, stage):
    names = [c for c in few(NAMES)[0] if c not in ("lang", "source")]
    own = docs(spark, names).withColumnsRenamed({"language": "lang"}).withColumn("n_chars", F.length("text").cast("long"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, own, small)
    assert out.columns == own.columns
    assert kept(own, out, names) > 0


def test_an_item_after_many_empty_texts(spark):
    """A block of texts is bounded in rows, too: none is out of reach."""
    n = 40_000
    rows = spark.range(n).selectExpr("id as doc_id", "'' as text").coalesce(1).unionByName(spark.createDataFrame([(n, "say the planted benchmark item of this test in full and go on")], "doc_id long, text string")).coalesce(1)
    benchmark = spark.createDataFrame([(5, "the planted benchmark item of this test in full")], "item_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(rows, benchmark).collect()] == [(n, 5)]
        assert decontamination.clean(rows, benchmark).count() == n
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    with pytest.raises(ValueError):
        decontamination.search([""] * 20_000, [])
