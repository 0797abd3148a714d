"""What is read to write a stored index and to show a page of it; repeated ids, nulls and empty pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.operators import search_index as si
from lexatlas.sources.corpus import Corpus
from lexatlas.sources.workspace import fresh_path

ARTICLE = "id long, law string, law_kind string, kind string, number string, text string"


def test_a_corpus_is_read_once_for_all_segments(spark):
    """Before, each segment read all paragraphs and joined all articles again."""
    read = spark.sparkContext.accumulator(0)

    def of(k):
        read.add(1)
        return k // 2

    laws = spark.createDataFrame([("LA", "Ley A", "ley")], "code string, name string, kind string")
    divisions = spark.createDataFrame([(1, "titulo", "1")], "id long, kind string, number string")
    articles = spark.range(60).select("id", F.lit("LA").alias("law"), F.when(F.col("id") % 3 > 0, 1).cast("long").alias("division_id"), F.col("id").cast("string").alias("number"), F.lit("articulo").alias("kind"), F.lit(None).cast("string").alias("reforms"))
    paragraphs = spark.range(0, 100, 1, 3).select(F.lit("LA").alias("law"), F.udf(of, "long")("id").alias("article_id"), (F.col("id") % 2 + 1).alias("number"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("word "), F.col("id").cast("string"))).alias("content"))
    path, own = fresh_path(spark, "test-index"), si.corpus_articles(Corpus(laws, divisions, articles, paragraphs))
    once = read.value
    for k in range(3):
        si.add_segment(path, own.where(F.col("id") % 3 == k), f"s{k}")
    assert read.value == once > 0
    rows = {r["id"]: (r["place"], r["text"]) for r in si._read(spark, path, "articles").collect()}
    text = lambda k: "\n\n".join(f"word {i}" for i in (2 * k, 2 * k + 1) if i % 9) if k < 50 else None
    assert rows == {k: ("titulo 1" if k % 3 else None, text(k)) for k in range(60)}


def _index(spark, rows) -> str:
    path = fresh_path(spark, "test-index")
    si.add_segment(path, spark.createDataFrame(rows, ARTICLE), "a")
    return path


def test_a_page_is_read_once(spark):
    """Before, the articles of a page were read for their rows and again for their snippets."""
    path = _index(spark, [(k, "LA", "ley", "articulo", str(k), f"uno dos {k}") for k in range(200)])
    page = si.search_index(spark, path, "dos", limit=30, page=2)
    assert path.rpartition("/")[2] not in "".join(page.inputFiles())
    assert [(r["id"], r["text"], r["snippet"]) for r in page.collect()] == [(k, f"uno dos {k}", f"uno <mark>dos</mark> {k}") for k in range(30, 60)]


def test_repeated_ids_nulls_and_empty_pages(spark):
    """Each row of an id is shown with the snippet of each; a null text has an empty one."""
    path = _index(spark, [(1, "LA", "ley", "articulo", "1", "uno dos"), (1, "LA", "ley", "articulo", "1", "tres dos"), (2, "LB", None, "articulo", None, "dos"), (3, "LA", "ley", "articulo", "dos 3", None), (4, None, "ley", "articulo", "4", "cuatro")])
    got = sorted((r["id"], r["text"] or "", r["snippet"]) for r in si.search_index(spark, path, "dos").collect())
    marked = {"uno dos": "uno <mark>dos</mark>", "tres dos": "tres <mark>dos</mark>"}
    assert got == sorted([(1, a, b) for a in marked for b in marked.values()] + [(2, "dos", "<mark>dos</mark>"), (3, "", "")])
    assert si.search_index(spark, path, "nada").collect() == [] == si.search_index(spark, path, "dos", page=9).collect()
