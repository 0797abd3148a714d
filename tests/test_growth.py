"""What larger tables need: tables of the corpus made when they are asked for, rows moved once, few pairs compared."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import search as s
from lexatlas.plans import QUERIES


def _folder(top, small):
    """The small tables under a new name, so that no other test has loaded them."""
    os.symlink(small, top / "tables")
    return str(top / "tables")


def _written(spark, name: str) -> set[str]:
    return set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/lexatlas/{name}-*"))


def test_queries_write_the_tables_they_read(spark, small, tmp_path):
    here, articles, paragraphs = _folder(tmp_path, small), _written(spark, "articles"), _written(spark, "paragraphs")
    QUERIES["tipos_mostrados"](spark, here).count()
    assert _written(spark, "articles") == articles
    for name in ("navegar", "divisiones_articulo", "ultimo_articulo", "buscar_referencias_antigua", "extraccion_por_lugar"):
        QUERIES[name](spark, here).count()
    assert len(_written(spark, "articles")) == len(articles) + 1
    assert _written(spark, "paragraphs") == paragraphs


def test_fuzzy_terms_by_first_look(spark):
    """Copies, ties by id and terms without enough similar texts, against every pair."""
    words = ["alpha", "alpine", "alphabet", "beta", "Alpha", "betamax", "gamma", "gam", "ga", "alp", "alpha beta", None, "alpha"]
    items = spark.createDataFrame([(k, None if words[k % 13] is None else words[k % 13] + str(k % 7 or "")) for k in range(200)], "id long, text string")
    terms = spark.createDataFrame([(t,) for t in ("alpha", "Alpha", "alpha3", "betamax", "gamma5", "zzz", "al", None, "alpha")], "term string")
    got = {(r["term"], r["id"], r["similarity"], r["place"]) for r in s.fuzzy_terms(items, terms, limit=7).collect()}
    want = set()
    for term in ("alpha", "Alpha", "alpha3", "betamax", "gamma5", "zzz"):
        want |= {(term, r["id"], r["similarity"], k + 1) for k, r in enumerate(s.fuzzy(items.where("text is not null"), term, limit=7).collect())}
    assert got == want


def test_fuzzy_terms_compare_few_pairs(spark):
    """Of texts that all resemble every term, those that can't be among the best are not compared."""
    items = spark.range(3000).select("id", F.format_string("Customer#%09d BUILDING", "id").alias("text"))
    terms = spark.range(60).select(F.format_string("Customer#%09d", F.col("id") * 41).alias("term"))
    assert s._fuzzy_pairs(items, terms, 0.3, 10)[0].count() < 60 * 3000 / 10
    df = s.fuzzy_terms(items, terms)
    assert df.count() == 600
    got = [(r["id"], r["similarity"]) for r in df.where("term = 'Customer#000001025'").orderBy("place").collect()]
    assert got == [(r["id"], r["similarity"]) for r in s.fuzzy(items, "Customer#000001025").collect()]


def _records(spark) -> int:
    """Records shuffled so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_fuzzy_terms_move_few_pairs(spark):
    """Before, a trigram that a term and a text share made a pair, and each text's trigrams were sorted by a shuffle."""
    items = spark.range(8000).select("id", F.format_string("Customer#%09d %s", "id", F.element_at(F.array(*map(F.lit, ("BUILDING", "FURNITURE", "AUTOMOBILE"))), (F.col("id") % 3 + 1).cast("int"))).alias("text"))
    terms = spark.range(500).select(F.format_string("Customer#%09d", "id").alias("term"))
    before = _records(spark)
    assert s.fuzzy_terms(items, terms).count() == 5000
    assert _records(spark) - before < 12 * 8000 + 200 * 500


@pytest.mark.parametrize("paired, misses, most, shared, least", [(64, (1, 3), 1000, 10**6, 0.3), (12, (0,), 5, 0, 0.05), (0, (2,), 1000, 10**6, 0.3), (17, (1, 2), 0, 10**6, 0.05)])
def test_fuzzy_terms_by_each_way(spark, monkeypatch, paired, misses, most, shared, least):
    """Short and long texts, looks that find much or nothing, keys that are broadcast or not, against every pair."""
    for name, value in (("PAIRED", paired), ("LOOKED_MISSES", misses), ("LOOKED_PAIRS", most), ("SHARED_KEYS", shared)):
        monkeypatch.setattr(s, name, value)
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abcdeñß") for _ in range(rng.randrange(1, most)))
    texts = [" ".join(word(9) for _ in range(rng.randrange(1, 5))) for _ in range(250)] + ["", "\U0001f600ab", "AÑB", "ab " * 40]
    texts += [w[: len(w) // 2] + "x" + w[len(w) // 2 :] for w in texts[:60]] + texts[:40]
    terms = {*texts[::9], *(t + "e" for t in texts[::13]), "qqqq", "aña", "\U0001f600abc", word(90)}
    grams = lambda t: {f"  {t.lower()} "[i : i + 3] for i in range(len(t) + 1)}
    want = set()
    for term in (t for t in terms if len(t.strip()) >= 3):
        near = [(-round(len(grams(term) & grams(x)) / len(grams(term) | grams(x)), 6), k) for k, x in enumerate(texts)]
        want |= {(term, k, -x, i + 1) for i, (x, k) in enumerate(sorted(r for r in near if -r[0] >= least)[:10])}
    got = s.fuzzy_terms(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), least)
    assert {(r["term"], r["id"], r["similarity"], r["place"]) for r in got.collect()} == want


def test_only_near_words_are_stemmed(spark):
    """What words_of_stems leaves out has none of the query's stems."""
    ends = ["", *s._STANDARD, *s._PRONOUNS, *(g for g, _ in s._GERUNDS), *s._Y_VERBS, *s._VERBS, *s._RESIDUALS, "uyendo", "gue", "cion", "iéndose"]
    words = [a + b + e for a in ("", "a", "á", "part", "é", "lleg", "índ") for b in ("", "u", "g", "ic") for e in ends if a + b + e]
    for w in words:
        stem = s.stem(w)
        assert len(stem) <= len(w) and stem[:2] == w.translate(str.maketrans("áéíóú", "aeiou"))[: min(2, len(stem))], w
    asked = s.Search([[(s.stem("partes"),)], [("indic",)]], [("n",)])
    texts = spark.createDataFrame([(" ".join(words) + " n no N",)], "text string")
    got = {r["term"] for r in s.words_of_stems(texts, asked).collect()}
    assert got == {w for w in [*words, "n", "no"] if s.stem(w) in ("part", "indic", "n")} | {"n"}


def test_article_search_moves_paragraphs_once(spark, small):
    from lexatlas.sources.corpus import load

    df = s.search_articles(load(spark, small), "partes returned -n", laws="LB,LC", limit=50)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    assert df.count() == 50


def test_paragraphs_lie_with_their_article(spark, small):
    """What is made of an article's paragraphs moves none of them again; a bucket is one file."""
    from lexatlas.operators.views import joined_text
    from lexatlas.sources.corpus import load

    paragraphs = load(spark, small).paragraphs
    for df in (joined_text(paragraphs, " "), paragraphs.groupBy("law", "article_id").count()):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    files = [f.rpartition("_")[2] for f in paragraphs.inputFiles()]
    assert len(files) == len(set(files)) and sum(r["count"] for r in df.collect()) == paragraphs.count()


def test_hits_are_computed_once(spark):
    """Before, hits were computed for the ranges' sample, for their rows and for the sums of each law."""
    from lexatlas.operators.presentation import group_hits

    read = spark.sparkContext.accumulator(0)

    def rank(k):
        read.add(1)
        return float(k % 7)

    hits = spark.range(0, 500, 1, 3).select("id", F.concat(F.lit("L"), (F.col("id") % 3).cast("string")).alias("law"), F.udf(rank, "double")("id").alias("rank"))
    rows = group_hits(hits).collect()
    assert read.value == 500
    for law in ("L0", "L1", "L2"):
        ids = [k for k in range(500) if f"L{k % 3}" == law]
        assert [(r["hits"], r["place"], r["id"]) for r in rows if r["law"] == law] == [(len(ids), i + 1, k) for i, k in enumerate(sorted(ids, key=lambda k: (-(k % 7), k)))]


def test_laws_are_scanned_once(spark, small):
    """Before, lines were scanned anew for headings, for paragraphs and for citations."""
    from lexatlas.operators.laws import law_contents
    from lexatlas.plans.laws import article_lines, law_rules

    before = _written(spark, "scanned")
    found = law_contents(article_lines(spark, small), law_rules(spark))
    assert len(_written(spark, "scanned")) == len(before) + 1
    assert all("/scanned-" in f or "/law-paragraphs-" in f for f in found.inputFiles()) and found.count() > 40


def test_segments_are_made_row_by_row(spark, monkeypatch):
    """Postings of blocks against a loop over words: repeated forms, accents, nulls, a number of many words."""
    from collections import defaultdict

    from lexatlas.operators import search_index as si
    from lexatlas.sources.workspace import fresh_path

    monkeypatch.setattr(si, "BLOCK_WORDS", 7)
    texts = ["parte partes parte, Partes", None, "", "año2 índice2 índices 12 12", "a b a b a", "x" * 40]
    numbers = ["1 Bis", "2", None, "parte 4", " ".join(["n", "m"] * 700), ""]
    rows = [(k, f"L{k % 2}", None if k == 3 else "ley", "articulo", numbers[k % 6], texts[k % 6]) for k in range(30)]
    path = fresh_path(spark, "test-index")
    si.add_segment(path, spark.createDataFrame(rows, "id long, law string, law_kind string, kind string, number string, text string"), "a")
    want = defaultdict(lambda: ([], set()))
    for k, law, law_kind, kind, number, text in rows:
        for value, back, weight in ((number, 1000, s.NUMBER_WEIGHT), (text, 0, s.TEXT_WEIGHT)):
            for i, w in enumerate((value or "").lower().replace(",", "").split()):
                hits, words = want[(s.stem(w), k, law, law_kind, kind)]
                hits.append((i - back, weight))
                words.add(w)
    got = spark.read.parquet(f"{path}/postings/a")
    assert got.groupBy("stem", "id").count().where("count > 1").isEmpty()
    assert {tuple(r[c] for c in ("stem", "id", "law", "law_kind", "kind")): ([tuple(h) for h in r["hits"]], sorted(r["words"])) for r in got.collect()} == {k: (sorted(h), sorted(w)) for k, (h, w) in want.items()}
    assert got.where(F.col("bucket") != si._bucket(F.col("stem"))).isEmpty()


def test_a_segment_shuffles_articles_alone(spark, small):
    """Before, every word of every article was a row, joined with the stems and grouped again."""
    from lexatlas.operators import search_index as si
    from lexatlas.sources.corpus import load
    from lexatlas.sources.workspace import fresh_path

    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def moved() -> int:
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    articles = si.corpus_articles(load(spark, small))
    n = articles.count()
    before = moved()
    si.add_segment(fresh_path(spark, "test-index"), articles, "a")
    assert moved() - before < 6 * n
