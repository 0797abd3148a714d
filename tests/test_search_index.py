"""The stored index: what a query reads, segments, ranks and fragments against loops."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import search, search_index as si
from lexatlas.plans import QUERIES
from lexatlas.plans.application import _stored_index
from lexatlas.sources.corpus import load
from lexatlas.sources.workspace import fresh_path

ARTICLE = "id long, law string, law_kind string, kind string, number string, text string, extra string"


def some(ids) -> list[tuple]:
    words = ["impuesto", "impuestos", "valor", "agregado", "renta", "casa", "de", "la", "pagar"]
    rng = random.Random(3)
    return [(i, f"L{i % 3}", "ley", "transitorio" if i % 5 == 0 else "articulo", f"{i} Bis", None if i == 4 else " ".join(rng.choices(words, k=rng.randrange(0, 40))), f"x{i}") for i in ids]


def test_same_page_as_without_an_index(spark, small):
    path, corpus = _stored_index(spark, small), load(spark, small)
    for text, more in (("partes returned -n", {}), ('"status o" OR 12', {"only_transitory": True}), ("supplier", {"laws": "LA,LB", "page": 2, "limit": 7})):
        want = [(r["id"], r["rank"]) for r in search.search_articles(corpus, text, **more).collect()]
        assert [(r["id"], r["rank"]) for r in si.search_index(spark, path, text, **more).collect()] == want and want


def test_only_the_stems_of_a_query_are_read(spark, small):
    path = _stored_index(spark, small)
    plan = si.postings_of(spark, path, ["part", "returned"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == plan.count("FileScan parquet") == 2
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(stem" in plan
    page = si.search_index(spark, path, "partes returned")._jdf.queryExecution().optimizedPlan().toString()
    assert page.count("Relation") <= 6


def test_segments_are_added_and_merged(spark):
    path = fresh_path(spark, "test-index")
    folder = Path(path.removeprefix("file://"))
    assert si.segments(spark, path) == []
    with pytest.raises(ValueError):
        si.search_index(spark, path, "impuesto")
    si.add_segment(path, spark.createDataFrame(some(range(90))[:60], ARTICLE), "a")
    before = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    si.add_segment(path, spark.createDataFrame(some(range(90))[60:], ARTICLE), "b")
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    with pytest.raises(ValueError):
        si.add_segment(path, spark.createDataFrame(some([1]), ARTICLE), "b")
    read = lambda **more: [tuple(r) for r in si.search_index(spark, path, "impuesto valor", limit=100, **more).collect()]
    once = fresh_path(spark, "test-index")
    si.add_segment(once, spark.createDataFrame(some(range(90)), ARTICLE), "all")
    want = [tuple(r) for r in si.search_index(spark, once, "impuesto valor", limit=100).collect()]
    assert read() == want and len(want) > 20
    si.merge_segments(spark, path, "m")
    assert si.segments(spark, path) == ["m"] and read() == want
    by_number = si.search_index(spark, path, "44 bis").collect()
    assert [(r["id"], r["extra"]) for r in by_number] == [(44, "x44")]
    assert si.search_index(spark, path, "nowhere").count() == 0


def test_empty_segment_and_short_queries(spark):
    path = fresh_path(spark, "test-index")
    si.add_segment(path, spark.createDataFrame([], ARTICLE), "none")
    assert si.segments(spark, path) == ["none"]
    for text in ("", "  ", "-x", "a"):
        with pytest.raises(ValueError):
            si.search_index(spark, path, text)


def density(hits: list[tuple], terms: list[str]) -> float:
    """By all stretches: those that hold all stems and no shorter one that does."""
    covers = []
    own = [h for h in hits if h[1] in terms]
    for i, j in itertools.combinations_with_replacement(range(len(own)), 2):
        inside = own[i : j + 1]
        holds = lambda part: {h[1] for h in part} == set(terms)
        if holds(inside) and not holds(inside[1:]) and not holds(inside[:-1]):
            last = {h[1]: h[2] for h in inside}
            mean = len(terms) / sum(1 / w for w in last.values())
            covers.append(mean / (1 + max(0, own[j][0] - own[i][0] + 1 - len(terms))))
    r = sum(covers)
    return round(r / (r + 1), 6)


def test_cover_density_by_weight(spark):
    rng, rows = random.Random(8), []
    for n in range(120):
        places = sorted(rng.sample(range(60), rng.randrange(0, 14)))
        rows.append((n, [(p, rng.choice("abcd"), rng.choice([1.0, 0.4])) for p in places]))
    df = spark.createDataFrame(rows, "id int, hits array<struct<pos:int,stem:string,weight:double>>")
    for terms in (["a"], ["a", "b"], ["a", "b", "c"]):
        asked = search.Search([[(t,) for t in terms]])
        got = {r["id"]: r["r"] for r in df.select("id", si.cover_density(F.col("hits"), asked).alias("r")).collect()}
        assert {n: pytest.approx(density(h, terms), abs=2e-6) for n, h in rows} == got
    assert len({r for r in got.values()}) > 5


def test_fragments_by_all_pairs():
    rng = random.Random(5)
    for _ in range(600):
        size, most, least = rng.randrange(0, 60), rng.randrange(1, 12), rng.randrange(0, 6)
        hit = [rng.random() < 0.2 for _ in range(size)]
        starts = [i for i in range(size) if i == 0 or (hit[i] and i <= size - least)]
        n = lambda i: sum(hit[i : i + most])
        options = [(n(i), 0, -i, 0) for i in starts] + [(n(i) + n(j), -1, -i, -j) for i in starts for j in starts if i + most <= j and n(j)]
        best = max(options, default=None)
        want = [] if best is None else [-best[2]] if best[1] == 0 else [-best[2], -best[3]]
        assert [a for a, _ in si.best_fragments(hit, most, least, 2)] == want
        assert len(si.best_fragments(hit, most, least, 1)) == min(1, size)


def test_fragments_are_marked(spark):
    text = "uno dos tres " + "x " * 80 + "Impuestos, y más " + "y " * 80 + "del impuesto al impuesto"
    rows = spark.createDataFrame([(1, text, ["impuesto", "impuestos"]), (2, None, None), (3, "", ["a"])], "id long, text string, words array<string>")
    got = {r["id"]: r["snippet"] for r in si.snippets(rows, most=10, least=3).collect()}
    assert got[1].startswith("<mark>Impuestos,</mark> y más y") and got[1].endswith(" ... <mark>impuesto</mark> al <mark>impuesto</mark>") and got[2] == got[3] == ""


def test_query_of_cover_density(spark, small):
    rows = QUERIES["buscar_en_indice_por_cobertura"](spark, small).collect()
    assert len(rows) == 50 and all("<mark>" in r["snippet"] for r in rows)
    assert [(-r["rank"], r["id"]) for r in rows] == sorted((-r["rank"], r["id"]) for r in rows)


def test_limits_of_fuzzy_search_and_suggestions(spark, small):
    from lexatlas.operators.views import suggestions

    items = spark.createDataFrame([(n, f"word{n}") for n in range(80)], "id long, text string")
    assert [search.fuzzy(items, "word", least=0.0, limit=n).count() for n in (None, 0, 51, 50)] == [10, 10, 10, 50]
    with pytest.raises(ValueError):
        search.fuzzy(items, " ab ")
    articles = spark.createDataFrame([(f"1{n}",) for n in range(100, 200)], "number string")
    assert [suggestions(articles, "11", n).count() for n in (None, 0, 21, 20, 10)] == [5, 5, 5, 20, 10]
    assert suggestions(articles, "1").count() == 0
