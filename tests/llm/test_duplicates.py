"""Line deduplication, the n-gram join and decontamination against brute force."""

from __future__ import annotations

import random

import pytest

from lexatlas.llm import decontamination, line_dedup, ngram_join
from lexatlas.llm.queries import QUERIES
from lexatlas.sources.workspace import table
from tests.llm.reference_results import components, line_dedup as slow_dedup


def generated(seed: int, n: int = 120) -> list[tuple]:
    """Documents with copies, chains of near copies, shared passages, short and empty texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs: list[str | None] = [None, "", "one", "one", "ONE two", "one two", "a b c", " \n ", "a b c d", "A b C d"]
    while len(docs) < n:
        kind = r.random()
        if kind < 0.4 or len(docs) < 20:
            docs.append("\n".join(" ".join(r.choices(vocabulary, k=r.randint(1, 8))) for _ in range(r.randint(1, 12))))
        else:
            words = (r.choice(docs[10:]) or "x").split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append(" ".join(words))
    return list(enumerate(docs))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, size, percent):
    docs = generated(size)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, component_id string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(df, size=size, percent=percent).collect()}
    assert got == components(docs, size, percent)


def test_ngram_join_of_the_table(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_ngram_join"](spark, small).collect()}
    assert got == components(docs, 4, 85)


def test_ngram_join_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "z z z"), (9, None), (8, "")]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 1, None), (9, 0, 9), (8, 0, 8)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_large_group_of_copies(spark):
    words = [f"v{i}" for i in range(100)]
    docs = [(i, " ".join(words)) for i in range(300)] + [(300 + i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(100)]
    got = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), size=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs, 4, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    lines = ["", " ", "a", "b", "c", "ü x"]
    docs = [(d, "\n".join(r.choices(lines, k=r.randint(1, 15)))) for d in range(60)] + [(100, None), (101, ""), (102, "\n\n\n\n\n")]
    df = spark.createDataFrame([(d, t, 5, "y") for d, t in docs], "doc_id long, text string, n_lines int, pos string")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    assert {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in got.collect()} == slow_dedup(docs)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_PARTS", 10)
    docs = [(d, "\n".join(["x", "y", "z", f"own {d}"] * 2)) for d in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in got} == slow_dedup(docs)


def test_line_dedup_of_rows_that_repeat(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")]
    got = sorted(map(repr, map(tuple, line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, [(1, "", 3, 3), (1, "", 3, 3), (None, "a\nb\nc", 3, 0), (2, "d", 4, 3)]))


def planted(seed: int = 3):
    """Benchmark items, and documents that hold them whole or slightly edited, or only common words of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(3, 9)))
    vocabulary = [word() for _ in range(800)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(25, 60)))) for i in range(12)]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k))
    docs, leaks = [], set()
    for d in range(60):
        text = prose(r.randint(40, 400))
        if d % 3 == 0:
            item = items[d % 12][1]
            if d % 2:
                words = item.split(" ")
                words[r.randrange(len(words))] = word()
                item = " ".join(words)
            text = f"{prose(30)} {item} {text}"
            leaks.add(d)
        docs.append((d, text))
    return items, docs, leaks


def test_decontamination(spark):
    items, docs, leaks = planted()
    docs += [(1000, None), (1001, ""), (None, "a b"), (1002, docs[0][1]), (1002, docs[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (None, items[0][1])], "item_id long, text string")
    clean = decontamination.clean(df, benchmark)
    assert clean.columns == df.columns
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(d) for d, _ in docs if d not in leaks | {1002})
    found = {r["doc_id"] for r in decontamination.contaminations(df, benchmark).collect()}
    assert leaks | {1002} == found
    assert decontamination.contaminations(df.limit(0), benchmark).count() == 0
    assert decontamination.contaminations(df, benchmark.limit(0)).count() == 0
