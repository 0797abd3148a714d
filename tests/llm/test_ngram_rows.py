"""The n-gram join of rows without doc_id, of rows that repeat, and of passages that many documents share."""

from __future__ import annotations

import random

from lexatlas.llm import ngram_join
from tests.llm.reference_results import components


def test_rows_without_doc_id_bridge_others(spark):
    words = [f"w{i}" for i in range(60)]
    far = lambda changed: " ".join(f"x{i}" if i in changed else w for i, w in enumerate(words))
    texts = [(1, far(())), (None, far((20,))), (2, far((20, 40))), (None, far((0, 10, 20, 30, 40, 50)))]
    sets = [(k, t) for k, (_, t) in enumerate(texts)]
    assert components(sets[:3], 4, 85) == {0: (57, 0), 1: (57, 0), 2: (57, 0)}
    assert len({root for _, root in components([sets[0], sets[2]], 4, 85).values()}) == 2  # only the row between links them
    got = ngram_join.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), size=4, percent=85).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 57, 1), (None, 57, 1), (2, 57, 1), (None, 57, None)]))


def test_one_of_each(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words, "a"), (1, f"{words} more", "b"), (1, f"{words} more", "b"), (None, f"{words} most", "c"), (None, "q r s t u v", "d"), (None, "q r s t u v", "d"), (5, None, "e"), (5, None, "e"), (1, "another text of the same id", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = ngram_join.one_of_each(df, size=5, percent=80)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[1], rows[4], rows[6], rows[7], rows[8]]))
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_one_of_rows_that_fill_a_third(spark):
    """Rows alike in doc_id and text, with and without words, beside others; all columns come back."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words, {"k": 1})] * 700 + [(None, None, {"k": 2})] * 400 + [(7, " \t\n", None)] * 300 + [(d, f"text of number {d} {d + 1} {d + 2}", {"k": d}) for d in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(6)
    got = ngram_join.one_of_each(df, size=5, percent=80)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows[699:]))


def test_frequent_shingles_are_those_of_the_highest_counts(spark, monkeypatch):
    """As many as there is room for, by whole steps, whatever the number of other shingles; none if there is no room."""
    docs = spark.createDataFrame([(d, " ".join([f"r{d}x{k}" for k in range(50)] + [f"c{k}" for k in range(d % 200)])) for d in range(400)], "doc_id long, text string")
    count = {k: sum(d % 200 > k for d in range(400)) for k in range(199)}
    for room in (1000, 50, 20):
        monkeypatch.setattr(ngram_join, "FREQUENT", room)
        codes, found = ngram_join.frequent_shingles(docs, 1)
        assert len(codes) <= room and (sorted(codes) == codes).all()
        want = sorted((n for n in count.values() if n >= ngram_join.LEAST_FREQUENT), reverse=True)[: len(codes)]
        assert sorted(found.tolist(), reverse=True) == want
        assert len(codes) == sum(n >= ngram_join.LEAST_FREQUENT for n in count.values()) if room == 1000 else len(codes) > room // 2
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    assert len(ngram_join.frequent_shingles(docs, 1)[0]) == 0


def test_shared_passages_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 20)
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for d in range(150):  # most share the passage only; some are copies but for a word or two
        own = passage + [f"o{d}x{i}" for i in range(12)] if d % 3 else passage[: r.randint(40, 60)]
        docs.append((d, " ".join(own)))
    for d in range(150, 180):
        words = docs[r.randrange(150)][1].split(" ")
        words[r.randrange(len(words))] = "new"
        docs.append((d, " ".join(words)))
    got = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=4, percent=85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == components(docs, 4, 85)


def test_a_very_long_text(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(30_000)}" for _ in range(700_000)]
    text = " ".join(words)
    docs = [(1, text), (2, f"{text} end"), (3, "short one"), (4, text[: len(text) // 2])]
    assert len(text) > 4_000_000
    got = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), size=4, percent=85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == components(docs, 4, 85)


def test_edited_copies_of_one_text(spark):
    """Copies edited in so many places that most link with the original alone, some with few others, some with none."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    docs = []
    for d in range(240):
        own = list(words)
        for i in r.sample(range(150), r.randint(1, 9)):
            own[i] = f"e{d}x{i}"
        docs.append((d, " ".join(own)))
    docs.append((500, " ".join(words)))
    want = components(docs, 5, 80)
    sizes = sorted(list(root for _, root in want.values()).count(k) for k in {root for _, root in want.values()})
    assert sizes[0] == 1 and sizes[-1] > 50
    got = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=5, percent=80).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def test_groups_of_one_prefix_and_several_components(spark, monkeypatch):
    """Documents with the same prefix and size, in families that differ in what follows: the prefix is rare shingles that
    all have, the rest frequent ones."""
    monkeypatch.setattr(ngram_join, "PART", 4)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 30)
    r = random.Random(9)
    head = [f"h{i}" for i in range(30)]
    common = [[f"c{k}x{i}" for i in range(40)] for k in range(6)]
    docs = [(1000 + k * 100 + j, " ".join(block)) for k, block in enumerate(common) for j in range(40)]
    for d in range(28):
        first, second = common[d % 4], common[4 + d % 2]
        cut = r.randint(0, 30)
        docs.append((d, " ".join(head + [";"] + first[: 30 - cut] + [";"] + second[:cut])))
    got = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=1, percent=85)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == components(docs, 1, 85)


def test_pairs_of_members_are_those_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 4)
    r = random.Random(10)
    rows = []
    for k in range(60):
        words = [r.choice((0, 0, 1 << r.randrange(62))) for _ in range(ngram_join.BITMAP)]
        rows.append((k % 3, k, 20 + 10 * (k % 3), r.randrange(4), *words))
    df = spark.createDataFrame(rows, f"gid long, id long, n long, label long, {', '.join(f'{b} long' for b in ngram_join._BITS)}")
    mixed = spark.createDataFrame([(0, 20), (2, 20)], "gid long, n long")
    got = ngram_join._pairs_of_members(df.select("gid", "id", "n", "label"), mixed, df.drop("gid", "label", "n"), 85).collect()
    apart = lambda x, y: sum(bin(a ^ b).count("1") for a, b in zip(x[4:], y[4:]))
    want = [(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[0] == y[0] != 1 and x[3] != y[3] and 185 * apart(x, y) <= 15 * (x[2] + y[2])]
    assert sorted(map(tuple, got)) == want and len(want) > 10
