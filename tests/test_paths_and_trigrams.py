"""Upkeep of stored paths after random moves, and fuzzy search for a table of terms, against plain versions."""

from __future__ import annotations

import random

import pytest

from lexatlas.operators import hierarchy, search

NODE = "id long, parent_id long, kind string, number string, name string"


def rows_of(df) -> dict:
    return {r["id"]: (list(r["path_ids"]), list(r["labels"])) for r in df.collect()}


def rebuilt(parents: dict) -> dict:
    def up(n):
        return [] if n is None else [*up(parents[n]), n]

    return {n: (up(n), [f"k {x}" for x in up(n)]) for n in parents}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_moves_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    parents = {n: None if n < 3 else rng.randrange(n) for n in range(150)}
    stored = spark.createDataFrame([(n, *rebuilt(parents)[n]) for n in parents], "id long, path_ids array<bigint>, labels array<string>")
    moves = {}
    for n in rng.sample(range(3, 150), 12):  # a parent of a smaller number never lies below
        moves[n] = rng.choice([None, rng.randrange(n)])
    whole, new = hierarchy.move_subtrees(stored, spark.createDataFrame([*moves.items(), (999, 1)], "id long, parent_id long"))
    after = rebuilt(parents | moves)
    assert rows_of(whole) == after
    touched = {n for n, (path, _) in rebuilt(parents).items() if set(path) & set(moves)}
    assert set(rows_of(new)) == touched and len(touched) < 150


def test_moves_that_cannot_be(spark):
    stored = spark.createDataFrame([(1, [1], ["a"]), (2, [1, 2], ["a", "b"]), (3, [1, 2, 3], ["a", "b", "c"])], "id long, path_ids array<bigint>, labels array<string>")
    move = lambda *pairs: hierarchy.move_subtrees(stored, spark.createDataFrame(pairs, "id long, parent_id long"))
    for bad in ((1, 3), (2, 77)):
        with pytest.raises(ValueError):
            move(bad)
    assert rows_of(hierarchy.move_subtrees(stored, spark.createDataFrame([], "id long, parent_id long"))[0]) == rows_of(stored)
    tree = spark.createDataFrame([(1, None, "k", "1", None), (2, 1, "k", "2", "n")], NODE)
    assert rows_of(hierarchy.stored_paths(tree)) == {1: ([1], ["k 1"]), 2: ([1, 2], ["k 1", "k 2 - n"])}


def grams(text: str) -> set:
    padded = f"  {text.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_terms_of_a_table_find_what_a_scan_finds(spark, least):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    items = [(n, f"{word()} {word()}") for n in range(300)] + [(900, None), (901, "")]
    terms = [f"{word()} {word()}" for _ in range(25)] + ["ab", None, "abc", "abc", "zzz"]
    got: dict = {}
    for r in search.fuzzy_terms(spark.createDataFrame(items, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), least, 50).orderBy("term", "place").collect():
        got.setdefault(r["term"], []).append((r["id"], r["similarity"]))
    want = {}
    for t in {t for t in terms if t and len(t) >= 3}:
        a = grams(t)
        near = [(i, round(len(a & grams(x)) / len(a | grams(x)), 6)) for i, x in items if x is not None]
        near = sorted((r for r in near if r[1] >= least), key=lambda r: (-r[1], r[0]))[:50]
        if near:
            want[t] = near
    assert got == want
