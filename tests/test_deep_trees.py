"""Trees of any depth."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import hierarchy
from lexatlas.operators.presentation import anchors
from lexatlas.plans.application import _nodes

PARAGRAPHS = "law string, article_id long, number long, parent_number long, kind string, identifier string, content string"


def chain(article: int, numbers: list[int]) -> list[tuple]:
    return [("L0", article, n, up, "inciso", f"{n})", "x") for up, n in zip([None, *numbers], numbers)]


def test_depth(spark):
    tree = {r["number"]: r["depth"] for r in hierarchy.paragraph_tree(spark.createDataFrame(chain(1, list(range(1, 23))), PARAGRAPHS)).collect()}
    assert tree == {n: n - 1 for n in range(1, 23)}


def test_anchors(spark):
    deep = [2**k for k in range(11)]  # paragraph 1,024 and those above it
    rows = [*chain(1, deep), *chain(1, [101]), *chain(2, [1, 3])]
    got = {(r["id"]): r["anchor"] for r in anchors(_nodes(spark.createDataFrame(rows, PARAGRAPHS)), F.concat_ws("/", "id.article_id", "id.number")).collect()}
    assert got["1/1024"] == "-".join(f"inciso-{n}" for n in deep)
    assert (got["1/101"], got["2/1"], got["2/3"]) == ("inciso-101", "inciso-1", "inciso-1-inciso-3")


def test_cycle(spark):
    with pytest.raises(ValueError):
        hierarchy.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "id long, parent_id long"))
