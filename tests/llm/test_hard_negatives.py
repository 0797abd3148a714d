"""Hard negatives against SQL on the table and against plain loops on odd rows."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import hard_negatives as hn
from lexatlas.llm.queries import ORACLE, QUERIES

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "id long, embedding array<float>, label int, uid string, vector string, score double"


def loops(rows: list[tuple], is_anchor) -> list[tuple]:
    """Plain version over (id, embedding, label)."""
    own = [(n, i, [math.floor(256 * x) for x in v], y) for n, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, y in own:
        if not is_anchor(i):
            continue
        order = sorted((-sum(a * b for a, b in zip(v, w)), j, m, z) for m, j, w, z in own if m != n)
        for ps, j, *_ in [r for r in order if r[3] == y][:5]:
            fit = [r for r in order if r[3] != y and -30 * ps <= -100 * r[0] <= -90 * ps][:10]
            out += [(i, j, k, r[1], -ps, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


def sql(folder: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    return sorted(con.execute(f"select {', '.join(NAMES)} from ({ORACLE['op13_hard_negatives']})").fetchall())


@pytest.mark.parametrize("rows, components", [(hn.ROWS, hn.ANCHOR_COMPONENTS), (40, 64)])
def test_the_table(spark, small, monkeypatch, rows, components):
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn, "ANCHOR_COMPONENTS", components)
    got = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, small).select(*NAMES).collect()))
    assert got and got == sql(small)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [1.0, nan], 1), (400, [1.0, -inf], 1), (500, [1.0, 1.0], None), (600, [], 1), (700, [0.5], 2), (700, [0.5], 2), (800, [-1.0, 0.25, 3.0], 2), (900, [0.0, 0.0], 3), (901, [0.0, 0.0], 3), (1000, [1e-3, 0.7], 2)]
    many = [(n, [((n * 37) % 11 - 3) / 7, ((n * 53) % 13 - 4) / 5], n % 3) for n in range(1, 120)]
    rows = odd + many + many[:30]
    docs = spark.createDataFrame([(*r, "x", "y", 0.5) for r in rows], SCHEMA)
    got = sorted(map(tuple, hn.hard_negatives(docs, F.col("id") % 100 == 0).select(*NAMES).collect()))
    floats = [(i, None if v is None else [None if x is None else float(F32(x)) for x in v], y) for i, v, y in rows]
    want = loops(floats, lambda i: i % 100 == 0)
    assert {700, 800, 1000} <= {r[0] for r in want}
    assert got == want


def F32(x: float) -> float:
    import numpy as np

    return np.float32(x)


def test_few_rows(spark):
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", "y", 0.0)], SCHEMA)
    pair = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", "y", 0.0), (1, [1.0, 2.0], 1, "x", "y", 0.0)], SCHEMA)
    three = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", "y", 0.0), (1, [1.0, 2.0], 1, "x", "y", 0.0), (2, [1.0, 1.0], 2, "x", "y", 0.0)], SCHEMA)
    for docs, n in ((alone, 0), (pair, 0), (three, 1), (spark.createDataFrame([], SCHEMA), 0)):
        assert hn.hard_negatives(docs, F.col("id") == 0).count() == n


def test_large_components(spark):
    big = [(0, [2e6, 1.0], 1), (1, [2e6, 1.0], 1), (2, [1e6, 1.0], 2)]
    rows = spark.createDataFrame(big, "id long, embedding array<double>, label int")
    assert sorted(map(tuple, hn.hard_negatives(rows, F.col("id") == 0).select(*NAMES).collect())) == loops(big, lambda i: i == 0)
    with pytest.raises(Exception, match="in size"):
        hn.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "id long, embedding array<double>, label int"), F.col("id") == 0)
