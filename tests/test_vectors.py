"""Vector search with more queries than one block holds."""

from __future__ import annotations

import math
import random

from lexatlas.operators import search


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_VECTORS", 7)
    r = random.Random(3)
    vectors = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0])]
    queries = [(i, v) for i, v in vectors if i % 3 == 0]
    df = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(3)
    got = search.nearest_vectors(df, spark.createDataFrame(queries, "query_id long, query array<float>"), k=5)

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    want = set()
    for q, v in queries:
        rows = sorted(((cosine(v, e), i) for i, e in vectors if i != q), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:5]
        want |= {(q, i, None if c is None else c + 0.0, place) for place, (c, i) in enumerate(rows, 1)}
    assert {tuple(x) for x in got.select("query_id", "id", "similarity", "place").collect()} == want
