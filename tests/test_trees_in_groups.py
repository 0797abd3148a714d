"""Trees that lie within a group: the paragraphs of an article."""

from __future__ import annotations

import contextlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import hierarchy
from lexatlas.operators.presentation import anchors
from lexatlas.plans import QUERIES
from lexatlas.sources.corpus import load

NODES = "g string, h long, id long, parent_id long, part string"


def _moved(spark) -> int:
    """Rows that this session has shuffled so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@contextlib.contextmanager
def _set(spark, **values):
    """As with tables too large to be broadcast, and other settings."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", **{f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chains_within_groups(spark):
    """Any depth and order, equal ids in other groups, parents that aren't there, a null group, nodes with many below."""
    draw = random.Random(5)
    rows = []
    for g, h, n in [("a", 1, 1), ("a", 2, 2), ("b", 1, 40), ("b", 2, 7), (None, 3, 9), ("c", 1, 300)]:
        ids = draw.sample(range(1000), n)
        for k, i in enumerate(ids):
            up = None if not k or draw.random() < 0.1 else ids[k - 1] if g == "b" else ids[0] if g == "c" else draw.choice(ids[:k])
            rows.append((g, h, i, 5000 if draw.random() < 0.05 else up, None if draw.random() < 0.3 else f"p{i}"))
    by = {(g, h, i): (up, part) for g, h, i, up, part in rows}

    def chain(g, h, i):
        up, part = by[g, h, i]
        above = chain(g, h, up) if (g, h, up) in by else []
        return [*above, part]

    got = {(r["g"], r["h"], r["id"]): (r["depth"], r["parts"]) for r in hierarchy.chains_within(spark.createDataFrame(rows, NODES), ["g", "h"]).collect()}
    want = {(g, h, i): (len(c) - 1, [p for p in c if p is not None]) for g, h, i, _, _ in rows for c in [chain(g, h, i)]}
    assert max(d for d, _ in want.values()) > 8 and got == want


@pytest.mark.parametrize("ring", [[7], [7, 8], [7, 8, 9, 10, 11]])
def test_rings_are_found(spark, ring):
    rows = [("a", 1, i, up, None) for i, up in zip(ring, ring[1:] + ring[:1])] + [("a", 1, 20 + k, 7, None) for k in range(30)] + [("b", 1, 1, None, None)]
    with pytest.raises(ValueError):
        hierarchy.chains_within(spark.createDataFrame(rows, NODES), ["g", "h"])


def test_anchors_by_group_and_by_key(spark):
    """Equal to those of ids that hold their group."""
    rows = [(1 + k % 3, k // 3, None if k < 3 else k // 6, "texto" if k % 4 == 0 else "inciso", None if k % 7 == 0 else f"{k})") for k in range(90)]
    own = spark.createDataFrame(rows, "a long, id long, parent_id long, kind string, number string").withColumn("parent_id", F.expr("nullif(parent_id, id)"))
    shown = F.col("a") * 100 + F.col("id")
    keyed = own.select(shown.alias("id"), (F.col("a") * 100 + F.col("parent_id")).alias("parent_id"), "kind", "number")
    got, want = anchors(own, shown, ["a"]).collect(), anchors(keyed).collect()
    assert len(got) == 90 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_paragraph_trees_move_no_paragraphs(spark, small):
    """Before, each round and the last join shuffled all paragraphs."""
    _moves_few(spark, small, "fracciones_articulo")


def test_anchors_move_no_paragraphs(spark, small):
    """Before, each round shuffled all paragraphs."""
    _moves_few(spark, small, "anclas")


def _moves_few(spark, small, name: str) -> None:
    paragraphs = load(spark, small).paragraphs
    n, before = paragraphs.count(), _moved(spark)
    with _set(spark):
        assert QUERIES[name](spark, small).count() == n
    assert _moved(spark) - before < n / 10


def test_a_bucket_is_one_file_whatever_the_session(spark, small, tmp_path):
    """Before, with more shuffle partitions than buckets each of that many tasks wrote a file into each bucket."""
    os.symlink(small, tmp_path / "tables")
    with _set(spark, shuffle_partitions="50"):
        paragraphs = load(spark, str(tmp_path / "tables")).paragraphs
    files = [f.rpartition("_")[2] for f in paragraphs.inputFiles()]
    assert len(files) == len(set(files)) == spark.sparkContext.defaultParallelism
    assert paragraphs.agg(F.count("*")).first()[0] == spark.read.parquet(f"{small}/lineitem.parquet").count()
