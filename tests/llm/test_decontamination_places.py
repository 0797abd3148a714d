"""Items, edits and places of the decontamination query against an alignment of every item with every text."""

from __future__ import annotations

import random

from lexatlas.llm import decontamination
from tests.llm.test_duplicates import planted
from tests.llm.test_pipeline import fewest_edits, single_spaced


def slow(docs: list[tuple], items: list[tuple]) -> dict:
    texts, out = [single_spaced(t or "") for _, t in docs], {}
    for k, item in items:
        folded = single_spaced(item)
        for (d, _), edits in zip(docs, fewest_edits(folded, texts).tolist()):
            if edits <= len(folded) * 10 // 100:
                out[d, k] = edits
    return out


def test_places_and_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 400)
    monkeypatch.setattr(decontamination, "GROUP", 2)
    items, docs, _ = planted()
    r = random.Random(11)
    docs = [(d, t.upper().replace(" ", r.choice([" ", "  ", ", ", "\n"]))) for d, t in docs] + [(500, " ".join(t for _, t in docs[:6]))]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, doc_id string, edits int")
    got = decontamination.contaminations(df, benchmark).collect()
    want, texts, item_of = slow(docs, items), dict(docs), dict(items)
    assert {(x["doc_id"], x["item_id"]): x["edits"] for x in got} == want and len(got) == len(want)
    for x in got:  # the stretch that is named is as near as said
        stretch = texts[x["doc_id"]][x["start"] : x["end"]]
        assert fewest_edits(single_spaced(item_of[x["item_id"]]), [single_spaced(stretch)])[0] == x["edits"]
        assert abs(len(single_spaced(stretch)) - len(single_spaced(item_of[x["item_id"]]))) <= x["edits"]
    assert {x["doc_id"] for x in decontamination.clean(df, benchmark).collect()} == set(texts) - {d for d, _ in want}


def test_a_very_long_text(spark):
    items, docs, _ = planted(5)
    long_ = " ".join(t for d, t in docs if d % 3) * 40
    rows = [(1, f"{long_} {items[3][1]} {long_}"), (2, long_), (3, None)]
    assert len(rows[0][1]) > 4_000_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminations(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(x["doc_id"], x["item_id"], x["edits"], x["start"]) for x in got] == [(1, 3, 0, len(long_) + 1)]
