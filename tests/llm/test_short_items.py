"""Short benchmark items against an alignment with every text."""

from __future__ import annotations

import random

from lexatlas.llm import decontamination
from tests.llm.test_pipeline import fewest_edits, single_spaced


def test_short_items(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdef", k=r.randint(1, 7)))
    items = [(k, " ".join(word() for _ in range(12))[:n].strip()) for k, n in enumerate([3, 5, 7, 8, 10, 12, 15, 16, 20, 23, 29, 30, 39, 40, 60])]
    docs = ["", "ab", "x"]
    for _, item in items:
        for changes in range(6):
            own = list(item)
            for _ in range(changes):
                own[r.randrange(len(own))] = r.choice(["", "z", "qz"])
            docs.append(" ".join([word(), word(), "".join(own), word()]))
    got = decontamination.contaminations(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    texts, want = [single_spaced(t) for t in docs], {}
    for k, item in items:
        folded = single_spaced(item)
        for d, edits in enumerate(fewest_edits(folded, texts).tolist()):
            if edits <= len(folded) * 10 // 100:
                want[d, k] = edits
    assert {(x["doc_id"], x["item_id"]): x["edits"] for x in got.collect()} == want
    assert any(e > 0 for (_, k), e in want.items() if len(items[k][1]) < 40)
