"""The whole pipeline against a plain version of each stage, one after the other."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lexatlas.llm.queries import tokenizer_path
from lexatlas.sources.workspace import table
from tests.llm.reference_results import components, line_dedup
from tests.llm.test_token_operators import check_packed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def grams(text: str) -> Counter:
    """Hashed n-grams of one to three characters of a text's words, with the space around each."""
    spaced = "".join(c if letter(c) else " " for c in f" {text.lower()} ")
    out: Counter = Counter()
    for n in (1, 2, 3):
        for own in (spaced[i : i + n] for i in range(len(spaced) - n + 1)):
            if own.strip(" ") and " " not in own[1:-1]:
                h = n
                for c in own:
                    h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                out[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 16] += 1
    return out


def known_language(docs: list[tuple]) -> list[tuple]:
    """Rows (doc_id, text, lang) whose language has a posterior of 0.5 or more on the evidence of 50 n-grams."""
    learned = [r for r in docs if r[2] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    counts, seen = defaultdict(Counter), Counter()
    for _, text, lang in learned:
        if text is not None:
            counts[lang] += grams(text)
            seen[lang] += 1
    langs = sorted({r[2] for r in learned})
    sizes = {x: sum(counts[x].values()) + 0.5 * (1 << 16) for x in langs}
    prior = {x: math.log((seen[x] + 1) / (sum(seen.values()) + len(langs))) for x in langs}
    kept = []
    for row in docs:
        if not any(map(letter, (row[1] or "").lower())):
            continue
        own = grams(row[1])
        n = sum(own.values())
        sums = {x: sum(k * math.log((counts[x][b] + 0.5) / sizes[x]) for b, k in own.items()) for x in langs}
        best = max(langs, key=lambda x: sums[x] + prior[x])
        held = {x: sums[x] * min(n, 50) / n + prior[x] for x in langs}
        if 1 / sum(math.exp(held[x] - held[best]) for x in langs) >= 0.5:
            kept.append(row)
    return kept


def folded(text: str) -> str:
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in low).split(" ")).strip(" ")


def single_spaced(text: str) -> str:
    return " ".join(x for x in folded(text).split(" ") if x)


def fewest_edits(item: str, texts: list[str]) -> np.ndarray:
    """The edits between the whole item and the stretch of each text that is nearest to it."""
    chars = np.full((len(texts), max(map(len, texts))), -1, np.int32)
    for k, t in enumerate(texts):
        chars[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    slope = np.arange(chars.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), len(slope)), np.int32)
    for i, c in enumerate(item):
        step = np.minimum(row[:, :-1] + (chars != ord(c)), row[:, 1:] + 1)
        step = np.concatenate([np.full((len(texts), 1), i + 1, np.int32), step], 1)
        row = np.minimum.accumulate(step - slope, axis=1) + slope
    return row.min(axis=1)


def without_items(docs: dict, items: list[str]) -> dict:
    texts, leaks = [single_spaced(t or "") for t in docs.values()], np.zeros(len(docs), bool)
    for item in {single_spaced(x) for x in items if x}:
        m = len(item)
        if m >= 8:
            leaks |= fewest_edits(item, texts) <= min(m * 10 // 100, (m - 8) // 8)
    return {d: t for (d, t), leak in zip(docs.items(), leaks) if not leak}


def fixture(spark, small, folder) -> tuple[list[tuple], list[str]]:
    """Short rows of the table, and rows planted for each stage."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, small, "documents").collect() if len(r["text"] or "") < 1500]
    items = [r["text"] for r in table(spark, small, "benchmark").collect()]
    words = " ".join(t or "" for _, t, _, _ in rows).split()
    prose = lambda k, n: " ".join(words[(k * 97 + 13 * i) % len(words)] for i in range(n))
    passage = "\n".join(prose(k, 9) for k in (1, 2, 3, 4))
    long_ = prose(7, 150)
    planted = [None, "", "12 34 ... !", f"{prose(20, 12)}\n{passage}", f"{prose(30, 12)}\n{passage}\n{prose(31, 7)}", passage, long_, long_, f"{long_} more", f"{prose(40, 20)} {items[0]} {prose(41, 20)}", f"{prose(50, 20)} {items[1][:-3]} {prose(51, 20)}"]
    rows += [(10**7 + k, t, None, "planted") for k, t in enumerate(planted)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    table(spark, small, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, small, tmp_path):
    rows, items = fixture(spark, small, tmp_path)
    first = {d: t for d, t, _ in known_language([r[:3] for r in rows])}
    second = {d: t for d, (t, lines, gone) in line_dedup(list(first.items())).items() if not gone or gone < lines}
    third = {d: second[d] for d, (_, root) in components(list(second.items()), 5, 80).items() if root == d}
    fourth = without_items(third, items)
    assert len(rows) > len(first) > len(second) > len(third) > len(fourth) > 20

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {d: [[*t.encode(text or "", add_special_tokens=False).ids, 1]] for d, text in fourth.items()}
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), want, 2048)


def test_stages_keep_the_columns(spark, small, tmp_path):
    fixture(spark, small, tmp_path)
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
