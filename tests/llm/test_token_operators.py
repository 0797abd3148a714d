"""Token output, packing and token counts against the tokenizer library itself."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

from lexatlas.llm import packing, token_count, token_output
from lexatlas.llm.queries import QUERIES, tokenizer_path
from lexatlas.sources.workspace import fresh_path, table
from tests.llm.reference_results import crc32_ids

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, ids string, bucket string, n_bytes string"
TRICKY = [None, "", " ", "\n\n \t", "Hello, world's end!", "it's we'll they'VE 'r 'q 'll", "a" * 5000, "é" * 300 + " Straße ÀÖ×÷ß", "<|endoftext|>x <|endoftext|>", "日本語 テキスト　全角", "1234 5.6e7", " nbsp sep\x85", "x\x00y", "😀😀 👩‍👩‍👧", "é combining", "word " * 4000, "</s> <s> <pad>"]


def fixture(spark, small):
    rows = [(d, t, "x", "y", "z", "w") for d, t in enumerate(TRICKY)] + [(3, TRICKY[4], None, None, None, None), (None, "no id", None, None, None, None), (3, TRICKY[4], None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def library(path: str):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark, small):
    return [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]


def test_token_output_of_the_table(spark, small, documents):
    encode, want, start = library(WORD), [], 0
    for d, t in sorted(documents, key=lambda x: x[0]):
        ids = [*encode(t), 2]
        want.append((d, start, len(ids), crc32_ids(ids)))
        start += len(ids)
    got = QUERIES["op1_token_output"](spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_token_output_of_odd_rows_and_selective_reads(spark, small):
    docs, encode = fixture(spark, small), library(WORD)
    path = fresh_path(spark, "test-tokens")
    token_output.write_tokens(docs, path, WORD, end_id=2, files=3)
    got = sorted((repr(r["doc_id"]), list(r["ids"])) for r in token_output.read_tokens(spark, path).collect())
    assert got == sorted((repr(r["doc_id"]), [*encode(r["text"]), 2]) for r in docs.collect())
    part = token_output.read_tokens(spark, path, first=5, last=8)
    assert sorted(r["doc_id"] for r in part.collect()) == [5, 6, 7, 8]
    plan = part.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_token_output_of_nothing(spark):
    path = fresh_path(spark, "test-tokens")
    token_output.write_tokens(spark.createDataFrame([], SCHEMA), path, WORD)
    assert token_output.read_tokens(spark, path).count() == 0
    assert token_output.with_starts(token_output.digest(token_output.read_tokens(spark, path))).count() == 0


def check_packed(pieces: list, want: dict, length: int) -> None:
    """Each document's ids lie in its pieces exactly once, and pieces fill sequences from 0 without gaps."""
    by_sequence: dict = {}
    found: dict = {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        found.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], list(p["ids"])))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert {k: sorted(v) for k, v in want.items()} == {k[0]: [sum((x for _, x in sorted(v)), [])] for k, v in found.items()}


def test_packing(spark, small, documents):
    encode = library(WORD)
    pieces = packing.pack(table(spark, small, "documents"), WORD, end_id=1, length=2048).collect()
    check_packed(pieces, {d: [[*encode(t), 1]] for d, t in documents}, 2048)
    total, sequences = sum(p["length"] for p in pieces), len({p["sequence_id"] for p in pieces})
    assert 2048 * sequences <= 1.02 * total + 2048 * 8


def test_packing_of_odd_rows(spark):
    encode = library(WORD)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in enumerate(TRICKY)], "doc_id long, text string, ids string").repartition(5)
    for length, windows in ((16, 2), (64, 8), (2048, 64)):
        pieces = packing.pack(docs, WORD, end_id=1, length=length, windows=windows)
        check_packed(pieces.collect(), {d: [[*encode(t), 1]] for d, t in enumerate(TRICKY)}, length)
    rows = packing.sequences(pieces, length=2048).collect()
    assert all(len(r["ids"]) == 2048 for r in rows)
    assert packing.pack(docs.limit(0), WORD).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], "doc_id long, text string")
    assert sum(p["length"] for p in packing.pack(twice, WORD).collect()) == 2 * (len(encode("a b")) + 1) + 1


def test_packing_query(spark, small, documents):
    encode = library(WORD)
    ids = {d: [*encode(t), 1] for d, t in documents}
    total = 0
    for r in QUERIES["op4_packing"](spark, small).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (crc32_ids(own), len(ids[r["doc_id"]]))
        total += r["length"]
    assert total == sum(map(len, ids.values()))


def test_token_counts(spark, small, documents):
    encode = library(BYTE)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_token_counts"](spark, small).collect()}
    want = {d: (len((t or "").encode()), n := len(encode(t)), n > 1024) for d, t in documents}
    assert got == want


def test_token_counts_of_odd_rows(spark, small):
    encode = library(BYTE)
    got = token_count.count_tokens(fixture(spark, small), BYTE).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(encode(r["text"])), n > 1024) for r in fixture(spark, small).collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_count.count_tokens(fixture(spark, small).limit(0), BYTE).count() == 0


def test_layout_of_token_files(spark, small):
    import pyarrow.parquet as pq

    path = fresh_path(spark, "test-layout")
    token_output.write_tokens(table(spark, small, "documents"), path, WORD, end_id=2, files=2)
    files = [f for f in __import__("pathlib").Path(path.removeprefix("file://")).rglob("*.parquet")]
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in (meta.row_group(g).column(i) for i in range(meta.num_columns)):
                assert c.has_offset_index and c.has_column_index
                if c.path_in_schema in ("doc_id", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in c.encodings and "RLE_DICTIONARY" not in c.encodings
                if c.path_in_schema.startswith("ids"):
                    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings)


def test_ties_of_open_windows():
    """Of windows with equal room the one opened first takes a piece, and is emitted first."""
    own = packing.Windows(10, 2)
    assert own.put((1, 0, 6, [0] * 6)) is None and own.put((2, 0, 6, [0] * 6)) is None
    assert own.put((3, 0, 3, [0] * 3)) is None
    assert [[p[0] for p in w] for w in own.open] == [[1, 3], [2]]
    assert own.put((4, 0, 3, [0] * 3)) is None
    assert [p[0] for p in own.put((5, 0, 9, [0] * 9))] == [1, 3]
    assert [[p[0] for p in w] for w in own.open] == [[2, 4], [5]]
