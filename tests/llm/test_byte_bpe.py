"""Byte-level BPE against the library itself."""

from __future__ import annotations

import base64
import hashlib
import random
import time

import numpy as np
import pytest
import tiktoken

from lexatlas.llm import byte_bpe
from lexatlas.llm.queries import QUERIES, token_pattern, tokenizer_path
from lexatlas.sources.workspace import table

RANKS, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern()
SCHEMA = "doc_id long, text string, ids string, n_tokens string, decoded string"
TEXTS = [None, "", " ", "\n\n \t  x", "Hello, world's end! it's we'll they'VE 'r", "é" * 300 + " Straße ÀÖ", "<|endoftext|>x", "日本語 テキスト　全角", "1234 5.6e7 ½ ٣", "nbsp\xa0sep\x85\x1c end", "x\x00y", "😀😀 👩‍👩‍👧 é", "�", "tab\t\t\tx", "'s't're've'm'll'd"]


def library(path: str = RANKS):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def wanted(doc_id, text, own) -> tuple:
    ids = own.encode_ordinary(text or "")
    return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


def test_the_table(spark, small):
    own = library()
    want = [wanted(r["doc_id"], r["text"], own) for r in table(spark, small, "documents").collect()]
    got = QUERIES["op12_byte_bpe"](spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_random_texts(vocabulary):
    own, ours, rng = library(tokenizer_path(vocabulary)), byte_bpe.BytePairEncoder(tokenizer_path(vocabulary), PATTERN), random.Random(7)
    entries = sorted(ours.ids)
    for n in range(1500):
        kind = n % 4
        if kind == 0:
            text = "".join(rng.choice("abcdeé'  \n\t1!Zñ日") for _ in range(rng.randrange(60)))
        elif kind == 1:  # one long match whose parts are entries, cut anew
            text = "".join(rng.choice("aeinost") for _ in range(rng.randrange(1, 200)))
        elif kind == 2:
            text = b"".join(rng.choice(entries) for _ in range(20)).decode("utf-8", "ignore")
        else:
            text = rng.choice("a=- \né") * rng.randrange(1, 700) + "x" * rng.randrange(3)
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text), repr(text)
        assert ours.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_long_matches_take_linear_time():
    ours, own, rng = byte_bpe.encoder(RANKS, PATTERN), library(), random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == own.encode_ordinary(text)
    took = []
    for n in (200_000, 800_000):
        began = time.process_time()
        ours.encode_match((text * 16)[:n].encode())
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_long_texts_are_split_alike():
    ours, own = byte_bpe.encoder(RANKS, PATTERN), library()
    text = ("word's  12, \n" * 40_000) + " " * 5000 + "é"
    assert len(text) > byte_bpe.LONG_TEXT
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_full_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    monkeypatch.setattr(byte_bpe, "MEMO_PAIRS", 2)
    ours, own = byte_bpe.BytePairEncoder(RANKS, PATTERN), library()
    for text in TEXTS[1:]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_odd_rows(spark):
    rows = [(d, t, "x", "y", "z") for d, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, TEXTS[3], None, None, None), (3, TEXTS[3], None, None, None)]
    docs, own = spark.createDataFrame(rows, SCHEMA), library()
    got = byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(wanted(d, t, own)) for d, t, *_ in rows)
    nothing = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, PATTERN), RANKS, PATTERN)
    assert nothing.count() == 0


def test_null_ids_and_unknown_bytes(spark, tmp_path):
    got = byte_bpe.decode(spark.createDataFrame([(1, None, None)], "doc_id long, n_tokens long, ids binary"), RANKS, PATTERN).collect()
    assert got[0]["decoded"] is None
    path = tmp_path / "few"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        byte_bpe.BytePairEncoder(str(path), PATTERN)
