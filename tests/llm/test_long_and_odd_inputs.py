"""Pages of other shapes, languages beyond one block of the model, texts of megabytes, repeated rows."""

from __future__ import annotations

import random
import time

import pytest
from tokenizers import Tokenizer

from lexatlas.llm import chat, language_id, line_dedup, main_text, packing, quality_rules, token_count
from lexatlas.llm.queries import tokenizer_path
from tests.llm.reference_results import line_dedup as slow_dedup
from tests.llm.reference_results import statistics

WORDS = [f"{a}{b}{c}" for a in "bdlmpr" for b in "aeio" for c in ("", "n", "s", "ta")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ","]) for _ in range(n)).capitalize().rstrip(",") + "."


def page(r: random.Random, kind: str) -> tuple[str, str]:
    """A page, and its main text as it was put together."""
    body = [prose(r, r.randint(25, 60)) for _ in range(r.randint(2, 6))]
    title = prose(r, 4)
    inner = [f"<p>{x[:30]}<svg><path d='M0'/></svg>{x[30:]}" + r.choice(["</p>", ""]) for x in body]
    menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>{prose(r, 2)}</a></li>" for k in range(8)) + "</ul></nav>"
    aside = f"<div class='{r.choice(['sidebar', 'cookie-notice', 'ad', 'newsletter box'])}'><p>{prose(r, 30)}</p></div>"
    comments = f"<section id='comments'><div class='comment'><p>{prose(r, 40)}</p></div></section>"
    if kind == "div":
        main = f"<div class='{r.choice(['text', 'content header-large', 'c1'])}'><h1>{title}</h1>{''.join(inner)}</div>"
    elif kind == "two articles":
        cut = len(inner) // 2
        main = f"<article><h1>{title}</h1>{''.join(inner[:cut])}</article>{aside}<article>{''.join(inner[cut:])}</article>"
    elif kind == "title before":
        main = f"<h1>{title}</h1><div>{''.join(inner)}</div>"
    else:
        main = f"<main class='nav-open'><article><h1>{title}</h1>{inner[0]}{aside}{''.join(inner[1:])}</article></main>"
    html = f"<html><head><title>x</title></head><body>{menu}{aside}{main}{comments}<footer><p>{prose(r, 12)}</p></footer></body></html>"
    return html, "\n".join([title, *body])


@pytest.mark.parametrize("kind", ["div", "two articles", "title before", "article"])
def test_pages(kind):
    r = random.Random(kind)
    for _ in range(100):
        html, want = page(r, kind)
        assert main_text.main_text(html) == want


@pytest.mark.parametrize("piece", ["<a '", "<a x='", "<a x=\"y", "<div>", "<b>", "<p><b>", "<!--", "</p>", "<script>", "<b><div></div>"])
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    main_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20  # a second or two; minutes if time grew with the square


def test_many_languages(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(language_id, "LANGUAGES", 4)
    monkeypatch.setattr(language_id, "HELD", 3)
    kinds = {f"l{k:02}": "".join(r.sample("abcdefghijklmnopqrstuvwxyz", 6)) for k in range(11)}
    say = lambda lang: " ".join("".join(r.choices(kinds[lang], k=r.randint(2, 7))) for _ in range(30))
    rows = [(k, say(lang), lang) for k, lang in enumerate(sorted(kinds) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(df, df["doc_id"] >= 22)
    assert len(model.blocks) == 3
    got = language_id.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.collect()
    assert all(x["lang_pred"] == x["lang"] for x in rows) and all(1 / 11 <= x["score"] <= 1 for x in rows)
    monkeypatch.setattr(language_id, "LANGUAGES", 64)
    whole = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(df, language_id.fit(df, df["doc_id"] >= 22)).collect()}
    assert all(whole[x["doc_id"]][0] == x["lang_pred"] and abs(whole[x["doc_id"]][1] - x["score"]) < 1e-9 for x in rows)


def test_texts_of_megabytes(spark):
    r = random.Random(2)
    text = "\n".join(prose(r, 12) for _ in range(70_000))
    assert len(text) > 3_000_000
    docs = [(1, text), (2, f"{text}\nend"), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").repartition(2)
    byte, word = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    size = lambda t, x: len(t.encode(x, add_special_tokens=False).ids)
    assert {(x["doc_id"], x["n_tokens"]) for x in token_count.count_tokens(df, tokenizer_path("byte_bpe_50k.json")).collect()} == {(d, size(byte, t)) for d, t in docs}
    pieces = packing.pack(df, tokenizer_path("word_bpe_49k.json"), end_id=1).groupBy("doc_id").sum("length").collect()
    assert {x["doc_id"]: x["sum(length)"] for x in pieces} == {1: size(word, docs[0][1]) + 1, 2: size(word, docs[1][1]) + 1, 3: 2 * (size(word, "a b") + 1)}
    kept = line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").distinct().collect()
    assert {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in kept} == slow_dedup(docs[:3])
    stats = quality_rules.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {tuple(x)[1:] for x in stats if x["doc_id"] != 3} == {statistics(t) for _, t in docs[:2]}
    found = language_id.predict(df, language_id.fit(df, df["doc_id"].isNotNull())).collect()
    assert {x["lang_pred"] for x in found} == {"en"}
    log = spark.createDataFrame([(1, 1, 1, "message", "user", text, "x")], "conv_id long, seq long, msg_id long, event string, role string, text string, rendered string")
    row = chat.format_conversations(log).collect()[0]
    assert chat.parse(row["rendered"]) == ("user", text)


def test_repeated_rows_of_statistics_and_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.apply(docs, quality_rules.fit(docs, labels))
    assert sorted(map(repr, [(x["doc_id"], x["n_words"]) for x in out.collect()])) == sorted(map(repr, [(1, 3), (1, 3), (None, 0)]))
    assert quality_rules.apply(docs.limit(0), []).count() == 0
