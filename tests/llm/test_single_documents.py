"""Operators that judge each document or conversation by itself: chat, main text, quality rules, language."""

from __future__ import annotations

import hashlib
import zlib

from lexatlas.llm import chat, language_id, main_text, quality_rules
from lexatlas.llm.queries import QUERIES
from lexatlas.sources.workspace import table
from tests.llm.reference_results import statistics

EVENTS = "conv_id long, seq long, msg_id long, event string, role string, text string"


def test_chat_digests(spark, small):
    logs: dict = {}
    for r in table(spark, small, "conversations").orderBy("conv_id", "turn").collect():
        logs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    logs[-1] = [("user", said), ("assistant", said)]
    want = {}
    for conv, turns in logs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        want[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = QUERIES["op2_chat_formatting"](spark, small).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_chat_escapes_and_folds(spark):
    texts = [*chat.CONTROL, "<⁠s>", "<⁠⁠/s>", "<<s>", "[[INST]", "a\\n\nb", "<|end|>\n<|turn|>user\nx"]
    rows = [(1, k, k, "message", "assistant", t) for k, t in enumerate(texts)]
    rows += [(2, 1, 1, "message", "user", "hi"), (2, 2, 2, "message", "assistant", ""), (2, 3, 2, "delta", None, "a"), (2, 4, 2, "delta", None, "b")]
    rows += [(2, 5, 1, "edit", None, "hello"), (2, 6, 2, "regenerate", None, None), (2, 7, 2, "delta", None, "c"), (2, 8, 3, "message", "user", "gone"), (2, 9, 3, "delete", None, None)]
    rows += [(None, None, None, "message", None, None), (3, 1, 1, "message", "user", "same"), (3, 1, 1, "message", "user", "same")]
    out = chat.format_conversations(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "seq", "part").collect()
    by: dict = {}
    for r in out:
        by.setdefault(r["conv_id"], []).append(r)
    assert [chat.parse(r["rendered"]) for r in by[1]] == [("assistant", t) for t in texts]
    for r in by[1]:
        masked = r["rendered"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert not any(c in masked for c in chat.CONTROL)
        assert r["rendered"].count(chat.TURN) == r["rendered"].count(chat.CLOSE) == 1
    assert [chat.parse(r["rendered"]) for r in by[2]] == [("user", "hello"), ("assistant", "c")]
    assert [chat.parse(r["rendered"]) for r in by[None]] == [("", "")]
    assert [chat.parse(r["rendered"]) for r in by[3]] == [("user", "same")] * 2
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], EVENTS))).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (1<2) {}</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, and yet more cookies on this site, please agree.</p></div>
<div id="content"><h1>Heading &amp; more</h1><p>The first  paragraph, with commas, is long enough, as prose goes,
 to be scored &lt;well&gt;.</p><p>Second paragraph<br>goes on, and on, and it is also rather long, with commas.<p>Unclosed third, which is as long as the others, more or less.</div>
<div class="sidebar"><p>Sidebar text, with commas, long enough, to be scored, if it were not for its class.</p></div>
<section class="comments"><p>A reader says, at length, with commas, that this was a good article indeed.</p></section>
<form><p>Subscribe</p></form><footer>Imprint</footer></body></html>"""


def test_main_text(spark):
    want = "Heading & more\nThe first paragraph, with commas, is long enough, as prose goes, to be scored <well>.\nSecond paragraph goes on, and on, and it is also rather long, with commas.\nUnclosed third, which is as long as the others, more or less."
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "", "", ""), (None, "u", "plain", "x"), (1, "u", PAGE, "x"), (4, "v", "<div " * 50 + "<p>x", ""), (5, "v", "<div>" * 3000 + "deep", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r["text"] for r in got.collect()}
    assert by[1] == want and by[2] == by[3] == "" and by[None] == "plain" and by[5] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert main_text.extract(df.limit(0)).count() == 0


def test_quality_statistics(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b c d e " * 3), (10**6 + 3, "é#é\n\n \n x\nx\nx"), (10**6 + 4, "a b c")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {d: statistics(t) for d, t in docs}
    assert quality_rules.statistics(df.limit(0)).count() == 0


def test_quality_rules(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rows = QUERIES["op7_quality_rules"](spark, small).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in rows}
    told = labels.where("quality is not null").collect()
    good = [kept[r["doc_id"]] for r in told if r["quality"] == 1 and r["doc_id"] in kept]
    assert sum(good) >= 0.9 * len(good)
    assert quality_rules.fit(docs, labels.limit(0)) == []
    learned = quality_rules.learn({"x": __import__("numpy").arange(90.0)}, __import__("numpy").arange(90) < 30)
    assert learned and all(c.feature == "x" and not c.above for c in learned[0])


def test_language(spark, small):
    docs = {r["doc_id"]: r for r in table(spark, small, "documents").collect()}
    rows = QUERIES["op9_language_id"](spark, small).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        d = docs[r["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert sum(right) >= 0.9 * len(right)


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "el gato come en la casa", "es"), (3, None, "en"), (4, "...", "es"), (None, "the dog", None), (5, "", None), (5, "", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.fit(df, df["doc_id"].isNotNull())
    got = language_id.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {(r["doc_id"], r["lang_pred"]) for r in got.collect()} == {(1, "en"), (2, "es"), (3, "und"), (4, "und"), (None, "en"), (5, "und")}
    assert {r["lang_pred"] for r in language_id.predict(df, language_id.fit(df.limit(0), df["doc_id"].isNotNull())).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_quality_rules_reject_what_they_learn_to(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rules = quality_rules.fit(docs, labels)
    assert rules
    rows = quality_rules.statistics(docs).select("*", quality_rules.verdict(rules).alias("kept"), *[quality_rules.feature(n).alias(n) for n in quality_rules.FEATURES]).collect()
    for r in rows:
        held = any(all(r[c.feature] > c.threshold if c.above else r[c.feature] <= c.threshold for c in rule) for rule in rules)
        assert r["kept"] == (not held)
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    rejected = {r["doc_id"] for r in rows if not r["kept"]}
    assert rejected and len(rejected & bad) >= 0.8 * len(rejected & {r["doc_id"] for r in labels.where("quality is not null").collect()})


def test_quality_sample_bounds_rows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(n % 3, f"w{n} " * 12) for n in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(3)], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels, sample=10) == []
