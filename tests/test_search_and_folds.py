"""Stemmer, ranks and snippets of the search, and the fold of lines into paragraphs, against loops and known values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import search as s
from lexatlas.operators import textlines
from lexatlas.operators.views import clamp
from lexatlas.plans import QUERIES
from lexatlas.sources.corpus import load

#: Pairs of the published sample vocabulary of the Spanish Snowball stemmer.
STEMS = "cheque chequ cheques chequ chica chic chicago chicag chicas chic chile chil chinchilla chinchill torcer torc toreado tor toreándolo tor torear tor toreara tor torearlo tor toreo tore torero torer toreros torer tormenta torment tormentas torment tornado torn tornados torn tornar torn tornillo tornill toro tor toros tor torpeza torpez torre torr torres torr torrenciales torrencial".split()


def test_stems():
    got = {w: s.stem(w) for w in STEMS[::2]}
    assert got == dict(zip(STEMS[::2], STEMS[1::2]))
    assert s.stem("impuestos") == s.stem("impuesto") and s.stem("") == ""


def slow_cover(words: list[str], terms: list[str]) -> float:
    """Every stretch that holds all terms and no shorter one that does."""
    covers = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(terms) <= set(words[i : j + 1])]
    least = [(i, j) for i, j in covers if not any((a, b) != (i, j) and i <= a and b <= j for a, b in covers)]
    r = sum(1 / max(1, j - i + 2 - len(terms)) for i, j in least)
    return round(r / (r + 1), 6)


def slow_snippet(text: str, terms: list[str], most: int = 50, least: int = 20) -> str:
    words = text.split()
    hit = ["".join(c for c in w if c.isalnum()).lower() in terms for w in words]
    starts = [0] + [i for i, h in enumerate(hit) if h and 0 < i <= max(len(words) - least, 0)]
    best = max(starts, key=lambda i: (sum(hit[i : i + most]), -i))
    return " ".join(f"<mark>{w}</mark>" if h else w for w, h in zip(words[best : best + most], hit[best : best + most]))


def test_cover_rank_and_snippets(spark):
    r = random.Random(8)
    asked = s.parse("a b c")
    rows = [(k, " ".join(r.choices("abcdefg", k=r.randint(1, 25)))) for k in range(60)] + [(k, " ".join(r.choices("abc" + "x" * 30, k=r.randint(60, 160)))) for k in range(60, 90)]
    words = s.tokens(F.col("text"))
    got = spark.createDataFrame(rows, "id long, text string").select("id", s.cover_rank(words, asked).alias("rank"), s.snippet(F.col("text"), asked).alias("snippet")).collect()
    texts = dict(rows)
    for row in got:
        own = texts[row["id"]]
        assert abs(row["rank"] - slow_cover(own.split(), ["a", "b", "c"])) < 2e-6
        assert row["snippet"] == slow_snippet(own, ["a", "b", "c"])


def test_article_search_by_stems(spark, small):
    rows = QUERIES["buscar_articulos"](spark, small)
    assert rows.count() == 20
    c = load(spark, small)
    got = s.search_articles(c, "partes", limit=3).collect()
    assert len(got) == 3 and all("<mark>Part</mark>" in x["snippet"] and x["rank"] > 0 for x in got)
    number = c.articles.where("number like '%Bis'").orderBy("id").first()["number"]
    found = s.search_articles(c, number).collect()
    assert number in {x["number"] for x in found}
    with pytest.raises(ValueError):
        s.search_articles(c, "  ")
    assert [clamp(x, 100, 20) for x in (None, 0, 1, 100, 101)] == [20, 20, 1, 100, 20]
    assert [s.worth_asking(x) for x in (None, "", " a ", "ab")] == [False, False, False, True]


def slow_fold(lines: list[tuple]) -> list[tuple]:
    """Paragraphs (number, x, text) of one document's lines (x, y, text)."""
    import re

    out: list[list] = []
    named, last = False, None
    for x, y, text in lines:
        text = text.strip()
        if not text:
            continue
        has = re.match(r"[IVXLC]+\.|[a-z]\)|\d+\.", text) is not None
        wraps = text[0].islower() or text[0] in ",:;.()" or (text[0].isdigit() and not re.match(r"\d+\.", text))
        if not out or has:
            new = True
        elif x - out[-1][0] > 10:
            new = False
        elif y - last >= 12 and not wraps:
            new = True
        elif out[-1][0] - x > 10:
            new = not wraps
        else:
            new = named
        if new:
            out.append([x, [text]])
            named = has
        else:
            out[-1][1].append(text)
        last = y
    return [(k, x, " ".join(t)) for k, (x, t) in enumerate(out, 1)]


def test_fold_by_start(spark):
    r = random.Random(9)
    begins = ["IV. uno", "a) dos", "3. tres", "Texto", "sigue", "(nota)", "12 de mayo", "Ñandú", " ", "á la"]
    docs = {d: [(r.choice([80, 85, 95, 110, 140]), 10 * k + r.choice([0, 1, 4]) * 3, r.choice(begins)) for k in range(r.randint(1, 30))] for d in range(40)}
    rows = [(d, k, x, y, t) for d, own in docs.items() for k, (x, y, t) in enumerate(own)]
    got: dict = {}
    for x in textlines.consolidate_by_start(spark.createDataFrame(rows, "doc long, pos int, x int, y int, text string").repartition(6)).collect():
        got.setdefault(x["doc"], []).append((x["number"], x["x"], x["text"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: slow_fold(v) for d, v in docs.items() if slow_fold(v)}


def test_parents(spark):
    r = random.Random(10)
    rows = [(d, n, r.choice(["inciso", "numeral", "texto", "fraccion"]), r.choice([80, 84, 95, 96, 110, 126, 300])) for d in range(20) for n in range(1, r.randint(2, 25))]
    got = {(x["doc"], x["number"]): x["parent_number"] for x in textlines.attach_parents(spark.createDataFrame(rows, "doc long, number long, kind string, x int")).collect()}
    want = {}
    for d, n, kind, x in rows:
        before = [m for e, m, _, y in rows if e == d and m < n and round(y / 10) * 10 < x - 10]
        want[d, n] = max(before, default=None) if kind in ("inciso", "numeral") or (kind == "texto" and x >= 95) else None
    assert got == want


def test_registry(spark):
    registry = spark.createDataFrame([("LISR", 1), ("CFF", 2)], "source string, n int")
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "source string")
    assert {tuple(r) for r in textlines.registered(names("lisr", "CFF"), registry).collect()} == {("lisr", 1), ("CFF", 2)}
    with pytest.raises(Exception, match="not configured: LXX"):
        textlines.registered(names("CFF", "LXX"), registry).collect()
