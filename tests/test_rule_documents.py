"""Rule documents against a loop over each document's lines, and end markers by font and place."""

from __future__ import annotations

import random
import re

from lexatlas.operators import textlines

RULE = re.compile(textlines.RULE_LINE)
COLUMNS = "doc long, pos int, page int, x int, x_end int, y int, text string, is_bold boolean, is_italic boolean"


def slow_rules(lines):
    """One document's lines (x, y, text, bold, italic), one by one: {rule: (name, [(kind, identifier, text)])}."""
    near = lambda x, edge: abs(x - edge) < 10
    given = {m[1] for x, _, t, b, _ in lines if b and near(x, 99) and (m := RULE.match(t.strip()))}
    out, rule, name, last = {}, None, "", None
    open_part = None  # [kind, identifier, text]

    def close():
        nonlocal open_part
        if rule and open_part and open_part[2]:
            out[rule][1].append(tuple(open_part))
        open_part = None

    def add(t):
        nonlocal open_part
        open_part = open_part or ["texto", None, ""]
        open_part[2] = f"{open_part[2]} {t}".strip()

    for x, y, t, bold, italic in lines:
        t = t.strip()
        if not t:
            continue
        m = RULE.match(t)
        if m and near(x, 99) and m[1] in given:
            close()
            rule, last = m[1], None
            out[rule] = (name or t[m.end() :].strip() or None, [])
            name = ""
        elif re.match(textlines.TITLE_LINE, t) or re.match(textlines.CHAPTER_LINE, t):
            name = ""
        elif bold and near(x, 156) and not re.match(r"[IVX]+\.", t):
            name = f"{name} {t}".strip()
        elif rule is None:
            continue
        elif not bold and near(x, 156) and (re.match(textlines.LAW_LINE, t) or italic):
            close()
            out[rule][1].append(("referencias", None, t))
        else:
            for edge, kind, pattern in ((156, "fraccion", r"([IVX]+)\."), (198, "inciso", r"([a-z])\)\s*"), (241, "numeral", r"(\d+)\.\s*")):
                if near(x, edge) and (m := re.match(pattern, t)):
                    close()
                    open_part = [kind, m[1], "" if kind == "fraccion" else t[m.end() :]]
                    break
            else:
                text = open_part[2] if open_part else ""
                if near(x, 156) and last is not None and y - last > 12.5 and text:
                    close()
                if text or any(near(x, e) for e in (156, 198, 241, 269)):
                    add(t)
            last = y
    close()
    return out


def test_rules_against_a_loop(spark):
    r = random.Random(4)
    texts = ["1.1.1. ", "1.1.2. Del plazo", "1.1.3.4.", "Título 2. De todo", "Capítulo 2.1. De algo", "IV. uno", "IV.", "a) dos", "b)", "3. tres", "4.", "Texto", "sigue", "LISR 27", "CFF 3", " ", "otro"]
    docs = {d: [(r.choice([99, 105, 109, 156, 150, 156, 198, 241, 269, 300]), r.choice([11, 12, 14]) * k, r.choice(texts), r.random() < 0.35, r.random() < 0.2) for k in range(r.randint(1, 60))] for d in range(150)}
    for own in docs.values():  # numbers stand at their edge more often than by chance
        for k in range(0, len(own), 7):
            own[k] = (99, own[k][1], r.choice(texts[:3]), r.random() < 0.7, False)
    rows = [(d, k, 1, x, x + 100, y, t, b, i) for d, own in docs.items() for k, (x, y, t, b, i) in enumerate(own)]
    got: dict = {}
    for x in textlines.rule_contents(spark.createDataFrame(rows, COLUMNS).repartition(5)).orderBy("doc", "pos", "paragraph").collect():
        rule = got.setdefault(x["doc"], {}).setdefault(x["rule"], (x["name"], []))
        if x["paragraph"] is not None:
            rule[1].append((x["kind"], x["identifier"], x["text"]))
    want = {d: slow_rules(own) for d, own in docs.items()}
    assert got == {d: v for d, v in want.items() if v}
    assert {k for v in want.values() for _, parts in v.values() for k, _, _ in parts} == {"texto", "fraccion", "inciso", "numeral", "referencias"}


def test_no_lines_and_no_flags(spark):
    assert textlines.rule_contents(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = [(1, 0, 1, 99, 120, 0, "1.1.1.", True, None), (1, 1, 1, 156, 300, 11, "Texto", None, None), (1, 2, 1, None, 300, 22, None, None, None)]
    got = textlines.rule_contents(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(x["rule"], x["name"], x["kind"], x["text"]) for x in got] == [("1.1.1", None, "texto", "Texto")]


def test_headings(spark):
    rows = [(1, 0, 1, 256, 356, 0, "Capítulo 1.1. Antes", True, False), (1, 1, 1, 256, 356, 9, "Título 2. De todo ", True, False), (1, 2, 1, 256, 356, 20, "Capítulo 2.1. De algo", True, False),
            (1, 3, 2, 99, 199, 0, "Capítulo 2.2. Al margen", True, False), (1, 4, 2, 256, 356, 9, "Capítulo 2.3. Fino", False, False)]
    got = textlines.rule_headings(spark.createDataFrame(rows, COLUMNS)).orderBy("pos").collect()
    assert [(x["kind"], x["number"], x["name"], x["title"]) for x in got] == [("capitulo", "1.1", "Antes", "0"), ("titulo", "2", "De todo", "2"), ("capitulo", "2.1", "De algo", "2")]


def test_end_page(spark):
    line = lambda d, p, x, t, b: (d, p, p, x, x + 50, 0, t, b, False)
    lines = spark.createDataFrame([line(1, 2, 90, "TRANSITORIOS", True), line(1, 3, 200, "TRANSITORIOS", False), line(1, 4, 200, "TRANSITORIOS", True), line(1, 6, 200, "TRANSITORIOS", True), line(2, 3, 90, "ANEXO", True)], COLUMNS)
    rows = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in range(1, 8)], "doc long, page int")
    last = lambda **more: {x["doc"]: (x["n"], x["e"]) for x in textlines.until_end_page(rows, lines, "(?i)transitorio", **more).groupBy("doc").agg({"page": "max", "end_page": "max"}).toDF("doc", "n", "e").collect()}
    got = last()
    assert {d: sorted(v, key=str) for d, v in got.items()} == {1: [4, 4], 2: [7, None], 3: [7, None]}
    assert last(extra="^ANEXO")[2] == (3, 3)
