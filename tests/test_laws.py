"""Whole laws: articles against a loop in the order of the scan and a page known by hand; the map read back; groups that
fill many ranges; gaps and baselines of any size."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import laws, loading, quality, textlines
from lexatlas.plans import QUERIES
from lexatlas.plans.laws import article_lines, law_rules, map_of_lines
from lexatlas.sources.ranking import neighbours

LINE = "doc long, source string, page int, pos int, y int, x int, x_end int, text string, is_bold boolean, is_italic boolean, is_non_black boolean, font_size double"
HEAD = re.compile(laws.ARTICLE.replace("(?iu)", ""), re.I)
NEXT = re.compile(laws.NEXT_ARTICLE.replace("(?iu)", ""), re.I)
END = re.compile("TRANSITORI[OA]S?", re.I)
CLASS = (("fraccion", r"([IVXLC]+)\.\s*"), ("inciso", r"([a-z]\))\s*"), ("numeral", r"(\d+\.)\s*"))


def number(text: str) -> str | None:
    m = HEAD.match(text[:50])
    if not m:
        return None
    base, ordinal, letter, suffix, more = m.groups()
    return base + (ordinal or "").lower() + (f"-{letter.upper()}" if letter else "") + (f" {suffix.capitalize()}" if suffix else "") + (f" {more}" if more else "")


def kind_of(text: str) -> tuple[str, str | None, str]:
    for kind, pattern in CLASS:
        if m := re.match(pattern, text):
            return kind, m[1], text[m.end() :]
    return "texto", None, text


def extract(rows: list, rules: dict) -> list[tuple]:
    """One document's articles by a plain scan, page after page."""
    rows = sorted((r for r in rows if r["text"].strip()), key=lambda r: r["pos"])
    noise, largest, ends = rules.get(rows[0]["source"], (None, None, None)) if rows else (None, None, None)
    more = re.compile(ends) if ends else None
    end = lambda t: bool(END.search(t) or (more and more.search(t)))
    known = any(r["is_bold"] is not None and r["page"] <= 5 for r in rows)
    last = min((r["page"] for r in rows if r["is_bold"] and ((END.search(r["text"]) and r["x"] > 150) or (more and more.search(r["text"])))), default=None)
    heads: dict = {}
    for r in rows:
        n = number(r["text"].strip())
        if n and (not known or (r["is_bold"] and 80 <= r["x"] <= 95)) and (last is None or r["page"] <= last):
            heads.setdefault(n, r)
    order, out = list(heads.items()), []
    for i, (n, head) in enumerate(order):
        to = order[i + 1][1]["page"] if i + 1 < len(order) else last if last is not None else head["page"] + 5
        lines, notes, inside = [], [], False
        for r in rows:
            if r["pos"] < head["pos"] or r["page"] > to:
                continue
            text, y = r["text"].strip(), r["y"] + 800 * (r["page"] - head["page"])
            if largest is not None and r["is_italic"] and r["is_non_black"] and r["font_size"] <= largest:
                notes += [(y, text)] * inside
                continue
            if any(s in text for s in noise or ()):
                continue
            starts = r is head or any(r is h for _, h in order)
            centred = r["is_bold"] and abs(r["x"] + r["x_end"] - 612) < 50
            if inside and r["is_bold"] and end(text) and not (starts and not centred):
                break
            if centred:
                continue
            if r is head:
                inside, rest = True, HEAD.sub("", text, count=1).lstrip("- ")
                lines += [(y, r["x"], r["x_end"], rest)] if rest else []
                continue
            if inside:
                if starts or (NEXT.match(text) and r["x"] >= 80):
                    break
                lines.append((y, r["x"], r["x_end"], text))
        paragraphs = []
        for j, (y, x, x_end, text) in enumerate(lines):
            before = lines[j - 1] if j else None
            signs = (x >= 80) + (before is not None and (y - before[0] > 15) + (before[2] < 530) + before[3].endswith(".")) + text[:1].isupper()
            if not j or kind_of(text)[0] != "texto" or signs >= 4:
                paragraphs.append([text, x, y])
            else:
                paragraphs[-1] = [f"{paragraphs[-1][0]} {text}", paragraphs[-1][1], y]
        made, edges = [], {}
        for j, (text, x, y) in enumerate(paragraphs, 1):
            kind, ident, body = kind_of(text)
            can = kind in ("inciso", "numeral") or (kind == "texto" and x >= 95)
            left = [k for k in edges if k < x - 10]
            parent = edges[max(left)] if can and left else None
            edge = round(x / 10) * 10
            edges = {k: v for k, v in (edges | {edge: j}).items() if k <= edge}
            made.append([j, kind, ident, " ".join(body.split()), parent, x, x + 22 if ident else x, y, []])
        for y, text in notes:
            above = [p for p in made if p[7] < y]
            if above:
                max(above, key=lambda p: (p[7], -p[0]))[8].append(text)
        for p in made or [[None] * 9]:
            out.append((i + 1, n, head["page"], to, *p[:7], "\n".join(p[8]) if p[8] else None))
    return out


COLUMNS = ["orden", "article", "page", "last_page", "number", "kind", "identifier", "content", "parent_number", "x_id", "x_text", "refs"]


def compared(lines, rules, found) -> int:
    by_doc: dict = {}
    for r in lines.collect():
        by_doc.setdefault(r["doc"], []).append(r)
    told = {r["source"]: (r["noise"], r["largest"], r["ends"]) for r in rules.collect()}
    want = sorted(repr((d, *row)) for d, rows in by_doc.items() for row in extract(rows, told))
    assert sorted(repr(tuple(r)) for r in found.select("doc", *COLUMNS).collect()) == want
    return len(want)


def test_articles_of_all_documents(spark, small):
    assert compared(article_lines(spark, small), law_rules(spark), QUERIES["contenido_de_leyes"](spark, small)) > 500


def test_articles_of_random_lines(spark):
    rng, rows = random.Random(4), []
    texts = ["Artículo 1o.- Uno.", "ARTÍCULO 2o.- dos", "Artículo 2o.-A.- con letra", "Artículo 3 Bis. tres", "Artículo 1o.- otra vez", "I. fracción", "a) inciso", "1. numeral", "Texto que sigue.", "y sigue", "DOF 1-1-2020", "TRANSITORIOS", "Fin de la ley", "artículo 9. de otra", "", "  ", "CÁMARA"]
    for doc in range(60):
        bold = [None] if doc % 10 == 0 else [True, False]
        for pos in range(rng.randrange(1, 70)):
            rows.append((doc, f"s{doc % 4}", pos // 9 + 1, pos, pos % 9 * 20 + rng.randrange(8), rng.choice([70, 85, 85, 85, 108, 130, 160, 250]), rng.choice([300, 400, 520, 540]), rng.choice(texts), rng.choice(bold), rng.random() < 0.2, rng.random() < 0.7, rng.choice([7.0, 12.0])))
    lines = spark.createDataFrame(rows, LINE)
    rules = spark.createDataFrame([("s0", ["DOF", "CÁMARA"], 8.0, None), ("s1", None, 8.0, "Fin de"), ("s2", ["DOF"], None, None)], "source string, noise array<string>, largest double, ends string")
    found = laws.law_contents(lines, rules).withColumn("refs", F.array_join("refs", "\n"))
    assert compared(lines.where("trim(text) <> ''"), rules, found) > 100
    assert laws.law_contents(lines.limit(0), rules).count() == 0


def test_an_article_known_by_hand(spark):
    rows = [
        (1, 20, 200, 412, "TÍTULO PRIMERO", True), (1, 60, 85, 440, "Artículo 1o.- Las personas pagan:", True), (1, 80, 110, 400, "I. La primera.", False), (1, 100, 140, 400, "a) Un inciso", False),
        (1, 115, 140, 500, "que sigue.", False), (2, 10, 90, 500, "LEY DE PRUEBA, DOF", False), (2, 40, 110, 400, "II. La segunda.", False), (2, 60, 85, 400, "Artículo 2o.- Nada.", True), (2, 90, 250, 360, "TRANSITORIOS", True), (2, 110, 85, 400, "Texto suelto.", False)]
    lines = [(1, "s", page, pos, y, x, x_end, text, bold, False, False, 12.0) for pos, (page, y, x, x_end, text, bold) in enumerate(rows)]
    lines.insert(5, (1, "s", 1, 99, 130, 90, 300, "Reformado DOF 1-1-2020", False, True, True, 7.0))
    lines = [(*r[:3], n, *r[4:]) for n, r in enumerate(lines)]
    rules = spark.createDataFrame([("s", ["DOF"], 8.0, None)], "source string, noise array<string>, largest double, ends string")
    got = laws.law_contents(spark.createDataFrame(lines, LINE), rules).orderBy("orden", "number").collect()
    assert [(r["article"], r["number"], r["kind"], r["identifier"], r["content"], r["parent_number"], r["refs"]) for r in got] == [
        ("1o", 1, "texto", None, "Las personas pagan:", None, None), ("1o", 2, "fraccion", "I", "La primera.", None, None), ("1o", 3, "inciso", "a)", "Un inciso que sigue.", 2, ["Reformado DOF 1-1-2020"]),
        ("1o", 4, "fraccion", "II", "La segunda.", None, None), ("2o", 1, "texto", None, "Nada.", None, None)]


def test_map_is_read_back(spark, small, tmp_path):
    rows = map_of_lines(spark, small).collect()
    want: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["place"] or (0, 0, 0), r["article"])):
        # of repeated titles, chapters or sections in one parent the last one stays
        doc = want.setdefault(r["doc"], {})
        at = (r["title"], r["chapter"], r["section"])
        place = r["place"] or (0, 0, 0)
        known = doc.setdefault("t", {})
        if known.get(r["title"], (place[0],))[0] != place[0]:
            known.pop(r["title"])
        chapters = known.setdefault(r["title"], (place[0], {}))[1]
        if chapters.get(r["chapter"], (place[1],))[0] != place[1]:
            chapters.pop(r["chapter"])
        sections = chapters.setdefault(r["chapter"], (place[1], {}))[1]
        if sections.get(r["section"], (place[2],))[0] != place[2]:
            sections.pop(r["section"])
        sections.setdefault(r["section"], (place[2], []))[1].append(str(r["article"]))
        assert at
    got = {r["doc"]: json.loads(r["value"])["titulos"] for r in QUERIES["mapa_de_lineas_json"](spark, small).collect()}
    assert set(got) == set(want)
    for doc, titles in got.items():
        plain = {t: {c: {None: x.get("articulos")} if "secciones" not in x else {s: y["articulos"] for s, y in x["secciones"].items()} for c, x in v["capitulos"].items()} for t, v in titles.items()}
        assert plain == {t: {c: {s: a for s, (_, a) in ss.items()} for c, (_, ss) in cs.items()} for t, (_, cs) in want[doc]["t"].items()}


def test_containers_of_documents_without_structure(spark):
    lines = spark.createDataFrame([(1, 1, 0, 10, "nothing"), (2, 1, 0, 10, "CAPITULO I"), (2, 1, 1, 20, "Del nombre"), (3, 1, 0, 10, "TITULO PRIMERO"), (3, 1, 1, 20, "ART. 1"), (4, 1, 0, 5, "SECCION I"), (4, 1, 1, 9, "TITULO II"), (4, 2, 2, 5, "CAPITULO I BIS"), (4, 2, 3, 9, "SECCION II"), (4, 2, 4, 12, "Otro nombre")], "doc long, page int, pos int, y int, text string")
    articles = spark.createDataFrame([(d, 10 * d + n, p, y) for d in range(1, 6) for n, (p, y) in enumerate([(1, 1), (2, 30), (1, None)])], "doc long, article long, page int, y int")
    got = {(r["doc"], r["article"] % 10): (r["title"], r["chapter"], r["chapter_name"], r["section"], r["section_name"]) for r in laws.law_map(lines, articles).collect()}
    assert {got[d, n] for d in (1, 5) for n in range(3)} == {("UNICO", "UNICO", None, None, None)}
    assert {got[2, n] for n in range(3)} == {("PRELIMINAR", "I", "Del nombre", None, None)}
    assert {got[3, n] for n in range(3)} == {("PRIMERO", "UNICO", None, None, None)}
    assert {got[4, n] for n in range(3)} == {("II", "I BIS", None, "II", "Otro nombre")}
    bare = textlines.with_virtual_chapters(articles.select("doc", F.lit("I").alias("title")).where("doc = 1").distinct(), articles.select("doc", F.lit("I").alias("title"), F.lit("x").alias("chapter")).where("doc = 9"), articles)
    assert {tuple(r) for r in bare.collect()} == {(1, "I", "UNICO"), *((d, "UNICO", "UNICO") for d in range(2, 6))}


@pytest.mark.parametrize("order", [["a"], ["b", "a"]])
def test_neighbours_in_a_hot_group(spark, order):
    rng = random.Random(2)
    rows = [(None if n % 500 == 7 else "hot" if n % 100 else f"g{n % 3}", n, rng.choice([None, 1, 2, 3]), rng.choice([None, None, None, f"v{n}"])) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, a long, b int, v string").repartition(5)
    got = {r["a"]: (r["p"], r["q"], r["k"]) for r in neighbours(df, ["g"], order, before={"p": "v"}, after={"q": "a"}, last={"k": F.col("v")}).collect()}
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: [(x is not None, x or 0) for x in ([r[1]] if order == ["a"] else [r[2], r[1]])])
        known = None
        for i, r in enumerate(own):
            known = r[3] or known
            assert got[r[1]] == (own[i - 1][3] if i else None, own[i + 1][1] if i + 1 < len(own) else None, known)
    assert neighbours(df.limit(0), ["g"], order, before={"p": "v"}).count() == 0


def test_gaps_of_any_width(spark):
    divisions = spark.createDataFrame([(1,), (2,), (3,), (4,)], "division_id long")
    articles = spark.createDataFrame([(1, 1), (1, 2_000_000_000), (2, 3), (2, 7), (2, 7), (2, 5), (3, 4)], "division_id long, n int")
    found = {r["division_id"]: r for r in quality.numbering_gaps(divisions, articles, F.col("n"), F.col("n").cast("string")).collect()}
    assert (found[1]["missing"], found[1]["missing_numbers"], found[1]["status"]) == (1_999_999_998, None, "error")
    assert (found[2]["missing_numbers"], found[2]["first_label"], found[2]["last_label"]) == ("4,6", "3", "7")
    assert (found[3]["missing_numbers"], found[3]["status"], found[4]["status"]) == (None, "ok", "empty")
    few = {r["division_id"]: r["missing_numbers"] for r in quality.numbering_gaps(divisions, articles, F.col("n"), F.col("n").cast("string"), listed=1).collect()}
    assert few[2] is None
    assert {tuple(r)[:1] + tuple(r)[2:] for r in quality.missing_intervals(articles, F.col("n")).collect()} == {(1, 2, 1_999_999_999), (2, 4, 4), (2, 6, 6)}


def test_baselines_of_every_shape(spark, tmp_path):
    shapes = {"one.json": '{"1":"a"}\n', "lines.json": '{"2":"b"}\n{"3":"c"}\n', "row.json": '{"4":"d","5":"e"}', "pretty.json": '{\n  "6": "f",\n  "7 \\"Bis\\"": "g"\n}\n', "empty.json": "{}\n"}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, loading.read_checksums(spark, str(tmp_path)).collect())) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e"), ("6", "f"), ('7 "Bis"', "g")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"1":\n"a"}')
    with pytest.raises(Exception, match="over two lines"):
        loading.read_checksums(spark, str(tmp_path / "bad")).collect()


def test_maps_with_repeated_keys_leave_the_session_alone(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"ley":"L","titulos":{"I":{"nombre":"a","capitulos":{"1":{"articulos":["x"]}}},"II":{"nombre":"b","capitulos":{}},"I":{"nombre":"c","capitulos":{"2":{"articulos":["y"],"secciones":{"s":{"articulos":["z"]},"s":{"articulos":["w"]}}}}}}}')
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    maps = loading.read_maps(spark, str(tmp_path))
    assert [(r["title"], r["chapter"], r["section"], r["article"]) for r in loading.map_entries(maps).orderBy("place").collect()] == [("I", "2", None, "y"), ("I", "2", "s", "w")]
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == before
