"""Queries over whole laws: the lines of documents with headings put among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.operators import laws
from lexatlas.plans.lines import LINES, _lines
from lexatlas.plans.registry import query


def _k() -> Column:
    return F.col("doc") + F.col("pos")


def article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with headings of articles by the margin, mentions that look like headings, and end markers."""
    k = _k()
    ordinal = F.when(F.col("pos") % 2 == 1, "o").otherwise("")
    suffix = F.when(F.col("pos") % 5 == 4, " Bis").when(F.col("pos") % 5 == 3, "-A").otherwise("")
    head = F.when(k % 7 == 3, F.concat(F.lit("Artículo "), F.col("pos").cast("string"), ordinal, suffix, F.lit(".- "))).when(k % 23 == 5, "Artículo 999. ").when(k % 97 == 50, "TRANSITORIOS ").otherwise("")
    changed = {"text": F.concat(head, "text"), "x": F.when(k % 7 == 3, 85).when(k % 97 == 50, 200).otherwise(F.col("x")), "is_bold": (k % 7 == 3) | (k % 97 == 50) | F.col("is_bold")}
    return _lines(spark, sf_dir).withColumns(changed)


def law_rules(spark: SparkSession) -> DataFrame:
    rows = [("src0", ["the "], 8.0, None), ("src1", None, 8.0, "of in"), ("src2", ["que la"], None, None), ("src3", [], 9.0, None)]
    return spark.createDataFrame(rows, "source string, noise array<string>, largest double, ends string")


_ARTICLE = laws.ARTICLE.replace("(?iu)", "(?i)")
_KIND = r"CASE WHEN regexp_matches({0}, '^[IVXLC]+\.') THEN 'fraccion' WHEN regexp_matches({0}, '^[a-z]\)') THEN 'inciso' WHEN regexp_matches({0}, '^[0-9]+\.') THEN 'numeral' ELSE 'texto' END"
_PART = lambda k: f"regexp_extract(h, '{_ARTICLE}', {k})"
_CONTENTS = f"""WITH {LINES}, rules AS (SELECT * FROM (VALUES ('src0', 'the ', 8.0, NULL), ('src1', NULL, 8.0, 'of in'), ('src2', 'que la', NULL, NULL), ('src3', NULL, 9.0, NULL)) AS t (source, noise, largest, ends)),
al AS (SELECT doc, source, pos, page, y, CASE WHEN (doc + pos) % 7 = 3 THEN 85 WHEN (doc + pos) % 97 = 50 THEN 200 ELSE x END AS x, x_end, (doc + pos) % 7 = 3 OR (doc + pos) % 97 = 50 OR is_bold AS bold, is_italic AND is_non_black AS small, font_size,
  CASE WHEN (doc + pos) % 7 = 3 THEN 'Artículo ' || CAST(pos AS VARCHAR) || CASE WHEN pos % 2 = 1 THEN 'o' ELSE '' END || CASE pos % 5 WHEN 4 THEN ' Bis' WHEN 3 THEN '-A' ELSE '' END || '.- '
       WHEN (doc + pos) % 23 = 5 THEN 'Artículo 999. ' WHEN (doc + pos) % 97 = 50 THEN 'TRANSITORIOS ' ELSE '' END || text AS text FROM lines),
f AS (SELECT al.*, substring(text, 1, 50) AS h, coalesce(small AND font_size <= largest, FALSE) AS note, coalesce(contains(text, noise), FALSE) AS noisy, bold AND (regexp_matches(text, '(?i)TRANSITORI[OA]S?') OR coalesce(contains(text, ends), FALSE)) AS is_end,
  bold AND abs(x + x_end - 612) < 50 AS centred, starts_with(text, 'Artículo ') AS is_next,
  min(CASE WHEN bold AND ((regexp_matches(text, '(?i)TRANSITORI[OA]S?') AND x > 150) OR coalesce(contains(text, ends), FALSE)) THEN page END) OVER (PARTITION BY doc) AS end_page
  FROM al LEFT JOIN rules ON rules.source = al.source),
n AS (SELECT *, CASE WHEN bold AND x BETWEEN 80 AND 95 AND (end_page IS NULL OR page <= end_page) AND {_PART(1)} <> '' THEN {_PART(1)} || lower({_PART(2)}) || CASE WHEN {_PART(3)} <> '' THEN '-' || upper({_PART(3)}) ELSE '' END
  || CASE WHEN {_PART(4)} <> '' THEN ' ' || upper({_PART(4)}[1]) || lower({_PART(4)}[2:]) ELSE '' END || CASE WHEN {_PART(5)} <> '' THEN ' ' || {_PART(5)} ELSE '' END END AS article FROM f),
g AS (SELECT *, article IS NOT NULL AND row_number() OVER (PARTITION BY doc, article ORDER BY pos) = 1 AS heading FROM n),
o AS (SELECT *, count(*) FILTER (heading) OVER (PARTITION BY doc ORDER BY pos) AS orden, coalesce(first_value(CASE WHEN heading THEN page END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), end_page, page + 5) AS last_page,
  CASE WHEN note THEN 'note' WHEN noisy THEN NULL WHEN heading AND NOT centred THEN 'start' WHEN is_end THEN 'stop' WHEN centred THEN NULL WHEN is_next THEN 'stop' ELSE 'line' END AS role FROM g),
s AS (SELECT *, last_value(CASE WHEN role IN ('start', 'stop') THEN {{'role': role, 'orden': orden, 'page': page, 'last': last_page}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS st FROM o),
i AS (SELECT doc, st.orden AS orden, pos, y + 800 * (page - st.page) AS y, x, x_end, role, CASE WHEN role = 'start' THEN ltrim(regexp_replace(text, '{_ARTICLE}', ''), '- ') ELSE text END AS text FROM s WHERE st.role = 'start' AND page <= st.last AND role IN ('start', 'line', 'note')),
l AS (SELECT * FROM i WHERE role <> 'note' AND text <> ''),
nw AS (SELECT *, row_number() OVER w = 1 OR {_KIND.format("text")} <> 'texto' OR CAST(x >= 80 AS INT) + coalesce(CAST(y - lag(y) OVER w > 15 AS INT), 0) + coalesce(CAST(lag(x_end) OVER w < 530 AS INT), 0) + CAST(regexp_matches(text, '^\\p{{Lu}}') AS INT) + coalesce(CAST(rtrim(lag(text) OVER w, ' ') LIKE '%.' AS INT), 0) >= 4 AS is_new FROM l WINDOW w AS (PARTITION BY doc, orden ORDER BY pos)),
nb AS (SELECT *, CAST(sum(CAST(is_new AS INT)) OVER (PARTITION BY doc, orden ORDER BY pos) AS BIGINT) AS number FROM nw),
p AS (SELECT doc, orden, number, string_agg(trim(text, ' '), ' ' ORDER BY pos) AS text, arg_min(x, pos) AS x, arg_max(y, pos) AS y_end FROM nb GROUP BY ALL),
k AS (SELECT *, {_KIND.format("text")} AS kind, CASE WHEN regexp_matches(text, '^[IVXLC]+\\.') THEN regexp_extract(text, '^([IVXLC]+)\\.', 1) ELSE nullif(regexp_extract(text, '^([a-z]\\)|[0-9]+\\.)', 1), '') END AS identifier FROM p),
up AS (SELECT a.doc, a.orden, a.number, max(b.number) AS parent_number FROM k a JOIN k b ON b.doc = a.doc AND b.orden = a.orden AND b.number < a.number AND round_even(b.x / 10.0, 0) * 10 < a.x - 10 WHERE a.kind IN ('inciso', 'numeral') OR (a.kind = 'texto' AND a.x >= 95) GROUP BY ALL),
nt AS (SELECT i.doc, i.orden, i.pos, i.text, k.number, row_number() OVER (PARTITION BY i.doc, i.orden, i.pos ORDER BY k.y_end DESC, k.number) AS r FROM i JOIN k ON k.doc = i.doc AND k.orden = i.orden AND k.y_end < i.y WHERE i.role = 'note'),
rf AS (SELECT doc, orden, number, string_agg(text, chr(10) ORDER BY pos) AS refs FROM nt WHERE r = 1 GROUP BY ALL)
SELECT a.doc, a.orden, a.article, a.page, CAST(a.last_page AS INTEGER) AS last_page, k.number, k.kind, k.identifier,
  trim(regexp_replace(CASE WHEN k.identifier IS NULL THEN k.text ELSE regexp_replace(k.text, '^([IVXLC]+\\.|[a-z]\\)|[0-9]+\\.)\\s*', '') END, '\\s+', ' ', 'g'), ' ') AS content,
  up.parent_number, CAST(k.x AS INTEGER) AS x_id, CAST(k.x + CASE WHEN k.identifier IS NULL THEN 0 ELSE 22 END AS INTEGER) AS x_text, rf.refs
FROM s a LEFT JOIN k ON k.doc = a.doc AND k.orden = a.orden LEFT JOIN up ON up.doc = k.doc AND up.orden = k.orden AND up.number = k.number LEFT JOIN rf ON rf.doc = k.doc AND rf.orden = k.orden AND rf.number = k.number WHERE a.heading"""


@query("contenido_de_leyes", _CONTENTS)
def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, E4 with E1, E2, W12, P12-P14, J11, J12: articles with paragraphs, parents and citations; tests compare it with a
    loop in the order of the scan."""
    found = laws.law_contents(article_lines(spark, sf_dir), law_rules(spark))
    return found.withColumn("refs", F.array_join("refs", "\n"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, roman = _k(), F.array(*map(F.lit, ("I", "II", "III", "IV", "V")))
    title = F.concat(F.lit("TÍTULO "), F.element_at(roman, (F.floor(F.col("pos") / 11) % 5 + 1).cast("int")))
    chapter = F.when(F.col("pos") % 4 == 3, "Capítulo único").otherwise(F.concat(F.lit("CAPITULO "), F.element_at(roman, (F.col("pos") % 3 + 1).cast("int"))))
    text = F.when(k % 11 == 0, title).when(k % 7 == 4, chapter).when(k % 5 == 3, F.concat(F.lit("Sección "), F.element_at(roman, (F.col("pos") % 2 + 1).cast("int")))).otherwise(F.col("text"))
    return _lines(spark, sf_dir).where("doc % 7 <> 6").withColumn("text", F.when(F.col("doc") % 13 == 5, F.col("text")).otherwise(text))


def map_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, k = _lines(spark, sf_dir), _k()
    articles = lines.where(k % 6 == 2).select("doc", F.col("pos").cast("long").alias("article"), "page", F.when(k % 12 == 8, F.col("y")).alias("y"))
    return laws.law_map(_scanned(spark, sf_dir), articles)


@query("mapa_de_lineas", f"""WITH {LINES}, r AS (SELECT ['I', 'II', 'III', 'IV', 'V'] AS n),
l AS (SELECT doc, pos, page, y, doc % 13 <> 5 AND (doc + pos) % 11 = 0 AS is_t, doc % 13 <> 5 AND (doc + pos) % 11 <> 0 AND (doc + pos) % 7 = 4 AS is_c, doc % 13 <> 5 AND (doc + pos) % 11 <> 0 AND (doc + pos) % 7 <> 4 AND (doc + pos) % 5 = 3 AS is_s, text FROM lines WHERE doc % 7 <> 6),
k AS (SELECT doc, pos, page, y, CASE WHEN is_t THEN 'titulo' WHEN is_c THEN 'capitulo' WHEN is_s THEN 'seccion' END AS kind,
       CASE WHEN is_t THEN n[pos // 11 % 5 + 1] WHEN is_c AND pos % 4 = 3 THEN 'ÚNICO' WHEN is_c THEN n[pos % 3 + 1] WHEN is_s THEN n[pos % 2 + 1] END AS number,
       CASE WHEN is_t THEN 'TÍTULO' WHEN is_c THEN 'CAPITULO' WHEN is_s THEN 'Sección' ELSE trim(text, ' ') END AS text FROM l, r),
f AS (SELECT *, count(*) FILTER (kind = 'titulo') OVER (PARTITION BY doc ORDER BY pos) AS title_no,
       first_value(CASE WHEN NOT (length(text) <= 3 OR regexp_matches(text, '^(ley\\s|cámara|secretaría|últim|código|constitución|\\d+\\s+de\\s+\\d+|\\[)', 'i')) THEN {{'text': text, 'page': page}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM k),
g AS (SELECT *, last_value(CASE WHEN kind = 'capitulo' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc, title_no ORDER BY pos) AS chapter_pos,
       CASE WHEN n.page <= page + 1 AND NOT regexp_matches(n.text, '^(art|cap|titulo|título|secc|[ivx]+\\.\\s|[a-z]\\)\\s)', 'i') THEN n.text END AS name FROM f),
titles AS (SELECT doc, title_no, pos, page, y, number AS title, name AS title_name FROM g WHERE kind = 'titulo' UNION ALL SELECT DISTINCT doc, 0, -1, 1, NULL, 'PRELIMINAR', NULL FROM g WHERE kind = 'capitulo' AND title_no = 0),
chapters AS (SELECT doc, title_no, pos AS chapter_pos, page, y, number AS chapter, name AS chapter_name FROM g WHERE kind = 'capitulo'
  UNION ALL SELECT doc, title_no, pos, page, y, 'UNICO', NULL FROM titles WHERE (doc, title_no) NOT IN (SELECT doc, title_no FROM g WHERE kind = 'capitulo')),
sections AS (SELECT doc, chapter_pos, pos AS section_pos, page, y, number AS section, name AS section_name FROM g WHERE kind = 'seccion' AND chapter_pos IS NOT NULL),
cuts AS (SELECT c.doc, coalesce(section_pos, c.chapter_pos) AS cut, coalesce(s.page, c.page) AS page, coalesce(s.y, c.y) AS y, title, title_name, chapter, chapter_name, section, section_name
  FROM chapters c JOIN titles t ON t.doc = c.doc AND t.title_no = c.title_no LEFT JOIN sections s ON s.doc = c.doc AND s.chapter_pos = c.chapter_pos),
arts AS (SELECT doc, CAST(pos AS BIGINT) AS article, page, CASE WHEN (doc + pos) % 12 = 8 THEN y ELSE 99999 END AS y FROM lines WHERE (doc + pos) % 6 = 2),
ranked AS (SELECT a.doc, a.article, c.*, row_number() OVER (PARTITION BY a.doc, a.article ORDER BY (c.page, c.y) <= (a.page, a.y) DESC, CASE WHEN (c.page, c.y) <= (a.page, a.y) THEN -c.page ELSE c.page END, CASE WHEN (c.page, c.y) <= (a.page, a.y) THEN -c.y ELSE c.y END, CASE WHEN (c.page, c.y) <= (a.page, a.y) THEN -c.cut ELSE c.cut END) AS i FROM arts a JOIN cuts c ON c.doc = a.doc)
SELECT a.doc, a.article, coalesce(title, 'UNICO') AS title, title_name, coalesce(chapter, 'UNICO') AS chapter, chapter_name, section, section_name
FROM arts a LEFT JOIN ranked r ON r.doc = a.doc AND r.article = a.article AND r.i = 1""")
def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines to the place of each article in titles, chapters and sections, documents without any included."""
    return map_of_lines(spark, sf_dir).select("doc", "article", "title", "title_name", "chapter", "chapter_name", "section", "section_name")


@query("mapa_de_lineas_json")
def _map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the same as one JSON map a document; tests read it back."""
    return laws.map_json(map_of_lines(spark, sf_dir).withColumn("number", F.col("article").cast("string")))
