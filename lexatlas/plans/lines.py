"""Queries over text lines: the lines of documents with a geometry made from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions import numbering
from lexatlas.operators import textlines as t
from lexatlas.plans.registry import query
from lexatlas.sources.workspace import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    k = F.col("doc") + F.col("pos")
    head = F.when(k % 9 == 3, "IV. ").when(k % 9 == 5, "a) ").when(k % 9 == 7, "3. ").otherwise("")
    return own.where(F.trim("raw") != "").select(
        "doc", "source", F.col("pos").cast("int").alias("pos"), (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"),
        ((F.col("pos") % 10) * 20 + (F.col("doc") + F.col("pos") * 7) % 13).cast("int").alias("y"),
        (80 + ((F.col("doc") * 31 + F.col("pos") * 17) % 5) * 30).cast("int").alias("x"),
        (400 + (F.length("raw") * 7) % 200).cast("int").alias("x_end"), F.concat(head, F.trim("raw")).alias("text"),
        (k % 6 == 0).alias("is_bold"), (k % 5 == 1).alias("is_italic"), (k % 3 == 1).alias("is_non_black"), (6.0 + k % 5).cast("double").alias("font_size"))


LINES = """lines AS (
  SELECT doc, source, CAST(pos AS INTEGER) AS pos, CAST(pos // 10 + 1 AS INTEGER) AS page, CAST((pos % 10) * 20 + (doc + pos * 7) % 13 AS INTEGER) AS y,
         CAST(80 + ((doc * 31 + pos * 17) % 5) * 30 AS INTEGER) AS x, CAST(400 + (length(raw) * 7) % 200 AS INTEGER) AS x_end,
         CASE (doc + pos) % 9 WHEN 3 THEN 'IV. ' WHEN 5 THEN 'a) ' WHEN 7 THEN '3. ' ELSE '' END || trim(raw, ' ') AS text,
         (doc + pos) % 6 = 0 AS is_bold, (doc + pos) % 5 = 1 AS is_italic, (doc + pos) % 3 = 1 AS is_non_black, CAST(6 + (doc + pos) % 5 AS DOUBLE) AS font_size
  FROM (SELECT doc_id AS doc, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(raw, ' ') <> '')"""
_KIND = r"CASE WHEN regexp_matches({0}, '^[IVXLC]+\.') THEN 'fraccion' WHEN regexp_matches({0}, '^[a-z]\)') THEN 'inciso' WHEN regexp_matches({0}, '^[0-9]+\.') THEN 'numeral' ELSE 'texto' END"
_IDENTIFIER = r"CASE WHEN regexp_matches({0}, '^[IVXLC]+\.') THEN regexp_extract({0}, '^([IVXLC]+)\.', 1) WHEN regexp_matches({0}, '^[a-z]\)') THEN regexp_extract({0}, '^([a-z]\))', 1) WHEN regexp_matches({0}, '^[0-9]+\.') THEN regexp_extract({0}, '^([0-9]+\.)', 1) END"
_PARAGRAPHS = LINES + r""", flagged AS (
  SELECT *, coalesce(row_number() OVER w = 1 OR """ + _KIND.format("text") + r""" <> 'texto' OR
    CAST(x >= 80 AS INT) + coalesce(CAST(y - lag(y) OVER w > 15 AS INT), 0) + coalesce(CAST(lag(x_end) OVER w < 530 AS INT), 0) + CAST(regexp_matches(text, '^\p{Lu}') AS INT) + coalesce(CAST(lag(text) OVER w LIKE '%.' AS INT), 0) >= 4, true) AS is_new
  FROM lines WINDOW w AS (PARTITION BY doc ORDER BY pos)),
numbered AS (SELECT *, CAST(sum(CAST(is_new AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS number FROM flagged),
joined AS (SELECT doc, number, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(x, pos) AS x, arg_max(y, pos) AS y_end FROM numbered GROUP BY 1, 2),
paragraphs AS (SELECT doc, number, text, """ + _KIND.format("text") + " AS kind, " + _IDENTIFIER.format("text") + " AS identifier, x, y_end FROM joined)"


@query("parrafos_de_lineas", f"WITH {_PARAGRAPHS} SELECT * FROM paragraphs")
def _consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands over the five signs."""
    return t.consolidate(_lines(spark, sf_dir))


@query("padre_de_parrafo", f"""WITH {_PARAGRAPHS}
SELECT a.doc, a.number, CAST(max(b.number) AS BIGINT) AS parent_number FROM paragraphs a
LEFT JOIN paragraphs b ON b.doc = a.doc AND b.number < a.number AND round_even(b.x / 10.0, 0) * 10 < a.x - 10 AND (a.kind IN ('inciso', 'numeral') OR (a.kind = 'texto' AND a.x >= 95))
GROUP BY 1, 2""")
def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, F10."""
    return t.attach_parents(t.consolidate(_lines(spark, sf_dir))).select("doc", "number", "parent_number")


@query("referencias_a_parrafo", f"""WITH {_PARAGRAPHS}, notes AS (SELECT doc, CAST(pos AS BIGINT) AS note, y FROM lines WHERE is_italic AND is_non_black AND font_size <= 8)
SELECT doc, note, number FROM (SELECT n.doc, n.note, p.number, row_number() OVER (PARTITION BY n.doc, n.note ORDER BY p.y_end DESC, p.number) AS r FROM notes n JOIN paragraphs p ON p.doc = n.doc AND p.y_end < n.y) WHERE r = 1""")
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, P14."""
    lines = _lines(spark, sf_dir)
    notes = t.reference_lines(lines).select("doc", F.col("pos").cast("long").alias("note"), "y")
    return t.attach_references(t.consolidate(lines), notes)


@query("articulo_a_corte", f"""WITH {LINES}, cuts AS (SELECT doc, CAST(pos AS BIGINT) AS cut, page, y FROM lines WHERE (doc + pos) % 4 = 1), arts AS (SELECT doc, CAST(pos AS BIGINT) AS article, page, CASE WHEN (doc + pos) % 16 = 3 THEN 99999 ELSE y END AS y FROM lines WHERE (doc + pos) % 4 = 3),
hit AS (SELECT a.doc, a.article, c.cut, row_number() OVER (PARTITION BY a.doc, a.article ORDER BY c.page DESC, c.y DESC, c.cut DESC) AS r FROM arts a JOIN cuts c ON c.doc = a.doc AND (c.page, c.y) <= (a.page, a.y)),
first_cut AS (SELECT doc, cut FROM (SELECT doc, cut, row_number() OVER (PARTITION BY doc ORDER BY page, y, cut) AS r FROM cuts) WHERE r = 1)
SELECT a.doc, a.article, coalesce(h.cut, f.cut) AS cut FROM arts a LEFT JOIN hit h ON h.doc = a.doc AND h.article = a.article AND h.r = 1 LEFT JOIN first_cut f ON f.doc = a.doc""")
def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join without a range join."""
    lines = _lines(spark, sf_dir)
    k = (F.col("doc") + F.col("pos")) % 16
    cuts = lines.where(k % 4 == 1).select("doc", F.col("pos").cast("long").alias("cut"), "page", "y")
    articles = lines.where(k % 4 == 3).select("doc", F.col("pos").cast("long").alias("article"), "page", F.when(k != 3, F.col("y")).alias("y"))
    return t.assign_to_cuts(articles, cuts)


@query("primera_aparicion", f"WITH {LINES} SELECT doc, pos, key FROM (SELECT doc, pos, substring(text, 1, 2) AS key, row_number() OVER (PARTITION BY doc, substring(text, 1, 2) ORDER BY pos) AS r FROM lines) WHERE r = 1")
def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return t.first_in_scan(_lines(spark, sf_dir).select("doc", "pos", F.substring("text", 1, 2).alias("key")), "key")


@query("contexto_vigente", f"""WITH {LINES}, a AS (SELECT *, (doc + pos) % 7 = 0 AS ti, (doc + pos) % 3 = 0 AS ch, sum(CAST((doc + pos) % 7 = 0 AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS g FROM lines)
SELECT doc, pos, last_value(CASE WHEN ti THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS title, last_value(CASE WHEN ch AND NOT ti THEN text END IGNORE NULLS) OVER (PARTITION BY doc, g ORDER BY pos) AS chapter FROM a""")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, E5."""
    k = F.col("doc") + F.col("pos")
    return t.running_context(_lines(spark, sf_dir), k % 7 == 0, k % 3 == 0).select("doc", "pos", "title", "chapter")


@query("segmentos_articulo", f"""WITH {LINES}, a AS (SELECT *, CAST(sum(CAST((doc + pos) % 5 = 2 AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS segment FROM lines),
b AS (SELECT *, sum(CAST((doc + pos) % 11 = 4 AS INT)) OVER (PARTITION BY doc, segment ORDER BY pos) AS e FROM a WHERE segment > 0) SELECT doc, pos, segment FROM b WHERE e = 0""")
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, E3, F14."""
    k = F.col("doc") + F.col("pos")
    return t.segments(_lines(spark, sf_dir), k % 5 == 2, k % 11 == 4).select("doc", "pos", "segment")


@query("hasta_marcador", f"WITH {LINES}, m AS (SELECT doc, min(pos) AS p FROM lines WHERE (doc + pos) % 13 = 6 GROUP BY 1) SELECT l.doc, l.pos FROM lines l LEFT JOIN m ON m.doc = l.doc WHERE m.p IS NULL OR l.pos < m.p")
def _until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, E2."""
    return t.until_marker(_lines(spark, sf_dir), (F.col("doc") + F.col("pos")) % 13 == 6).select("doc", "pos")


@query("paginas_articulo", f"WITH {LINES} SELECT doc, pos, page, CAST(coalesce(lead(page) OVER (PARTITION BY doc ORDER BY pos), CASE WHEN doc % 2 = 0 THEN 40 END, page + 5) AS INTEGER) AS last_page FROM lines WHERE (doc + pos) % 5 = 2")
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    own = _lines(spark, sf_dir).where((F.col("doc") + F.col("pos")) % 5 == 2).withColumn("end_page", F.when(F.col("doc") % 2 == 0, F.lit(40)))
    return t.page_ranges(own).select("doc", "pos", "page", "last_page")


@query("sin_ruido", f"WITH {LINES} SELECT doc, pos FROM lines WHERE NOT (source = 'src1' AND (contains(text, 'the ') OR contains(text, 'la '))) AND NOT (source = 'src2' AND contains(text, 'on'))")
def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-source rules are a broadcast join."""
    noise = spark.createDataFrame([("src1", ["the ", "la "]), ("src2", ["on"])], "source string, noise array<string>")
    return t.without_noise(_lines(spark, sf_dir), noise).select("doc", "pos")


@query("encabezados_centrados", f"WITH {LINES} SELECT doc, pos FROM lines WHERE is_bold AND abs(2 * x + (x_end - x) - 612) < 50")
def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return t.centred_headings(_lines(spark, sf_dir)).select("doc", "pos")


@query("encabezados_articulo", f"""WITH {LINES}, k AS (SELECT doc, bool_or(page <= 5 AND is_bold) AS known FROM lines GROUP BY 1),
f AS (SELECT l.doc, l.pos, regexp_extract(substring(l.text, 1, 50), '^([A-Z][a-z]+)', 1) AS number FROM lines l JOIN k ON k.doc = l.doc WHERE NOT k.known OR (l.is_bold AND l.x BETWEEN 80 AND 95))
SELECT doc, pos, number FROM (SELECT *, row_number() OVER (PARTITION BY doc, number ORDER BY pos) AS r FROM f WHERE number <> '') WHERE r = 1""")
def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, F7."""
    return t.article_headings(_lines(spark, sf_dir), "^([A-Z][a-z]+)").select("doc", "pos", "number")


@query("articulos_derogados", f"""WITH {LINES}, m AS (SELECT doc, pos, lower(concat_ws(' ', CASE WHEN (doc + pos) % 10 = 1 THEN text || ' Se deroga' ELSE text END, lead(CASE WHEN (doc + pos) % 10 = 1 THEN text || ' Se deroga' ELSE text END) OVER w, lead(CASE WHEN (doc + pos) % 10 = 1 THEN text || ' Se deroga' ELSE text END, 2) OVER w)) AS said FROM lines WINDOW w AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos, contains(said, 'se deroga') OR contains(said, '(derogado)') AS repealed FROM m WHERE (doc + pos) % 4 = 0""")
def _repealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12."""
    k = F.col("doc") + F.col("pos")
    lines = _lines(spark, sf_dir).withColumn("text", F.when(k % 10 == 1, F.concat("text", F.lit(" Se deroga"))).otherwise(F.col("text")))
    return t.repealed(lines, k % 4 == 0).select("doc", "pos", "repealed")


@query("indice_o_contenido", f"WITH {LINES}, o AS (SELECT doc, pos FROM lines WHERE doc % 3 = 0 AND is_bold), c AS (SELECT doc, pos FROM lines WHERE is_italic) SELECT * FROM o UNION ALL SELECT * FROM c WHERE doc NOT IN (SELECT doc FROM o)")
def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7."""
    lines = _lines(spark, sf_dir)
    return t.outline_or_content(lines.where("doc % 3 = 0 and is_bold").select("doc", "pos"), lines.where("is_italic").select("doc", "pos"))


@query("capitulos_virtuales", f"""WITH {LINES}, ti AS (SELECT doc, CAST(pos AS VARCHAR) AS title FROM lines WHERE (doc + pos) % 7 = 0), ch AS (SELECT doc, CAST(pos AS VARCHAR) AS title, substring(text, 1, 5) AS chapter FROM lines WHERE (doc + pos) % 7 = 0 AND is_italic)
SELECT * FROM ch UNION ALL SELECT doc, title, 'UNICO' FROM ti WHERE (doc, title) NOT IN (SELECT doc, title FROM ch)""")
def _virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6."""
    own = _lines(spark, sf_dir).where((F.col("doc") + F.col("pos")) % 7 == 0).withColumn("title", F.col("pos").cast("string"))
    return t.with_virtual_chapters(own.select("doc", "title"), own.where("is_italic").select("doc", "title", F.substring("text", 1, 5).alias("chapter")))


@query("regla_a_capitulo", f"WITH {LINES}, r AS (SELECT doc, pos, CAST(doc % 5 AS VARCHAR) || '.' || CAST(page AS VARCHAR) || '.' || CAST(pos AS VARCHAR) AS number FROM lines) SELECT r.doc, r.pos, r.number, CAST(CASE WHEN doc % 5 < 4 AND pos // 10 + 1 < 4 THEN (doc % 5) * 10 + pos // 10 + 1 END AS INTEGER) AS chapter_id FROM r")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    rules = _lines(spark, sf_dir).select("doc", "pos", F.concat_ws(".", (F.col("doc") % 5).cast("string"), F.col("page").cast("string"), F.col("pos").cast("string")).alias("number"))
    chapters = spark.createDataFrame([(f"{a}.{b}", 10 * a + b) for a in range(4) for b in range(1, 4)], "number string, chapter_id int")
    return t.rule_chapters(rules, chapters).select("doc", "pos", "number", "chapter_id")


@query("parrafos_de_reglas", f"""WITH {LINES}, b AS (SELECT doc, pos, y, trim(text, ' ') AS text, CASE WHEN abs(x + 76 - 156) <= 10 THEN 0 WHEN abs(x + 76 - 198) <= 10 THEN 1 WHEN abs(x + 76 - 241) <= 10 THEN 2 WHEN abs(x + 76 - 269) <= 10 THEN 3 END AS band FROM lines),
m AS (SELECT *, lag(pos) OVER w IS NULL OR y - lag(y) OVER w > 12.5 OR band IS DISTINCT FROM lag(band) OVER w AS new FROM b WINDOW w AS (PARTITION BY doc ORDER BY pos)),
n AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS number FROM m)
SELECT doc, number, CAST(min(band) AS INTEGER) AS band, string_agg(text, ' ' ORDER BY pos) AS text FROM n GROUP BY 1, 2""")
def _rule_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands and gaps."""
    return t.rule_paragraphs(_lines(spark, sf_dir).withColumn("x", F.col("x") + 76))


@query("titulos_pendientes", f"""WITH {LINES}, a AS (SELECT *, regexp_extract(text, '^([0-9]+[.])', 1) AS number FROM lines),
s AS (SELECT *, coalesce(sum(CAST(number <> '' AS INT)) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM a),
b AS (SELECT doc, pos, number, last_value(CASE WHEN is_bold AND number = '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc, g ORDER BY pos) AS title FROM s) SELECT * FROM b WHERE number <> ''""")
def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading before a rule's number."""
    return t.pending_titles(_lines(spark, sf_dir), r"^(\d+[.])")


_HEADS = "CASE (doc + pos) % 12 WHEN 0 THEN 'Título ' || CAST(pos // 12 + 1 AS VARCHAR) || '. ' WHEN 6 THEN 'Capítulo ' || CAST(pos // 12 + 1 AS VARCHAR) || '.1. ' ELSE '' END"


@query("encabezados_de_reglas", f"""WITH {LINES}, h AS (SELECT doc, pos, page, is_bold, x, x_end, {_HEADS} || text AS text FROM lines),
f AS (SELECT *, regexp_extract(text, '^Título\\s+([0-9]+)\\.\\s+.+$', 1) AS t, regexp_extract(text, '^Capítulo\\s+([0-9]+\\.[0-9]+)\\.\\s+.+$', 1) AS c FROM h WHERE is_bold AND abs(x + x_end - 612) < 50)
SELECT doc, pos, page, CASE WHEN t <> '' THEN 'titulo' ELSE 'capitulo' END AS kind, CASE WHEN t <> '' THEN t ELSE c END AS number, trim(regexp_extract(text, '^(Título|Capítulo)\\s+[0-9.]+\\.\\s+(.+)$', 2), ' ') AS name,
       coalesce(last_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '0') AS title FROM f WHERE t <> '' OR c <> ''""")
def _rule_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and chapters, bold and centred."""
    k, number = (F.col("doc") + F.col("pos")) % 12, (F.floor(F.col("pos") / 12) + 1).cast("string")
    head = F.when(k == 0, F.concat(F.lit("Título "), number, F.lit(". "))).when(k == 6, F.concat(F.lit("Capítulo "), number, F.lit(".1. "))).otherwise("")
    return t.rule_headings(_lines(spark, sf_dir).withColumn("text", F.concat(head, "text")))


@query("contenido_de_reglas")
def _rule_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8, whole: names, paragraphs and citations of rules; tests compare it with a loop."""
    k = F.col("doc") + F.col("pos")
    edge = F.element_at(F.array(*map(F.lit, (99, 156, 198, 241, 269))), (F.pmod(F.floor(k / 2), F.lit(5)) + 1).cast("int"))
    number = F.concat(F.concat_ws(".", (F.col("doc") % 5 + 1).cast("string"), F.col("page").cast("string"), (F.col("pos") + 1).cast("string")), F.lit(". "))
    lines = _lines(spark, sf_dir).withColumns({"x": F.when(k % 7 == 0, 99).otherwise(edge), "text": F.concat(F.when(k % 7 == 0, number).otherwise(""), "text"), "is_bold": F.col("is_bold") | (k % 14 == 0)})
    return t.rule_contents(lines)


@query("hasta_pagina_final", f"""WITH {LINES}, e AS (SELECT doc, min(page) AS end_page FROM lines WHERE is_bold AND (text LIKE '%e%' AND x > 150 OR text LIKE 'T%') GROUP BY doc)
SELECT doc, pos, page, end_page FROM lines LEFT JOIN e USING (doc) WHERE is_italic AND (end_page IS NULL OR page <= end_page)""")
def _end_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to the first page with an end marker."""
    lines = _lines(spark, sf_dir)
    return t.until_end_page(lines.where("is_italic").select("doc", "pos", "page"), lines, "e", "^T")


@query("pliegue_por_inicio")
def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that SQL windows can't express; tests compare it with a loop."""
    return t.consolidate_by_start(_lines(spark, sf_dir))


@query("lineas_de_caracteres", """WITH c AS (SELECT event_id // 40 AS doc, CAST(1 AS INTEGER) AS page, CAST((event_id % 40) * 1.7 AS DOUBLE) AS top, CAST(event_id % 40 AS INTEGER) AS x, CAST(1 AS INTEGER) AS width, substring(event_type, 1, 1) AS char, event_id % 3 <> 0 AS bold, event_id % 2 = 0 AS italic FROM events)
SELECT doc, page, CAST(round_even(top / 5, 0) * 5 AS INTEGER) AS y, min(x) AS x, max(x + width) AS x_end, coalesce(bool_and(bold) FILTER (char <> ' '), false) AS is_bold, avg(CAST(italic AS INT)) FILTER (char <> ' ') > 0.5 AS is_italic, string_agg(char, '' ORDER BY x) AS text FROM c GROUP BY 1, 2, 3""")
def _characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positioned characters."""
    e = F.col("event_id")
    chars = table(spark, sf_dir, "events").select(F.floor(e / 40).alias("doc"), F.lit(1).alias("page"), ((e % 40) * 1.7).alias("top"), (e % 40).cast("int").alias("x"), F.lit(1).alias("width"), F.substring("event_type", 1, 1).alias("char"), (e % 3 != 0).alias("bold"), (e % 2 == 0).alias("italic"))
    return t.lines_from_characters(chars)


@query("y_global", f"WITH {LINES} SELECT doc, pos, CAST(y + 800 * (page - 1) AS INTEGER) AS y_global, CAST(CASE WHEN x < 95 THEN 0 WHEN x < 124 THEN 1 WHEN x < 152 THEN 2 ELSE 3 END AS INTEGER) AS level, CAST(CASE WHEN " + _KIND.format("text") + " <> 'texto' THEN x + 22 ELSE x END AS INTEGER) AS x_text FROM lines")
def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F11, F34."""
    x_text = F.when(numbering.paragraph_class(F.col("text"))["kind"] != "texto", F.col("x") + 22).otherwise(F.col("x"))
    return t.global_y(_lines(spark, sf_dir), F.lit(1)).select("doc", "pos", "y_global", numbering.indent_level(F.col("x")).alias("level"), x_text.alias("x_text"))


@query("lineas_de_tramos", """WITH c AS (SELECT event_id // 8 AS doc, CAST(1 AS INTEGER) AS page, CAST(event_id // 4 % 2 AS INTEGER) AS y, CAST(event_id % 4 * 100 AS INTEGER) AS x, CAST(event_id % 4 * 100 + 90 AS INTEGER) AS x_end, event_type || ' ' AS text, event_id % 7 > 0 AS bold FROM events)
SELECT doc, page, y, min(x) AS x, max(x_end) AS x_end, string_agg(text, '' ORDER BY x) AS text, coalesce(sum(length(trim(text))) FILTER (bold), 0) / sum(length(trim(text))) > 0.8 AS is_bold FROM c GROUP BY 1, 2, 3""")
def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, P15, in the way of rule documents: bold by more than 80 % of the characters; events as spans."""
    e = F.col("event_id")
    place = lambda c: F.floor(c).cast("int")
    spans = table(spark, sf_dir, "events").select(F.floor(e / 8).alias("doc"), F.lit(1).alias("page"), place(e / 4 % 2).alias("y"), (e % 4 * 100).cast("int").alias("x"), (e % 4 * 100 + 90).cast("int").alias("x_end"), F.concat("event_type", F.lit(" ")).alias("text"), (e % 7 > 0).alias("bold"))
    return t.lines_from_spans(spans)


@query("fuentes_registradas", "SELECT doc_id AS doc, source, length(source) AS size FROM documents")
def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is looked up in a registry; tests hold the error for one that is missing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    registry = docs.select(F.upper("source").alias("source")).distinct().withColumn("size", F.length("source").cast("long"))
    return t.registered(docs, registry).select("doc", "source", "size")


@query("nombres_de_division", f"""WITH {LINES}, s AS (SELECT *, NOT (length(text) <= 3 OR regexp_matches(text, '^(ley\\s|cámara|secretaría|últim|código|constitución|\\d+\\s+de\\s+\\d+|\\[)', 'i')) AS fine FROM (SELECT doc, pos, page, trim(CASE WHEN (doc + pos) % 8 = 1 THEN 'LEY ' ELSE '' END || text, ' ') AS text FROM lines)),
f AS (SELECT *, first_value(CASE WHEN fine THEN {{'text': text, 'page': page}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM s)
SELECT doc, pos, CASE WHEN n.page <= page + 1 AND NOT regexp_matches(n.text, '^(art|cap|titulo|título|secc|[ivx]+\\.\\s|[a-z]\\)\\s)', 'i') THEN n.text END AS name FROM f WHERE (doc + pos) % 4 = 0""")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the line that names a division, on its page or the next."""
    k = F.col("doc") + F.col("pos")
    lines = _lines(spark, sf_dir).withColumn("text", F.concat(F.when(k % 8 == 1, "LEY ").otherwise(""), "text"))
    return t.division_names(lines, k % 4 == 0).select("doc", "pos", "name")
