"""Queries of integrity checks, reconciliation and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions import numbering
from lexatlas.operators import quality as q
from lexatlas.plans.registry import query
from lexatlas.sources.corpus import MODEL, Corpus, load
from lexatlas.sources.workspace import table

_WITH = f"WITH {MODEL}"


@query("articulos_huerfanos", f"{_WITH} SELECT a.id, a.law FROM articles a WHERE NOT EXISTS (SELECT 1 FROM divisions d WHERE d.id = a.division_id AND d.id % 5 <> 2)")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With some divisions taken away."""
    c = load(spark, sf_dir)
    return q.orphans(c.articles, c.divisions.where("id % 5 != 2").withColumnRenamed("id", "division_id"), "division_id").select("id", "law")


@query("capitulos_vacios", f"""WITH {MODEL} SELECT d.id, d.law, d.number FROM divisions d WHERE d.kind = 'capitulo'
AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.division_id = d.id) AND NOT EXISTS (SELECT 1 FROM articles a JOIN divisions s ON a.division_id = s.id WHERE s.parent_id = d.id)""")
def _empty_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, P9, over all articles."""
    return q.empty_chapters(load(spark, sf_dir))


@query("secciones_vacias", f"{_WITH} SELECT d.id FROM divisions d WHERE d.kind = 'seccion' AND d.id NOT IN (SELECT division_id FROM articles)")
def _empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    return c.divisions.where("kind = 'seccion'").join(c.articles.select(F.col("division_id").alias("id")), "id", "left_anti").select("id")


@query("esperado_y_real", f"""{_WITH}, e AS (SELECT d.kind, d.number, count(*) AS n FROM articles a JOIN divisions d ON d.id = a.division_id GROUP BY 1, 2),
r AS (SELECT d.kind, d.number, count(*) AS n FROM articles a JOIN divisions d ON d.id = a.division_id WHERE a.id % 23 <> 0 GROUP BY 1, 2)
SELECT coalesce(e.kind, r.kind) AS kind, coalesce(e.number, r.number) AS number, coalesce(e.n, 0) AS expected, coalesce(r.n, 0) AS actual, coalesce(e.n, 0) = coalesce(r.n, 0) AS ok FROM e FULL JOIN r ON e.kind = r.kind AND e.number = r.number""")
def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind and number, divisions of equal name summed; some articles taken away."""
    c = load(spark, sf_dir)
    own = c.articles.join(c.divisions.select(F.col("id").alias("division_id"), "kind", F.col("number").alias("d")), "division_id").select("id", c.divisions.kind, F.col("d").alias("number"))
    return q.reconcile_counts(own, own.where("id % 23 != 0"), ["kind", "number"])


@query("conjuntos_articulos", f"""{_WITH}, e AS (SELECT law, trim(regexp_replace(upper(replace(number, '-', ' ')), '\\s+', ' ', 'g')) AS key FROM articles WHERE id % 19 <> 0), r AS (SELECT law, trim(regexp_replace(upper(replace(number, '-', ' ')), '\\s+', ' ', 'g')) AS key FROM articles WHERE id % 17 <> 0)
SELECT coalesce(e.law, r.law) AS law, coalesce(e.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'extra' ELSE 'ok' END AS state FROM (SELECT DISTINCT * FROM e) e FULL JOIN (SELECT DISTINCT * FROM r) r ON e.law = r.law AND e.key = r.key""")
def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, Q9, J9, U4 under the loader's keys."""
    a = load(spark, sf_dir).articles.select("id", "law", numbering.load_key(F.col("number")).alias("key"))
    return q.reconcile(a.where("id % 19 != 0"), a.where("id % 17 != 0"), ["law", "key"])


@query("conjuntos_articulos_canonicos", f"""{_WITH}, k AS (SELECT id, law, regexp_replace(CASE WHEN id % 4 = 2 THEN replace(number, ' Bis', '-BIS') ELSE number END, '-BIS', ' Bis') AS key FROM articles)
SELECT coalesce(e.law, r.law) AS law, coalesce(e.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'extra' ELSE 'ok' END AS state
FROM (SELECT DISTINCT law, key FROM k WHERE id % 19 <> 0) e FULL JOIN (SELECT DISTINCT law, key FROM k WHERE id % 17 <> 0) r ON e.law = r.law AND e.key = r.key""")
def _canonical_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 under the validator's canonical numbers: `3-BIS` extracted is `3 Bis` expected."""
    a = load(spark, sf_dir).articles.select("id", "law", "number")
    key = lambda c: numbering.canonical(c).alias("key")
    expected = a.where("id % 19 != 0").select("law", key(F.col("number")))
    extracted = a.where("id % 17 != 0").select("law", key(F.when(F.col("id") % 4 == 2, F.replace("number", F.lit(" Bis"), F.lit("-BIS"))).otherwise(F.col("number"))))
    return q.reconcile(expected, extracted, ["law", "key"])


_INDEX = f"""{_WITH}, official AS (SELECT DISTINCT kind, number, name FROM divisions WHERE id % 7 <> 3 AND kind <> 'seccion' UNION ALL SELECT 'capitulo', '9' || CAST(r_regionkey AS VARCHAR) || '.1', r_name FROM region),
imported AS (SELECT kind, number, min(name) AS name FROM divisions WHERE id % 11 <> 4 AND kind <> 'seccion' GROUP BY 1, 2),
compared AS (SELECT coalesce(o.kind, i.kind) AS kind, coalesce(o.number, i.number) AS number, o.name AS official_name, i.name AS imported_name,
  CASE WHEN i.number IS NULL THEN 'faltante' WHEN o.number IS NOT NULL THEN 'ok' WHEN i.kind = 'capitulo' AND split_part(i.number, '.', 1) IN ('1','6','7','8','9','10') THEN 'virtual' ELSE 'extra' END AS state
  FROM official o FULL JOIN imported i ON o.kind = i.kind AND o.number = i.number)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir).divisions.where("kind != 'seccion'")
    added = table(spark, sf_dir, "region").select(F.lit("capitulo").alias("kind"), F.concat(F.lit("9"), F.col("r_regionkey").cast("string"), F.lit(".1")).alias("number"), F.col("r_name").alias("name"))
    official = d.where("id % 7 != 3").select("kind", "number", "name").distinct().unionByName(added)
    two_levels = F.split_part("number", F.lit("."), F.lit(1)).isin("1", "6", "7", "8", "9", "10")
    return q.index_comparison(official, d.where("id % 11 != 4"), (F.col("kind") == "capitulo") & two_levels)


@query("comparar_divisiones_indice", f"{_INDEX} SELECT * FROM compared")
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full outer join in place of three branches."""
    return _compared(spark, sf_dir)


@query("verificar_indice", f"""{_INDEX}, s AS (SELECT kind, count(DISTINCT CASE WHEN state IN ('ok','faltante') THEN number END) AS official, count(DISTINCT CASE WHEN state = 'ok' THEN number END) AS matched, count(DISTINCT CASE WHEN state = 'faltante' THEN number END) AS missing,
 count(DISTINCT CASE WHEN state = 'extra' THEN number END) AS extra, count(DISTINCT CASE WHEN state = 'virtual' THEN number END) AS virtual FROM compared GROUP BY 1) SELECT *, CASE WHEN official = 0 THEN 100.0 ELSE round(CAST(matched AS DOUBLE) / official * 100, 1) END::DOUBLE AS percent FROM s""")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary by kind as one aggregation."""
    return q.index_summary(_compared(spark, sf_dir))


@query("comparar_reglas_indice", f"""{_WITH} SELECT CAST(o.id AS BIGINT) AS id, o.number, CASE WHEN i.number IS NOT NULL THEN 'ok' ELSE 'faltante' END AS state FROM (SELECT id, number FROM articles WHERE kind = 'regla') o LEFT JOIN (SELECT DISTINCT number FROM articles WHERE kind = 'regla' AND id % 13 <> 0) i ON o.number = i.number""")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir).articles.where("kind = 'regla'").select("id", "number")
    have = a.where("id % 13 != 0").select("number").distinct().withColumn("h", F.lit(True))
    return a.join(have, "number", "left").select("id", "number", F.when(F.col("h"), "ok").otherwise("faltante").alias("state"))


@query("verificar_ley", """WITH d AS (SELECT DISTINCT doc_id // 100 AS division_id FROM documents), a AS (SELECT doc_id // 100 AS division_id, doc_id % 100 AS n, 'doc ' || CAST(doc_id AS VARCHAR) AS label FROM labels),
s AS (SELECT division_id, count(*) AS total, min(n) AS lo, max(n) AS hi, arg_min(label, n) AS first_label, arg_max(label, n) AS last_label, list(n) AS have FROM a GROUP BY 1),
m AS (SELECT *, hi - lo + 1 AS expected, list_filter(range(lo, hi + 1), lambda x: NOT list_contains(have, x)) AS gone FROM s),
p AS (SELECT d.division_id, coalesce(total, 0) AS total, first_label, last_label, CAST(coalesce(expected, 0) AS BIGINT) AS expected, CAST(coalesce(expected - total, 0) AS BIGINT) AS missing, CASE WHEN total IS NULL THEN 100.0::DOUBLE ELSE round(CAST(total AS DOUBLE) / expected * 100, 1) END AS percent, CASE WHEN len(gone) > 0 THEN array_to_string(list_sort(gone), ',') END AS missing_numbers FROM d LEFT JOIN m USING (division_id))
SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN percent >= 100 THEN 'ok' WHEN percent >= 80 THEN 'warning' ELSE 'error' END AS status FROM p""")
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as numbered articles of divisions of a hundred."""
    hundred = F.floor(F.col("doc_id") / 100).alias("division_id")
    divisions = table(spark, sf_dir, "documents").select(hundred).distinct()
    articles = table(spark, sf_dir, "labels").select(hundred, "doc_id")
    return q.numbering_gaps(divisions, articles, F.col("doc_id") % 100, F.concat(F.lit("doc "), F.col("doc_id").cast("string")))


_SUMS = "sums AS (SELECT law, article_id, substring(sha256(string_agg(content, chr(10) ORDER BY number)), 1, 16) AS checksum FROM paragraphs GROUP BY 1, 2)"


@query("checksums_articulos", f"{_WITH}, {_SUMS} SELECT * FROM sums")
def _checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, F24, F21."""
    return q.article_checksums(load(spark, sf_dir).paragraphs)


@query("cambios_checksum", f"""{_WITH}, {_SUMS}, was AS (SELECT article_id, CASE WHEN article_id % 31 = 0 THEN 'x' ELSE checksum END AS checksum FROM sums WHERE article_id % 37 <> 0), now AS (SELECT article_id, checksum FROM sums WHERE article_id % 41 <> 0)
SELECT coalesce(w.article_id, n.article_id) AS article_id, CASE WHEN w.checksum IS NULL THEN 'nuevo' WHEN n.checksum IS NULL THEN 'eliminado' ELSE 'modificado' END AS state FROM was w FULL JOIN now n ON w.article_id = n.article_id WHERE w.checksum IS DISTINCT FROM n.checksum""")
def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: against a baseline with some sums edited and some left out."""
    sums = q.article_checksums(load(spark, sf_dir).paragraphs).select("article_id", "checksum")
    was = sums.where("article_id % 37 != 0").withColumn("checksum", F.when(F.col("article_id") % 31 == 0, "x").otherwise(F.col("checksum")))
    return q.checksum_drift(was, sums.where("article_id % 41 != 0"), "article_id")


@query("sha_parrafos", f"{_WITH} SELECT law, article_id, number, sha256(content) AS checksum FROM paragraphs")
def _sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each paragraph's full checksum."""
    return load(spark, sf_dir).paragraphs.select("law", "article_id", "number", F.sha2("content", 256).alias("checksum"))


@query("validar_estructura", f"""{_WITH}, e AS (SELECT concat('L', chr(65 + r_regionkey)) AS code, unnest(['titulos', 'capitulos', 'secciones']) AS element, unnest([1, 5, 300]) AS expected FROM region),
n AS (SELECT law AS code, kind, count(*) AS actual FROM divisions GROUP BY 1, 2) SELECT e.code, e.element, CAST(e.expected AS BIGINT) AS expected, coalesce(n.actual, 0) AS actual, e.expected = coalesce(n.actual, 0) AS ok FROM e LEFT JOIN n ON n.code = e.code AND n.kind = rtrim(e.element, 's')""")
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sections never match, by the rule for plurals."""
    c = load(spark, sf_dir)
    return q.validate_structure(c, c.laws.select("code", F.lit('{"titulos": 1, "capitulos": 5, "secciones": 300}').alias("expected")))


@query("restricciones", f"""{_WITH}, b AS (SELECT id, CASE WHEN id % 29 = 0 THEN 'otro' ELSE kind END AS kind, law, number, CASE WHEN id % 43 = 0 THEN -1 ELSE division_id END AS division_id FROM articles)
SELECT 'division key' AS rule, (SELECT count(*) FROM (SELECT id FROM divisions GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'article key', (SELECT count(*) FROM (SELECT id FROM b GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'article number in law', (SELECT count(*) FROM (SELECT law, number FROM b GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'paragraph key', (SELECT count(*) FROM (SELECT law, article_id, number FROM paragraphs GROUP BY 1, 2, 3 HAVING count(*) > 1))
UNION ALL SELECT 'division law', (SELECT count(*) FROM divisions WHERE law NOT IN (SELECT code FROM laws))
UNION ALL SELECT 'division parent', (SELECT count(*) FROM divisions d WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM divisions p WHERE p.id = d.parent_id AND p.law = d.law))
UNION ALL SELECT 'article division', (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM divisions p WHERE p.id = b.division_id AND p.law = b.law))
UNION ALL SELECT 'paragraph article', (SELECT count(*) FROM paragraphs p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = p.article_id AND p.law = b.law))
UNION ALL SELECT 'paragraph parent', (SELECT count(*) FROM paragraphs p WHERE parent_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM paragraphs o WHERE o.law = p.law AND o.article_id = p.article_id AND o.number = p.parent_number))
UNION ALL SELECT 'article kind', (SELECT count(*) FROM b WHERE kind NOT IN ('articulo','regla','transitorio','ficha','criterio'))""")
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: keys, foreign keys and allowed values, with some rows falsified."""
    c = load(spark, sf_dir)
    bad = c.articles.withColumn("kind", F.when(F.col("id") % 29 == 0, "otro").otherwise(F.col("kind"))).withColumn("division_id", F.when(F.col("id") % 43 == 0, -1).otherwise(F.col("division_id")))
    return q.constraint_violations(Corpus(c.laws, c.divisions, bad, c.paragraphs))


@query("regresion", f"""{_WITH}, b AS (SELECT law, kind FROM articles WHERE id % 101 <> 0), n AS (SELECT law, CASE WHEN id % 103 = 0 THEN 'ficha' ELSE kind END AS kind FROM articles)
SELECT *, '-' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, '+' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM b)""")
def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14."""
    a = load(spark, sf_dir).articles
    return q.regression(a.where("id % 101 != 0").select("law", "kind"), a.select("law", F.when(F.col("id") % 103 == 0, "ficha").otherwise(F.col("kind")).alias("kind")))


@query("ultimo_articulo", f"{_WITH} SELECT law, id, number FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY position DESC, id DESC) AS r FROM articles) WHERE r = 1")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: each law's last article."""
    return q.previous_and_last(load(spark, sf_dir).articles)


@query("divisiones_no_permitidas", f"{_WITH} SELECT d.id, d.law, d.kind FROM divisions d JOIN laws l ON l.code = d.law WHERE NOT list_contains(string_split(l.allowed_divisions, ','), d.kind)")
def _forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported, not rejected."""
    return q.forbidden_kinds(load(spark, sf_dir))


@query("integridad_reglas", """WITH r AS (SELECT CAST(doc_id % 7 AS VARCHAR) || '.' || CAST(doc_id % 3 AS VARCHAR) || '.' || CAST(doc_id AS VARCHAR) AS number, CAST(doc_id % 7 AS VARCHAR) || '.' || CAST(doc_id % 3 AS VARCHAR) AS ch FROM documents), c AS (SELECT CAST(r_regionkey AS VARCHAR) || '.' || CAST(n AS VARCHAR) AS number FROM region, (SELECT unnest(range(5)) AS n))
SELECT (SELECT count(*) FROM r) AS rules, (SELECT count(*) FROM r WHERE ch NOT IN (SELECT number FROM c)) AS orphans, (SELECT count(*) FROM c WHERE number NOT IN (SELECT ch FROM r)) AS empty_chapters""")
def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11."""
    i = F.col("doc_id")
    rules = table(spark, sf_dir, "documents").select(F.concat_ws(".", (i % 7).cast("string"), (i % 3).cast("string"), i.cast("string")).alias("number"))
    chapters = table(spark, sf_dir, "region").select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"), "r_regionkey").select(F.concat_ws(".", F.col("r_regionkey").cast("string"), F.col("n").cast("string")).alias("number"))
    return q.rule_integrity(rules, chapters)


_PLACES = """pl AS (SELECT a.id, a.law, t.number AS title, c.number AS chapter, CASE WHEN d.kind = 'seccion' THEN d.number END AS section, a.number
  FROM articles a JOIN divisions d ON d.id = a.division_id JOIN divisions c ON c.id = CASE WHEN d.kind = 'seccion' THEN d.parent_id ELSE d.id END JOIN divisions t ON t.id = c.parent_id)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the numbers of their title, chapter and section."""
    c = load(spark, sf_dir)
    d = c.divisions.select("id", "parent_id", "kind", "number")
    of = lambda name: d.select(F.col("id").alias(f"{name}_id"), F.col("parent_id").alias(f"{name}_up"), F.col("kind").alias(f"{name}_kind"), F.col("number").alias(name))
    own = c.articles.select("id", "law", "number", F.col("division_id").alias("own_id")).join(of("own"), "own_id")
    in_section = F.col("own_kind") == "seccion"
    own = own.withColumn("chapter_id", F.when(in_section, F.col("own_up")).otherwise(F.col("own_id"))).join(of("chapter"), "chapter_id")
    own = own.withColumn("title_id", F.col("chapter_up")).join(of("title"), "title_id")
    return own.select("id", "law", "title", "chapter", F.when(in_section, F.col("own")).alias("section"), "number")


@query("articulos_por_capitulo", f"""{_WITH}, {_PLACES}, own AS (SELECT * FROM pl WHERE section IS NULL), e AS (SELECT DISTINCT law, title, chapter, number FROM own WHERE id % 190 <> 0), a AS (SELECT DISTINCT law, title, CASE WHEN id % 70 = 0 THEN 'X' ELSE chapter END AS chapter, number FROM own WHERE id % 170 <> 0),
b AS (SELECT coalesce(e.law, a.law) AS law, coalesce(e.title, a.title) AS title, coalesce(e.chapter, a.chapter) AS chapter, e.law IS NOT NULL AS in_e, a.law IS NOT NULL AS in_a FROM e FULL JOIN a ON e.law = a.law AND e.title = a.title AND e.chapter = a.chapter AND e.number = a.number),
s AS (SELECT law, title, chapter, count(*) FILTER (in_e) AS expected, count(*) FILTER (in_a) AS actual, count(*) FILTER (in_e AND NOT in_a) AS missing, count(*) FILTER (in_a AND NOT in_e) AS extra FROM b GROUP BY 1, 2, 3)
SELECT *, CASE WHEN expected = 0 THEN 'only_stored' WHEN missing = 0 AND extra = 0 THEN 'ok' ELSE 'different' END AS state FROM s""")
def _chapter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: articles by title and chapter, some of them missing and some stored under another chapter."""
    own = _places(spark, sf_dir).where("section is null")
    moved = own.where("id % 170 <> 0").withColumn("chapter", F.when(F.col("id") % 70 == 0, "X").otherwise(F.col("chapter")))
    return q.chapter_sets(own.where("id % 190 <> 0"), moved)


@query("extraccion_por_lugar", f"""{_WITH}, {_PLACES}, e AS (SELECT DISTINCT law, title, chapter, section, number FROM pl WHERE id % 19 <> 0), x AS (SELECT DISTINCT law, CASE WHEN id % 13 = 0 THEN number || '-Z' ELSE number END AS number FROM pl WHERE id % 17 <> 0)
SELECT law, title, chapter, section, number, 'missing' AS state FROM e WHERE (law, number) NOT IN (SELECT law, number FROM x)
UNION ALL SELECT law, '?', NULL, NULL, number, 'extra' FROM x WHERE (law, number) NOT IN (SELECT law, number FROM e)""")
def _place_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: an extraction against the map, by title, chapter and section; numbers in another writing are the same."""
    own = _places(spark, sf_dir)
    written = F.when(F.col("id") % 13 == 0, F.concat("number", F.lit("-Z"))).when(F.col("id") % 4 == 2, F.replace("number", F.lit(" Bis"), F.lit("-BIS"))).otherwise(F.col("number"))
    return q.place_differences(own.where("id % 19 <> 0"), own.where("id % 17 <> 0").select("law", written.alias("number")))


@query("ultimo_articulo_con_vista", f"""{_WITH}, l AS (SELECT law, id, number FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY position DESC, id DESC) AS r FROM articles) WHERE r = 1)
SELECT l.law, l.id, l.number, count(p.article_id) AS paragraphs, coalesce(substring(arg_max(p.content, p.number), 1, 80), 'N/A') AS preview FROM l LEFT JOIN paragraphs p ON p.article_id = l.id GROUP BY 1, 2, 3""")
def _last_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: each law's last article, how many paragraphs it has, and how the last one begins."""
    c = load(spark, sf_dir)
    return q.last_articles(c.articles, c.paragraphs)
