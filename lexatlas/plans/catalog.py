"""Queries over the corpus model: catalogue views, hierarchy, navigation and the API's table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.operators import hierarchy, views
from lexatlas.plans.registry import query
from lexatlas.sources.corpus import MODEL, load

_WITH = f"WITH RECURSIVE {MODEL}"
_CLOSURE = "closure AS (SELECT id, id AS ancestor, 0 AS distance, parent_id AS up FROM divisions UNION ALL SELECT c.id, d.id, c.distance + 1, d.parent_id FROM closure c JOIN divisions d ON c.up = d.id)"
_PATH_TEXT = "kind || ' ' || number || coalesce(' - ' || name, '')"
_LEVEL = "CAST(CASE kind WHEN 'libro' THEN 0 WHEN 'titulo' THEN 1 WHEN 'capitulo' THEN 2 WHEN 'seccion' THEN 3 ELSE 4 END AS INTEGER)"
_STRUCTURE = f"""
tot AS (SELECT c.ancestor AS id, count(*) AS total FROM closure c JOIN articles a ON a.division_id = c.id GROUP BY 1),
fl AS (SELECT division_id AS id, arg_min(number, position) AS first, arg_max(number, position) AS last FROM articles GROUP BY 1),
structure AS (SELECT d.id, d.kind, d.number, d.name, {_PATH_TEXT} AS path_text, {_LEVEL} AS level, coalesce(tot.total, 0) AS total, fl.first, fl.last, d.parent_id, d.position
              FROM divisions d LEFT JOIN tot ON d.id = tot.id LEFT JOIN fl ON d.id = fl.id)"""


@query("estructura_ley", f"{_WITH}, {_CLOSURE}, {_STRUCTURE} SELECT * FROM structure")
def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every law's structure."""
    return hierarchy.structure(load(spark, sf_dir))


@query("divisiones_hijas", f"{_WITH}, {_CLOSURE}, {_STRUCTURE} SELECT id, kind, number, name, path_text, level, total, first, last, position FROM structure WHERE parent_id = 1003")
def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    return hierarchy.children(load(spark, sf_dir), 1003)


@query("rango_heredado", f"""{_WITH}, {_CLOSURE}
SELECT c.ancestor AS id, arg_min(a.number, (a.position, a.number)) AS first, arg_max(a.number, (a.position, a.number)) AS last
FROM closure c JOIN articles a ON a.division_id = c.id GROUP BY 1""")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return hierarchy.inherited_range(load(spark, sf_dir))


@query("divisiones_articulo", f"{_WITH}, {_CLOSURE} SELECT CAST(c.distance AS INTEGER) AS distance, d.id, d.kind, d.number, d.name, d.kind || ' ' || d.number || coalesce(' - ' || d.name, '') AS path_text FROM closure c JOIN articles a ON a.division_id = c.id JOIN divisions d ON d.id = c.ancestor WHERE a.id = 3")
def _breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3."""
    return hierarchy.breadcrumb(load(spark, sf_dir), 3)


_MOVED = """moved AS (SELECT id, CASE WHEN kind = 'seccion' AND id % 7 = 0 THEN 1000 + id % 25 WHEN id IN (1003, 1007) THEN 1000 WHEN id = 1000 THEN 4 ELSE parent_id END AS parent_id, kind, number, name FROM divisions),
after_move AS (SELECT id, id AS ancestor, 0 AS distance, parent_id AS up FROM moved UNION ALL SELECT c.id, d.id, c.distance + 1, d.parent_id FROM after_move c JOIN moved d ON c.up = d.id)"""


@query("rutas_movidas", f"""{_WITH}, {_MOVED} SELECT c.id, string_agg(CAST(c.ancestor AS VARCHAR), ',' ORDER BY c.distance DESC) AS path_ids,
       string_agg(d.kind || ' ' || d.number || coalesce(' - ' || d.name, ''), ' > ' ORDER BY c.distance DESC) AS path_text, CAST(max(c.distance) AS INTEGER) AS depth FROM after_move c JOIN moved d ON d.id = c.ancestor GROUP BY 1""")
def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored paths kept up to date as sections, chapters and a chapter they moved to move on."""
    d = load(spark, sf_dir).divisions
    to = F.when((F.col("kind") == "seccion") & (F.col("id") % 7 == 0), 1000 + F.col("id") % 25).when(F.col("id").isin(1003, 1007), 1000).when(F.col("id") == 1000, 4)
    moves = d.select("id", to.cast("long").alias("parent_id")).where("parent_id is not null")
    whole, _ = hierarchy.move_subtrees(hierarchy.stored_paths(d), moves)
    return hierarchy.shown_paths(whole).withColumn("path_ids", F.array_join("path_ids", ","))


@query("rutas_divisiones", f"""{_WITH}, {_CLOSURE}
SELECT c.id, string_agg(CAST(c.ancestor AS VARCHAR), ',' ORDER BY c.distance DESC) AS path_ids,
       string_agg(d.kind || ' ' || d.number || coalesce(' - ' || d.name, ''), ' > ' ORDER BY c.distance DESC) AS path_text, CAST(max(c.distance) AS INTEGER) AS depth
FROM closure c JOIN divisions d ON d.id = c.ancestor GROUP BY 1""")
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialised paths."""
    return hierarchy.paths(load(spark, sf_dir).divisions).withColumn("path_ids", F.array_join("path_ids", ","))


@query("contenido_en_ruta", f"{_WITH}, {_CLOSURE} SELECT id FROM closure WHERE ancestor = 1003")
def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: divisions whose path holds another, found from there down."""
    d = load(spark, sf_dir).divisions
    return hierarchy.descendants(d, d.where("id = 1003")).select("id")


@query("division_por_path", f"""{_WITH}, {_CLOSURE}
SELECT s.id, s.kind, s.number, s.name, r.kind || ' ' || r.number || coalesce(' - ' || r.name, '') || ' > ' || c.kind || ' ' || c.number || coalesce(' - ' || c.name, '') || ' > ' || s.kind || ' ' || s.number || coalesce(' - ' || s.name, '') AS path_text,
       (SELECT count(*) FROM articles a WHERE a.division_id = s.id) AS total
FROM divisions r JOIN divisions c ON c.parent_id = r.id JOIN divisions s ON s.parent_id = c.id
WHERE r.parent_id IS NULL AND lower(c.kind) = 'capitulo' AND s.number = '6' AND lower(s.kind) = 'seccion' AND c.number = (SELECT number FROM divisions WHERE id = (SELECT parent_id FROM divisions WHERE id = 1000006))
  AND r.number = (SELECT number FROM divisions WHERE id = (SELECT p.parent_id FROM divisions s2 JOIN divisions p ON s2.parent_id = p.id WHERE s2.id = 1000006))""")
def _by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of section 6, resolved; letters' case of kinds is mixed on purpose."""
    corpus = load(spark, sf_dir)
    up = hierarchy.ancestors(corpus.divisions, corpus.divisions.where("id = 1000006")).select(F.col("ancestor").alias("id"), "distance")
    numbers = [r["number"] for r in corpus.divisions.join(up, "id").orderBy(F.desc("distance")).select("number").take(3)]
    steps = [x for kind, number in zip(("Titulo", "CAPITULO", "seccion"), numbers) for x in (kind, number)]
    return hierarchy.resolve_path(corpus, steps)


@query("padres_ilegales", f"""{_WITH}
SELECT d.id, d.kind, coalesce(p.kind, '') AS parent_kind
FROM (SELECT id, CASE WHEN id % 50 = 7 THEN 'libro' ELSE kind END AS kind, parent_id FROM divisions) d
LEFT JOIN (SELECT id, CASE WHEN id % 50 = 7 THEN 'libro' ELSE kind END AS kind FROM divisions) p ON d.parent_id = p.id
WHERE (d.kind, coalesce(p.kind, '')) NOT IN (('titulo','libro'),('capitulo','titulo'),('capitulo','libro'),('seccion','capitulo'),('subseccion','seccion'),('libro',''),('titulo',''),('capitulo',''))""")
def _illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With some kinds falsified."""
    d = load(spark, sf_dir).divisions
    return hierarchy.illegal_parents(d.withColumn("kind", F.when(F.col("id") % 50 == 7, "libro").otherwise(F.col("kind"))))


@query("fracciones_articulo", f"""{_WITH}, tree AS (
  SELECT law, article_id, number, parent_number, kind, identifier, content, 0 AS depth FROM paragraphs WHERE parent_number IS NULL
  UNION ALL SELECT p.law, p.article_id, p.number, p.parent_number, p.kind, p.identifier, p.content, t.depth + 1 FROM paragraphs p JOIN tree t ON p.law = t.law AND p.article_id = t.article_id AND p.parent_number = t.number)
SELECT law, article_id, number, parent_number, kind, identifier, content, CAST(depth AS INTEGER) AS depth, kind = 'texto' AND depth > 0 AS continues FROM tree""")
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article's paragraph tree."""
    return hierarchy.paragraph_tree(load(spark, sf_dir).paragraphs)


@query("tipos_mostrados", f"{_WITH} SELECT id, CASE kind WHEN 'titulo' THEN 'Título' WHEN 'capitulo' THEN 'Capítulo' WHEN 'seccion' THEN 'Sección' ELSE kind END AS shown, number FROM divisions")
def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    return hierarchy.shown_divisions(load(spark, sf_dir).divisions)


@query("v_catalogo", f"{_WITH} SELECT l.code, l.name, l.short_name, l.kind, l.base_law, (SELECT count(*) FROM articles a WHERE a.law = l.code) AS total_articles FROM laws l")
def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, A2, S1."""
    return views.laws_view(load(spark, sf_dir))


@query("v_divisiones", f"{_WITH}, n AS (SELECT division_id, law, count(*) AS n FROM articles GROUP BY 1, 2) SELECT d.id, d.law, d.parent_id, d.kind, d.number, d.position, d.name, coalesce(n.n, 0) AS total_articles FROM divisions d LEFT JOIN n ON n.division_id = d.id AND n.law = d.law")
def _divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, J2."""
    return views.divisions_view(load(spark, sf_dir))


_BASE = "CAST(coalesce(TRY_CAST(regexp_extract(a.number, '^([0-9]+)', 1) AS INTEGER), 0) AS INTEGER)"


@query("v_articulos", f"""{_WITH}, t AS (SELECT law, article_id, string_agg(content, chr(10) || chr(10) ORDER BY number) AS content FROM paragraphs WHERE parent_number IS NULL AND kind = 'texto' GROUP BY 1, 2)
SELECT a.id, a.law, l.name AS law_name, a.number, {_BASE} AS base, a.title, a.kind, d.kind || ' ' || d.number AS place, t.content, a.kind = 'transitorio' AS is_transitory, a.position
FROM articles a JOIN laws l ON l.code = a.law LEFT JOIN divisions d ON d.id = a.division_id AND d.law = a.law LEFT JOIN t ON t.law = a.law AND t.article_id = a.id""")
def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, J1, J3, A1, F1, F17."""
    return views.articles_view(load(spark, sf_dir))


_FULL = f"""{_WITH}, t AS (SELECT law, article_id, string_agg(content, chr(10) || chr(10) ORDER BY number) AS content FROM paragraphs GROUP BY 1, 2),
full_articles AS (SELECT a.id, a.law, l.name AS law_name, a.number, {_BASE} AS base, a.title, a.kind, d.kind || ' ' || d.number AS place, t.content, a.kind = 'transitorio' AS is_transitory, a.reforms, a.refs, CAST(NULL AS VARCHAR) AS incoming, CAST(NULL AS VARCHAR) AS outgoing, a.position
FROM articles a JOIN laws l ON l.code = a.law LEFT JOIN divisions d ON d.id = a.division_id AND d.law = a.law LEFT JOIN t ON t.law = a.law AND t.article_id = a.id)"""


@query("v_articulos_completos", f"{_FULL} SELECT * FROM full_articles")
def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    return views.full_articles(load(spark, sf_dir))


@query("articulo", f"{_FULL} SELECT * FROM full_articles WHERE id = 3")
def _article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.article(load(spark, sf_dir), 3)


@query("articulo_por_ley", f"{_FULL} SELECT * FROM full_articles WHERE law = 'LB' AND number = (SELECT min(number) FROM articles WHERE law = 'LB')")
def _by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = load(spark, sf_dir)
    return views.article_by_number(corpus, "LB", corpus.of("LB").articles.agg(F.min("number")).first()[0])


@query("articulos_division", f"""{_WITH}, t AS (SELECT law, article_id, string_agg(content, chr(10) || chr(10) ORDER BY number) AS content FROM paragraphs WHERE parent_number IS NULL AND kind = 'texto' GROUP BY 1, 2)
SELECT a.id, a.number, a.title, a.kind, t.content, a.position FROM articles a LEFT JOIN t ON t.law = a.law AND t.article_id = a.id WHERE a.division_id = 1003""")
def _in_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, O2."""
    return views.division_articles(load(spark, sf_dir), 1003)


@query("articulos_subarbol", f"{_WITH}, {_CLOSURE} SELECT a.id, a.number, a.position, CASE WHEN l.kind = 'resolucion' THEN CAST(regexp_extract(a.number, '([0-9]+)$', 1) AS VARCHAR) ELSE CAST(a.position AS VARCHAR) END AS order_key FROM closure c JOIN articles a ON a.division_id = c.id JOIN laws l ON l.code = a.law WHERE c.ancestor = 1003")
def _below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older articulos_division (subtree), with the conditional order key of O6."""
    corpus = load(spark, sf_dir)
    own = hierarchy.descendants(corpus.divisions, corpus.divisions.where("id = 1003")).select(F.col("id").alias("division_id"))
    laws = corpus.laws.select(F.col("code").alias("law"), F.col("kind").alias("law_kind"))
    key = F.when(F.col("law_kind") == "resolucion", F.regexp_extract("number", r"(\d+)$", 1)).otherwise(F.col("position").cast("string"))
    return corpus.articles.join(own, "division_id").join(laws, "law").select("id", "number", "position", key.alias("order_key"))


@query("stats", f"{_WITH} SELECT l.code, l.name, l.kind, (SELECT count(*) FROM divisions d WHERE d.law = l.code) AS divisions, (SELECT count(*) FROM articles a WHERE a.law = l.code) AS articles, (SELECT count(*) FROM articles a WHERE a.law = l.code AND a.kind = 'transitorio') AS transitory FROM laws l")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3."""
    return views.stats(load(spark, sf_dir))


@query("stats_v1", f"{_WITH} SELECT l.code, l.name, (SELECT count(*) FROM divisions d WHERE d.law = l.code) AS divisions, (SELECT count(*) FROM articles a WHERE a.law = l.code) AS articles, (SELECT count(*) FROM paragraphs p WHERE p.law = l.code) AS paragraphs FROM laws l")
def _stats_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stats_with_paragraphs(load(spark, sf_dir))


@query("v_estadisticas", f"{_WITH} SELECT (SELECT count(*) FROM laws) AS laws, (SELECT count(*) FROM divisions) AS divisions, (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM paragraphs) AS paragraphs")
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A17."""
    return views.totals(load(spark, sf_dir))


@query("navegar", f"{_WITH} SELECT a.id, p.id AS previous_id, p.number AS previous_number, n.id AS next_id, n.number AS next_number FROM articles a LEFT JOIN articles p ON p.law = a.law AND p.position = a.position - 1 LEFT JOIN articles n ON n.law = a.law AND n.position = a.position + 1")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 for every article: exact positions, so gaps give null."""
    return views.neighbours(load(spark, sf_dir).articles)


@query("navegar_desconocido", "SELECT CAST(NULL AS BIGINT) AS previous_id, CAST(NULL AS VARCHAR) AS previous_number, CAST(NULL AS BIGINT) AS next_id, CAST(NULL AS VARCHAR) AS next_number")
def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown id gives one row of nulls."""
    return views.navigate(load(spark, sf_dir).articles, -5)


@query("navegar_articulo", f"{_WITH} SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM articles WINDOW w AS (PARTITION BY law ORDER BY position, id)")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return views.nearest(load(spark, sf_dir).articles)


@query("sugerencias", f"{_WITH} SELECT DISTINCT number AS term, CAST(1 AS INTEGER) AS frequency FROM articles WHERE number ILIKE '12%' ORDER BY term LIMIT 10")
def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9, O7, P7."""
    return views.suggestions(load(spark, sf_dir).articles, "12")


@query("filtro_lista", f"{_WITH} SELECT id, law, kind FROM articles WHERE law IN ('LB', 'LD') AND kind IN ('regla')")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional comma-separated filters."""
    return load(spark, sf_dir).articles.where(views.in_list("law", "LB,LD") & views.in_list("kind", "regla") & views.in_list("number", None)).select("id", "law", "kind")


@query("lectura_rest", f"{_WITH} SELECT id, law, number FROM articles WHERE law = 'LC' AND position > 5 AND number ILIKE '%a%' ORDER BY id LIMIT 20 OFFSET 3")
def _rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gateway's filters, order, limit and offset."""
    return views.rest_scan(load(spark, sf_dir).articles, {"law": "eq.LC", "position": "gt.5", "number": "ilike.*a*", "order": "id", "limit": "20", "offset": "3", "select": "id,law,number"})


@query("v_referencias", f"""{_WITH}
SELECT o.id AS origin, ol.name AS origin_law, d.id AS target, dl.name AS target_law, 'cita' AS edge_kind
FROM lineitem e JOIN articles o ON e.l_orderkey = o.id JOIN articles d ON d.id = e.l_partkey JOIN laws ol ON ol.code = o.law JOIN laws dl ON dl.code = d.law GROUP BY ALL""")
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge list of references (line items as edges from an order to the order numbered as the part)."""
    from lexatlas.operators.references import edge_view
    from lexatlas.sources.workspace import table

    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_partkey").alias("target"), F.lit("cita").alias("edge_kind"))
    return edge_view(load(spark, sf_dir), edges)


@query("vecinos_articulo", f"""{_WITH}, e AS (SELECT DISTINCT o.id AS origin, d.id AS target FROM lineitem e JOIN articles o ON e.l_orderkey = o.id JOIN articles d ON d.id = e.l_partkey)
SELECT a.id, (SELECT string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) FROM e WHERE origin = a.id) AS outgoing, (SELECT string_agg(CAST(origin AS VARCHAR), ',' ORDER BY origin) FROM e WHERE target = a.id) AS incoming FROM articles a""")
def _in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing and incoming references of each article."""
    from lexatlas.operators.references import in_and_out
    from lexatlas.sources.workspace import table

    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_partkey").alias("target"))
    out = in_and_out(load(spark, sf_dir), edges)
    ids = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: x["id"]), ",")).alias(c)
    return out.select("id", ids("outgoing"), ids("incoming"))


@query("division_por_tipo_numero", f"{_WITH} SELECT d.id, d.kind, d.number, d.name, (SELECT count(*) FROM articles a WHERE a.division_id = d.id) AS total FROM divisions d WHERE d.law = 'LB' AND d.kind = 'capitulo' AND d.number = (SELECT min(number) FROM divisions WHERE law = 'LB' AND kind = 'capitulo')")
def _kind_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir).of("LB")
    first = own.divisions.where("kind = 'capitulo'").agg(F.min("number")).first()[0]
    return views.divisions_view(own).where((F.col("kind") == "capitulo") & (F.col("number") == first)).select("id", "kind", "number", "name", F.col("total_articles").alias("total"))


@query("primero_por_clave", f"{_WITH} SELECT kind, number, min(id) AS id FROM divisions GROUP BY 1, 2")
def _distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One division for each kind and number, the smallest id."""
    w = Window.partitionBy("kind", "number").orderBy("id")
    return load(spark, sf_dir).divisions.withColumn("r", F.row_number().over(w)).where("r = 1").select("kind", "number", "id")


@query("claves_orden", f"""{_WITH} SELECT id, coalesce(TRY_CAST(regexp_extract(number, '^([0-9]+)', 1) AS INTEGER), 999999) AS article_first,
 array_to_string(list_transform(string_split(number, '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER), 0)), '.') AS dotted, TRY_CAST(string_split(number, '.')[-1] AS INTEGER) AS last_number,
 trim(regexp_replace(upper(replace(number, '-', ' ')), '\\s+', ' ', 'g')) AS load_key FROM articles""")
def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys and normal forms of numbers."""
    from lexatlas.functions import numbering as n

    c = F.col("number")
    return load(spark, sf_dir).articles.select("id", n.article_key(c)["first"].alias("article_first"), F.array_join(n.dotted_key(c).cast("array<string>"), ".").alias("dotted"), n.last_number(c).alias("last_number"), n.load_key(c).alias("load_key"))


@query("estructura_anterior", f"""{_WITH}, {_CLOSURE}, p AS (SELECT c.id, string_agg({_PATH_TEXT}, ' > ' ORDER BY c.distance DESC) AS path_text FROM closure c JOIN divisions d ON d.id = c.ancestor GROUP BY 1),
n AS (SELECT c.ancestor AS id, count(*) AS total FROM closure c JOIN articles a ON a.division_id = c.id GROUP BY 1), m AS (SELECT division_id AS id, min(number) AS first FROM articles GROUP BY 1)
SELECT d.id, d.kind, d.number, d.name, p.path_text, {_LEVEL} AS level, coalesce(n.total, 0) AS total, m.first FROM divisions d JOIN p ON p.id = d.id LEFT JOIN n ON n.id = d.id LEFT JOIN m ON m.id = d.id""".replace("string_agg(kind || ' ' || number || coalesce(' - ' || name, '')", "string_agg(d.kind || ' ' || d.number || coalesce(' - ' || d.name, '')").replace("CASE kind", "CASE d.kind"))
def _older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """api.estructura of the older form."""
    return hierarchy.older_structure(load(spark, sf_dir))


@query("articulo_con_referencias", f"""{_FULL}, e AS (SELECT DISTINCT l_orderkey AS origin, l_partkey AS target, 'cita' AS tipo FROM lineitem),
o AS (SELECT CAST(to_json(list({{'id': a.id, 'ley': a.law, 'numero_raw': a.number, 'tipo': e.tipo}} ORDER BY a.id)) AS VARCHAR) AS j FROM e JOIN articles a ON a.id = e.target WHERE e.origin = 3),
i AS (SELECT CAST(to_json(list({{'id': a.id, 'ley': a.law, 'numero_raw': a.number, 'tipo': e.tipo}} ORDER BY a.id)) AS VARCHAR) AS j FROM e JOIN articles a ON a.id = e.origin WHERE e.target = 3)
SELECT f.* EXCLUDE (incoming, outgoing), o.j AS outgoing, i.j AS incoming FROM full_articles f, o, i WHERE f.id = 3""")
def _with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obtener_articulo: with its references both ways as JSON."""
    from lexatlas.sources.workspace import table

    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_partkey").alias("target"), F.lit("cita").alias("edge_kind")).distinct()
    return views.article_with_references(load(spark, sf_dir), edges, 3)


@query("articulos_por_ley", f"{_FULL} SELECT id, number, base, place, substring(content, 1, 300) AS preview, is_transitory, position FROM full_articles WHERE law = 'LB' ORDER BY position, id LIMIT 100 OFFSET 7")
def _of_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articulos_por_ley: previews of 300 characters."""
    return views.law_articles(load(spark, sf_dir), "LB", offset=7)
