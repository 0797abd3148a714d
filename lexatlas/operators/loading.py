"""Loading: nested documents to tables, upserts, per-law replacement, checked inserts, JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions.numbering import load_key
from lexatlas.operators.laws import last_of_keys
from lexatlas.sources.ranking import numbered

_SECTION = "struct<nombre:string,pagina:int,articulos:array<string>>"
_CHAPTER = f"struct<nombre:string,pagina:int,articulos:array<string>,secciones:map<string,{_SECTION}>>"
#: A structure map: titles, chapters and sections are keys of nested objects, in the order of the document.
MAP_SCHEMA = f"struct<ley:string,fuente:string,metodo:string,notas:string,estadisticas:map<string,int>,titulos:map<string,struct<nombre:string,pagina:int,capitulos:map<string,{_CHAPTER}>>>>"
_PARAGRAPH = "struct<numero:int,tipo:string,identificador:string,contenido:string,padre_numero:int,x_id:int,x_texto:int,referencias:array<string>>"
CONTENT_SCHEMA = f"ley string, tipo_contenido string, ultima_reforma_dof string, articulos array<struct<numero:string,tipo:string,orden:int,pagina:int,nombre:string,division:string,referencias:string,parrafos:array<{_PARAGRAPH}>>>"


def read_maps(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Structure maps, one document a file, or one a line. Of repeated keys the last counts."""
    docs = spark.read.text(path, wholetext=not lines).select(F.from_json("value", MAP_SCHEMA).alias("m")).select("m.*")
    once = lambda m: F.when(F.col(m).isNotNull() if isinstance(m, str) else m.isNotNull(), last_of_keys(F.map_entries(m)))  # noqa: E731  (from_json keeps all of repeated keys)
    chapter = lambda c: c.withField("secciones", once(c["secciones"]))
    title = lambda t: t.withField("capitulos", F.transform_values(once(t["capitulos"]), lambda _, c: chapter(c)))
    return docs.withColumn("titulos", F.transform_values(once("titulos"), lambda _, t: title(t)))


def read_content(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Content documents, one a file, or one a line, under an explicit schema; a missing reform date raises."""
    docs = spark.read.schema(CONTENT_SCHEMA).json(path, multiLine=not lines)
    date = F.coalesce(F.col("ultima_reforma_dof").try_cast("date"), F.raise_error(F.concat(F.lit("no valid ultima_reforma_dof in "), F.coalesce("ley", F.lit("?")))).cast("date"))
    return docs.withColumn("ultima_reforma_dof", date)


def map_entries(maps: DataFrame) -> DataFrame:
    """(law, title, chapter, section, article, place) of every article that a structure map lists."""
    t = maps.select(F.col("ley").alias("law"), F.posexplode("titulos").alias("tp", "title", "t"))
    c = t.select("law", "tp", "title", F.posexplode_outer("t.capitulos").alias("cp", "chapter", "c"))
    own = c.select("law", "tp", "title", "cp", "chapter", F.lit(None).cast("int").alias("sp"), F.lit(None).cast("string").alias("section"), F.posexplode("c.articulos").alias("ap", "article"))
    s = c.select("law", "tp", "title", "cp", "chapter", F.posexplode("c.secciones").alias("sp", "section", "s"))
    below = s.select("law", "tp", "title", "cp", "chapter", "sp", "section", F.posexplode("s.articulos").alias("ap", "article"))
    return own.unionByName(below).select("law", "title", "chapter", "section", "article", F.struct("tp", "cp", "sp", "ap").alias("place"))


def preorder(maps: DataFrame) -> DataFrame:
    """Divisions of structure maps in document order: law, orden (from 1), kind, number, name, parent_orden."""
    t = maps.select(F.col("ley").alias("law"), F.posexplode("titulos").alias("tp", "title", "t"))
    c = t.select("law", "tp", F.posexplode("t.capitulos").alias("cp", "chapter", "c"))
    s = c.select("law", "tp", "cp", F.posexplode("c.secciones").alias("sp", "section", "s"))
    none = F.lit(None).cast("int")
    rows = t.select("law", "tp", none.alias("cp"), none.alias("sp"), F.lit("titulo").alias("kind"), F.col("title").alias("number"), F.col("t.nombre").alias("name"))
    rows = rows.unionByName(c.select("law", "tp", "cp", none.alias("sp"), F.lit("capitulo").alias("kind"), F.col("chapter").alias("number"), F.col("c.nombre").alias("name")))
    rows = rows.unionByName(s.select("law", "tp", "cp", "sp", F.lit("seccion").alias("kind"), F.col("section").alias("number"), F.col("s.nombre").alias("name")))
    placed = numbered(rows, ["law"], ["tp", "cp", "sp"], "orden").withColumn("orden", F.col("orden").cast("int"))
    parents = placed.where("kind <> 'seccion'").select(F.col("law").alias("_law"), F.col("tp").alias("_tp"), F.col("cp").alias("_cp"), F.col("orden").alias("parent_orden"))
    above = F.when(F.col("sp").isNotNull(), F.col("cp"))
    joined = placed.withColumn("_above", above).join(parents, F.col("law").eqNullSafe(F.col("_law")) & (F.col("tp") == F.col("_tp")) & F.col("_above").eqNullSafe(F.col("_cp")), "left")
    return joined.select("law", "orden", "kind", "number", "name", F.when(F.col("kind") != "titulo", F.col("parent_orden")).alias("parent_orden"))


def map_statistics(maps: DataFrame) -> DataFrame:
    """Per law: titles, chapters, sections and articles listed."""
    d = preorder(maps).groupBy("law").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("titulo", "titles"), ("capitulo", "chapters"), ("seccion", "sections"))])
    return d.join(map_entries(maps).groupBy("law").agg(F.count("*").alias("articles")), "law", "left")


def article_places(maps: DataFrame) -> DataFrame:
    """(law, key, title, chapter, section): where each article belongs under the loader's key; the last of repeats."""
    own = map_entries(maps).withColumn("key", load_key(F.col("article")))
    return own.groupBy("law", "key").agg(F.max_by(F.struct("title", "chapter", "section"), "place").alias("p")).select("law", "key", "p.*")


def content_paragraphs(content: DataFrame) -> DataFrame:
    """(law, article, orden, number, kind, identifier, content, parent_number) of content documents."""
    a = content.select(F.col("ley").alias("law"), F.inline("articulos"))
    p = a.select("law", F.col("numero").alias("article"), F.col("orden").alias("article_orden"), F.explode("parrafos").alias("p"))
    return p.select("law", "article", "article_orden", F.col("p.numero").alias("number"), F.col("p.tipo").alias("kind"), F.col("p.identificador").alias("identifier"), F.col("p.contenido").alias("content"), F.col("p.padre_numero").alias("parent_number"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """The table after an upsert: new keys are inserted whole, known ones change in the updated columns only."""
    i = incoming.select(*[F.col(c).alias(f"_{c}") for c in current.columns])
    both = current.withColumn("_old", F.lit(True)).join(i, F.col(key) == F.col(f"_{key}"), "full_outer")
    new, known = F.col("_old").isNull(), F.col(f"_{key}").isNotNull()
    return both.select(*[F.when(new | (known & F.lit(c in updated)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns])


def tree_ids(divisions: DataFrame, start: int = 1) -> DataFrame:
    """Divisions (law, orden, parent_orden, ...) with ids in order and the ids of their parents."""
    ids = numbered(divisions, ["law"], ["orden"], "id").withColumn("id", (F.col("id") + start - 1).cast("int"))
    parents = ids.select("law", F.col("orden").alias("parent_orden"), F.col("id").alias("parent_id"))
    return ids.join(parents, ["law", "parent_orden"], "left")


def place_articles(articles: DataFrame, places: DataFrame, divisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles with their division, and those whose division isn't found: (good, errors). Matched by the loader's key,
    then by title, chapter and section, null-safe."""
    keyed = articles.withColumn("key", load_key(F.col("number"))).join(places, ["law", "key"], "left")
    d = divisions.select(F.col("law").alias("_law"), F.col("title").alias("_t"), F.col("chapter").alias("_c"), F.col("section").alias("_s"), F.col("id").alias("division_id"))
    found = keyed.join(d, (F.col("law") == F.col("_law")) & (F.col("title") == F.col("_t")) & F.col("chapter").eqNullSafe(F.col("_c")) & F.col("section").eqNullSafe(F.col("_s")), "left").drop("_law", "_t", "_c", "_s")
    return found.where("division_id is not null"), found.where("division_id is null").select("law", "number", F.lit("no division").alias("error"))


def without_law(df: DataFrame, law: str) -> DataFrame:
    """The table without a law's rows."""
    return df.where(~F.col("law").eqNullSafe(F.lit(law)))


def replace_law(df: DataFrame, path: str) -> None:
    """Writes laws over what a table partitioned by law holds of them; other laws stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("law").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, nulls included."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def checksum_entries(sums: DataFrame, law: str) -> DataFrame:
    """The JSON entries of a law's article checksums (article_id, value), an object each, in no order: so a law of any
    size can be written as lines and read back by read_checksums."""
    own = sums.where(F.col("law") == law)
    return own.select("article_id", F.to_json(F.create_map(F.col("article_id").cast("string"), F.col("checksum"))).alias("value"))


#: An entry of a flat JSON object of strings.
_ENTRY = r'"(?:[^"\\]|\\.)*"\s*:\s*"(?:[^"\\]|\\.)*"'


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(number, checksum) of baselines: flat JSON objects of strings, one for a whole law or one a line, printed in one
    line or with an entry a line.

    Files are read line by line, so that large ones are split among tasks; a line's entries are taken out of it. An entry
    must not be divided between lines: a line that ends after a key and its colon raises.
    """
    lines = spark.read.text(path)
    whole = F.when(F.regexp_like("value", F.lit(r'"\s*:\s*$')), F.raise_error(F.concat(F.lit("an entry over two lines: "), "value"))).otherwise(F.col("value"))
    entries = lines.select(F.explode(F.regexp_extract_all(whole, F.lit(_ENTRY), 0)).alias("entry"))
    return entries.select(F.explode(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), "map<string,string>")).alias("number", "checksum"))


def checksum_document(sums: DataFrame, law: str) -> DataFrame:
    """One row: the JSON object of a law's article checksums, in order, as a baseline of one document holds it."""
    own = sums.where(F.col("law") == law)
    return own.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("article_id").cast("string"), "checksum"))))).alias("value"))


def search_terms(log: DataFrame) -> DataFrame:
    """Counts of search terms (term, ts): lower case, trimmed, of two characters or more, cut at a hundred."""
    term = F.substring(F.trim(F.lower("term")), 1, 100)
    return log.select(term.alias("term"), "ts").where(F.length("term") >= 2).groupBy("term").agg(F.count("*").alias("times"), F.max("ts").alias("last_seen"))
