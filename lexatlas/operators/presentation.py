"""What an application shows: grouping of hits and laws, nesting of divisions, anchors, labels, display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.operators.hierarchy import chains, chains_within
from lexatlas.sources.ranking import neighbours, numbered
from lexatlas.sources.workspace import materialize


def group_hits(hits: DataFrame, page: int | None = None) -> DataFrame:
    """Hits (law, id, rank) grouped by law, larger groups first, of equals that with the better first hit: law, hits (in
    all), place (from 1), id. `page`: only so many of each law; all by default, a row each, so that no law fills a row.
    Hits are computed once.
    """
    hits = materialize(hits.select("law", "id", "rank"), "hits")
    total = hits.groupBy("law").agg(F.count("*").cast("int").alias("hits"), F.max("rank").alias("_first"))
    placed = numbered(hits, ["law"], [F.desc("rank"), F.col("id")], "place").withColumn("place", F.col("place").cast("int"))
    shown = placed if page is None else placed.where(F.col("place") <= page)
    return shown.join(total, "law").orderBy(F.desc("hits"), F.desc("_first"), "law", "place").select("law", "hits", "place", "id")


def group_laws(laws: DataFrame, categories: DataFrame, default: str = "fiscal") -> DataFrame:
    """Regulations under their base law, laws in categories (code, category, place): one row per base law."""
    own = laws.join(categories, "code", "left").select("code", "kind", "base_law", F.coalesce("category", F.lit(default)).alias("category"), F.coalesce("place", F.lit(0)).alias("place"))
    under = own.where("base_law is not null").groupBy(F.col("base_law").alias("code")).agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("regulations"))
    return own.where("base_law is null").join(under, "code", "left").select("category", "place", "code", "regulations").orderBy("place", "category", "code")


def nest(structure: DataFrame) -> DataFrame:
    """Titles with their chapters and the chapters' sections as nested arrays, in order; what has neither articles below
    nor a first article is dropped."""
    own = structure.where((F.col("total") > 0) | F.col("first").isNotNull())
    inner = lambda kind, extra: own.where(F.col("kind") == kind).groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "number", *extra))).alias("inside"))
    sections = inner("seccion", [])
    chapters = own.where("kind = 'capitulo'").join(sections, "id", "left").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "number", "inside"))).alias("chapters"))
    return own.where("kind = 'titulo'").join(chapters, "id", "left").select("id", "number", "name", "chapters")


def forward_titles(divisions: DataFrame) -> DataFrame:
    """Flat divisions in order (law, place, kind, id), each with the title it stands under."""
    return neighbours(divisions, ["law"], ["place"], last={"title_id": F.when(F.col("kind") == "titulo", F.col("id"))})


def quality_counts(rows: DataFrame, quality: str = "quality") -> DataFrame:
    """One row: articles with errors, corrected, and in order (no quality record), from JSON records."""
    status = F.get_json_object(quality, "$.estatus")
    return rows.agg(F.count_if(status == "con_error").alias("with_error"), F.count_if(status == "corregida").alias("corrected"), F.count_if(F.col(quality).isNull()).alias("in_order"))


def anchors(paragraphs: DataFrame, shown: Column | None = None, within: list[str] | None = None) -> DataFrame:
    """Anchor of each paragraph (id, parent_id, kind, number): `fraccion-I-inciso-a`; its chain of numbered parts from the
    root, text left out; p-{id} if there is none. `shown` is the id to return, where id is a key of several columns, or
    one in its group alone: `within` names the columns of groups that no tree leaves."""
    part = F.when(~F.col("kind").isin("texto", "parrafo") & F.col("number").isNotNull(), F.concat(F.col("kind"), F.lit("-"), F.regexp_replace("number", r"[).]", "")))
    own = F.col("id") if shown is None else shown
    nodes = paragraphs.select(*(within or []), "id", "parent_id", part.alias("part"))
    named = (chains_within(nodes, within) if within else chains(nodes)).withColumn("_anchor", F.array_join("parts", "-"))
    return named.select(own.alias("id"), F.when(F.col("_anchor") == "", F.concat(F.lit("p-"), own.cast("string"))).otherwise(F.col("_anchor")).alias("anchor"))


def contents(paragraphs: DataFrame) -> DataFrame:
    """Entries of a table of contents: root fractions with their incisos and whether they have any."""
    under = paragraphs.where("kind = 'inciso'").groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("number")), ",").alias("children"))
    return paragraphs.where("kind = 'fraccion' and parent_id is null and number is not null").join(under, "id", "left").select("id", "number", "children", F.col("children").isNotNull().alias("has_children"))


def headline(text: Column, most: int = 80) -> Column:
    """A title from a text: its first sentence if short, else the whole if short, else cut at the last space, with dots."""
    sentence = F.regexp_extract(text, r"^(.+?[.;:])", 1)
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when((sentence != "") & (F.length(sentence) <= most), sentence).when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def only_marks(html: Column) -> Column:
    """Text of a snippet: of all tags only <mark> without attributes stays."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<mark\s[^>]*>", "<mark>"), r"(?i)<(?!/?mark>)[^>]*>", "")


def display_date(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def blank_line_blocks(text: Column) -> Column:
    """Blocks that blank lines divide, empty ones dropped."""
    return F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != "")


#: Labels and routes by kind of content.
LABELS = {"ficha": ("Ficha", "ficha"), "criterio": ("Criterio", "criterio"), "regla": ("Regla", "regla")}


def label(kind: Column) -> Column:
    """(label, route) of a kind of content; an article for any other."""
    out = F.struct(F.lit("Art.").alias("label"), F.lit("articulo").alias("route"))
    for k, (a, b) in LABELS.items():
        out = F.when(kind == k, F.struct(F.lit(a).alias("label"), F.lit(b).alias("route"))).otherwise(out)
    return out


def url_steps(path: Column) -> Column:
    """(law, steps) of `/LAW/titulo/PRIMERO/capitulo/I`, decoded."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.url_decode(p))
    return F.struct(F.get(parts, F.lit(0)).alias("law"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("steps"))


def continuation(level: Column) -> Column:
    """How text at a level continues: (level above, kind shown)."""
    up = F.greatest(level - 1, F.lit(0))
    return F.struct(up.alias("level"), F.when(up == 0, "parrafo").when(up == 1, "fraccion").when(up == 2, "inciso").otherwise("numeral").alias("kind"))
