"""Integrity and reconciliation: what is missing, extra, changed or out of order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.functions.numbering import canonical
from lexatlas.sources.corpus import Corpus
from lexatlas.sources.ranking import neighbours
from lexatlas.sources.workspace import materialize


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows without a parent."""
    return children.join(parents.select(key), key, "left_anti")


def empty_chapters(corpus: Corpus) -> DataFrame:
    """Chapters without articles, directly or in one of their sections."""
    chapters = corpus.divisions.where("kind = 'capitulo'").select("id", "law", "number")
    direct = corpus.articles.select(F.col("division_id").alias("id")).distinct()
    sections = corpus.divisions.select(F.col("id").alias("division_id"), F.col("parent_id").alias("id"))
    below = corpus.articles.select("division_id").distinct().join(sections, "division_id").select("id").where("id is not null")
    return chapters.join(direct, "id", "left_anti").join(below, "id", "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two sets of keys: `missing`, `extra` or `ok`."""
    e, a = expected.select(*keys).distinct().withColumn("_e", F.lit(True)), actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    return e.join(a, keys, "full_outer").select(*keys, F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("ok").alias("state"))


def reconcile_counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on either side, and whether they agree; keys that stand for several divisions are summed."""
    e, a = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((expected, "expected"), (actual, "actual")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(a, keys, "full_outer").select(*keys, zero("expected"), zero("actual")).withColumn("ok", F.col("expected") == F.col("actual"))


def index_comparison(official: DataFrame, imported: DataFrame, virtual: Column) -> DataFrame:
    """Official index against imported divisions (kind, number, name): ok, faltante, virtual or extra, with both names.

    Of imported rows with one kind and number, that with the smallest name counts.
    """
    key = ["kind", "number"]
    o = official.select(*key, F.col("name").alias("official_name"), F.lit(True).alias("_o"))
    i = imported.groupBy(*key).agg(F.min("name").alias("imported_name")).withColumn("_i", F.lit(True))
    state = F.when(F.col("_i").isNull(), "faltante").when(F.col("_o").isNotNull(), "ok").when(virtual, "virtual").otherwise("extra")
    return o.join(i, key, "full_outer").select(*key, "official_name", "imported_name", state.alias("state"))


def index_summary(compared: DataFrame) -> DataFrame:
    """Per kind: numbers in the index, matched, missing, extra and virtual, and the percentage matched (100 of none)."""
    n = lambda *states: F.count_distinct(F.when(F.col("state").isin(*states), F.col("number")))
    out = compared.groupBy("kind").agg(n("ok", "faltante").alias("official"), n("ok").alias("matched"), n("faltante").alias("missing"), n("extra").alias("extra"), n("virtual").alias("virtual"))
    return out.withColumn("percent", F.when(F.col("official") == 0, 100.0).otherwise(F.round(F.col("matched") / F.col("official") * 100, 1)))


#: Missing numbers of a division that are listed; of more, only the intervals and the count are given.
LISTED = 1000


def missing_intervals(articles: DataFrame, number: Column) -> DataFrame:
    """Numbers missing between the first and the last of a division, as intervals: division_id, after, first_missing,
    last_missing. A row for each gap between two neighbours, however wide it is."""
    own = articles.select("division_id", number.cast("long").alias("n")).where("n is not null").distinct()
    following = neighbours(own, ["division_id"], ["n"], after={"next": "n"})
    return following.where("next > n + 1").select("division_id", F.col("n").alias("after"), (F.col("n") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"))


def numbering_gaps(divisions: DataFrame, articles: DataFrame, number: Column, label: Column, listed: int = LISTED) -> DataFrame:
    """Per division (division_id): articles with a number, the first and last of them, how many the range would hold, how
    many are missing, percentage complete, and status: empty, ok (100), warning (80 or more) or error. missing_numbers
    lists the missing ones if they are `listed` or fewer, and is null for none or more (missing_intervals has all)."""
    own = articles.select("division_id", number.alias("n"), label.alias("label")).where("n is not null")
    agg = own.groupBy("division_id").agg(F.count("*").alias("total"), F.min(F.struct("n", "label")).alias("lo"), F.max_by("label", F.struct("n", "label")).alias("last_label"), F.max("n").cast("long").alias("hi"))
    expected = F.col("hi") - F.col("lo.n").cast("long") + 1
    width = F.col("last_missing") - F.col("first_missing") + 1
    short = F.when(width <= listed, F.sequence("first_missing", "last_missing"))
    gaps = missing_intervals(articles, number)
    wide = gaps.groupBy("division_id").agg(F.sum(width).alias("gone")).where(F.col("gone") <= listed)
    lists = gaps.join(wide.select("division_id"), "division_id").groupBy("division_id").agg(F.sort_array(F.flatten(F.collect_list(short))).alias("list"))
    out = divisions.select("division_id").join(agg, "division_id", "left").join(lists, "division_id", "left")
    percent = F.when(F.col("total").isNull(), 100.0).otherwise(F.round(F.col("total") / expected * 100, 1))
    status = F.when(F.col("total").isNull(), "empty").when(percent >= 100, "ok").when(percent >= 80, "warning").otherwise("error")
    return out.select("division_id", F.coalesce("total", F.lit(0)).alias("total"), F.col("lo.label").alias("first_label"), "last_label", F.coalesce(expected, F.lit(0)).cast("long").alias("expected"), F.coalesce(expected - F.col("total"), F.lit(0)).cast("long").alias("missing"), percent.alias("percent"), status.alias("status"), F.array_join(F.col("list").cast("array<string>"), ",").alias("missing_numbers"))


def article_checksums(paragraphs: DataFrame, chars: int = 16) -> DataFrame:
    """(law, article_id, checksum): the first hex digits of sha256 of an article's paragraphs, joined by line ends;
    articles without paragraphs have none."""
    own = paragraphs.groupBy("law", "article_id").agg(F.sort_array(F.collect_list(F.struct("number", "content"))).alias("p"))
    return own.select("law", "article_id", F.substring(F.sha2(F.array_join(F.transform("p", lambda x: x["content"]), "\n"), 256), 1, chars).alias("checksum"))


def checksum_drift(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys whose checksum changed, that are new, or that are gone."""
    b, n = before.select(key, F.col("checksum").alias("was")), now.select(key, F.col("checksum").alias("is"))
    state = F.when(F.col("was").isNull(), "nuevo").when(F.col("is").isNull(), "eliminado").otherwise("modificado")
    return b.join(n, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select(key, state.alias("state"))


def validate_structure(corpus: Corpus, expected: DataFrame) -> DataFrame:
    """Per law, kinds of division against a flat JSON of expected counts (code, expected: `{"titulos": 3}`).

    A kind is its JSON key without the plural s, so `secciones` never meets `seccion` and counts 0.
    """
    entries = expected.select("code", F.explode(F.from_json("expected", "map<string,long>")).alias("element", "expected")).withColumn("kind", F.rtrim("element", F.lit("s")))
    n = corpus.divisions.groupBy(F.col("law").alias("code"), "kind").agg(F.count("*").alias("actual"))
    return entries.join(n, ["code", "kind"], "left").select("code", "element", "expected", F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("ok", F.col("expected") == F.col("actual"))


def constraint_violations(corpus: Corpus) -> DataFrame:
    """Constraints that a store would enforce: (rule, n) rows that break each."""
    d, a, p = corpus.divisions, corpus.articles, corpus.paragraphs
    repeated = lambda df, *keys: df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n"))
    missing = lambda df, cols, other, others: df.join(other.select(*[F.col(o).alias(f"_{o}") for o in others]), [F.col(c) == F.col(f"_{o}") for c, o in zip(cols, others)], "left_anti").agg(F.count("*").alias("n"))
    rules = {
        "division key": repeated(d, "id"),
        "article key": repeated(a, "id"),
        "article number in law": repeated(a, "law", "number"),
        "paragraph key": repeated(p, "law", "article_id", "number"),
        "division law": missing(d, ["law"], corpus.laws, ["code"]),
        "division parent": missing(d.where("parent_id is not null"), ["parent_id", "law"], d, ["id", "law"]),
        "article division": missing(a, ["division_id", "law"], d, ["id", "law"]),
        "paragraph article": missing(p, ["article_id", "law"], a, ["id", "law"]),
        "paragraph parent": missing(p.where("parent_number is not null"), ["law", "article_id", "parent_number"], p, ["law", "article_id", "number"]),
        "article kind": a.where(~F.col("kind").isin("articulo", "regla", "transitorio", "ficha", "criterio")).agg(F.count("*").alias("n")),
    }
    out = None
    for rule, n in rules.items():
        row = n.select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def regression(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows that are gone or new between two snapshots, repeated rows counted."""
    return before.exceptAll(now).withColumn("change", F.lit("-")).unionByName(now.exceptAll(before).withColumn("change", F.lit("+")))


def forbidden_kinds(corpus: Corpus) -> DataFrame:
    """Divisions of a kind that their law doesn't list as allowed."""
    laws = corpus.laws.select(F.col("code").alias("law"), "allowed_divisions")
    return corpus.divisions.join(laws, "law").where(~F.array_contains(F.split("allowed_divisions", ","), F.col("kind"))).select("id", "law", "kind")


def rule_integrity(rules: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row: rules, rules without a chapter, chapters without rules."""
    assigned = rules.join(chapters.select(F.col("number").alias("chapter")), F.substring_index(rules.number, ".", 2) == F.col("chapter"), "left")
    used = rules.select(F.substring_index("number", ".", 2).alias("number")).distinct()
    return assigned.agg(F.count("*").alias("rules"), F.count_if(F.col("chapter").isNull()).alias("orphans")).crossJoin(chapters.join(used, "number", "left_anti").agg(F.count("*").alias("empty_chapters")))


def chapter_sets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per title and chapter, both sides' sets of articles (law, title, chapter, number): expected, actual, missing and
    extra counts, and state: ok, different, or only_stored for a chapter that isn't expected. Articles in no section are
    compared; a number that repeats in a chapter counts once."""
    key = ["law", "title", "chapter"]
    e, a = expected.select(*key, "number").distinct().withColumn("_e", F.lit(1)), actual.select(*key, "number").distinct().withColumn("_a", F.lit(1))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*key, "number")]
    both = e.alias("e").join(a.alias("a"), reduce(Column.__and__, same), "full_outer").select(*[F.coalesce(f"e.{c}", f"a.{c}").alias(c) for c in key], "_e", "_a")
    n = lambda condition, name: F.count_if(condition).alias(name)
    in_e, in_a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    out = both.groupBy(*key).agg(n(in_e, "expected"), n(in_a, "actual"), n(in_e & ~in_a, "missing"), n(in_a & ~in_e, "extra"))
    state = F.when(F.col("expected") == 0, "only_stored").when((F.col("missing") == 0) & (F.col("extra") == 0), "ok").otherwise("different")
    return out.withColumn("state", state)


def place_differences(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """What an extraction lacks, by place, and what nothing expects: law, title, chapter, section, number, state.

    expected: (law, title, chapter, section, number); extracted: (law, number). Numbers are compared in their canonical
    form. missing: an expected number that wasn't extracted, at its place; extra: an extracted one that stands nowhere,
    under title ?. Each side's rows are computed once and written, as both answers read them.
    """
    places = [F.col(c).cast("string").alias(c) for c in ("title", "chapter", "section")]  # a column of bare nulls can't be written
    e = materialize(expected.select("law", *places, canonical(F.col("number")).alias("number")), "expected").distinct()
    a = materialize(extracted.select("law", canonical(F.col("number")).alias("number")), "extracted").distinct()
    missing = e.join(a, ["law", "number"], "left_anti").withColumn("state", F.lit("missing"))
    none = F.lit(None).cast("string")
    extra = a.join(e.select("law", "number").distinct(), ["law", "number"], "left_anti")
    extra = extra.select("law", F.lit("?").alias("title"), none.alias("chapter"), none.alias("section"), "number", F.lit("extra").alias("state"))
    return missing.select(*extra.columns).unionByName(extra)


def last_articles(articles: DataFrame, paragraphs: DataFrame, chars: int = 80) -> DataFrame:
    """Each law's last article with its number of paragraphs and the first characters of the last one (N/A of none)."""
    last = previous_and_last(articles)
    own = paragraphs.join(last.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    n = own.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("paragraphs"), F.max_by("content", "number").alias("_c"))
    return last.join(n, "id", "left").select("law", "id", "number", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce(F.substring("_c", 1, chars), F.lit("N/A")).alias("preview"))


def previous_and_last(articles: DataFrame) -> DataFrame:
    """Last article of each law."""
    return articles.groupBy("law").agg(F.max_by(F.struct("id", "number"), F.struct("position", "id")).alias("a")).select("law", "a.id", "a.number")
