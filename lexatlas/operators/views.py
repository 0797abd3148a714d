"""Catalogue views and the table functions of the API, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.functions.numbering import base_number, place
from lexatlas.sources import ranking as rank
from lexatlas.sources.corpus import Corpus

#: Rows of a response at most.
RESPONSE_ROWS = 1000


def joined_text(paragraphs: DataFrame, separator: str, condition: Column | None = None) -> DataFrame:
    """(law, article_id, text): paragraphs in their order, joined; articles without any are left out."""
    rows = paragraphs if condition is None else paragraphs.where(condition)
    own = rows.groupBy("law", "article_id").agg(F.sort_array(F.collect_list(F.struct("number", "content"))).alias("p"))
    return own.select("law", "article_id", F.array_join(F.transform("p", lambda x: x["content"]), separator).alias("text"))


def laws_view(corpus: Corpus) -> DataFrame:
    """Laws with their number of articles."""
    n = corpus.articles.groupBy(F.col("law").alias("code")).agg(F.count("*").alias("total_articles"))
    return corpus.laws.join(n, "code", "left").select("code", "name", "short_name", "kind", "base_law", F.coalesce("total_articles", F.lit(0)).alias("total_articles"))


def divisions_view(corpus: Corpus) -> DataFrame:
    """Divisions with the number of articles directly in them."""
    n = corpus.articles.groupBy(F.col("division_id").alias("id"), "law").agg(F.count("*").alias("total_articles"))
    return corpus.divisions.join(n, ["id", "law"], "left").select("id", "law", "parent_id", "kind", "number", "position", "name", F.coalesce("total_articles", F.lit(0)).alias("total_articles"))


def _articles(corpus: Corpus, text: DataFrame) -> DataFrame:
    a = corpus.articles.join(corpus.laws.select(F.col("code").alias("law"), F.col("name").alias("law_name")), "law")
    d = corpus.divisions.select(F.col("id").alias("division_id"), "law", place(F.col("kind"), F.col("number")).alias("place"))
    t = text.select("law", F.col("article_id").alias("id"), F.col("text").alias("content"))
    return a.join(d, ["division_id", "law"], "left").join(t, ["law", "id"], "left").withColumns({"base": base_number(F.col("number")), "is_transitory": F.col("kind") == "transitorio"})


def articles_view(corpus: Corpus) -> DataFrame:
    """Articles with law name, place and introduction: root paragraphs of kind texto."""
    root = F.col("parent_number").isNull() & (F.col("kind") == "texto")
    return _articles(corpus, joined_text(corpus.paragraphs, "\n\n", root)).select("id", "law", "law_name", "number", "base", "title", "kind", "place", "content", "is_transitory", "position")


def full_articles(corpus: Corpus) -> DataFrame:
    """Articles with all their paragraphs; incoming and outgoing references are null, as in the API."""
    none = F.lit(None).cast("string")
    return _articles(corpus, joined_text(corpus.paragraphs, "\n\n")).select("id", "law", "law_name", "number", "base", "title", "kind", "place", "content", "is_transitory", "reforms", "refs", none.alias("incoming"), none.alias("outgoing"), "position")


def article(corpus: Corpus, article_id: int) -> DataFrame:
    """One article by id; the filter is pushed into every table."""
    one = Corpus(corpus.laws, corpus.divisions, corpus.articles.where(F.col("id") == article_id), corpus.paragraphs.where(F.col("article_id") == article_id))
    return full_articles(one)


def article_by_number(corpus: Corpus, law: str, number: str) -> DataFrame:
    """One article by law and exact number."""
    own = corpus.of(law)
    return full_articles(Corpus(own.laws, own.divisions, own.articles.where(F.col("number") == number), own.paragraphs))


def article_with_references(corpus: Corpus, edges: DataFrame, article_id: int) -> DataFrame:
    """One article with the articles it refers to and that refer to it (edges: origin, target, edge_kind), each a JSON array
    in order of id, null if there are none. An id below 1 raises ValueError."""
    if article_id < 1:
        raise ValueError(f"no article has the id {article_id}")

    def side(own: str, other: str, name: str) -> DataFrame:
        known = edges.where(F.col(own) == article_id).select(F.col(own).alias("id"), F.col(other).alias("_id"), "edge_kind")
        there = corpus.articles.select(F.col("id").alias("_id"), "law", "number")
        one = F.struct(F.col("_id").alias("id"), F.col("law").alias("ley"), F.col("number").alias("numero_raw"), F.col("edge_kind").alias("tipo"))
        return known.join(there, "_id").groupBy("id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias(name))

    own = article(corpus, article_id).drop("incoming", "outgoing")
    return own.join(side("origin", "target", "outgoing"), "id", "left").join(side("target", "origin", "incoming"), "id", "left")


def law_articles(corpus: Corpus, law: str, limit: int = 100, offset: int = 0, chars: int = 300) -> DataFrame:
    """A law's articles in order of position, a page of them, with the first characters of their text."""
    own = corpus.of(law)
    rows = own.articles.orderBy("position", "id").offset(offset).limit(limit)
    page = full_articles(Corpus(own.laws, own.divisions, rows, own.paragraphs))
    return page.select("id", "number", "base", "place", F.substring("content", 1, chars).alias("preview"), "is_transitory", "position")


def division_articles(corpus: Corpus, division: int, law: str | None = None) -> DataFrame:
    """Articles directly in a division, in order; `law` is tested only if given."""
    own = corpus if law is None else corpus.of(law)
    own = Corpus(own.laws, own.divisions, own.articles.where(F.col("division_id") == division), own.paragraphs)
    return articles_view(own).select("id", "number", "title", "kind", "content", "position")


def stats(corpus: Corpus) -> DataFrame:
    """Per law: divisions, articles and transitory articles."""
    d = corpus.divisions.groupBy(F.col("law").alias("code")).agg(F.count("*").alias("divisions"))
    a = corpus.articles.groupBy(F.col("law").alias("code")).agg(F.count("*").alias("articles"), F.count_if(F.col("kind") == "transitorio").alias("transitory"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return corpus.laws.join(d, "code", "left").join(a, "code", "left").select("code", "name", "kind", zero("divisions"), zero("articles"), zero("transitory"))


def stats_with_paragraphs(corpus: Corpus) -> DataFrame:
    """The older form: per law, divisions, articles and paragraphs."""
    n = corpus.paragraphs.groupBy(F.col("law").alias("code")).agg(F.count("*").alias("paragraphs"))
    return stats(corpus).join(n, "code", "left").select("code", "name", "divisions", "articles", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


def totals(corpus: Corpus) -> DataFrame:
    """One row of counts over the whole corpus."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(corpus.laws, "laws").crossJoin(one(corpus.divisions, "divisions")).crossJoin(one(corpus.articles, "articles")).crossJoin(one(corpus.paragraphs, "paragraphs"))


def neighbours(articles: DataFrame) -> DataFrame:
    """Per article, those at exactly the previous and next position of its law (null at ends and gaps)."""
    at = lambda shift, name: articles.select("law", (F.col("position") + shift).alias("position"), F.struct("id", "number").alias(name))
    out = articles.select("id", "law", "position").join(at(1, "p"), ["law", "position"], "left").join(at(-1, "n"), ["law", "position"], "left")
    return out.select("id", F.col("p.id").alias("previous_id"), F.col("p.number").alias("previous_number"), F.col("n.id").alias("next_id"), F.col("n.number").alias("next_number"))


def nearest(articles: DataFrame) -> DataFrame:
    """Per article, those at the nearest lower and higher position of its law, across gaps."""
    rows = articles.select("law", "position", "id")
    return rank.neighbours(rows, ["law"], ["position", "id"], before={"previous_id": "id"}, after={"next_id": "id"}).select("id", "previous_id", "next_id")


def navigate(articles: DataFrame, article_id: int) -> DataFrame:
    """neighbours of one article: always one row, all null for an unknown id."""
    spark = articles.sparkSession
    return spark.createDataFrame([(article_id,)], "wanted long").join(neighbours(articles), F.col("wanted") == F.col("id"), "left").drop("wanted", "id")


#: Letters of a prefix at least, suggestions at most, and those if more are asked for.
PREFIX_LETTERS, MOST_SUGGESTIONS, SUGGESTIONS = 2, 20, 5


def suggestions(articles: DataFrame, prefix: str, limit: int | None = 10) -> DataFrame:
    """Distinct numbers that begin with a prefix (letters' case ignored), in order, each with frequency 1; none for a prefix
    of fewer than PREFIX_LETTERS. limit is SUGGESTIONS unless 1 to MOST_SUGGESTIONS."""
    asked = F.col("number").ilike(prefix + "%") & F.lit(len(prefix) >= PREFIX_LETTERS)
    rows = clamp(limit, MOST_SUGGESTIONS, SUGGESTIONS)
    return articles.where(asked).select(F.col("number").alias("term")).distinct().orderBy("term").limit(rows).withColumn("frequency", F.lit(1))


def in_list(column: str, given: str | None) -> Column:
    """The optional filter by a comma-separated list: none given, no filter; an empty one matches nothing."""
    if given is None:
        return F.lit(True)
    return F.col(column).isin(given.split(",")) if given else F.lit(False)


OPERATORS = {"eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "like": lambda c, v: c.like(v.replace("*", "%")), "ilike": lambda c, v: c.ilike(v.replace("*", "%")), "in": lambda c, v: c.isin(v.strip("()").split(",")), "is": lambda c, v: c.isNull() if v == "null" else c == (v == "true")}


def rest_scan(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """A view read as the gateway does: `column=op.value` filters, select, order, limit and offset, at most
    RESPONSE_ROWS rows. Unknown operators raise ValueError."""
    for name, value in params.items():
        if name in ("select", "order", "limit", "offset"):
            continue
        op, _, operand = value.partition(".")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        df = df.where(OPERATORS[op](F.col(name), operand))
    if "order" in params:
        df = df.orderBy(*[F.col(c.partition(".")[0]).desc() if c.endswith(".desc") else F.col(c.partition(".")[0]).asc() for c in params["order"].split(",")])
    if "offset" in params:
        df = df.offset(int(params["offset"]))
    df = df.limit(min(int(params.get("limit", RESPONSE_ROWS)), RESPONSE_ROWS))
    return df.select(*params["select"].split(",")) if "select" in params else df


def clamp(value: int | None, most: int, default: int) -> int:
    """A page size: the default unless 1..most."""
    return value if value is not None and 1 <= value <= most else default
