"""Citations: parsing of reference strings, resolution against articles, and the graph of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.operators.views import joined_text
from lexatlas.sources.corpus import Corpus


def parse_citations(rows: DataFrame, text: str = "refs") -> DataFrame:
    """(id, part, law, number) of each comma-separated token of a reference text.

    `CFF 27, 30` names a law once for the numbers that follow: the code is carried forward over the tokens. Tokens
    before any law, and empty ones, are dropped. Parsed within each row, so nothing is shuffled.
    """
    pattern = r"^([A-Z]{2,10})\s+(.+)$"
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    code = lambda t: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    number = lambda t: F.when(code(t).isNotNull(), F.trim(F.regexp_extract(t, pattern, 2))).otherwise(t)
    listed = rows.select("id", tokens.alias("t")).withColumn("codes", F.transform("t", code))
    before = lambda i: F.array_compact(F.slice("codes", F.lit(1), i + 1))
    parts = F.transform("t", lambda t, i: F.struct(i.alias("part"), F.try_element_at(before(i), F.lit(-1)).alias("law"), number(t).alias("number")))
    return listed.select("id", F.inline(parts)).where("law is not null")


def resolve_citations(corpus: Corpus, tokens: DataFrame, chars: int = 500) -> DataFrame:
    """Each token with the title and the first characters of its article's root paragraphs, and whether it was found.

    Law and number must be equal; of several articles with one number, that with the smallest id is taken. Articles get
    their texts first, so that tokens move once, by what they cite: by the article found, all of a law that cite none
    would come to one task.
    """
    text = joined_text(corpus.paragraphs, " ", F.col("parent_number").isNull()).select("law", F.col("article_id").alias("article"), F.substring("text", 1, chars).alias("content"))
    one = corpus.articles.groupBy("law", "number").agg(F.min(F.struct("id", "title")).alias("a")).select("law", "number", F.col("a.id").alias("article"), "a.title")
    found = tokens.join(one.join(text, ["law", "article"], "left"), ["law", "number"], "left")
    return found.select("id", "part", "law", "number", "title", "content", F.col("article").isNotNull().alias("found"))


#: Codes that begin a reference in the older form, in the order in which they are looked for; those it
#: recognises at the start of a part; and codes stored under another name.
FIRST_CODES = ("CFF", "LISR", "LIVA", "LIEPS", "RCFF", "RMF", "LSS", "LFT")
KNOWN_CODES = ("CFF", "LISR", "LIVA", "LIEPS", "LIC", "LFD", "RCFF", "RLISR", "RLIVA", "RISR", "RMF", "RISAT", "LSS", "LFT", "CPEUM")
ALIASES = {"RLISR": "RISR", "RLIVA": "RIVA"}


def parse_loose_citations(rows: DataFrame, text: str = "refs") -> DataFrame:
    """(id, part, law, stored_law, number) in the older, looser form: from the first listed code on; parts divided by
    commas, semicolons and ` y `; trailing `o.`, `°.` and `.` dropped; words skipped."""
    upper = F.upper(text)
    at = F.lit(0)
    for code in reversed(FIRST_CODES):
        found = F.instr(upper, code)
        at = F.when(found > 0, found).otherwise(at)
    codes = "|".join(sorted(KNOWN_CODES, key=len, reverse=True))
    own = rows.select("id", text, at.alias("at")).where("at > 0").select("id", F.posexplode(F.split(F.expr(f"substring({text}, at)"), r"[,;]\s*|\s+y\s+")).alias("part", "t"))
    own = own.withColumn("t", F.trim("t")).where("t != ''")
    head = F.nullif(F.regexp_extract("t", rf"^(?i)({codes})(?![A-Za-z])\s*", 1), F.lit(""))
    w = Window.partitionBy("id").orderBy("part")
    own = own.withColumn("law", F.last(F.upper(head), ignorenulls=True).over(w)).withColumn("number", F.trim(F.regexp_replace(F.regexp_replace(F.when(head.isNotNull(), F.regexp_replace("t", r"^[A-Za-z]+\s*", "")).otherwise(F.col("t")), r"[o°]\.\s*$", ""), r"\.\s*$", "")))
    stored = F.col("law")
    for a, b in ALIASES.items():
        stored = F.when(F.col("law") == a, b).otherwise(stored)
    return own.where("law is not null and number != ''").where(~F.regexp_like("number", F.lit("^[a-z]"))).select("id", "part", "law", stored.alias("stored_law"), "number")


def resolve_loose(corpus: Corpus, tokens: DataFrame) -> DataFrame:
    """Loose matches of numbers: equal without regard to case, with a trailing dot, or, for a bare integer, followed by
    `.` or `-`; the smallest number wins. The match is an equi-join on law and leading digits, then the conditions."""
    lead = lambda c: F.regexp_extract(F.upper(c), r"^(\d*)", 1)
    a = corpus.articles.select(F.col("law").alias("stored_law"), F.col("number").alias("have"), "title", lead(F.col("number")).alias("lead"))
    keyed = tokens.withColumn("lead", lead(F.col("number"))).join(a, ["stored_law", "lead"], "left")
    same = (F.upper("have") == F.upper("number")) | (F.upper("have") == F.concat(F.upper("number"), F.lit("."))) | (F.regexp_like("number", F.lit(r"^\d+$")) & F.regexp_like(F.substr("have", F.length("number") + 1), F.lit("^[.-]")))
    best = keyed.groupBy("id", "part", "law", "number").agg(F.min(F.when(same, F.struct("have", "title"))).alias("m"))
    return best.select("id", "part", "law", "number", F.col("m.have").alias("matched"), F.col("m.title").alias("title"), F.col("m").isNotNull().alias("found"))


def edge_view(corpus: Corpus, edges: DataFrame) -> DataFrame:
    """Distinct edges (origin, target, edge_kind) between articles, with the names of their laws."""
    laws = corpus.laws.select(F.col("code").alias("law"), "name")
    named = corpus.articles.select("id", "law").join(laws, "law")
    o = named.select(F.col("id").alias("origin"), F.col("name").alias("origin_law"))
    t = named.select(F.col("id").alias("target"), F.col("name").alias("target_law"))
    return edges.distinct().join(o, "origin").join(t, "target").select("origin", "origin_law", "target", "target_law", "edge_kind")


def in_and_out(corpus: Corpus, edges: DataFrame) -> DataFrame:
    """Per article, arrays of (id, number) it refers to and that refer to it; null where there are none."""
    a = corpus.articles.select("id", "number")
    known = edges.select("origin", "target").distinct().join(a.select(F.col("id").alias("origin"), F.col("number").alias("on")), "origin").join(a.select(F.col("id").alias("target"), F.col("number").alias("tn")), "target")
    side = lambda by, of, number, name: known.groupBy(F.col(by).alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col(of).alias("id"), F.col(number).alias("number")))).alias(name))
    return a.join(side("origin", "target", "tn", "outgoing"), "id", "left").join(side("target", "origin", "on", "incoming"), "id", "left")
