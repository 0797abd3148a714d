"""Removal of repeated passages: overlapping windows of three consecutive lines, compared over the whole corpus.

Native Spark only. Lines are hashed inside each document's row, so that windows, not texts, are shuffled; the first
place of each window is a map-side combined minimum; the windows that occur twice or more mark later places, and a
document's covered positions are merged as a set. Windows so frequent that their places might fill one task are joined
by broadcast: there are fewer than HOT_PARTS of them, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.columns import aside
from lexatlas.sources.workspace import materialize

WINDOW = 3
#: A window with more than 1 / HOT_PARTS of all places is broadcast; so there are fewer than HOT_PARTS such windows.
HOT_PARTS = 1000


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def _windows(window: int) -> Column:
    """(pos, a, b) of each window of the lines column that has a word in one of its lines: two 64-bit hashes."""
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")).alias("w")))
    at = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        rows = [F.get("h", i + k) for k in range(window)]
        word = rows[0]["w"]
        for r in rows[1:]:
            word = word | r["w"]
        return F.struct(i.alias("pos"), F.xxhash64(*[r["a"] for r in rows]).alias("a"), F.xxhash64(*[r["b"] for r in rows]).alias("b"), word.alias("w"))

    return F.filter(F.transform(at, one), lambda x: x["w"]), hashed


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes passages of `window` or more lines that occurred before, in this document or an earlier one.

    Lines are what "\\n" separates, compared exactly. A window is `window` consecutive lines, a word
    ([^\\x20\\x09-\\x0D]) in one of them at least; its first place is the smallest by doc_id (null first), then hash of
    the text, then position; every later place is covered, and all covered lines go, whichever windows cover them.
    Returns all columns of docs, with text made of the lines left, and n_lines and n_removed (replaced if there).

    A null text stays null (0 lines). A document of fewer than `window` lines stays as it is. Rows that are the same in
    doc_id and text are one document: what is first in one is first in the other, and both come out alike. Documents
    that lose every line have an empty text. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    names, docs = docs.columns, aside(docs)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _lines().alias("lines"))
    found, hashed = _windows(window)
    places = keyed.select("doc_id", "text_hash", "lines", hashed.alias("h")).select("doc_id", "text_hash", F.inline(found)).drop("w")
    places = materialize(places, "line-windows")

    place = F.struct("doc_id", "text_hash", "pos")
    # places of one document may repeat as rows; a window counts as repeated if its places differ
    repeated = places.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last")
    repeated = materialize(repeated.select("a", "b", "n", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"), F.col("first.pos").alias("p")), "repeated-windows")
    hot = F.lit(max(1, places.count() // HOT_PARTS))

    later = ~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("pos") == F.col("p")))
    often = F.broadcast(repeated.where(F.col("n") > hot))
    one = places.join(often, ["a", "b"]).where(later)
    rest = places.join(F.broadcast(repeated.where(F.col("n") > hot).select("a", "b")), ["a", "b"], "left_anti")
    two = rest.join(repeated.where(F.col("n") <= hot), ["a", "b"]).where(later)
    covered = one.unionByName(two).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at"))

    texts = docs.withColumn("_hash", F.xxhash64("text"))
    joined = texts.join(covered.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"}), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    gone = F.array_distinct(F.flatten(F.transform("at", lambda i: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: i + k))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    out = joined.withColumns({"_lines": _lines(), "_gone": gone})
    shown = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*shown, n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed")).toDF(*names, "n_lines", "n_removed")


#: The result of op6 in DuckDB SQL.
SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
win AS (
  SELECT doc_id, pos, line AS l1,
         lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
good AS (SELECT * FROM win WHERE l3 IS NOT NULL AND regexp_matches(l1 || l2 || l3, '[^\x20\x09-\x0D]')),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS rn FROM good),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest(range(3)) AS k) WHERE rn > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id
),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS INTEGER) AS n_lines,
       CAST(coalesce(n.n_removed, 0) AS INTEGER) AS n_removed
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
