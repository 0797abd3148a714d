"""A training-data pipeline over the table documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm import decontamination, language_id, line_dedup, ngram_join, packing
from lexatlas.llm.columns import aside
from lexatlas.llm.queries import held_out, tokenizer_path
from lexatlas.sources.workspace import materialize, table

#: Least score of a document's language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised: not `und` (null text, or no letter), and with LEAST_SCORE or more.

    The model learns from docs with a lang whose doc_id isn't held out. Without any, every document would be `und`, and
    none is kept. Rows are judged one by one, whatever their doc_id; an empty table stays empty.
    """
    model = language_id.fit(docs, ~held_out())
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return language_id.predict(aside(docs), model).where(known).drop("lang_pred", "score").toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of three lines or more; n_chars follows the text.

    Documents of which nothing is left, because all their lines occurred before, go. Others stay, with the cases as in
    dedup_lines.
    """
    own = aside(docs)
    out = line_dedup.dedup_lines(own).where("n_removed = 0 or n_removed < n_lines")
    chars = lambda c: F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c))
    return out.select(*[(chars(f"`{c}`") if name == "n_chars" else F.col(f"`{c}`")).alias(name) for name, c in zip(docs.columns, own.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more; cases
    as in one_of_each: rows are compared by their texts, also without a doc_id."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; cases as in contaminations."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids: a row per piece, with its ids; cases as in packing.pack."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: The learned language model, the tokenizer and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
