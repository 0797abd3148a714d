"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.hard_negatives import SQL as HARD_NEGATIVES_SQL
from lexatlas.llm.line_dedup import SQL as LINE_DEDUP_SQL
from lexatlas.llm.structure_repair import SQL as STRUCTURE_REPAIR_SQL
from lexatlas.sources.workspace import fresh_path, materialize, table

#: The folder's name of the tokenizer files' package; path(name) gives a file's place on any machine.
TOKENIZERS = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    return import_module(TOKENIZERS).path(name)


def token_pattern() -> str:
    """The pattern that splits a text before the merges of a file of ranks."""
    return import_module(TOKENIZERS).PATTERN


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.token_output import digest, read_tokens, with_starts, write_tokens

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    rows = materialize(digest(read_tokens(spark, path)), "token-digests")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.chat import digest, format_conversations

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    log = rows.unionByName(added).select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg_id"), F.lit("message").alias("event"), "role", "text")
    return digest(materialize(format_conversations(log), "chat", compression="zstd"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.packing import digest, pack

    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.quality_rules import apply, fit

    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.decontamination import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.structure_repair import audit

    return audit(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.byte_bpe import decode, digest, encode

    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern()
    return digest(decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_ngram_join": op10_ngram_join,
    "op11_structure_repair": op11_structure_repair,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op6_line_dedup": LINE_DEDUP_SQL,
    "op11_structure_repair": STRUCTURE_REPAIR_SQL,
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
