"""Columns of a caller's table that an operator only passes on."""

from __future__ import annotations

from pyspark.sql import DataFrame

OWN = ("doc_id", "text")


def aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names that no operator uses; .toDF(*docs.columns) undoes it."""
    return docs.toDF(*(c if c in OWN else f"column {n}" for n, c in enumerate(docs.columns)))
