"""Windows over groups of any size: row numbers, neighbours, last values.

Rows are dealt by ranges of (group, order), so that a large group spreads over many tasks. Each range gives a summary of
a group: how many rows it holds, its first and last row, its last value that isn't null. A scan over the summaries, of
which a group has no more than there are ranges, tells what stands before and after a range; a window in the range
itself does the rest. Null groups are groups like others; nulls come first in an ascending order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.sources.workspace import materialize


def _dealt(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    return materialize(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _with_summaries(dealt: DataFrame, summaries: DataFrame, group: list[str]) -> DataFrame:
    named = summaries.withColumnsRenamed({c: f"_of_{c}" for c in ("_part", *group)})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_part", *group)])
    return dealt.join(named, same).drop(*(f"_of_{c}" for c in ("_part", *group)))


def numbered(rows: DataFrame, group: list[str], order: list, name: str = "n") -> DataFrame:
    """Adds the place (from 1) of each row in its group, by order (names or sort columns); ties in no set order.

    Rows move once: the ranges are written in order, with the number of each row in its range.
    """
    keys = [*group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(placed, "ranges").withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*group).orderBy("_part")
    before = materialize(sizes.withColumn("_before", F.sum("_n").over(own) - F.col("_n")).drop("_n"), "sizes")
    here = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return _with_summaries(dealt, before, group).withColumn(name, here.cast("long")).drop("_part", "_at", "_first", "_before")


def neighbours(rows: DataFrame, group: list[str], order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """Adds values of other rows of a group, in ascending order of the columns `order`, which no two rows share.

    before: new name -> column of the previous row. after: new name -> column of the next row. last: new name -> an
    expression, of which the last value that isn't null is taken, up to the row itself. Null where there is none.
    """
    before, after, last = before or {}, after or {}, {f"_last_{n}": (n, e) for n, e in (last or {}).items()}
    dealt = _dealt(rows.withColumns({c: e for c, (_, e) in last.items()}), group, order)
    place = F.struct(*order)
    ends = [F.max_by(c, place).alias(f"_end_{n}") for n, c in before.items()] + [F.min_by(c, place).alias(f"_begin_{n}") for n, c in after.items()]
    ends += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_known{c}") for c in last]
    across = Window.partitionBy(*group).orderBy("_part")
    so_far = across.rowsBetween(Window.unboundedPreceding, -1)
    around = {f"_end_{n}": F.lag(f"_end_{n}").over(across) for n in before} | {f"_begin_{n}": F.lead(f"_begin_{n}").over(across) for n in after}
    around |= {f"_known{c}": F.last(f"_known{c}", ignorenulls=True).over(so_far) for c in last}
    summaries = dealt.groupBy("_part", *group).agg(F.count("*").alias("_size"), *ends).withColumns(around)
    own = Window.partitionBy("_part", *group).orderBy(*order)
    at = F.row_number().over(own)
    found = _with_summaries(dealt, summaries, group).withColumn("_at", at)
    values = {n: F.when(F.col("_at") == 1, F.col(f"_end_{n}")).otherwise(F.lag(c).over(own)) for n, c in before.items()}
    values |= {n: F.when(F.col("_at") == F.col("_size"), F.col(f"_begin_{n}")).otherwise(F.lead(c).over(own)) for n, c in after.items()}
    values |= {n: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"_known{c}")) for c, (n, _) in last.items()}
    return found.select(*rows.columns, *(v.alias(n) for n, v in values.items()))
