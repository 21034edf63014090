"""Range algebra: inclusive index ranges as rows (s, e) within a document.

Every window is partitioned by document (or document and label), so a partition
holds the ranges of one document, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` marked for a join by shuffle and merge, for tables with a row for each sentence or range.

    The planner takes a table for as small as its compressed files and sees
    nothing of what an explode adds, so it would send such rows through the
    driver; at run time it takes that back only if no shuffle is added.
    """
    return rows.hint("merge")


def clamp(rows: DataFrame, last: Column) -> DataFrame:
    """Ranges inside 0..last, ends in order; none if ``last`` is negative."""

    def inside(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0)), last)

    a, b = inside(F.col("s")), inside(F.col("e"))
    return rows.where(last >= 0).withColumns({"s": F.least(a, b), "e": F.greatest(a, b)})


def coalesce(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys, ri, s, e: overlapping and touching ranges joined, numbered from 0 by place."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return out.select(*keys, (F.col("__island") - 1).cast("int").alias("ri"), "s", "e")


def from_indices(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys, ri, s, e: sorted indices (column idx) as the fewest runs."""
    order = Window.partitionBy(*keys).orderBy("idx")
    marked = rows.withColumn("__island", F.col("idx") - F.row_number().over(order))
    out = marked.groupBy(*keys, "__island").agg(F.min("idx").alias("s"), F.max("idx").alias("e"))
    return out.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("s")) - 1).cast("int").alias("ri"), "s", "e")


def from_flags(flags: DataFrame, *keys: str) -> DataFrame:
    """Keys, ri, s, e from rows (idx, starts): a new range begins wherever ``starts`` is true, and at the first row."""
    order = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = flags.withColumn("__run", F.sum(F.when(F.col("starts") & (F.col("idx") > 0), 1).otherwise(0)).over(order))
    out = marked.groupBy(*keys, "__run").agg(F.min("idx").alias("s"), F.max("idx").alias("e"))
    return out.select(*keys, F.col("__run").cast("int").alias("ri"), "s", "e")


def to_indices(rows: DataFrame) -> DataFrame:
    """One row for every index of every range."""
    return rows.where("s <= e").withColumn("idx", F.explode(F.sequence("s", "e")))
