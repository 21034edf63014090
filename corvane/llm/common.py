"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.tables import BROADCAST_ROWS, Scratch, delete_at_end, discard, materialise, scratch, shared_dir, small_or_shuffled, unused

__all__ = ["BROADCAST_ROWS", "UPPER", "Scratch", "ascii_lower", "delete_at_end", "discard", "materialise", "scratch", "shared_dir", "small_or_shuffled", "table", "unused"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
