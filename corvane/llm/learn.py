"""What the trained operators share: held-out rows and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def held_out(mod: int, rest: int, id_col: str = "doc_id") -> Column:
    """Whether a row is held out of training. A row without id is not, but it is never trained on either."""
    return F.coalesce(remainder(mod, id_col) == rest, F.lit(False))


def bounded_sample(ids: DataFrame, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows of ``ids`` at most, chosen by a hash of doc_id, all of them if there are fewer.

    Only ids are counted. The expected size is the bound; it varies with its square root.
    """
    n = ids.count()
    if n <= bound:
        return ids
    cut = int((bound / n) * 2**63)
    return ids.where(F.abs(F.xxhash64("doc_id", F.lit(seed))) < F.lit(cut))


def labelled_ids(labels: DataFrame, column: str, mod: int, rest: int, bound: int) -> DataFrame:
    """(doc_id, y) of at most about ``bound`` labelled documents, none of them held out.

    Null ids and null labels are left out. An id with several labels keeps the greatest.
    """
    fit = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(mod, rest))
    return bounded_sample(fit.groupBy("doc_id").agg(F.max("y").alias("y")), bound)
