"""Structural metrics of segmentations, and statistics of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ranges import coalesce

BINS = 10


def range_sizes(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, gi, ri, valid, size: a range outside the document counts, with size 0."""
    valid = (F.col("s") >= 0) & (F.col("s") <= F.col("e")) & (F.col("e") < F.col("n"))
    rows = groups.join(counts.select("doc_id", "n"), "doc_id")
    return rows.select("doc_id", "gi", "ri", valid.alias("valid"), F.when(valid, F.col("e") - F.col("s") + 1).otherwise(0).cast("long").alias("size"))


def positions(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, topic, idx: distinct sentences of every topic (a full label)."""
    rows = groups.join(counts.select("doc_id", "n"), "doc_id").where("s >= 0 and s <= e and e < n")
    rows = rows.select("doc_id", F.array_join("label", ">").alias("topic"), "s", "e")
    return rows.withColumn("idx", F.explode(F.sequence("s", "e"))).select("doc_id", "topic", "idx").distinct()


def topics(groups: DataFrame, counts: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, topic, n_sentences, n_ranges, clean_chars."""
    at = positions(groups, counts).join(sentences.select("doc_id", F.col("idx").cast("long").alias("idx"), F.length("text").alias("chars")), ["doc_id", "idx"])
    sizes = at.groupBy("doc_id", "topic").agg(F.count("*").alias("n_sentences"), F.sum("chars").alias("clean_chars"))
    ranges = groups.groupBy("doc_id", F.array_join("label", ">").alias("topic")).agg(F.count("*").alias("n_ranges"))
    return ranges.join(sizes, ["doc_id", "topic"], "left").select("doc_id", "topic", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), "n_ranges", F.coalesce("clean_chars", F.lit(0)).alias("clean_chars"))


def hierarchy(groups: DataFrame) -> DataFrame:
    """doc_id, path, n_children for every label prefix, the root (empty) included."""
    labels = groups.select("doc_id", "label").distinct()
    steps = labels.select("doc_id", "label", F.explode(F.sequence(F.lit(0), F.size("label"))).alias("k"))
    rows = steps.select("doc_id", F.array_join(F.slice("label", F.lit(1), F.col("k")), ">").alias("path"), F.get("label", F.col("k")).alias("child"))
    return rows.groupBy("doc_id", "path").agg(F.count_distinct("child").alias("n_children"))


def bins(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, bin, n_topics: distinct topics that meet each tenth of a document."""
    tenths = counts.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    tenths = tenths.select("doc_id", "bin", F.floor(F.col("bin") * F.col("n") / BINS).alias("lo"), F.floor((F.col("bin") + 1) * F.col("n") / BINS).alias("hi"))
    rows = groups.join(counts.select("doc_id", "n"), "doc_id").where("s >= 0 and s <= e and e < n").select("doc_id", F.array_join("label", ">").alias("topic"), "s", "e")
    hit = tenths.join(rows, (tenths.doc_id == rows.doc_id) & (rows.s < tenths.hi) & (rows.e >= tenths.lo), "left").drop(rows.doc_id)
    return hit.groupBy("doc_id", "bin").agg(F.count_distinct("topic").alias("n_topics"))


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Keys, n, min, max, mean, median of a column."""
    c = F.col(value)
    return rows.groupBy(*keys).agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).cast("double").alias("median"))


def singletons(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, singleton_topics, singleton_ranges: shares of topics and ranges of one sentence."""
    t = positions(groups, counts).groupBy("doc_id", "topic").agg(F.count("*").alias("k")).groupBy("doc_id").agg(F.avg((F.col("k") == 1).cast("double")).alias("singleton_topics"))
    r = range_sizes(groups, counts).groupBy("doc_id").agg(F.avg((F.col("size") == 1).cast("double")).alias("singleton_ranges"))
    out = counts.select("doc_id").join(t, "doc_id", "left").join(r, "doc_id", "left")
    return out.na.fill(0.0, ["singleton_topics", "singleton_ranges"])


# --- runs ----------------------------------------------------------------------


def ok(status: str = "status") -> Column:
    return F.col(status) == "ok"


def latency(runs: DataFrame, *keys: str) -> DataFrame:
    """Keys, n_runs, n_failed, failure_rate, p50, p95, pstdev; latencies of successful runs only."""
    x = F.when(ok(), F.col("elapsed_seconds"))
    failed = F.sum(F.when(ok(), 0).otherwise(1))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), failed.alias("n_failed"), (failed / F.count("*")).alias("failure_rate"),
        F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.95)).alias("p95"), F.stddev_pop(x).alias("pstdev"),
    )


def throughput(runs: DataFrame, *keys: str) -> DataFrame:
    """Keys, chars_per_second: median over successful runs."""
    return runs.where(ok()).where("elapsed_seconds > 0").groupBy(*keys).agg(F.percentile(F.col("input_chars") / F.col("elapsed_seconds"), F.lit(0.5)).alias("chars_per_second"))


def namespace_totals(calls: DataFrame) -> DataFrame:
    """namespace (null: all), n_calls, elapsed_seconds, n_failures."""
    return calls.rollup("namespace").agg(F.count("*").alias("n_calls"), F.sum("elapsed_seconds").alias("elapsed_seconds"), F.sum((~ok()).cast("long")).alias("n_failures"))


def corpus_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, sha256, side: documents that only one of two runs has, or has with other bytes."""
    a, b = left.select("id", "sha256"), right.select("id", "sha256")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def compare(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """document_id, place, medians (array of struct<label, median>, by label): every run label's median latency.

    ``seen`` has (document_id, seen); documents are numbered from 0 in the order of their least ``seen``.
    """
    first = seen.groupBy("document_id").agg(F.min("seen").alias("seen"))
    each = runs.where(ok()).groupBy("document_id", "label").agg(F.percentile("elapsed_seconds", F.lit(0.5)).alias("median"))
    rows = each.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("label", "median"))).alias("medians")).join(first, "document_id")
    return rows.select("document_id", (F.row_number().over(Window.orderBy("seen")) - 1).cast("int").alias("place"), "medians")


def coverage(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n, n_covered, n_uncovered, n_multiple, coverage for every document of ``counts``: a sweep over the ends of ranges, without a row for each sentence."""
    rows = groups.join(counts.select("doc_id", "n"), "doc_id").where("s >= 0 and s <= e and e < n").select("doc_id", F.array_join("label", ">").alias("topic"), "s", "e")
    rows = coalesce(rows, "doc_id", "topic")  # a topic has a sentence once
    steps = rows.select("doc_id", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy("doc_id", "x.at").agg(F.sum("x.d").alias("d"))
    order = Window.partitionBy("doc_id").orderBy("at")
    spans = steps.select("doc_id", F.sum("d").over(order).alias("depth"), (F.lead("at").over(order) - F.col("at")).alias("k"))
    agg = spans.groupBy("doc_id").agg(F.sum(F.when(F.col("depth") > 0, F.col("k"))).alias("n_covered"), F.sum(F.when(F.col("depth") > 1, F.col("k"))).alias("n_multiple"))
    out = counts.select("doc_id", "n").join(agg, "doc_id", "left").na.fill(0, ["n_covered", "n_multiple"])
    rate = F.when(F.col("n") > 0, F.col("n_covered") / F.col("n")).otherwise(0.0)
    return out.select("doc_id", "n", F.col("n_covered").cast("long").alias("n_covered"), (F.col("n") - F.col("n_covered")).cast("long").alias("n_uncovered"), F.col("n_multiple").cast("long").alias("n_multiple"), rate.alias("coverage"))
