"""Corpora of files, as tables; readers go through Spark, so any store that it reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of texts, and of those that are HTML.
TEXTS, HTML = (".txt", ".md", ".html", ".htm"), (".html", ".htm")


def corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id (path), path, is_html, sha256, text, status, error: every text file below the paths, each path once.

    A path that is missing, or a single file of another kind, is an error. A
    file that isn't UTF-8 is a row with an error; the others go on.
    """
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            raise ValueError(f"{path} does not exist")
        if fs.getFileStatus(target).isFile() and not path.lower().endswith(TEXTS):
            raise ValueError(f"{path} is none of {' '.join(TEXTS)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).dropDuplicates(["path"])
    name = F.lower("path")
    wanted = files.where(F.regexp_extract(name, r"(\.[a-z]+)$", 1).isin(*TEXTS))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return wanted.select(
        F.col("path").alias("doc_id"), "path", F.regexp_extract(name, r"(\.[a-z]+)$", 1).isin(*HTML).alias("is_html"), F.sha2("content", 256).alias("sha256"),
        F.when(good, F.col("content").cast("string")).alias("text"), F.when(good, "ok").otherwise("error").alias("status"), F.when(~good, "not valid UTF-8").alias("error"),
    )


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark artifact (JSON); its schema version must be 1."""
    schema = (
        "schema_version int, created_at string, label string, model string, host string, splitter string, config map<string, string>, "
        "documents array<struct<id: string, path: string, sha256: string, input_chars: bigint>>, complete boolean, "
        "runs array<struct<document_id: string, repeat: int, status: string, elapsed_seconds: double, error: string>>"
    )
    table = spark.read.schema(schema).json(path, multiLine=True)
    if not table.where("schema_version is null or schema_version <> 1").isEmpty():
        raise ValueError(f"{path}: schema_version must be 1")
    return table


def results_json(sentences: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, json: {"sentences": [...], "groups": [...]} of each document."""
    s = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "start", "end", "text"))).alias("sentences"))
    ranges = groups.groupBy("doc_id", "gi", "label").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("ranges"))
    g = ranges.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gi", "label", "ranges"))), lambda x: F.struct(x["label"].alias("label"), x["ranges"].alias("ranges"))).alias("groups"))
    return s.join(g, "doc_id", "left").select("doc_id", F.to_json(F.struct("sentences", "groups")).alias("json"))
