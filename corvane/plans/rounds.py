"""Model requests in rounds: cached, retried, and written down before they are used.

A round takes requests (doc_id, seq, namespace, prompt, temperature) and gives
answers (doc_id, seq, content, error). Answers are appended to a cache table
before anything reads them, so a lost executor repeats calls of its own tasks
at most, and a second action never calls a model again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import response_error, strip_reasoning
from corvane.tables import materialise

VERSION = "1"
CACHE_SCHEMA = "key string, response string, error string, created_at double, elapsed_seconds double, namespace string, model_id string, prompt_version string, temperature double"


class Client(Protocol):
    """What calls a model. It is pickled to executors."""

    model_id: str

    def call(self, prompt: str, temperature: float) -> str: ...


def cache_key(namespace: Column, model_id: Column, prompt_version: Column, prompt: Column, temperature: Column) -> Column:
    """SHA-256 of all that an answer depends on, as compact JSON with sorted keys; a missing value is null there, so fields can't run into each other."""
    fields = {"model_id": model_id, "namespace": namespace, "prompt": prompt, "prompt_version": prompt_version, "temperature": temperature, "version": F.lit(int(VERSION))}
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}), 256)


def lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (with ``key``) that the cache answers, with the answer, and the distinct keys that it doesn't."""
    latest = upserted(cache).where("error is null").select("key", F.col("response").alias("content"))
    return requests.join(latest, "key"), requests.join(latest, "key", "left_anti").dropDuplicates(["key"])


def upserted(cache: DataFrame) -> DataFrame:
    """The newest entry of each key; entries are compared before the shuffle, so only one of each key and task moves."""
    rest = [c for c in cache.columns if c not in ("key", "created_at", "response")]
    newest = F.max(F.struct("created_at", "response", *rest)).alias("x")
    return cache.groupBy("key").agg(newest).select(*[F.col("key") if c == "key" else F.col(f"x.{c}").alias(c) for c in cache.columns])


def retried(client: Client, prompt: str, temperature: float, retries: int, backoff: float) -> tuple[str | None, str | None, float]:
    """Answer, error and seconds of a call that is repeated after failures, waiting twice as long each time."""
    began = time.monotonic()
    for attempt in range(retries + 1):
        try:
            return client.call(prompt, temperature), None, time.monotonic() - began
        except Exception as e:  # a failing request is a row with an error, not a failing job
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(backoff * 2**attempt)
    return None, error, time.monotonic() - began


def call_all(requests: DataFrame, client: Client, concurrency: int = 0, retries: int = 3, backoff: float = 1.0, prompt_version: str = "v1") -> DataFrame:
    """Cache rows of ``requests`` (key, namespace, prompt, temperature); ``concurrency`` tasks (0: as many as the cluster runs at once) call at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, namespace, prompt, temperature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content, error, took = retried(client, prompt, temperature, retries, backoff)
                row = [key, content, error, time.time(), took, namespace, client.model_id, prompt_version, temperature]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], _NAMES)

    return requests.select("key", "namespace", "prompt", "temperature").repartition(concurrency or requests.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, CACHE_SCHEMA)


_NAMES = [x.split()[0] for x in CACHE_SCHEMA.split(", ")]
_KINDS = [pa.string() if x.split()[1] == "string" else pa.float64() for x in CACHE_SCHEMA.split(", ")]


def answer(requests: DataFrame, client: Client, cache_path: str, prompt_version: str = "v1", cache_nonzero_temperature: bool = False, **calls: float) -> DataFrame:
    """doc_id, seq, content, error of one round.

    Requests at a temperature above zero bypass stored answers unless told
    otherwise; an answer is checked (empty, too long, repetitive) after its
    reasoning has been taken out.
    """
    spark = requests.sparkSession
    blank = requests.where(F.trim("namespace") == "")
    if not blank.isEmpty():
        raise ValueError("a request needs a namespace")
    keyed = requests.withColumn("key", cache_key(F.col("namespace"), F.lit(client.model_id), F.lit(prompt_version), F.col("prompt"), F.col("temperature")))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    again = keyed.where("temperature <> 0").dropDuplicates(["key"]) if not cache_nonzero_temperature else keyed.limit(0)
    _, missing = lookup(keyed if cache_nonzero_temperature else keyed.where("temperature = 0"), cache)
    call_all(missing.unionByName(again), client, prompt_version=prompt_version, **calls).write.mode("append").parquet(cache_path)
    done = upserted(spark.read.schema(CACHE_SCHEMA).parquet(cache_path)).select("key", strip_reasoning(F.col("response")).alias("content"), "error")
    out = keyed.join(done, "key", "left")
    lengths = F.length("prompt").cast("long").alias("prompt_chars"), F.length("content").cast("long").alias("response_chars")
    return out.select("doc_id", "seq", "content", F.coalesce("error", response_error(F.col("content"))).alias("error"), *lengths)


def scheduled(requests: DataFrame, client: Client, cache_path: str, schedule: list[tuple[str, float]], **options: object) -> DataFrame:
    """As ``answer``, with failed requests asked again: attempt k appends its text to the prompt and adds to the temperature (kept within 0 and 2).

    The result has a column ``attempt``, from 0; the last attempt's error stands.
    """
    done = None
    left = requests
    for attempt, (more, warmer) in enumerate([("", 0.0), *schedule]):
        asked = left.withColumns({"prompt": F.concat("prompt", F.lit(more)), "temperature": F.least(F.greatest(F.col("temperature") + warmer, F.lit(0.0)), F.lit(2.0))})
        got = materialise(answer(asked, client, cache_path, **options).withColumn("attempt", F.lit(attempt)), "attempt")
        last = attempt == len(schedule)
        keep = got if last else got.where("error is null")
        done = keep if done is None else done.unionByName(keep)
        if last:
            break
        left = materialise(left.join(got.where("error is not null").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi"), "again")
        if left.isEmpty():
            break
    return done


class MemoryCache:
    """Answers kept in the driver, for tests and small runs."""

    def __init__(self) -> None:
        self._rows: dict[str, dict] = {}

    def get(self, key: str) -> dict | None:
        return self._rows.get(key)

    def set(self, key: str, row: dict) -> None:
        self._rows[key] = row
