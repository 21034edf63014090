"""Command line: segment, decide, find keywords or insights, and benchmark, over files or folders.

    python -m corvane.cli topics notes/ --out results --host http://localhost:8080
    python -m corvane.cli bench notes/ --out bench --label first --repeats 3

Without --host the deterministic stand-in answers, which is what tests use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import reports
from corvane.functions import stub
from corvane.operators import cleaning, metrics, tokens
from corvane.plans import rounds, sessions
from corvane.sources import files, models
from corvane.tables import materialise, scratch


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corvane", description=__doc__.splitlines()[0])
    p.add_argument("what", choices=["topics", "insights", "keywords", "bench"])
    p.add_argument("paths", nargs="+", help="files or folders of .txt, .md, .html, .htm")
    p.add_argument("--out", required=True, help="folder of the results")
    p.add_argument("--host", help="address of a completion server; without it the stand-in answers")
    p.add_argument("--model", default="")
    p.add_argument("--cache", help="folder of answers given before")
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--splitter", choices=["sparse", "normalised", "hard"], default="sparse")
    p.add_argument("--gap", choices=["repair", "ask", "strict"], default="repair")
    p.add_argument("--max-chars", type=int, default=84_000)
    p.add_argument("--min-gap-words", type=int, default=20)
    p.add_argument("--reassign", action="store_true")
    p.add_argument("--boundaries", action="store_true")
    p.add_argument("--join", action="store_true")
    p.add_argument("--keep-similar", action="store_true", help="leave topics with similar labels apart")
    p.add_argument("--html", action="store_true", help="write a page for each document as well")
    p.add_argument("--label", default="run")
    p.add_argument("--repeats", type=int, default=3)
    p.add_argument("--warmup", type=int, default=0)
    return p.parse_args(argv)


SPLITTERS = {"sparse": lambda d: tokens.sparse_sentences(d, 12, 24, 4), "normalised": tokens.normalised_sentences, "hard": tokens.hard_sentences}


def answerer(spark: SparkSession, a: argparse.Namespace, docs: DataFrame):
    """How requests are answered: by the server behind the cache, or by the stand-in."""
    if a.host:
        cache = a.cache or scratch(spark, "cache")
        return lambda requests: rounds.answer(requests.withColumn("temperature", F.lit(a.temperature)), models.Completion(a.host, a.model), cache)
    marks = lambda c: F.regexp_extract_all(c, F.lit(r"\{(\d+)\} "), F.lit(1))

    def stand_in(requests: DataFrame) -> DataFrame:
        n = F.size(marks(F.col("prompt")))
        topic = F.when(n > 0, F.concat(F.lit("General>Text: 0-"), (n - 1).cast("string"))).otherwise("General>Text: 0")
        content = F.when(F.col("namespace") == "keyword", stub.keyword_response(n.cast("long"))).when(F.col("namespace").isin("topic-range", "insight"), topic).otherwise("PREVIOUS")
        return requests.select("doc_id", "seq", content.alias("content"))

    return stand_in


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, text, original) with HTML cleaned, their offset maps, and files that failed (doc_id, error)."""
    found = materialise(files.corpus(spark, *paths), "corpus")
    good = found.where("status = 'ok'")
    pages = materialise(cleaning.clean_table(good.where("is_html").select("doc_id", "text")), "cleaned")
    plain = good.where("not is_html").select("doc_id", "text", F.col("text").alias("original"))
    cleaned = pages.select("doc_id", "text").join(good.select("doc_id", F.col("text").alias("original")), "doc_id")
    return materialise(plain.unionByName(cleaned), "docs"), pages, found.where("status <> 'ok'").select("doc_id", "error")


def restored(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with start and end in the source: those of cleaned pages are mapped back, others stay."""
    html = rows.join(pages.select("doc_id"), "doc_id", "left_semi")
    return rows.join(pages.select("doc_id"), "doc_id", "left_anti").unionByName(cleaning.restore_spans(html, pages))


def run(spark: SparkSession, a: argparse.Namespace, docs: DataFrame, pages: DataFrame) -> tuple[DataFrame, sessions.Result]:
    """(doc_id, json) of every document, and the result behind it."""
    answer = answerer(spark, a, docs)
    if a.what == "keywords":
        out = sessions.drive(sessions.keyworded(docs, a.min_gap_words, min(a.max_chars, 12_000)), answer)
        return reports.topics_json(docs, restored(out.groups, pages)), out
    split = SPLITTERS[a.splitter]
    if a.what == "insights":
        out = sessions.drive(sessions.insights(docs, split, a.max_chars), answer)
        groups = out.groups.withColumnRenamed("name", "label")
    else:
        plan = sessions.segmented(docs, split, a.gap, a.reassign, a.boundaries, a.join, not a.keep_similar, most=a.max_chars)
        out = sessions.drive(plan, answer)
        groups = out.groups
    return files.results_json(restored(out.items, pages), groups), out


def bench(spark: SparkSession, a: argparse.Namespace, docs: DataFrame, pages: DataFrame, failed: DataFrame) -> int:
    """Each document on its own, warm-up runs first; a run that fails is a row. Files are written after every document."""
    names = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").toLocalIterator()]
    payload = {"schema_version": 1, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "label": a.label, "model": a.model, "host": a.host or "", "splitter": a.splitter, "config": {"gap": a.gap, "max_chars": str(a.max_chars)}, "documents": [], "runs": [], "warmups": [], "complete": False}
    payload["runs"] += [{"document_id": r.doc_id, "repeat": 0, "status": "error", "elapsed_seconds": None, "error": r.error} for r in failed.collect()]
    paths, coverage = reports.output_names(a.out, a.label), []
    for name in names:
        one = docs.where(F.col("doc_id") == name)
        text = one.first().original
        payload["documents"].append({"id": name, "path": name, "sha256": one.select(F.sha2("original", 256)).first()[0], "input_chars": len(text)})
        for k in range(a.warmup + a.repeats):
            began, status, error = time.perf_counter(), "ok", None
            try:
                out = sessions.drive(sessions.segmented(one, SPLITTERS[a.splitter], a.gap, a.reassign, a.boundaries, a.join, not a.keep_similar, most=a.max_chars), answerer(spark, argparse.Namespace(**{**vars(a), "cache": None}), one))
                groups = materialise(out.groups, "groups")
                if not out.errors.isEmpty():
                    status, error = "error", out.errors.first().error
            except Exception as e:  # a run that fails is a row of the benchmark
                status, error = "error", f"{type(e).__name__}: {e}"
            row = {"document_id": name, "repeat": k - a.warmup, "status": status, "elapsed_seconds": time.perf_counter() - began, "error": error}
            payload["warmups" if k < a.warmup else "runs"].append(row)
        if status == "ok":
            coverage += [r.asDict() for r in metrics.coverage(groups, tokens.counts_of_sentences(one, out.items)).select("doc_id", "coverage").collect()]
        payload["complete"] = name == names[-1]
        reports.write_whole(paths[0], json.dumps(payload, indent=1))
    schema = "label string, status string, elapsed_seconds double"
    rows = spark.createDataFrame([(a.label, r["status"], r["elapsed_seconds"]) for r in payload["runs"]], schema)
    reports.write_whole(paths[1], reports.bench_page([payload], [r.asDict() for r in metrics.latency(rows, "label").collect()], coverage))
    return int(any(r["status"] != "ok" for r in payload["runs"]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if every document went through, 1 if one failed, 130 if interrupted."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    try:
        docs, pages, failed = read(spark, a.paths)
        if a.what == "bench":
            return bench(spark, a, docs, pages, failed)
        results, out = run(spark, a, docs, pages)
        results = materialise(results, "results")
        results.write.mode("overwrite").parquet(os.path.join(a.out, "json"))
        if a.html:
            reports.document_reports(docs.select("doc_id", F.col("original").alias("text")), results).select("doc_id", "html").write.mode("overwrite").parquet(os.path.join(a.out, "html"))
        bad = failed.unionByName(out.errors.select("doc_id", "error")).where("error is not null")
        bad.write.mode("overwrite").parquet(os.path.join(a.out, "errors"))
        return int(not spark.read.parquet(os.path.join(a.out, "errors")).isEmpty())
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
