"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
every result as Parquet in the shared folder and reads it again, so a stage
starts from a finished table whatever happens to executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language, minhash, mixing, quality
from corvane.llm.common import Scratch, discard, materialise, table

#: A language is kept if its confidence is at least this.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5. Documents go whose language can't be told, or only with little confidence.

    Null and empty texts, and those without a letter, have no language and go.
    If nothing can be learned (no row has a language) no language can be told.
    """
    return language.confident(docs, language.train(docs), MIN_LANGUAGE_SCORE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7. Documents go that the classifier gives less than its threshold. Without labels to learn from all stay."""
    return quality.good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6. Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays.

    Candidates are what op 6's operator links, and for copies that differ in more bits those of MinHash; both are compared as whole sets.
    Texts without words are copies of each other. Repeated rows become one.
    Rows without an id are copies like any other, but all of them stay.
    """
    return minhash.representatives(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9. Documents with a passage of a benchmark item go; null and empty texts have none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10. What the mix takes, with the number of copies of each document. Texts without words are never taken."""
    return mixing.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", remove_near_duplicates),
    ("benchmarks", remove_benchmarks),
    ("mix", mix_sources),
]

#: Stages 1 to 3 can't be told in SQL (trained models, XXH64 shingle sets and their components); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Every stage takes empty tables, null ids and extra columns of any name.

    What a stage writes on its way is deleted when it is done, and its result
    when the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch() as tables:
            if last is not None:
                tables.keep(last)
            docs = tables.keep(materialise(stage(spark, docs, sf_dir), name))
        if last is not None:
            discard(last)
        last = docs
    return docs
