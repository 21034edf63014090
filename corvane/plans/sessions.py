"""Segmentation as a session of request rounds.

A plan is a generator over tables: it yields requests (doc_id, seq, namespace,
prompt, temperature) and gets answers (doc_id, seq, content). A session holds it
between rounds, so that the caller decides how requests are answered, and when.
Every table a later round needs is written before the round is handed out.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import response_error, strip_reasoning
from corvane.operators import decisions, gaps, keywords, parsing, refine, tokens
from corvane.operators.ranges import shuffled
from corvane.plans import prompts
from corvane.plans.pipelines import joined_answers, topic_requests
from corvane.tables import materialise

Plan = Generator[DataFrame, DataFrame, "Result"]
ANSWERED = ("doc_id", "seq")


@dataclass
class Result:
    """What a plan makes: sentences or words, groups or keywords, and the documents that failed (doc_id, error)."""

    items: DataFrame
    groups: DataFrame
    errors: DataFrame


class Session:
    """A plan between its rounds: ``pending`` requests, ``submit`` their answers, in the end ``result``."""

    def __init__(self, plan: Plan) -> None:
        self._plan, self._result, self.pending = plan, None, None
        self._step(None)

    def _step(self, answers: DataFrame | None) -> None:
        try:
            self.pending = materialise(self._plan.send(answers), "requests")
        except StopIteration as end:
            self.pending, self._result = None, end.value
            return
        if self.pending.isEmpty():
            self._step(self.pending.select(*ANSWERED, F.lit(None).cast("string").alias("content")))

    @property
    def is_complete(self) -> bool:
        return self.pending is None

    @property
    def result(self) -> Result:
        if self._result is None:
            raise RuntimeError("requests are pending")
        return self._result

    def submit(self, answers: DataFrame) -> None:
        """Answers to all pending requests, one for each."""
        if self.pending is None:
            raise RuntimeError("no requests are pending")
        answers = materialise(answers.select(*ANSWERED, "content"), "answers")
        asked, got = self.pending.groupBy(*ANSWERED).count(), answers.groupBy(*ANSWERED).count()
        if not asked.exceptAll(got).isEmpty() or not got.exceptAll(asked).isEmpty():
            raise ValueError("every pending request needs one answer")
        self._step(answers)


def drive(plan: Plan, answer: Callable[[DataFrame], DataFrame]) -> Result:
    """Go through all rounds with a function from requests to answers."""
    session = Session(plan)
    while not session.is_complete:
        session.submit(answer(session.pending))
    return session.result


def by_namespace(answers: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """Answer each request by the function of its namespace; one without is an error."""

    def answer(requests: DataFrame) -> DataFrame:
        names = [r[0] for r in requests.select("namespace").distinct().collect()]
        if missing := [str(n) for n in names if n not in answers]:
            raise ValueError(f"no client for namespace {', '.join(sorted(missing))}")
        parts = [answers[n](requests.where(F.col("namespace") == n)).select(*ANSWERED, "content") for n in names]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return answer


def _requests(rows: DataFrame, namespace: str, prompt: Column, seq: str = "seq") -> DataFrame:
    return rows.select("doc_id", F.col(seq).cast("long").alias("seq"), F.lit(namespace).alias("namespace"), prompt.alias("prompt"), F.lit(0.0).alias("temperature"))


def invalid_inputs(groups: DataFrame, counts: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, error: documents whose gaps can't be handled."""
    have = sentences.groupBy("doc_id").agg(F.count("*").alias("k"))
    rows = counts.select("doc_id", "n").join(have, "doc_id", "left").join(groups.select("doc_id").distinct().withColumn("some", F.lit(True)), "doc_id", "left")
    error = F.when(F.col("n") <= 0, "no sentences").when(F.col("some").isNull(), "no groups").when(F.coalesce("k", F.lit(0)) != F.col("n"), "sentences and their number differ")
    return rows.select("doc_id", error.alias("error")).where("error is not null")


def resolved_count(marked: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n: the number of marked items, else of items."""
    n = items.groupBy("doc_id").agg(F.count("*").alias("k"))
    return marked.join(n, "doc_id", "left").select("doc_id", F.coalesce("n_items", "k", F.lit(0)).cast("long").alias("n"))


def _checked(answers: DataFrame) -> DataFrame:
    clean = answers.withColumn("content", strip_reasoning(F.col("content")))
    return clean.withColumn("content", F.when(response_error(F.col("content")).isNull(), F.col("content")))


def segmented(
    docs: DataFrame, split: Callable[[DataFrame], DataFrame] = tokens.hard_sentences, gap: str = "repair", reassign: bool = False, boundaries: bool = False, join: bool = False, merge: bool = True,
    two_stage: bool = False, most: int = 84_000, shortest: int = 40, rules: str = prompts.TOPIC_LINES, namespace: str = "topic-range", decode: bool = True,
) -> Plan:
    """Topics of every document: split, mark, ask, parse, close gaps (``repair``, ``ask`` or ``strict``), refine, join, merge.

    ``two_stage`` asks for the topics first and then assigns lines to them. A
    document whose answers can't be used is in the result's errors.
    """
    sentences = materialise(split(docs), "sentences")
    counts = materialise(tokens.counts_of_sentences(docs, sentences), "counts")
    marked = materialise(tokens.mark_sentences(docs, sentences), "marked")
    if two_stage:
        first = yield topic_requests(marked, most, rules=prompts.EXTRACT_TOPICS, namespace="topic-extract")
        found = joined_answers(_checked(first), counts).select("doc_id", F.col("response").alias("topics"))
        chunks = tokens.chunks(marked, most).join(found, "doc_id").withColumnRenamed("chunk_id", "seq")
        answers = yield _requests(chunks, "topic-assign", prompts.assign("topics", "tagged_text"))
    else:
        answers = yield topic_requests(marked, most, rules=rules, namespace=namespace)
    responses = materialise(joined_answers(_checked(answers), counts), "responses")
    groups = materialise(parsing.parse_topics(responses, decode), "groups")
    errors = counts.select("doc_id").join(groups.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no topic ranges in response"))
    if gap == "ask":
        resolved = materialise(gaps.resolve(groups, counts, sentences), "resolved")
        pending = resolved.where("owner is null")
        around = gaps.context(pending, gaps.ownership(groups), sentences)
        asked = gaps.prompts(pending, around, groups, sentences)
        answers = yield _requests(asked, "gap", F.col("prompt"), "idx")
        groups = gaps.apply_answers(groups, resolved, answers.select("doc_id", F.col("seq").cast("int").alias("idx"), F.col("content").alias("answer")))
    elif gap == "strict":
        errors = errors.unionByName(gaps.strict_errors(groups, counts).where("error is not null and error <> 'no groups'"))
        groups = gaps.strict(groups, counts)
    else:
        groups = gaps.repair(groups, counts)
    groups = materialise(groups, "whole")
    if reassign:
        owned = refine.owners(groups)
        asked = materialise(refine.short_candidates(owned, sentences, shortest), "short")
        answers = yield _requests(refine.reassign_context(asked, owned, sentences), "reassign", prompts.reassign("text", "before", "after"))
        groups = materialise(refine.apply_reassignments(groups, asked, answers.select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("content").alias("answer"))), "reassigned")
    if boundaries:
        around = refine.boundary_context(refine.owners(groups), sentences)
        answers = yield _requests(around, "boundary", prompts.boundary("left_text", "right_text"), "idx")
        groups = materialise(refine.apply_shifts(groups, answers.select("doc_id", F.col("seq").cast("int").alias("idx"), F.col("content").alias("answer"))), "shifted")
    if join:
        groups = refine.join_adjacent(groups)
    if merge:
        groups = refine.merge_similar(groups)
    return Result(sentences, groups, errors)


def insights(docs: DataFrame, split: Callable[[DataFrame], DataFrame] = tokens.hard_sentences, most: int = 84_000) -> Plan:
    """Named insights with their ranges; they need not cover the document."""
    sentences = materialise(split(docs), "sentences")
    counts = materialise(tokens.counts_of_sentences(docs, sentences), "counts")
    answers = yield topic_requests(tokens.mark_sentences(docs, sentences), most, rules=prompts.INSIGHT_LINES, namespace="insight")
    responses = materialise(joined_answers(_checked(answers), counts), "responses")
    groups = parsing.parse_insights(responses)
    errors = counts.select("doc_id").join(groups.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no insights in response"))
    return Result(sentences, groups, errors)


def _once(answers: DataFrame) -> DataFrame:
    """doc_id, response: the different index tokens of a document's answers, in order, spelled as first seen."""
    found = F.regexp_extract_all("content", F.lit(r"([0-9]+\s*-\s*[0-9]+|[0-9]+)"), F.lit(0))
    rows = answers.select("doc_id", "seq", F.posexplode(found).alias("k", "token")).withColumn("key", F.regexp_replace("token", r"\s", ""))
    first = rows.groupBy("doc_id", "key").agg(F.min(F.struct("seq", "k", "token")).alias("x"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"]), ", ").alias("response"))


def keyworded(docs: DataFrame, min_gap_words: int = 20, most: int = 12_000, overlap: int = 20, max_keywords: int = 50) -> Plan:
    """Keywords of every document; long runs of words that they leave out are marked from 0 and asked about again."""
    marked = materialise(tokens.mark_words(docs), "words")
    chunks = tokens.chunks(marked, most, overlap, by_words=True).withColumnRenamed("chunk_id", "seq")
    answers = yield _requests(chunks, "keyword", prompts.keyword("tagged_text", max_keywords))
    responses = _once(_checked(answers)).join(marked.select("doc_id", F.col("n_items").alias("n")), "doc_id")
    old = materialise(keywords.build(parsing.parse_keywords(responses), docs), "keywords")
    runs = materialise(keywords.gaps(docs, old, min_gap_words), "runs")
    # A run is a document of its own: its words are numbered from 0, and found spans are moved by where it starts.
    own = materialise(runs.select(F.struct("doc_id", "ri").alias("doc_id"), "text", "start"), "gap_texts")
    again = tokens.mark_words(own.select(F.to_json("doc_id").alias("doc_id"), "text"))
    again = again.select(F.from_json("doc_id", own.schema["doc_id"].dataType).alias("x"), "tagged_text", "n_items").select("x.doc_id", F.col("x.ri").alias("seq"), "tagged_text", "n_items")
    again = materialise(again, "gap_words")
    answers = yield _requests(again, "keyword", prompts.keyword("tagged_text", max_keywords))
    got = _checked(answers).where("content is not null").join(again.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("n_items").alias("n")), list(ANSWERED))
    key = F.struct("doc_id", F.col("seq").cast("int").alias("ri"))
    spans = parsing.parse_keywords(got.select(F.to_json(key).alias("doc_id"), "n", F.col("content").alias("response")))
    texts = own.select(F.to_json("doc_id").alias("doc_id"), "text", F.col("start").alias("moved"))
    new = keywords.build(spans, texts).join(texts.select("doc_id", "moved"), "doc_id").select(F.from_json("doc_id", own.schema["doc_id"].dataType)["doc_id"].alias("doc_id"), (F.col("start") + F.col("moved")).cast("int").alias("start"), (F.col("end") + F.col("moved")).cast("int").alias("end"), "text")
    merged = keywords.merge(old, new.withColumn("seq", F.col("start").cast("long")))
    return Result(tokens.word_tokens(docs), merged, docs.select("doc_id", F.lit(None).cast("string").alias("error")).limit(0))


def labelled(bodies: DataFrame, retries: int = 2, most: int = decisions.LABEL_CHARS, count: int = decisions.SECTIONS) -> Plan:
    """Labels (doc_id, ri, label) of sections (doc_id, ri, body); sections without one are asked about again, numbered from 1 in each request."""
    left, done = materialise(bodies, "bodies"), None
    for _ in range(1 + retries):
        packed = materialise(decisions.label_batches(left, most, count), "packed")
        lines = shuffled(packed).join(left, ["doc_id", "ri"]).select("doc_id", "batch", "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("body")).alias("line"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n")
        asked = lines.groupBy("doc_id", "batch").agg(text.alias("text"), F.max("number").alias("n"))
        answers = yield _requests(asked, "topic-labels", prompts.over(prompts.LABELS, "text"), "batch")
        got = shuffled(_checked(answers).where("content is not null")).join(asked.select("doc_id", F.col("batch").cast("long").alias("seq"), "n"), list(ANSWERED))
        key = F.to_json(F.struct("doc_id", F.col("seq").cast("int").alias("batch")))
        named = parsing.parse_labels(got.select(key.alias("doc_id"), "n", F.col("content").alias("response")))
        kind = packed.select(F.struct("doc_id", "batch").alias("x")).schema["x"].dataType
        named = named.select(F.from_json("doc_id", kind).alias("x"), F.col("section").alias("number"), "label").select("x.*", "number", "label")
        new = materialise(shuffled(packed).join(named, ["doc_id", "batch", "number"]).select("doc_id", "ri", "label"), "labels")
        done = new if done is None else materialise(done.unionByName(new), "labels")
        left = materialise(left.join(shuffled(new), ["doc_id", "ri"], "left_anti"), "left")
    return Result(bodies, done, left.select("doc_id", F.concat(F.lit("no label for section "), F.col("ri").cast("string")).alias("error")))


# --- batches that run elsewhere -----------------------------------------------


def prepare(docs: DataFrame, path: str, split: Callable[[DataFrame], DataFrame] = tokens.hard_sentences, most: int = 84_000) -> DataFrame:
    """Write what ``finalize`` needs below ``path`` and give the requests, which are answered elsewhere and at any time."""
    spark = docs.sparkSession
    split(docs).write.parquet(f"{path}/sentences")
    sentences = spark.read.parquet(f"{path}/sentences")
    tokens.counts_of_sentences(docs, sentences).write.parquet(f"{path}/counts")
    topic_requests(tokens.mark_sentences(docs, sentences), most, rules=prompts.TOPIC_LINES).write.parquet(f"{path}/requests")
    return spark.read.parquet(f"{path}/requests")


def finalize(spark: SparkSession, path: str, answers: DataFrame, decode: bool = True) -> Result:
    """Groups from prepared tables and answers (doc_id, seq, content): parsed and repaired, similar topics left apart."""
    sentences, counts = spark.read.parquet(f"{path}/sentences"), spark.read.parquet(f"{path}/counts")
    groups = materialise(parsing.parse_topics(materialise(joined_answers(_checked(answers), counts), "responses"), decode), "groups")
    errors = counts.select("doc_id").join(groups.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no topic ranges in response"))
    return Result(sentences, gaps.repair(groups, counts), errors)
