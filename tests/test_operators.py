"""Operators on the literal cases that their semantics are known by."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as fx
from corvane.operators import cleaning, decisions, gaps, metrics, parsing, refine, tokens
from corvane.plans import rounds

GROUPS = "doc_id int, gi int, ri int, label array<string>, s bigint, e bigint"


def groups(spark, spec):
    """{label: [(s, e), ...]} of document 1."""
    return spark.createDataFrame([(1, g, r, label.split(">"), s, e) for g, (label, spans) in enumerate(spec) for r, (s, e) in enumerate(spans)], GROUPS)


def counts(spark, n):
    return spark.createDataFrame([(1, n)], "doc_id int, n bigint")


def shape(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.gi, r.ri)):
        out.setdefault((r.gi, ">".join(r.label)), []).append((r.s, r.e))
    return [(label, spans) for (_, label), spans in sorted(out.items())]


@pytest.mark.parametrize(
    ("response", "n", "want"),
    [
        ("Garden>Trees>Apple: 1, 3, 5-8", 9, [("Garden>Trees>Apple", [(1, 1), (3, 3), (5, 8)])]),
        ("Music>Jazz>Take-5: 2-70", 7, [("Music>Jazz>Take-5", [(2, 6)])]),
        ("Music>Choir: 4-1", 8, [("Music>Choir", [(1, 4)])]),
        ("Garden>Soil: often, 0-1, --, 6", 8, [("Garden>Soil", [(0, 1), (6, 6)])]),
        ("Tech>Claude&nbsp;Tag: 0-1\nTech>Claude  Tag: 3-4", 5, [("Tech>Claude Tag", [(0, 1), (3, 4)])]),
        ("Technology>Cloud>AWS: Security: IAM: 1-2", 5, [("Technology>Cloud>AWS>Security>IAM", [(1, 2)])]),
        ("just some text", 5, []), ("", 5, []), ("A: 1", 0, []),
    ],
)
def test_topics(spark, response, n, want):
    rows = spark.createDataFrame([(1, response, n)], "doc_id int, response string, n bigint")
    found = parsing.parse_topics(rows)
    assert shape(found) == want
    assert parsing.topic_errors(rows, found).count() == (not want)


def test_other_answers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(parsing.boundary_shift(F.lit(x), 3)) for x in ("CORRECT", "SHIFT_LEFT 10", "SHIFT_LEFT", "", "shift_right 1")] == [0, 3, 0, 0, -1]
    assert [one(parsing.gap_decision(F.lit(x))) for x in ("PREVIOUS", "next", "NEW: A > B", "I cannot decide", "maybe next")] == ["previous", "next", "new", "unknown", "next"]
    assert one(parsing.new_topic(F.lit("NEW: Technology > AI > Agentic Workflows"))) == ["Technology", "AI", "Agentic Workflows"]
    rows = spark.createDataFrame([(1, "0, 3, 7-10, 15, 10-7, 19-30", 20)], "doc_id int, response string, n bigint")
    assert sorted((r.s, r.e) for r in parsing.parse_keywords(rows).collect()) == [(0, 0), (3, 3), (7, 10), (15, 15)]


@pytest.mark.parametrize(
    ("spec", "n", "want"),
    [
        ([("A", [(2, 4)])], 5, [("A", [(0, 4)])]),
        ([("A", [(0, 1)]), ("B", [(3, 4)])], 5, [("A", [(0, 2)]), ("B", [(3, 4)])]),
        ([("A", [(0, 3)]), ("B", [(2, 4)])], 5, [("A", [(0, 3)]), ("B", [(4, 4)])]),
        ([("A", [(2, 3)]), ("B", [(6, 8)]), ("C", [(7, 8)])], 10, [("A", [(0, 5)]), ("B", [(6, 9)])]),
    ],
)
def test_repair(spark, spec, n, want):
    assert shape(gaps.repair(groups(spark, spec), counts(spark, n))) == want


@pytest.mark.parametrize(("answer", "want"), [
    ("PREVIOUS", [("A", [(0, 1)]), ("B", [(2, 2)])]), ("NEXT", [("A", [(0, 0)]), ("B", [(1, 2)])]), ("I cannot decide", [("A", [(0, 1)]), ("B", [(2, 2)])]),
    ("NEW: T > U", [("A", [(0, 0)]), ("B", [(2, 2)]), ("T>U", [(1, 1)])]),
])
def test_model_repair(spark, answer, want):
    g, c = groups(spark, [("A", [(0, 0)]), ("B", [(2, 2)])]), counts(spark, 3)
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(["one", "two", "three"])], "doc_id int, idx int, text string")
    resolved = gaps.resolve(g, c, s)
    assert [(r.idx, r.owner) for r in resolved.collect()] == [(1, None)]
    answers = spark.createDataFrame([(1, 1, answer)], "doc_id int, idx bigint, answer string")
    assert shape(gaps.apply_answers(g, resolved, answers)) == want
    assert "<GAP>two</GAP>" in gaps.prompts(resolved, gaps.context(resolved, gaps.ownership(g), s), g, s).first().prompt


@pytest.mark.parametrize(("answer", "want"), [
    ("SHIFT_LEFT 1", [("A", [(0, 2)]), ("B", [(3, 3)])]), ("SHIFT_RIGHT 1", [("A", [(0, 0)]), ("B", [(1, 3)])]), ("SHIFT_LEFT 10", [("A", [(0, 3)])]), ("CORRECT", [("A", [(0, 1)]), ("B", [(2, 3)])]),
])
def test_shifts(spark, answer, want):
    g = groups(spark, [("A", [(0, 1)]), ("B", [(2, 3)])])
    assert shape(refine.apply_shifts(g, spark.createDataFrame([(1, 1, answer)], "doc_id int, idx bigint, answer string"))) == want


def test_merge_and_join(spark):
    assert shape(refine.merge_similar(groups(spark, [("Machine Learning", [(0, 1)]), ("MachineLearning", [(2, 3)])]))) == [("Machine Learning", [(0, 3)])]
    assert shape(refine.join_adjacent(groups(spark, [("A", [(0, 1)]), ("A", [(2, 3)]), ("B", [(4, 4)]), ("A", [(5, 5)])]))) == [("A", [(0, 3)]), ("B", [(4, 4)]), ("A", [(5, 5)])]


def test_cleaning():
    clean = lambda t, f=cleaning.tag_spans: cleaning.clean(t, f)[0]
    assert cleaning.clean("A<b>B</b>C")[1] == [(0, 0, 1), (1, 1, 1), (2, 4, 1), (3, 5, 1), (4, 9, 1)]
    assert [clean(t) for t in ("Hello<br/>world", "<br><hr><img/>", "AB<script>ignored</script>CD", "")] == ["Hello world", "", "AB CD", ""]
    parsed = [clean(t, cleaning.parser_spans) for t in ("Math: 3 < 10 > 2 and heart <3>", "X<script>bad<p>Y</p>", "<style/>A<b>B</b>")]
    assert parsed == ["Math: 3 < 10 > 2 and heart <3>", "X", "A B"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fx.normalise(F.lit("&amp;nbsp;‌  hello  ​  world  "))) == "hello world"
    assert [one(fx.content_free(F.lit(x))) for x in ("...---", "42")] == [True, False]
    assert [one(fx.fit_text(F.lit("abcdefghij"), n)) for n in (5, 2, 1, 10)] == ["ab…ij", "a…", "a", "abcdefghij"]
    assert one(fx.looks_repetitive(F.lit("word " * 200))) and not one(fx.looks_repetitive(F.lit("word " * 50)))


def test_chunks():
    lines = [f"{{{i}}} Sentence number {i}." for i in range(20)]
    cut = tokens.balanced_chunks("\n".join(lines), 120, 30)
    assert all(len("\n".join(c)) <= 120 for c in cut) and list(dict.fromkeys(x for c in cut for x in c)) == lines
    assert tokens.balanced_chunks("short", 120, 30) == [["short"]] and all(len(x) <= 20 for c in tokens.balanced_chunks("{7} " + "x" * 100, 20, 0) for x in c)


def test_metrics(spark):
    g = groups(spark, [("A>one", [(0, 1), (1, 2)]), ("A>one", [(2, 2)]), ("A>two", [(2, 3)]), ("B", [(3, 3)])])
    c = metrics.coverage(g, counts(spark, 5)).first()
    assert (c.n_covered, c.n_multiple, c.coverage) == (4, 2, 0.8)
    assert {r.path: r.n_children for r in metrics.hierarchy(g).collect()} == {"": 2, "A": 2, "A>one": 0, "A>two": 0, "B": 0}


def test_decisions(spark):
    p = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.2)], "doc_id int, idx int, probability double")
    assert [(r.s, r.e) for r in decisions.sections(p, counts(spark, 4)).orderBy("s").collect()] == [(0, 1), (2, 3)]
    assert decisions.batches(counts(spark, 4), 2).count() == 2


def echo(folder):
    """A client whose class is sent to workers by value."""

    class Echo:
        model_id = "echo"

        def __init__(self, folder):
            self.folder = folder

        def call(self, prompt, temperature):
            open(os.path.join(self.folder, os.urandom(8).hex()), "w").close()
            if prompt == "bad":
                raise RuntimeError("no")
            return "<think>hm</think> " + prompt.upper()

    return Echo(folder)


def test_rounds_call_each_prompt_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(1, 0, "n", "a", 0.0), (2, 0, "n", "a", 0.0), (3, 0, "n", "bad", 0.0)], "doc_id int, seq int, namespace string, prompt string, temperature double")
    for k in (1, 2):
        got = {r.doc_id: (r.content, r.error) for r in rounds.answer(rows, echo(str(calls)), str(tmp_path / "cache"), retries=0, backoff=0.0).collect()}
        assert got[1] == got[2] == ("A", None) and got[3] == (None, "RuntimeError: no")
        assert len(list(calls.iterdir())) == 1 + k  # the failure is tried again
    with pytest.raises(ValueError, match="namespace"):
        rounds.answer(rows.withColumn("namespace", F.lit(" ")), echo(str(calls)), str(tmp_path / "cache"))
