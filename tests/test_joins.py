"""Tables with a row for each sentence or range never go through the driver, however small the planner takes them for."""

import pytest

import corvane.catalogue
from corvane.operators import decisions
from corvane.plans import pipelines, sessions

NAMES = ["decision_ranges", "section_bodies", "label_batches", "decision_topic_lines", "decision_pipeline", "label_session", "boundary_context", "sentence_join", "short_sentence_reassign"]


def broadcasts(df):
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_not_broadcast(spark, name, monkeypatch):
    """Only tables with a row for each document may be: the joins for counts."""
    found, write = [], corvane.catalogue.materialise

    def watched(df, label):
        found.extend((label, x) for x in broadcasts(df) if label != "counts")
        return write(df, label)

    for module in (corvane.catalogue, pipelines, sessions):
        monkeypatch.setattr(module, "materialise", watched)
    out = corvane.catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found + [("result", x) for x in broadcasts(out)] == []


def test_sections_need_no_join(spark):
    """Repeated, null, first and overlong indices, and documents without sentences or without gaps."""
    p = [(1, 2, 0.9), (1, 2, 0.8), (1, 3, None), (1, 0, 0.9), (1, 7, 0.9), (2, 1, 0.5), (3, 1, 0.9), (9, 1, 0.9)]
    p = spark.createDataFrame(p, "doc_id long, idx long, probability double")
    n = spark.createDataFrame([(1, 5), (2, 2), (3, 0), (4, 1), (None, 3)], "doc_id long, n long")
    out = decisions.sections(p, n)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "int", "int"]
    assert sorted(tuple(r) for r in out.where("doc_id is not null").collect()) == [(1, 0, 0, 1), (1, 1, 2, 4), (2, 0, 0, 0), (2, 1, 1, 1), (4, 0, 0, 0)]
    assert [tuple(r) for r in out.where("doc_id is null").collect()] == [(None, 0, 0, 2)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_packing_goes_through_a_document_once(spark):
    """4000 sections of one document beside others, with limits by number and by size; a section over the limit stands alone."""
    rows = [(1, k, "x" * (k % 50)) for k in range(4000)] + [(2, 0, "y" * 900), (2, 1, None), (3, 0, "")]
    sized = spark.createDataFrame(rows, "doc_id long, ri int, body string").repartition(3)
    want = []
    for doc in (1, 2, 3):
        batch = number = chars = 0
        for _, ri, body in (r for r in rows if r[0] == doc):
            more = len(body or "") + 8
            if number and (number >= 20 or chars + more > 600):
                batch, number, chars = batch + 1, 0, 0
            number, chars = number + 1, chars + more
            want.append((doc, ri, batch, number))
    out = decisions.label_batches(sized, 600, 20)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
