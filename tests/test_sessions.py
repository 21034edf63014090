import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from corvane import cli, reports
from corvane.operators import cleaning, decisions, keywords, tokens
from corvane.plans import rounds, sessions, trace
from corvane.sources import files, models

TEXT = "Alpha beta gamma delta. Second sentence is here. Third one follows now. Fourth closes it."


def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, "One here. Two there."), (3, None), (4, " ")], "doc_id long, text string")


def answers(requests, content):
    return requests.select("doc_id", "seq", content.alias("content"))


def test_session_rounds(spark):
    s = sessions.Session(sessions.segmented(docs(spark), gap="ask", decode=False))
    assert not s.is_complete and {r.namespace for r in s.pending.collect()} == {"topic-range"}
    with pytest.raises(RuntimeError):
        s.result  # noqa: B018
    with pytest.raises(ValueError, match="one answer"):
        s.submit(answers(s.pending, F.lit("A: 0")).limit(1))
    s.submit(answers(s.pending, F.when(F.col("doc_id") == 1, "A>x: 0\nB: 3").otherwise("A: 0-1")))
    assert {(r.doc_id, r.seq, r.namespace) for r in s.pending.collect()} == {(1, 1, "gap"), (1, 2, "gap")}
    s.submit(answers(s.pending, F.when(F.col("seq") == 1, "NEXT").otherwise("NEW: C>y")))
    assert s.is_complete
    assert sorted((r.doc_id, tuple(r.label), r.s, r.e) for r in s.result.groups.collect() if r.doc_id == 1) == [(1, ("A", "x"), 0, 0), (1, ("B",), 1, 1), (1, ("B",), 3, 3), (1, ("C", "y"), 2, 2)]
    with pytest.raises(RuntimeError):
        s.submit(answers(docs(spark).withColumn("seq", F.lit(0)), F.lit("x")))


def test_refining_rounds_and_two_stages(spark):
    seen = []

    def answer(requests):
        rows = requests.collect()
        seen.append(rows[0].namespace if rows else None)
        say = {"topic-extract": "A\nB", "topic-assign": "A: 0-1\nB: 2-3", "reassign": "NEXT", "boundary": "SHIFT_LEFT 1"}
        return answers(requests, F.coalesce(*[F.when(F.col("namespace") == k, v) for k, v in say.items()]))

    one = docs(spark).where("doc_id = 1")
    out = sessions.drive(sessions.segmented(one, two_stage=True, reassign=True, boundaries=True, join=True, shortest=26, decode=False), answer)
    assert seen == ["topic-extract", "topic-assign", "reassign", "boundary"] and out.errors.isEmpty()
    assert sum(r.e - r.s + 1 for r in out.groups.collect()) == 4
    assert sessions.drive(sessions.segmented(one, decode=False), lambda r: answers(r, F.lit("nothing"))).errors.count() == 1
    with pytest.raises(ValueError, match="no client"):
        sessions.by_namespace({})(sessions.Session(sessions.segmented(one)).pending)


def test_label_rounds_stop(spark):
    bodies = spark.createDataFrame([(1, k, f"body {k}") for k in range(5)], "doc_id long, ri int, body string")
    out = sessions.drive(sessions.labelled(bodies, retries=1), lambda r: answers(r, F.lit("1: A\n2: B>c")))
    assert out.groups.count() == 4 and [r.error for r in out.errors.collect()] == ["no label for section 4"]


def test_open_runs_and_merge_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        own = [(3 * i, 3 * i + 2) for i in range(rng.randrange(12))]
        spans = [(s := rng.randrange(36), s + 1 + rng.randrange(9)) for _ in range(rng.randrange(4))]
        free = [not any(e > s and a < z for s, z in spans) for a, e in own]
        runs = list(keywords.open_runs(own, spans))
        assert [any(s <= i <= e for s, e in runs) for i in range(len(own))] == free and all(s == 0 or not free[s - 1] for s, _ in runs)
        found = [{"seq": None if k < 2 else rng.randrange(5), "start": (s := rng.randrange(30)), "end": s + 1 + rng.randrange(5), "text": ""} for k in range(rng.randrange(8))]
        slow = [k for k in found if k["seq"] is None]
        for k in sorted((k for k in found if k["seq"] is not None), key=lambda k: (k["seq"], k["start"], k["end"])):
            if not any(k["end"] > x["start"] and k["start"] < x["end"] for x in slow):
                slow.append(k)
        assert keywords.accepted(found) == slow


def test_requests_fit(spark):
    sentences = [{"id": i + 1, "paragraph_break_before": False, "text": "word " * (400 if i == 7 else 20)} for i in range(20)]
    for window in (None, 100_000, 3000, 1500, 700):
        got = list(decisions.fit(sentences, window))
        assert [k for a, b, _ in got for k in range(a, b + 1)] == list(range(2, 21))
        assert not window or all(decisions.tokens_of(p, b - a + 1) <= window for a, b, p in got)
    with pytest.raises(ValueError, match="does not fit"):
        list(decisions.fit(sentences, 300))
    d = spark.createDataFrame([(1, "One. Two. Three. Four.")], "doc_id long, text string")
    rows = decisions.fitting_requests(decisions.content(d, tokens.hard_sentences(d)), 2000, 2).collect()
    assert [(r.first_gap, r.last_gap) for r in rows] == [(2, 3), (4, 4)] and decisions.fitting_requests(decisions.content(d, tokens.hard_sentences(d)), 10).first().error


def test_trace():
    t = trace.Tracer()
    with pytest.raises(KeyError), t.span("outer", n=3, zero=0):
        with t.span("inner"):
            t.add(chars=7)
        raise KeyError("x")
    lines = t.format().split("\n")
    assert lines[0].startswith("outer (") and "n=3" in lines[0] and "zero" not in lines[0] and "KeyError" in lines[0] and lines[1].startswith("  inner") and "chars=7" in lines[1]


def test_scheduled_retries(spark, tmp_path):
    client = models.Function(lambda prompt, temperature: f"fine {temperature}" if "try again" in prompt else "", "m")
    rows = spark.createDataFrame([(1, 0, "n", "ask", 1.8)], "doc_id long, seq long, namespace string, prompt string, temperature double")
    got = rounds.scheduled(rows, client, str(tmp_path / "c"), [("", 0.1), (" try again", 0.5)], retries=0).collect()
    assert [(r.content, r.error, r.attempt, r.prompt_chars, r.response_chars) for r in got] == [("fine 2.0", None, 2, 13, 8)]


class Server(BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.calls.append((self.path, body))
        code = 400 if "bad" in json.dumps(body) else 503 if self.path.endswith("systemone") and len(self.calls) < 3 else 200
        out = {"choices": [{"message": {"content": "<think>why</think> A: 0"}}], "answers": {}}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *args):
        pass


def test_clients_against_a_local_server():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert "A: 0" in models.Completion(url).call("hello", 0.5) and Server.calls[-1][1]["messages"][0]["content"] == "hello" and Server.calls[-1][1]["cache_prompt"]
    with pytest.raises(ValueError, match="400"):
        models.Completion(url).call("bad", 0.0)
    Server.calls.clear()
    assert json.loads(models.Decisions(url).call(json.dumps({"state": {}, "questions": []}), 0.0))["answers"] == {} and len(Server.calls) == 3
    assert models.Concurrent(models.Completion(url), 2).call_many([("a", 0.0), ("b", 0.0)])[0] == models.Completion(url).call("a", 0.0)
    server.shutdown()
    with pytest.raises(ValueError, match="option"):
        models.choice("x", {"a": " "})


def test_files_and_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    (tmp_path / "in" / "b.HTML").write_text("<p>One &amp; only here.</p><script>x</script><p>Two <b>there</b> again.</p>")
    (tmp_path / "in" / "c.md").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "d.csv").write_text("x")
    found = {r.path.rsplit("/", 1)[1]: r for r in files.corpus(spark, str(tmp_path / "in")).collect()}
    assert set(found) == {"a.txt", "b.HTML", "c.md"} and found["b.HTML"].is_html and found["c.md"].status == "error" and found["a.txt"].text == TEXT
    for path in ("missing", "in/d.csv"):
        with pytest.raises(ValueError, match=path.rsplit("/")[-1]):
            files.corpus(spark, str(tmp_path / path))
    out = str(tmp_path / "out")
    assert cli.main(["topics", str(tmp_path / "in"), "--out", out, "--splitter", "hard", "--html"], spark) == 1
    rows = {r.doc_id.rsplit("/", 1)[1]: json.loads(r.json) for r in spark.read.parquet(f"{out}/json").collect()}
    html = (tmp_path / "in" / "b.HTML").read_text()
    first = rows["b.HTML"]["sentences"][0]
    assert html[first["start"] : first["start"] + 3] == "One" and rows["a.txt"]["groups"][0]["ranges"] == [{"start": 0, "end": 3}]
    assert all("<script" not in r.html and "<details" in r.html for r in spark.read.parquet(f"{out}/html").collect())
    (tmp_path / "in" / "c.md").unlink()
    assert cli.main(["keywords", str(tmp_path / "in"), "--out", out], spark) == 0 and json.loads(spark.read.parquet(f"{out}/json").first().json)["keywords"]
    assert cli.main(["bench", str(tmp_path / "in" / "a.txt"), "--out", out, "--repeats", "1", "--warmup", "1", "--splitter", "hard"], spark) == 0
    name = next(p for p in (tmp_path / "out").glob("run-*.json"))
    payload = json.loads(name.read_text())
    assert payload["complete"] and [r["status"] for r in payload["runs"]] == ["ok"] and len(payload["warmups"]) == 1 and files.load_benchmark(spark, str(name)).first().label == "run"
    assert reports.warnings([payload, {**payload, "label": "b", "config": {}, "documents": []}]) == ["b: another corpus than run", "b: another configuration than run"]
    assert cli.main(["topics", str(tmp_path / "none"), "--out", out], spark) == 1


def test_restored_spans(spark):
    d = spark.createDataFrame([(1, "<p>One two.</p><p>Three</p>"), (2, "plain")], "doc_id long, text string")
    cleaned = cleaning.clean_table(d)
    source = dict(d.collect())
    for r in cleaning.restore_spans(tokens.word_tokens(cleaned.select("doc_id", "text")), cleaned).collect():
        assert source[r.doc_id][r.start : r.start + len(r.text)] == r.text


def test_parser_cleaning_equals_pattern_cleaning_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    a, b = (cleaning.clean_table(pages, parser=p).select("doc_id", "text").collect() for p in (False, True))
    assert sorted(a) == sorted(b)
