"""HTML without scripts: a page for each document's result, and one for benchmark runs."""

from __future__ import annotations

import datetime
import html
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.s{color:#777}mark{background:#fe9}"


def page(title: str, *parts: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def table(head: list[str], rows: list[list[object]]) -> str:
    cell = lambda x: "–" if x is None else f"{x:.3f}" if isinstance(x, float) else html.escape(str(x))
    lines = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in row) + "</tr>" for row in rows)
    return "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + f"</tr>{lines}</table>"


def meter(value: float) -> str:
    return f"<meter min='0' max='1' value='{min(max(value, 0.0), 1.0):.3f}'></meter> {value:.1%}"


def document_page(doc_id: object, text: str | None, result: str | None) -> str:
    """Groups with their sentences, the sentences in order, and the text, from a result in JSON."""
    found = json.loads(result or "{}")
    sentences, groups = found.get("sentences") or [], found.get("groups") or []
    seen = {s["index"]: s["text"] for s in sentences}
    parts = []
    for g in groups:
        label = g["label"] if isinstance(g["label"], str) else " > ".join(g["label"])
        body = "".join("<p>" + " ".join(f"<span class='s'>{i}</span> {html.escape(seen.get(i, ''))}" for i in range(r["start"], r["end"] + 1)) + "</p>" for r in g["ranges"])
        parts.append(f"<details open><summary><b>{html.escape(label)}</b></summary>{body}</details>")
    listed = table(["#", "start", "end", "text"], [[s["index"], s["start"], s["end"], s["text"]] for s in sentences])
    return page(f"Document {doc_id}", f"<h2>Groups ({len(groups)})</h2>", *parts, f"<h2>Sentences ({len(sentences)})</h2>", listed, f"<h2>Text</h2><pre>{html.escape(text or '')}</pre>")


def document_reports(docs: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, json, html of every document; ``results`` has (doc_id, json). A document without a result has an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [document_page(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pages, pa.string())], ["doc_id", "json", "html"])

    return docs.select("doc_id", "text").join(results, "doc_id", "left").select("doc_id", "text", "json").mapInArrow(run, f"doc_id {kind}, json string, html string")


def keyword_page(doc_id: object, highlighted: str, keywords: list[str]) -> str:
    """``highlighted`` is escaped already (see the keyword operators)."""
    return page(f"Document {doc_id}", f"<h2>Keywords ({len(keywords)})</h2><ul>{''.join(f'<li>{html.escape(k)}</li>' for k in keywords)}</ul><h2>Text</h2><pre>{highlighted}</pre>")


def warnings(payloads: list[dict]) -> list[str]:
    """How runs differ from the first in their corpus or configuration, so that they can't be compared."""
    out = []
    corpus = lambda p: sorted((d["id"], d["sha256"]) for d in p.get("documents", []))
    for p in payloads[1:]:
        if corpus(p) != corpus(payloads[0]):
            out.append(f"{p.get('label')}: another corpus than {payloads[0].get('label')}")
        if p.get("config") != payloads[0].get("config"):
            out.append(f"{p.get('label')}: another configuration than {payloads[0].get('label')}")
    return out


def bench_page(payloads: list[dict], latency: list[dict], coverage: list[dict]) -> str:
    """Collected aggregates of runs (one row a label) and of documents, as tables and meters."""
    notes = "".join(f"<p><b>{html.escape(w)}</b></p>" for w in warnings(payloads))
    rows = [[r.get(k) for k in ("label", "n_runs", "n_failed", "p50", "p95", "pstdev")] for r in latency]
    cover = "".join(f"<tr><td>{html.escape(str(r['doc_id']))}</td><td>{meter(r['coverage'])}</td></tr>" for r in coverage)
    return page("Benchmark", notes, "<h2>Latency</h2>", table(["label", "runs", "failed", "p50", "p95", "deviation"], rows), f"<h2>Coverage</h2><table>{cover}</table>")


def output_names(folder: str, label: str, now: datetime.datetime | None = None) -> tuple[str, str]:
    """Paths of a JSON and an HTML file, named by label and UTC time."""
    stamp = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y%m%dT%H%M%SZ")
    name = "".join(c if c.isalnum() or c in "-_" else "-" for c in label) or "run"
    return os.path.join(folder, f"{name}-{stamp}.json"), os.path.join(folder, f"{name}-{stamp}.html")


def write_whole(path: str, content: str) -> None:
    """Write beside the target and rename, so that a reader sees the old file or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(part, path)


def topics_json(results: DataFrame, keywords: DataFrame) -> DataFrame:
    """doc_id, json: {"keywords": [...]} of each document of ``results`` (doc_id)."""
    k = keywords.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("keywords"))
    return results.select("doc_id").join(k, "doc_id", "left").select("doc_id", F.to_json(F.struct("keywords")).alias("json"))
