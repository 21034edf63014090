import io
import os
import random
import re
import subprocess
import sys
import time
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane import tables
from corvane.llm import decontaminate, html_extract, language, licenses, mixing, quality, rules, toxicity, warc

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
DOCS = "doc_id long, text string, lang string, source string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0.5) for i, t, lang, src in rows], DOCS)


# --- HTML ----------------------------------------------------------------------

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>x</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>T &amp; U</h1><p>Hello,   world &lt;b&gt; one<br>two <a href=x>link</a></p>
<script>var a="</p>";</script><form><p>Sign up</p></form><p>More,\n text</p></article><section id="comments"><p>nice, very nice, really nice indeed</p></section><footer>f</footer>"""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE, "T & U\n\nHello, world <b> one two link\n\nMore, text"), (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"),
        ("<article><p>unclosed <b>tag", "unclosed tag"), ("<!-- open comment <p>x</p>", ""), ("<article>" + "<div>" * 500 + "deep", "deep"),
    ],
)
def test_html(page, want):
    assert html_extract.extract(page) == want


def test_html_table(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r.n_chars for r in out) == [0, 48, 48] and all(r.n_chars == len(r.text) for r in out)


LONG = "A sentence of the article, with commas, and with words enough to count, as real ones have. " * 4
BODY = f"<p>Short lead.</p>{f'<p>{LONG}</p>' * 30}<h2>Part</h2><ul><li>one</li><li>two</li></ul><blockquote>Said.</blockquote><table><tr><td>cell</td></tr></table>"
AROUND = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>{}<aside>Elsewhere</aside><footer>Imprint</footer>"


@pytest.mark.parametrize(
    "shape",
    [
        "<article><h1>Title</h1><div class='body'>{}</div><div><p>Last words.</p></div></article>",
        "<article><h1>Title</h1><section>{}</section><section><h3>Small</h3><p>Last words.</p></section></article>",
        "<main><h1>Title</h1><div><div>{}</div></div><p>Last words.</p></main>",
        "<main><h1>Title</h1><article><div>{}</div></article><p>Last words.</p></main>",
        "<div class='wrap'><div class='content'><h1>Title</h1><div>{}</div><section><p>Last words.</p></section></div></div>",
        "<h1>Title</h1><div>{}</div><p>Last words.</p>",
    ],
)
@pytest.mark.parametrize("around", [AROUND, "{}"])
def test_nested_pages_keep_the_whole_article(shape, around):
    out = html_extract.extract(f"<html><body>{around.format(shape.format(BODY))}</body></html>").split("\n\n")
    want = ["Title", "Short lead.", *[LONG.strip()] * 30, "Part", "one", "two", "Said.", "cell", "Last words."]
    assert [x for x in out if x != "Small"] == want and ("Small" in out) == ("Small" in shape)


@pytest.mark.parametrize("name", ["has-sidebar", "layout with-sidebar", "post no-comments", "page-header-fixed", "single cookies-not-set", "header", "modal"])
def test_names_of_wrappers_do_not_erase_the_only_article(name):
    page = f"<html><body><nav><a href=a>Home</a></nav><div class='{name}'><article><h1>Title</h1>{BODY}</article></div><footer>f</footer></body></html>"
    assert html_extract.extract(page).startswith("Title\n\nShort lead.") and html_extract.extract(page.replace("article>", "section>")).count(LONG.strip()) == 30


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "cookie-notice", "comments", "commentList", "ad", "ad-banner", "related-posts", "share-links", "newsletter-signup"])
def test_furniture_goes_by_its_name(name):
    page = f"<html><body><div class='{name}'><p>{LONG}Furniture.</p></div><article><h1>Title</h1>{BODY}</article><div id='{name}'><p>Furniture.</p></div></body></html>"
    out = html_extract.extract(page)
    assert "Furniture" not in out and out.startswith("Title")


def slow_points(page):
    """Points, characters and characters in links of every element, by the definition: each block walks up by itself."""
    nodes, found = html_extract._tree(page)
    points, chars, link = {}, {}, {}
    for text, k, node in found:
        up = [node]
        while up[-1].parent is not None:
            up.append(up[-1].parent)
        for n in up:
            chars[id(n)], link[id(n)] = chars.get(id(n), 0) + len(text), link.get(id(n), 0) + k
        near = [n for n in up[: html_extract.LEVELS] if n.tag != "p"]
        for share, n in enumerate(near, 1):
            points[id(n)] = points.get(id(n), 0) + (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - k / len(text)) / share
    base = {id(n): n.score for n in nodes}
    return nodes, found, {i: base[i] + points.get(i, 0) for i in base}, chars, link


def test_points_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 80)):
            parts.append(rng.choice(["<div>", "</div>", "<section class=content>", "</section>", "<p>", "</p>", "<ul><li>", "</ul>", "<article>", "</article>", "<a href=x>", "</a>", "word, and more, ", "text " * rng.randrange(60), "<br>", "</span>"]))
        nodes, found, points, chars, link = slow_points("".join(parts))
        for n in nodes[1:]:
            html_extract._under_name(n)
        html_extract._judged(nodes, found)
        assert all(not n.off for n in nodes)
        assert all(abs(n.score - points[id(n)]) < 1e-6 and n.chars == chars.get(id(n), 0) and n.link == link.get(id(n), 0) for n in nodes)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<a " * 50_000, "<p class='" * 50_000, "<ul><li>" + "<div>" * 10_000 + "<li>x</li></span>" * 10_000, "<p>a</p><!-- x > y", "<p>a</p><script>x > y", "</" * 50_000])
def test_odd_pages_take_linear_time(page):
    began = time.monotonic()
    html_extract.extract(page)
    assert time.monotonic() - began < 2


def test_html_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, n_chars int")
    assert html_extract.extract_pages(empty).count() == 0


# --- licenses ------------------------------------------------------------------


def test_licenses():
    n, n_base, first, last, base, labels, score, hits = licenses.scan("Licensed under CC BY 4.0. All rights reserved. CC-BY cc by")
    assert (n, n_base, first, last, base) == (13, 4, 2, 11, "cc-by,reserved")
    assert {"cc-by", "cc-by-4.0", "reserved"} <= set(labels.split(",")) and 0 < score <= 1
    assert licenses.scan(None)[:7] == (0, 0, None, None, "", "", 0.0)
    assert "gpl-3.0" in licenses.scan("the GNU General Public License, version 3")[5] and len(licenses.rules()) > 200


def test_suppression_keeps_the_containing_detection():
    a, b, c = licenses.Hit("long", 0, 9, 50, 1.0), licenses.Hit("inside", 2, 4, 50, 1.0), licenses.Hit("strong", 3, 5, 90, 1.0)
    assert licenses.suppress([b, a, c]) == [a, c]


def alternatives(tree):
    """One text for every way through a parsed regular expression (optional parts with and without, repeats once or as often as needed)."""
    out = [""]
    for op, av in tree:
        match str(op):
            case "LITERAL":
                ways = [chr(av)]
            case "IN":
                ways = [chr(v if str(k) == "LITERAL" else v[0]) if str(k) in ("LITERAL", "RANGE") else "x" for k, v in av]
            case "BRANCH":
                ways = [w for branch in av[1] for w in alternatives(branch)]
            case "SUBPATTERN":
                ways = alternatives(av[3])
            case "MAX_REPEAT":
                ways = [""] * (av[0] == 0) + [w * max(av[0], 1) for w in alternatives(av[2])]
            case _:
                ways = [""]
        out = [a + w for a in out for w in ways]
    return out


def test_every_alternative_holds_a_keyword():
    for r in licenses.rules():
        texts = [f" {t.strip()} " for t in alternatives(re._parser.parse(r.pattern.pattern))]
        assert all(any(k in t for k in r.keywords) for t in texts), r.label


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("may not be reproduced", "no-redistribution"), ("must not be republished", "no-redistribution"), ("may not be copied", "no-redistribution"), ("may not be redistributed", "no-redistribution"),
        ("may not be used to train AI", "no-ai-training"), ("not be used for training of machine learning", "no-ai-training"), ("TDM rights reserved", "tdm-reservation"),
        ("text and data mining prohibited", "tdm-reservation"), ("DMCA", "dmca"), ("Digital Millennium Copyright Act", "dmca"), ("do what the fuck you want to public license", "wtfpl"), ("WTFPL", "wtfpl"),
    ],
)
def test_gated_detections_equal_ungated(text, label):
    joined = licenses.words_of(f"This {text} here")[1]
    ungated = {r.label for r in licenses.rules() if r.pattern.search(joined)}
    assert label in ungated and label in {h.label for h in licenses.detect(joined)}


def slow_suppress(found):
    """Detections that no other contains, of higher priority, or of the same priority and longer, or first by label."""
    better = lambda a, b: a is not b and a.first <= b.first and b.last <= a.last and (a.priority > b.priority or (a.priority == b.priority and ((a.last - a.first, b.label) > (b.last - b.first, a.label))))
    return sorted({h for h in found if not any(better(k, h) for k in found)}, key=lambda h: (h.first, h.last, h.label))


def license_texts():
    rng = random.Random(4)
    parts = [w.strip() for r in licenses.rules()[::5] for w in alternatives(re._parser.parse(r.pattern.pattern))[-1:]]
    fill = "some words of a text about a license and the rights of others cc by general public all".split()
    return [" ".join(rng.choice([rng.choice(parts), *rng.choices(fill, k=3)]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]


def test_license_detections_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        found = [licenses.Hit(rng.choice("abc"), f := rng.randrange(12), f + rng.randrange(5), rng.choice([10, 20, 30]), 1.0) for _ in range(rng.randrange(12))]
        assert licenses.suppress(list(dict.fromkeys(found))) == slow_suppress(found)
    for text in license_texts():
        joined = licenses.words_of(text)[1]
        words = joined.split()
        found = []
        for r in licenses.rules():
            for m in r.pattern.finditer(joined):
                first = len(joined[: m.start()].split())
                found.append(licenses.Hit(r.label, first, first + len(m[0].split()) - 1, r.priority, r.confidence))
                assert words[first : first + len(m[0].split())] == m[0].split()
        assert licenses.detect(joined) == slow_suppress(found)


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d),
h AS (SELECT rid, k - 1 AS k, CASE WHEN array_to_string(w[k:k+1], ' ') = 'cc by' THEN 'cc-by' WHEN array_to_string(w[k:k+2], ' ') = 'general public license' THEN 'gpl' WHEN array_to_string(w[k:k+2], ' ') = 'all rights reserved' THEN 'reserved' END AS label FROM p)
SELECT doc_id, len(w), count(label), min(k) FILTER (label IS NOT NULL), max(k) FILTER (label IS NOT NULL), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN h USING (rid) GROUP BY rid, doc_id, w ORDER BY ALL
"""


def test_license_table(spark):
    texts = [None, "", "  ", "CC-BY cc by CC BY 4.0", "all rights reserved " * 3, "É cc by ü", "word " * 100_000 + "general public license", *license_texts(), "cc by cc by", "cc by cc by"]
    d = docs(spark, [*((i, t, "x", "s") for i, t in enumerate(texts)), (None, "cc by", None, None), (3, texts[3], "x", "s")])
    out = licenses.scan_documents(d).collect()
    con = duckdb.connect()
    con.register("docs", d.select("doc_id", "text").toPandas())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == sorted((i is None or i != i, 0 if i is None or i != i else int(i), *r) for i, *r in con.execute(BASE_SQL).fetchall())
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(",")))) for r in out)
    assert licenses.scan_documents(d.limit(0)).count() == 0


# --- WARC ----------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_ranges(zip64):
    raw = warc.zip_bytes([("a", b"hello"), ("b/c", b"")], b"\n", zip64)
    z = warc.ZipRanges(lambda at, n: raw[at : at + n], len(raw))
    assert z.range("a", 1, 3) == b"ell" and z.range("b/c", 0, 0) == b"" and zipfile.ZipFile(io.BytesIO(raw)).read("a") == b"hello"
    with pytest.raises(ValueError, match="outside"):
        z.range("a", 3, 9)


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big), (7, None, big), (3, "u\nv", big), (4, "x", "small"), (5, "x", "small"), (6, "y", None), (None, "z", big), (7, None, big)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    out = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()), key=str)
    want = [(1, 1200, "revisit", 7), (3, 1200, "revisit", 7), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 1200, "response", None), (7, 1200, "response", None), (None, 1200, "revisit", 7)]
    assert out == sorted(want, key=str)
    path = next((tmp_path / "w").glob("*.txt"))
    assert warc.DATA in warc.open_ranges(str(path)).members
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_warc_ids_of_any_kind(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    big = "x" * 1500
    rows = [("a\tb", "u", big), ("line\nbreak", None, big), ("", "u", "short"), (None, "u", None), ("zé%41=>", "u", big), ("", "v", None)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"))
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out.collect()), key=str) == sorted([("a\tb", "revisit", "zé%41=>"), ("line\nbreak", "revisit", "zé%41=>"), ("", "response", None), (None, "response", None), ("zé%41=>", "response", None), ("", "response", None)], key=str)
    exact = spark.createDataFrame([("1.50", big), ("2.25", big)], "id string, html string").selectExpr("cast(id as decimal(10, 2)) AS page_id", "cast(null as string) AS url", "html")
    assert sorted((str(r.page_id), str(r.refers_to)) for r in warc.round_trip(exact).collect()) == [("1.50", "2.25"), ("2.25", "None")]


def test_archives_are_split_and_read_without_seeking(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choices("abcdefghij", k=3000))) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), 50_000)
    assert len(list((tmp_path / "w").glob("*.txt"))) > 4
    seek = sorted(warc.read_archives(pages, f"file:{tmp_path}/w").collect())
    monkeypatch.setattr(warc, "_seekable", lambda path: False)
    assert sorted(warc.read_archives(pages, f"file:{tmp_path}/w").collect()) == seek and len(seek) == 200


# --- language, quality, toxicity -------------------------------------------------

VOCABULARY = {"aa": "the that with from which house", "bb": "über schön nicht für straße haus", "cc": "où été français être maison"}


def corpus(n=160):
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(30)), lang, "s") for i in range(n) for lang in [sorted(VOCABULARY)[i % 3]]]


def test_language(spark):
    rows = [*corpus(), (900, None, None, None), (901, "12 !!", "aa", None), (None, "the house", None, None)]
    d = docs(spark, rows)
    out = {r.doc_id: r for r in language.identify(d, language.train(d)).collect()}
    truth = {i: lang for i, _, lang, _ in corpus()}
    assert sum(out[i].lang_pred == lang for i, lang in truth.items()) >= 0.95 * len(truth)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0 and 0 <= out[0].score <= 1
    empty = language.train(d.limit(0))
    assert {r.lang_pred for r in language.identify(d, empty).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice("alpha beta gamma delta, epsilon. Zeta".split()) for _ in range(40)) for _ in range(120)]
    rows = [(i, t if i % 2 else t.replace(" ", "%%% "), "x", "s") for i, t in enumerate(good)]
    d = docs(spark, [*rows, (500, None, None, None), (501, "", None, None)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(d, quality.fit(d, labels)).collect()}
    assert all(out[i].predicted == i % 2 for i in range(120)) and 0 <= out[500].score == out[501].score <= 1
    assert {r.score for r in quality.classify(d, quality.fit(d, labels.limit(0))).collect()} == {0.5}


def test_bundles_equal_brute_force():
    texts = ["The house, the über-house!", None, "12", "a", "ß" * 50]
    fast = language.bundles(texts)
    for t, v in zip(texts, fast, strict=True):
        s = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        s = f" {' '.join(s)} " if s else ""
        slow = np.zeros(language.DIM)
        for i in range(len(s) - 2):
            bound = np.ones(language.DIM)
            for place, c in enumerate(s[i : i + 3]):
                bound *= np.roll(language.letter_vectors(np.array([ord(c)]))[0], 2 - place)
            slow += bound
        assert np.array_equal(slow, v)


def test_long_texts_are_read_whole(monkeypatch):
    text = "the house that was über alles " * 400
    whole, stats = language.bundles([text]), quality.statistics(text)
    monkeypatch.setattr(language, "GROUP", 500)
    assert np.array_equal(language.bundles([text]), whole) and stats[0] == 2400


def test_compiled_quality_equals_plain_evaluation(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["word", "WORD", "a,", "b.", "%%%", "1234", "!"], k=rng.randrange(1, 60))) for _ in range(150)] + [None, "", "x " * 50_000]
    d = docs(spark, [*((i, t, None, None) for i, t in enumerate(texts)), (0, texts[0], None, None), (None, "word", None, None)])
    labels = spark.createDataFrame([(i, int("%%%" in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    assert model.rules
    out = quality.classify(d, model).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        x = dict(zip(quality.STATISTICS, quality.statistics(texts[r.doc_id] if r.doc_id is not None else "word"), strict=True))
        z = model.intercept + sum(w for rule, w in model.rules if all(x[n] <= v if op == "<=" else x[n] > v for n, op, v in rule))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert quality.classify(d.limit(0), model).count() == 0 and language.identify(d.limit(0), language.train(d.limit(0))).count() == 0


def test_kernel_equals_brute_force():
    from itertools import combinations

    def brute(s, t):
        pairs = ((a, b) for a in combinations(range(len(s)), 3) for b in combinations(range(len(t)), 3) if all(s[x] == t[y] for x, y in zip(a, b, strict=True)))
        return sum(toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a, b in pairs)

    items = [b"\0abcd", b"\0acbd", b"\0aa", b"\0aabbab", b"\0x"]
    got = toxicity.kernel(items, items)
    assert all(abs(got[i, j] - brute(a, b)) < 1e-4 for i, a in enumerate(items) for j, b in enumerate(items))
    assert all(abs(x - got[i, i]) < 1e-4 for i, x in enumerate(toxicity._own(items)))


def insulted(n=400):
    """Rows (doc_id, text, y): a third with insults, some of them gapped or with a character inserted."""
    rng = random.Random(7)
    words = "meadow harbor lantern silver copper winter garden window simple orange".split()
    rows = []
    for i in range(n):
        t = [rng.choice(words) + rng.choice(["", "ing", "er", "s"]) for _ in range(30)]
        if i % 3 == 0:
            for at in rng.sample(range(30), 3):
                t[at] = rng.choice(["blockhead", "numbskull", "block-head", "n u m b s k u l l", "blockxhead", "numbsskull"])
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    return rows


def test_toxicity(spark):
    rows = insulted()
    long = ("meadow harbor winter " * 20_000, "meadow harbor winter " * 20_000 + " ".join(["blockhead numbskull"] * 5), "ab" * 200 + "blockhead" + "ab" * 200)
    odd = [(1000, None), (1001, ""), (1002, "you blockhead, blockhead, blockhead"), (1003, "b l o c k h e a d and numbskull, numbskulls"), (1004, "blockyhead num.bskull numbqskull"), (1005, "meadow harbor winter"), *enumerate(long, 1006), (None, rows[0][1]), (0, rows[0][1])]
    d = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in [r[:2] for r in rows] + odd], "doc_id long, text string, y string, hash double, minima int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(d, labels)
    assert np.allclose(toxicity.fit(d.repartition(7), labels).weights, model.weights) and toxicity.passing(list(model.toxic), model.tables, model.need).all()
    out = toxicity.classify(d, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    found = {r.doc_id: r for r in out}
    assert [found[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007)] == [0, 0, 1, 1, 1, 0, 0, 1]
    y = {i: v for i, _, v in rows}
    assert sum(found[i].predicted == v for i, v in y.items()) >= 0.97 * len(y)
    assert len({r.score for r in toxicity.classify(d, toxicity.fit(d, labels.limit(0))).collect()}) == 1
    assert toxicity.classify(d.limit(0), model).count() == 0

    # A plain scorer: every piece of every string gets its margin, none is left out by the lookup.
    texts = [t for _, t in [r[:2] for r in rows][:60]] + [t for _, t in odd[2:6]]
    for t, fast in zip(texts, toxicity.features(texts, model, {}), strict=True):
        kind, starts, _ = toxicity.strings([t])
        items, of = toxicity.pieces(kind, starts, np.r_[starts[1:], len(kind)])
        margin = toxicity.margins(items, model, {})
        best = [max(margin[of == i].max(), toxicity.FLOOR) for i in range(len(starts))]
        assert abs(np.log1p(sum(m > 0 for m in best)) - fast[1]) < 1e-6 and (max(best) <= 0 or abs(max(best) - fast[0]) < 1e-6)


def test_lookup_finds_a_landmark_at_any_place_of_a_long_string():
    marks = (bytes([0, *range(1, 8)]),)
    tables, need = toxicity.lookup_tables(marks)
    for m in range(1, 400):
        kind, starts, _ = toxicity.strings(["ab" * m + "abcdefg"])
        assert toxicity.candidates(kind, starts, tables, need).all(), m


def test_model_does_not_depend_on_the_hash_seed():
    code = "from corvane.llm import toxicity as t; m = t.gate([bytes([0, *(c - 96 for c in w)]) for w in (b'abcde', b'abxcde', b'zzyxw', b'mnopq')]); print(m[0], t._minima('a b c d e f g'), sorted(t.items_of('some words here')), t.different([t._minima(x) for x in ('a b c', 'a b c', 'd e')]))"
    runs = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": seed}, cwd=ROOT, capture_output=True, text=True, check=True).stdout for seed in ("1", "2")}
    assert len(runs) == 1


# --- rules ---------------------------------------------------------------------


def test_rule_measures():
    assert rules.measure(None) == (0,) * 8
    text = "a b c d e\na b c d e\n#x $y !"
    n, chars, symbols, dup, repeat, lines, upper, bangs = rules.measure(text)
    assert (n, chars, symbols, dup, repeat, lines, upper, bangs) == (13, 15, 2, 1, 10, 3, 0, 1)


def test_ablations(spark):
    d = docs(spark, [(1, "x", "a", "s"), (2, "A% " * 20, "a", "s"), (3, " ".join(f"word{i}" for i in range(30)), "a", "s"), (4, None, None, None)])
    rows = rules.ledger(d)
    got = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(rows, "base").collect()}
    assert got == {"few_words": (2, 2), "repeated_windows": (1, 1)}


def test_ledger_edges(spark):
    texts = [None, "", "\n \n", "a " * 60_000, "a b c", "a b c"]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "x", 1, "z")], "doc_id long, text string, n_words int, failed_bits string")
    out = {r.doc_id: r for r in rules.ledger(d).collect()}
    assert len(out) == 7 and out[0].n_words == out[1].n_words == out[2].n_words == 0 and out[3].n_repeat_words == 60_000 and out[4][1:] == out[5][1:]
    assert rules.ledger(d.limit(0)).count() == 0


# --- benchmarks ----------------------------------------------------------------


def brute_hits(text, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, who = cut(text), set(), set()
    for name, item in items:
        v = cut(item)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                who.add(str(name))
    return len(w), len(hit), len(who)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_equals_brute_force(spark, limit):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:14])), (2, "Short One"), (3, " ".join(words[:14])), (4, None), (5, ""), (10, " ".join(words[30:41]))]
    texts = [None, "", " ".join(words[:14]), "x, " + " ".join(words[:12]).upper() + " y short-one", " ".join(words[25:45]), "w1 w2 w3", "short one short one", " ".join(words)]
    d = docs(spark, [(i, t, "a", "s") for i, t in enumerate(texts)] + [(7, texts[7], "a", "s")])
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.report(d, b, max_windows=limit).collect()
    assert len(out) == 9 and all((r.n_words, r.n_hit, r.n_items) == brute_hits(texts[r.doc_id], items) for r in out)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 1, 5}
    spans = {r.doc_id: r.text for r in decontaminate.clean(d, b, mode="spans").collect()}
    assert spans[3] == "x, y " and spans[5] == "w1 w2 w3" and spans[0] is None
    assert decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0 and decontaminate.report(d.limit(0), b).count() == 0


# --- mixing --------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), "x", rng.choice(["a", "b", "b", "b", "c", None])) for i in range(1500)]
    d = docs(spark, [*rows, (9999, None, None, "d")])
    out = mixing.mix(d).collect()
    by = {}
    source = {i: s for i, _, _, s in rows} | {9999: "d"}
    for r in out:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        t = by.setdefault(source[r.doc_id], [0, r.target, r.source_size])
        t[0] += r.taken
    assert all(abs(took - target) <= 30 and target <= 2 * size for took, target, size in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(s for _, _, s in by.values())) < 1e-6
    assert sorted(map(tuple, mixing.mix(d.repartition(7)).collect())) == sorted(map(tuple, out)) and mixing.mix(d.limit(0)).count() == 0


def test_pareto_sample_has_its_inclusion_probabilities(spark):
    rows = [(i, "w " * (4 if i % 2 else 100), "x", "a") for i in range(4000)] + [(9000 + i, "w " * 30, "x", "b") for i in range(1000)]
    run = mixing.mix(docs(spark, rows)).where("doc_id < 9000").collect()
    first = run[0]
    whole, need = int(first.target // first.source_size), first.target % first.source_size  # words of extra copies
    long, short = 7, 3  # binary digits of 100 and of 4
    scale = need / (2000 * (long * 100 + short * 4))
    for odd, digits in ((0, long), (1, short)):
        share = np.mean([r.taken > whole * r.size for r in run if r.doc_id % 2 == odd])
        assert 0 < scale * digits < 1 and abs(share - scale * digits) < 0.05, (odd, share, scale * digits)
    assert first.target - 4 <= sum(r.taken for r in run) <= first.target


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_mixing_joins_either_way(spark, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    d = docs(spark, [(i % 90, "w " * (i % 7), None, "abc"[i % 3] if i % 10 else None) for i in range(100)])
    took = {}
    for r in mixing.mix(d).collect():
        took.setdefault(r.doc_id, []).append(r.taken)
    clash = d.withColumnsRenamed({"lang": "copies", "score": "need"}).withColumn("sk", F.lit(1)).withColumn("__row", F.lit(2))
    kept = mixing.mixed(clash)
    assert kept.columns == ["doc_id", "text", "source", "need", "sk", "__row", "copies"]
    rows = kept.collect()
    assert sorted((r.doc_id, r.copies * len(r.text.split())) for r in rows) == sorted((i, t) for i, ts in took.items() for t in ts if t > 0)


# --- pipeline ------------------------------------------------------------------


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == [*source.columns, "copies"] and 0 < out.count() < source.count()
    assert out.select("doc_id").distinct().count() == out.count() and [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "benchmarks", "mix"]


def pipeline_tables(spark, tmp_path):
    """Tables with every odd case: nulls, empties, repeats, near copies, benchmark passages, columns named like those of the stages."""
    rng = random.Random(12)
    rows = []
    for i in range(240):
        lang = sorted(VOCABULARY)[i % 3]
        words = [rng.choice(VOCABULARY[lang].split()) + rng.choice(["", "x", "y"]) for _ in range(60)]
        rows.append((i, " ".join(words) if i % 4 else "%%% ".join(words), lang if i % 5 else None, rng.choice(["web", "book", None])))
    rows += [(300 + i, r[1] + " end", r[2], r[3]) for i, r in enumerate(rows[1:60:2])]
    passage = " ".join(f"item{i}" for i in range(40))
    rows += [(400 + i, rows[i + 1][1] + " " + passage, "aa", "web") for i in range(0, 40, 4)]
    rows += [(500, None, "aa", "web"), (501, "", "aa", "web"), (502, "12 !!", "bb", None), (None, rows[1][1], "bb", "web"), (None, None, None, None), rows[1], rows[1], (503, "the house " * 3000, "aa", "book")]
    schema = "doc_id long, text string, lang string, source string, lang_pred int, score double, copies int, __language int, __row int, k_id int, quality_score int"
    spark.createDataFrame([(*r, 1, 0.5, 9, 3, 4, 5, 6) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)]
    spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))


def test_stages_equal_brute_force_on_odd_tables(spark, tmp_path):
    pipeline_tables(spark, tmp_path)
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = d.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")
    before = sorted(d.collect(), key=key)
    model = language.train(d)
    told = language.predict([r.text for r in before], *model)
    kept = sorted(corpus_pipeline.identify_language(spark, d, str(tmp_path)).collect(), key=key)
    assert kept == [r for r, lang, score in zip(before, *told, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE] and 0 < len(kept) < len(before)
    d1 = spark.createDataFrame(kept, d.schema)
    rated = quality.fit(d1, spark.read.parquet(str(tmp_path / "labels.parquet")))

    def rate(t):
        x = dict(zip(quality.STATISTICS, quality.statistics(t), strict=True))
        return 1 / (1 + np.exp(-(rated.intercept + sum(w for rule, w in rated.rules if all(x[n] <= v if op == "<=" else x[n] > v for n, op, v in rule)))))

    good = sorted(corpus_pipeline.classify_quality(spark, d1, str(tmp_path)).collect(), key=key)
    assert good == [r for r in kept if rate(r.text) >= quality.THRESHOLD] and 0 < len(good) < len(kept)
    d2 = spark.createDataFrame(good, d.schema)
    single = corpus_pipeline.remove_near_duplicates(spark, d2, str(tmp_path))
    comp = brute_components([r.text for r in good])
    groups = {}
    for r, c in zip(good, comp, strict=True):
        groups.setdefault(c, []).append(r)
    want = sorted([min((r for r in g if r.doc_id is not None), key=key) for g in groups.values() if any(r.doc_id is not None for r in g)] + [r for r in good if r.doc_id is None], key=key)
    assert single.columns == names and sorted(single.collect(), key=key) == want and len(want) < len(good)
    d3 = spark.createDataFrame(want, d.schema)
    item = spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()
    clean = sorted(corpus_pipeline.remove_benchmarks(spark, d3, str(tmp_path)).collect(), key=key)
    assert clean == [r for r in want if not brute_hits(r.text, [tuple(x) for x in item])[1]] and 0 < len(clean) < len(want)
    last = corpus_pipeline.mix_sources(spark, spark.createDataFrame(clean, d.schema), str(tmp_path))
    took = {(r.doc_id, r.size): r.taken for r in mixing.mix(spark.createDataFrame(clean, d.schema)).collect()}
    rows = last.collect()
    assert {(r.doc_id, len(r.text.split())): r.copies * len(r.text.split()) for r in rows} == {k: v for k, v in took.items() if v}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.text, r.copies) for r in whole) == sorted((r.doc_id or -1, r.text, r.copies) for r in rows)


def brute_components(texts):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("stage", [corpus_pipeline.remove_near_duplicates, corpus_pipeline.mix_sources, corpus_pipeline.remove_benchmarks])
def test_stages_take_empty_tables(spark, tmp_path, stage):
    d = docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert stage(spark, d, str(tmp_path)).count() == 0


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(session)
