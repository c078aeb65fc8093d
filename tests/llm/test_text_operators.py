"""HTML, PII, languages, licences, quality, benchmark leaks."""

from __future__ import annotations

import html as entities
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.llm import decontam, html, langid, licenses, pii, quality
from foldline.llm import queries as Q
from foldline.llm.common import id_remainder

from .conftest import CLASHING, words

# HTML


def test_article_of_the_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")

    def want(page):
        article = re.search(r"(?s)<article>(.*)</article>", page)[1]
        return " ".join(" ".join(entities.unescape(t).split()) for t in re.split(r"</?(?:h1|p|b|br)>", article) if t.strip())

    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r for r in Q.op1_html_extraction(spark, data).collect()}
    assert {k: r["text"] for k, r in got.items()} == {k: want(v) for k, v in source.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_held_out_layouts():
    w, rng, wrong, total = html.trained(), np.random.default_rng(77), 0, 0
    for _ in range(200):
        page, labels = html._example(rng)
        kept = html.label(w, [html.blocks(page)])[0]
        wrong, total = wrong + (kept != np.array(labels)).sum(), total + len(labels)
    assert wrong <= 0.01 * total


def test_parsing():
    text = lambda page: [b.text for b in html.blocks(page)]
    assert text("<p>a &amp; b<p>c<br>d<script>x='<p>no</p>'</script><!-- <p>no --><style>q</style>") == ["a & b", "c d"]
    assert text("<ul><li>1<li>2</ul>1 < 2 &lt;b&gt; <b>bold</b>word <foo") == ["1", "2", "1 < 2 <b> boldword"]
    assert text("") == text(None) == text("<p> \n </p>") == []
    page = "<article><p>" + "word " * 200_000 + "</p></article>"
    start = time.time()
    assert len(html.main_text(html.trained(), [page, "<div>" * 5000 + "x", None])[0]) == 999_999
    assert time.time() - start < 20


def test_page_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "t", 1), (None, "u", "", None, None), (3, "u", "<article><h1>Head</h1><p>Some words of text here.</p></article>", "t", 1)]
    rows.append(rows[2])
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, ""), (3, "Head Some words of text here."), (3, "Head Some words of text here.")]
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


# PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok[kind](m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_spans_match_plain_patterns():
    rnd = random.Random(3)
    for _ in range(8000):
        text = "".join(rnd.choice(rnd.choice(["a@.", "01.", "0 -5", "+1() .-", "b_%@.c-", "25. 4", "é +123 ", "9-4 "])) for _ in range(rnd.randint(1, 60)))
        assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.find(text) if s.kind in PATTERNS] == plain_spans(text), text


def test_added_kinds_and_scores():
    found = {s.kind: s for s in pii.find("My IBAN is DE89 3704 0044 0532 0130 00, ssn 123-45-6789, mail me@x.org")}
    assert found["iban"].score == 1.0 and found["ssn"].score == 0.6 and found["email"].score == 1.0
    assert not pii.find("DE89 3704 0044 0532 0130 01 and 123-45-6789")
    start = time.time()
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a." * 100_000 + "@", "+1" * 100_000, "GB82" * 50_000):
        pii.find(text)
    assert time.time() - start < 20


def test_leading_zeros_and_context_behind():
    long = "0" * 5000 + "1"
    assert [(x.kind, x.end) for x in pii.find(f"{long}.1.1.255")] == [("ip", 5009)]
    assert not [x for x in pii.find(f"{'0' * 5000}256.1.1.1") if x.kind == "ip"]
    assert [x.kind for x in pii.find("123-45-6789 is my ssn")] == ["ssn"]
    assert pii.find("card of mine: 4111 1111 1111 1111")[0].score == pii.find("4111 1111 1111 1111 is the card")[0].score == 1.0
    assert pii.find("4111 1111 1111 1111 by order")[0].score == 0.6


@pytest.mark.parametrize(
    "text",
    [
        "the key AKIA" + "ABCDEFGH" * 2, "token: ghp_" + "a1" * 18, "xoxb-" + "123456789012", "sk_live_" + "a1B2" * 6, "AIza" + "a1B2c" * 7, "password = hunter2!x", 'api_key: "abc123def456"',
        "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----", "Bearer eyJ" + "a1" * 8 + ".eyJ" + "b2" * 8 + "." + "c3" * 8,
    ],
)
def test_secrets(text):
    assert [x.kind for x in pii.find(text) if x.kind == "secret"] == ["secret"]
    assert not any(x.kind == "secret" for x in pii.find("The secret of the password: remember it; token: something, key = 1.5 or sk-ill"))
    start = time.time()
    for long in ("eyJ" * 100_000, "-----BEGIN " * 30_000, "password=" * 30_000, "sk-" * 100_000):
        pii.find(long)
    assert time.time() - start < 20


def test_pii_query(spark, data, docs, edges, nothing):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in Q.op2_pii(spark, data).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
    assert pii.report(pii.spans_of(edges)).count() == edges.count()
    assert pii.report(pii.spans_of(nothing)).count() == 0


# Languages


def test_languages_of_held_out_documents(spark, docs):
    fold = id_remainder("doc_id", 4)
    got = langid.predict(docs, fold != 2).join(docs.select("doc_id", "lang"), "doc_id").filter(fold == 2).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edges, nothing):
    got = langid.predict(edges, F.lit(True)).collect()
    assert len(got) == edges.count()
    named = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(named[i] == "und" for i in (0, 1, 2, 12, 17)) and named[4] in ("en", "de")
    assert {r["lang_pred"] for r in langid.predict(edges.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}
    assert langid.predict(nothing, F.lit(True)).count() == 0


def test_presence_is_of_the_whole_text():
    assert langid.presence("ab" * 50_000 + " zq") is not None
    a, b = langid.presence("abc " * 1000 + "zebra"), langid.presence("abc " * 1000)
    assert a.sum() > b.sum() and langid.presence("12 34") is None


def test_ibans_in_a_row():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for text in (f"{de} {gb}", f"AB12 3456 7890 1234 {de}", f"DE00 3704 0044 0532 0130 00 {gb} {de}", f"{de}X {gb}", f"{de},{gb.replace(' ', '')}"):
        got = [text[a:b] for a, b in pii.ibans(text)]
        assert got == sorted((x for x in (de, gb, gb.replace(" ", "")) if x in text and x + "X" not in text), key=text.index), text


# Licences


def test_licences(spark, edges, nothing):
    mit = licenses.KNOWN[0][1]
    variants = [mit, "Copyright (c) 2020 Some One\n\n" + mit.upper(), mit.replace("sublicense", "sub-license").replace('"', "“"), "  " + mit.replace("\n\n", "\n * "), mit + " More.", None, "", "Licenced under the Apache Licence, version 2.0"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(variants)], "doc_id long, text string, license string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: "Apache-2.0"}
    assert licenses.scan(edges).count() == edges.count() and licenses.scan(nothing).count() == 0
    lines = ["words\r\nReleased under the MIT Licence\rLicensed under CC BY 4.0.", "a Released under the MIT License.", "Copyright (c) 2020\n* Licensed under the Apache License, Version 2.0 *\n", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    assert {r["doc_id"]: r["lines"] for r in licenses.scan(docs).collect()} == {0: ["CC-BY-4.0", "MIT"], 1: [], 2: ["Apache-2.0"], 3: []}


def test_notices_within_texts(spark, edges, nothing):
    mit, zlib = licenses.KNOWN[0][1], licenses.KNOWN[5][1]
    gpl = dict(licenses.full_texts())["GPL-3.0-only"]
    line = "This work is licensed under the GNU General Public License, version 3."
    texts = [
        f"some words\n{line}\nmore words", f"some words {line}\nmore", line[:-1] + " or later\nx", f"first\r\n\r\n# {line.upper()}\r\n# Released under the MIT Licence.\r\nlast",
        "A file.\n\n" + mit.replace(" and ", "\nand ") + "\n\nAnd more.", "A file.\n" + zlib + "\nend", mit.replace("free of charge", "for a fee"), None, "", "\ue000 " + line, f"x\n\n{gpl}\n\ny", line,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, line])], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.notices(docs).collect()}
    gnu = ["GPL-3.0-only"]
    assert got == {0: gnu, 1: [], 2: [], 3: ["GPL-3.0-only", "MIT"], 4: ["MIT"], 5: ["Zlib"], 6: [], 7: [], 8: [], 9: gnu, 10: gnu, 11: gnu, 12: gnu}
    own = {r["doc_id"]: r["licenses"] for r in licenses.notices(docs, table=[("own", "More words"), ("none", " ... ")]).collect()}
    assert own.pop(0) == ["own"] and not any(own.values())
    assert {r["license"] for r in licenses.scan(docs, table=[("own", line)]).collect()} == {"own", None}
    assert licenses.notices(edges).count() == edges.count() and licenses.notices(nothing).count() == 0


def test_notices_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    lines = {t: k for k, t in licenses.KNOWN if "\n" not in t}
    want = {r["doc_id"]: ",".join(sorted({lines[x] for x in r["text"].split("\n") if x in lines})) for r in rows}
    found = Q.MORE["license_notices"](spark, data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["licenses"] for r in found.collect()} == want and sum(map(bool, want.values())) > 2
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct")), plan


# Quality


def test_quality_of_held_out_documents(spark, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = [r for r in Q.op9_quality_classifier(spark, data).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.9 * len(got) > 0


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (6, 1, None), (7, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(edges, labels, F.lit(True)).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.scored(edges, labels.filter("false"), F.lit(True)).collect()} == {0.5}
    one = quality.scored(edges, labels.filter("quality = 1"), F.lit(True)).collect()
    assert all(r["score"] > 0.9 for r in one)
    assert quality.scored(nothing, labels, F.lit(True)).count() == 0
    assert quality.accepted(edges, labels.filter("quality = 1"), F.lit(True)).columns == edges.columns


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9

    def walk(row):
        total = forest.start
        for at in forest.root:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])


# Benchmark leaks

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, body in items:
        b = plain_words(body)
        n = min(10, len(b))
        spots = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in spots:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_leaks_match_plain_search(spark, edges, nothing):
    rnd = random.Random(8)
    items = [(i, " ".join(words(rnd, rnd.randint(8, 40)))) for i in range(12)] + [(20, "one"), (21, "Two words"), (22, None), (23, "?!"), (None, "no id here"), (24, "three short words"), (25, "a a a a a a a a a a a a")]
    texts = ["one", "x one. y", "two, WORDS two words", "a " * 25, "no id here", None, "", "thrée short words three short words"]
    for _ in range(60):
        body = plain_words(rnd.choice(items)[1])
        a = rnd.randint(0, max(0, len(body) - 10))
        texts.append(" ".join(words(rnd, rnd.randint(0, 20)) + body[a : a + rnd.randint(5, 25)] + words(rnd, rnd.randint(0, 20))))
    rows = [(i, t, *["z"] * len(CLASHING)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)
    bench = spark.createDataFrame([(i, t, "z", "z") for i, t in items], "item_id long, text string, words string, size string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {i: plain_hits(t, items) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in decontam.clean(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not plain_hits(t, items)[1]}
    assert decontam.decontaminate(edges, bench).count() == edges.count()
    assert decontam.decontaminate(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(edges, bench.filter("false")).collect())
    assert decontam.clean(edges, bench).columns == edges.columns


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op8_license_scan", "op10_benchmark_decontamination"])
def test_queries_match_their_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = Q.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))
