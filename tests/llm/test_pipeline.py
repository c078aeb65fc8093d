"""Each stage against a plain version on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from foldline.llm import quality
from foldline.llm.common import id_remainder, table, written

from .test_copies import brute
from .test_text_operators import plain_hits


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = written(stages[name](spark, docs, data), name)
        assert name == "best_fit_packing" or out.columns == columns
        return out, {r["doc_id"]: r for r in out.collect()}

    one, kept = after("quality_classifier", docs)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, table(spark, data, "labels"), id_remainder("doc_id", 3) != 1).collect()}
    assert set(kept) == {k for k, s in scores.items() if s >= 0.5}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, data, "labels").collect()}
    assert sum((k in kept) != bool(q) for k, q in labels.items()) <= 0.05 * len(labels)

    two, kept2 = after("exact_dedup", one)
    last = {}
    for k, r in kept.items():
        last[r["text"]] = max(k, last.get(r["text"], -1))
    assert set(kept2) == set(last.values())

    three, kept3 = after("ngram_jaccard_join", two)
    groups = brute([(k, kept2[k]["text"]) for k in sorted(kept2)])
    assert set(kept3) == {c for _, c in groups.values()}

    four, kept4 = after("benchmark_decontamination", three)
    assert set(kept4) == {k for k, r in kept3.items() if not plain_hits(r["text"], items)[1]}

    five = stages["best_fit_packing"](spark, four, data).collect()
    assert {r["doc_id"] for r in five} == set(kept4)


def test_stages_take_awkward_tables(spark, data, edges, nothing):
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, nothing, data).count() == 0, name
        out = stage(spark, edges, data)
        assert out.count() > 0, name
        assert name == "best_fit_packing" or out.columns == edges.columns
    rows = edges.collect()
    kept = lambda name: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, edges, data).collect()), key=repr)
    pairs = sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    # Repeated rows go or stay together; what goes is scored below one half.
    one = kept("quality_classifier")
    assert set(one) <= set(pairs) and all(one.count(x) == pairs.count(x) for x in set(one))
    # One row of each text, that of the largest id; null and empty are one text.
    last = {}
    for k, t in pairs:
        last[t or ""] = max(-1 if k is None else k, last.get(t or "", -1))
    assert sorted((t or "", -1 if k is None else k) for k, t in kept("exact_dedup")) == sorted(last.items())
    # Of linked documents the smallest id: 7 is a copy of 6 and 8 is near it, a row without an id stays.
    three = kept("ngram_jaccard_join")
    assert {6, 9, 10, None} <= {k for k, _ in three} and not {7, 8, 11} & {k for k, _ in three}
    assert [k for k, t in three if not (t or "").split()] == [0, 1, 2]
    # No document here has a passage of the benchmark.
    assert kept("benchmark_decontamination") == pairs
    packed = stages["best_fit_packing"](spark, edges, data).groupBy("doc_id").max("length").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows} and {r["doc_id"]: r[1] for r in packed}[0] == 1
