"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from foldline.llm import dedup, jaccard
from foldline.llm.common import written

from .conftest import words

ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_dedup_matches_groups(spark, edges, nothing):
    rows, groups = edges.collect(), {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    got = dedup.dedup(edges).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r["text_sha256"]]
        keep = max((x for x in ids if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert dedup.dedup(nothing).count() == 0


def test_dedup_state_goes_on(spark):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    known = dedup.Dedup(spark)
    known.feed(make((1, "a"), (2, "b")))
    known.feed(make((7, "a"), (3, "c")))
    state = {(r["keep_id"], r["n"]) for r in known.state().collect()}
    assert state == {(7, 2), (2, 1), (3, 1)}


def test_feed_leaves_no_store_open(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)], "doc_id long, text string").repartition(2)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("a table made by Python on the executors"))
    stores = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    known = dedup.Dedup(spark)
    deadline = time.time() + 30
    while stores.getNumRocksDBInstances(True) and time.time() < deadline:  # of earlier streams
        time.sleep(0.5)
    before = stores.getNumRocksDBInstances(True)
    for turn in (1, 2):
        seen = known.feed(docs)
        assert stores.getNumRocksDBInstances(True) == before == 0
        assert {(r["keep_id"], r["n"]) for r in seen.collect()} == {(i + 40 if i < 20 else i, turn * (2 if i < 20 else 1)) for i in range(40)}
    assert known.seen.schema.names == ["digest", "keep_id", "locator", "n"]


def test_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(dedup, "digest", lambda text: F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, 1).cast("binary"), 256))
    docs = spark.createDataFrame([(1, "ax"), (2, "ax"), (3, "ay"), (4, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in dedup.dedup(docs).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)]


def test_digests_clash_across_feeds(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    monkeypatch.setattr(dedup, "digest", lambda text: F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, 1).cast("binary"), 256))
    known = dedup.Dedup(spark)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda docs: sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in dedup.dedup(docs, known=known).collect())
    assert told(make((1, "ax"), (2, "b"), (9, "c"))) == [(1, 1, 1), (2, 2, 1), (9, 9, 1)]
    # From a Parquet file the locators are the file's own; a name that needs escaping is read again too.
    make((3, "ay"), (4, "ax"), (5, "c"), (6, "d")).write.parquet(str(tmp_path / "a b%"))
    assert told(spark.read.parquet(str(tmp_path / "a b%"))) == [(3, 3, 1), (4, 4, 2), (5, 9, 2), (6, 6, 1)]
    assert {(r["keep_id"], r["locator"]["row"] is not None) for r in known.state().collect()} == {(4, True), (2, True), (9, True), (6, True)}


def test_kept_rows(spark, edges):
    got = dedup.kept_rows(edges)
    assert got.columns == edges.columns
    rows = got.collect()
    assert sorted((r["text"] or "") for r in rows) == sorted({(r["text"] or "") for r in edges.collect()})


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        out.setdefault(find(i), []).append(k)
    return {rows[i][0]: (len(sets[i]), min(out[find(i)])) for i in range(len(rows))}


def family(rnd, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = "".join(rnd.choice("xyz") for _ in range(5))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    passage = words(rnd, 60)
    texts = family(rnd, words(rnd, 120), 60, 5) + family(rnd, words(rnd, 45), 40, 2) + family(rnd, words(rnd, 9), 12, 1)
    texts += [" ".join(words(rnd, rnd.randint(0, 30)) + passage + words(rnd, rnd.randint(0, 30))) for _ in range(40)]
    texts += [" ".join(words(rnd, rnd.randint(0, 8))) for _ in range(30)] + ["", "A b", "a B", "a  b"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs).collect()}
    assert got == brute(rows)


def test_links_through_null_and_repeated_ids(spark):
    rnd = random.Random(9)
    base, other = words(rnd, 100), words(rnd, 90)
    near = lambda w, *at: " ".join("changed" if i in at else x for i, x in enumerate(w))
    # 1 and 9 are each alike enough to the row without an id, but not to each other.
    rows = [(1, near(base, 5, 30)), (None, near(base, 5, 60)), (9, near(base, 60, 90)), (None, "of its own"), (None, "")]
    apart = {r["doc_id"]: r["component_id"] for r in jaccard.similar(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()}
    assert apart == {1: 1, 9: 9}
    # One id with two texts joins what either is linked with.
    rows += [(13, " ".join(other)), (15, " ".join(other)), (15, "x " + " ".join(base[::-1])), (17, "y " + " ".join(base[::-1])), (20, "alone here")]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 9: 1, None: None, 13: 13, 15: 13, 17: 13, 20: 20}


def test_awkward_rows(spark, edges, nothing):
    got = jaccard.similar(edges).collect()
    assert len(got) == edges.count()
    one = {r["doc_id"]: r for r in got}
    assert one[None]["component_id"] is None and one[0]["n_shingles"] == one[1]["n_shingles"] == one[2]["n_shingles"] == 0
    assert [one[i]["component_id"] for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11)] == [0, 1, 2, 4, 4, 6, 6, 6, 9, 10, 10]
    assert jaccard.similar(nothing).count() == 0


def test_buckets_lose_no_shared_shingle(spark):
    rnd = random.Random(4)
    shared = words(rnd, 30)
    texts = [" ".join(words(rnd, 20) + shared[: rnd.randint(5, 30)]) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    count: dict = {}
    for t in texts:
        for g in plain_set(t):
            count[g] = count.get(g, 0) + 1
    want = {i: sum(count[g] > 1 for g in plain_set(t)) for i, t in enumerate(texts)}
    for buckets in (1, 5, 40):
        got = {r["doc_id"]: r["shared"] for r in written(jaccard.count_shared(docs, buckets), "t").collect()}
        assert got == want


def test_longer_prefixes_are_chosen_by_cost():
    assert jaccard.extension(100, np.array([2] * 10)) == (0, 0)
    more, take = jaccard.extension(100, np.array([2] * 100))
    assert take == 100 - 80 + more and more > 1
    assert jaccard.extension(3, np.array([5, 5, 5]))[0] >= 1


def test_dedup_of_changed_texts(spark, tmp_path):
    """Texts that were changed after they were read aren't those that a file has."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    told = lambda docs: sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in dedup.dedup(docs).collect())
    assert told(docs.withColumn("text", F.lower("text"))) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    assert told(docs.select("doc_id", F.lower("text").alias("text"))) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    assert told(docs.filter("doc_id > 1").union(docs)) == [(1, 1, 1), (2, 2, 2), (2, 2, 2), (3, 3, 2), (3, 3, 2)]
    assert told(docs.withColumnRenamed("text", "x").withColumn("text", F.col("x"))) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert told(docs.toDF("doc_id", "text").filter("doc_id < 3")) == [(1, 1, 1), (2, 2, 1)]
