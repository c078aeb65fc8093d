"""Token memo, packing and wavelet files against the library itself."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldline.llm import packing, wavelet
from foldline.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("path", "words_only"), [(WORD, True), (BYTE, False)])
def test_memo_gives_the_library_s_ids(path, words_only):
    mine, plain, rnd = Encoder(path, words_only, memo=500), Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rnd.choice([" ", "\n", "a", "B", ".", "'s", "é", "\t", "1", " the", "  ", "ab", "İ", "Σ", "́", "\0", "　", "<|endoftext|>"]) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += [None, "x" * 1000, " ".join(["word"] * 3000)]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def _ids(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_is_whole_and_gapless(spark, edges):
    plain, want = Tokenizer.from_file(WORD), []
    for row in edges.collect():
        ids = _ids(plain, row["text"], 1)
        want += [(row["doc_id"], k, s, len(ids[s : s + 4096]), _crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    got = packing.pack_documents(edges, WORD).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 4096) + 1


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 100, rng.integers(1, 80))
        place, offset = packing.pack_block(sizes, 100)
        fill = np.bincount(place, sizes)
        assert fill.max() <= 100 and (np.unique(place) == np.arange(len(fill))).all()
        bins = packing.Bins(sizes, 100)
        bins.best_fit()
        assert len(fill) <= len(bins.items) and len(fill) >= bins.least()
    bins = packing.Bins(np.array([60, 60, 40, 30, 10]), 100)
    before = [[0, 3], [1], [2, 4]]
    bins.items, bins.fill = [list(x) for x in before], [90, 60, 50]
    bins.search()
    assert sum(map(bool, bins.items)) == 2


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 300, 3000), rng.zipf(1.4, 2500).clip(0, 50_000), np.zeros(17, int), np.array([5]), np.zeros(0, int), rng.integers(0, 200_000, 90_000)):
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert (m.tokens() == ids).all()
        for at in range(0, len(ids), max(1, len(ids) // 50)):
            token = int(ids[at])
            assert m.access(at) == token and m.rank(token, at) == (ids[:at] == token).sum()
            k = int((ids[:at] == token).sum())
            assert m.select(token, k) == at
        assert m.rank(299_999, len(ids)) == 0
        with pytest.raises(IndexError):
            m.access(len(ids))


def test_token_files_round_trip(spark, edges, nothing, tmp_path):
    plain = Tokenizer.from_file(BYTE)
    wavelet.write_tokens(edges, BYTE, f"{tmp_path}/t", shard_tokens=5_000)
    got = wavelet.read_documents(spark, f"{tmp_path}/t", ids=True).orderBy("start").collect()
    rows = sorted(edges.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for r, row in zip(got, rows, strict=True):
        ids = _ids(plain, row["text"], 0)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (row["doc_id"], at, len(ids), _crc(ids), ids)
        at += len(ids)
    assert spark.read.parquet(f"{tmp_path}/t").count() > 3
    for token in {0, got[6]["ids"][0], got[6]["ids"][-2], 49_999}:
        want = sorted((r["doc_id"] or -1, k) for r in got for k, x in enumerate(r["ids"]) if x == token)
        assert sorted((r["doc_id"] or -1, r["at"]) for r in wavelet.occurrences(spark, f"{tmp_path}/t", token).collect()) == want
    assert wavelet.encode_documents(nothing, BYTE).count() == 0


def test_a_file_answers_without_opening_all_of_it():
    ids = np.random.default_rng(4).integers(0, 40_000, 60_000)
    names = wavelet.pa.RecordBatch.from_pydict({"doc_id": ["a", None, "c"], "length": [10_000, 20_000, 30_000]})
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes(names))
    assert all(isinstance(p, bytes) for p in m.planes) and m.documents().equals(names)
    assert m.rank(40_001, 60_000) == 0 and all(isinstance(p, bytes) for p in m.planes)
    level, one = 3, 1
    plain = np.flatnonzero(np.unpackbits(m.plane(level), count=m.n) == one)
    assert [m.select1(level, one, k) for k in range(0, len(plain), 997)] == plain[::997].tolist()
    assert [m.rank1(level, at) for at in (0, 1, 511, 512, 513, 60_000)] == [(plain < at).sum() for at in (0, 1, 511, 512, 513, 60_000)]
    assert isinstance(m.planes[0], bytes) and m.planes[0] != m.plane(0).tobytes()


def test_rows_of_one_id_go_to_many_ranges(spark, tmp_path):
    docs = spark.range(600).selectExpr("cast(if(id < 500, 7, null) as bigint) doc_id", "concat(hash(id), ' some words') text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    wavelet.write_tokens(docs, BYTE, f"{tmp_path}/t", shard_tokens=100)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/t").select("part").distinct().count() == 3
    got = wavelet.read_documents(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 100 + [7] * 500


def test_rows_of_one_id_are_dealt_over_blocks(spark):
    pieces = spark.range(400).selectExpr("cast(null as bigint) doc_id", "0 piece", "0L start", "100L length", "7L ids_crc32")
    got = packing.pack(pieces, capacity=1000, block=50).collect()
    per = np.unique([r["sequence_id"] >> 32 for r in got], return_counts=True)[1]
    assert len(got) == 400 and len(per) > 4 and per.max() < 120


def test_local_search_tries_every_underfull_bin():
    lengths = np.random.default_rng(0).integers(1000, 1701, 2048)
    bins = packing.Bins(lengths, 4096)
    bins.best_fit()
    before = len(bins.items)
    bins.search()
    assert before - sum(map(bool, bins.items)) >= 40 and sorted(x for items in bins.items for x in items) == list(range(2048))
    assert [sum(bins.lengths[x] for x in items) for items in bins.items] == bins.fill and max(bins.fill) <= 4096
    # No move or swap of two small bins is left that raises the sum of squares.
    rng = np.random.default_rng(1)
    for _ in range(20):
        bins = packing.Bins(rng.integers(20, 60, 24), 100)
        bins.best_fit()
        bins.search()
        live = [b for b in range(len(bins.items)) if bins.items[b]]
        if len(live) == bins.least():
            continue
        total = lambda xs: sum(bins.lengths[x] for x in xs)
        for a in live:
            for b in live:
                outs = [c for k in (1, 2) for c in itertools.combinations(bins.items[a], k)]
                for out, back in itertools.product(outs, [(), *((x,) for x in bins.items[b])]):
                    moved = total(out) - total(back)
                    if a != b and bins.fill[b] + moved <= 100 and bins.fill[a] - moved <= 100:
                        assert moved * (bins.fill[b] - bins.fill[a] + moved) <= 0
    bins = packing.Bins(np.array([1] * 70 + [30]), 100)
    bins.items, bins.fill = [list(range(70)), [70]], [70, 30]
    bins.search()
    assert sum(map(bool, bins.items)) == 1


def test_part_filled_bins_of_blocks_are_packed_together(spark):
    pieces = spark.range(300).selectExpr("id doc_id", "0 piece", "0L start", "60L + id % 7 length", "7L ids_crc32")
    rows = packing.pack(pieces.unionByName(pieces.selectExpr("doc_id + 300 doc_id", "piece", "start", "30L - doc_id % 7 length", "ids_crc32")), capacity=1000, block=20).collect()
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 600 and len(bins) <= -(-sum(r["length"] for r in rows) // 1000) + 12
    for found in bins.values():
        assert [o for o, _ in sorted(found)] == [sum(n for _, n in sorted(found)[:i]) for i in range(len(found))] and sum(n for _, n in found) <= 1000
