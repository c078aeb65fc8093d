"""Benchmark decontamination: a prefix-filtered join of benchmark windows and documents, in SQL functions alone.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window. A window is
a set of shingles, each ``SHINGLE`` words long (or as long as a shorter window), and it must be contained whole,
so a prefix of one shingle suffices: the rarest, by its occurrences in all documents. Three scans:

1. count the occurrences in documents of the shingles that windows have;
2. join the documents' shingles with each window's rarest one; the place of the match gives the start, and a
   start before the text or an end behind it is dropped (length and positional bounds);
3. compare the words of the whole window at each start that is left, in those documents only.

In 1 and 2 each document's shingles pass a sieve before they become rows, so few that match nothing do.
The words of the benchmark are broadcast only if a count proves them small; otherwise they are joined by
shuffle. Candidates are grouped by document, never by window or shingle, so no common passage makes a hot group.

Defined cases: a null or empty text has no words and no hits; items without words have no window; rows of a null
item id mark hits but aren't listed; rows that share a doc_id are told apart by their text; a null doc_id stays;
empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, spare, written

WINDOW = 10
SHINGLE = 3
#: Bits of the sieve that shingles pass before they are joined, as a power of two: at least, at most, and a shingle.
SIEVE_LEAST, SIEVE_MOST, SIEVE_BITS = 17, 23, 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and everything outside ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def shingles(words: Column, size: int) -> Column:
    """At each word the hash of the words from there on; the last places have shorter ones, which match nothing longer."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """window_id, words, size of its shingles: one row a distinct window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(window), F.lit(0)))
    cut = items.filter(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("at"))
    cut = cut.select("item_id", F.slice("words", F.col("at") + 1, window).alias("words"))
    return cut.withColumn("size", F.least(F.size("words"), F.lit(shingle)))


def sieve(tokens: DataFrame, size: int) -> tuple[Column, int]:
    """A test that every wanted shingle of a size passes, and few others: bits by hash, as a literal, and how many.

    They follow the wanted shingles up to a bound; beyond it more others pass, which costs time and changes nothing.
    """
    n = tokens.filter(F.col("size") == size).count()
    wide = 1 << min(SIEVE_MOST, max(SIEVE_LEAST, (SIEVE_BITS * n).bit_length()))
    place = F.col("token").bitwiseAND(wide - 1)
    words = tokens.filter(F.col("size") == size).groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits"))
    bits = [0] * (wide // 64)
    for row in words.collect():  # at most a row for 64 bits
        bits[row["word"]] = row["bits"]
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>"), wide  # folded into one literal


def scan(docs: DataFrame, wanted: DataFrame, sizes: list[int], keys: list[str]) -> DataFrame:
    """The shingles of documents that pass the sieve of the wanted ones: keys, size, at, token."""
    out = None
    for size in sizes:
        bits, wide = sieve(wanted, size)
        passes = lambda t: F.getbit(F.get(bits, F.shiftright(t, 6).bitwiseAND(wide // 64 - 1).cast("int")), t.bitwiseAND(63).cast("int")) == 1  # noqa: B023, E731
        marked = F.transform(shingles(F.col("words"), size), lambda t, i: F.when(passes(t), F.struct(i.alias("at"), t.alias("token"))))  # noqa: B023
        one = docs.select(*keys, F.lit(size).alias("size"), F.inline(F.array_compact(marked)))
        out = one if out is None else out.unionByName(one)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document with hits: k1, k2, spans (start, end in words, sorted), items (ids as sorted strings)."""
    keyed = keyed_words(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("words"))
    cut = written(windows_of(items, window, shingle), "windows")
    windows = written(cut.select("words", "size").distinct(), "distinct-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    tokens = None
    for size in sizes:
        one = windows.filter(F.col("size") == size).select("words", "size", F.posexplode(F.slice(shingles(F.col("words"), size), 1, F.size("words") - (size - 1))).alias("offset", "token"))
        tokens = one if tokens is None else tokens.unionByName(one)
    if tokens is None:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, spans array<struct<start:int,end:int>>, items array<string>")
    tokens = written(tokens, "tokens")
    wanted = written(tokens.select("size", "token").distinct(), "wanted")
    counts = scan(keyed, wanted, sizes, []).join(broadcast_if_small(wanted, 64), ["size", "token"]).groupBy("size", "token").agg(F.count(F.lit(1)).alias("n"))
    rarity = written(wanted.join(counts, ["size", "token"], "left").select("size", "token", F.coalesce("n", F.lit(0)).alias("n")), "rarity")
    # The prefix of a window: its rarest shingle. One that no document has drops the window.
    ranked = tokens.join(rarity, ["size", "token"]).groupBy("words", "size").agg(F.min(F.struct("n", "token", "offset")).alias("first"))
    prefixes = written(ranked.filter("first.n > 0").select("words", "size", "first.token", "first.offset"), "prefixes")
    measured = keyed.withColumn("n_words", F.size("words"))
    near = scan(measured, prefixes, sizes, ["k1", "k2", "n_words"]).join(broadcast_if_small(prefixes, 64), ["size", "token"])
    start = F.col("at") - F.col("offset")
    near = near.filter((start >= 0) & (start + F.size("words") <= F.col("n_words")))
    near = near.groupBy("k1", "k2").agg(F.collect_set(F.struct(start.alias("start"), F.col("words").alias("window"))).alias("near"))
    near = written(near, "candidates")
    texts = keyed.join(broadcast_if_small(near.select("k1", "k2"), 32), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    proven = texts.join(near, ["k1", "k2"]).select(
        "k1", "k2", F.filter("near", lambda c: F.slice(F.col("words"), c["start"] + 1, F.size(c["window"])) == c["window"]).alias("hits")
    )
    proven = written(proven.filter(F.size("hits") > 0), "hits")
    spans = proven.select("k1", "k2", F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.size(h["window"])).alias("end"))))).alias("spans"))
    named = proven.select("k1", "k2", F.explode(F.array_distinct(F.col("hits.window"))).alias("words"))
    named = named.join(cut.filter("item_id is not null").select("words", "item_id").distinct(), "words").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return spans.join(named, ["k1", "k2"], "left").select("k1", "k2", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keyed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 name a row by its id and its text."""
    key = row_key(F.col(id_col), F.col(text_col))
    return docs.select(key[0].alias("k1"), key[1].alias("k2"), words_of(F.col(text_col)).alias("words"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))), F.xxhash64(text)


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    found = written(contaminated(docs, benchmark, window, id_col=id_col, text_col=text_col), "contaminated")
    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), key[0].alias("k1"), key[1].alias("k2"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", covered(spans).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"), (F.size(spans) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    found = written(contaminated(docs, benchmark).select("k1", "k2"), "contaminated")
    key = row_key(F.col("doc_id"), F.col("text"))
    one, two = spare(docs, "_key_1"), spare(docs, "_key_2")
    found = broadcast_if_small(found.toDF(one, two), 32)
    return docs.join(found, (key[0] == F.col(one)) & (key[1] == F.col(two)), "left_anti")
