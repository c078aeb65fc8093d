"""Self join of documents by the Jaccard similarity of their word shingles, and its connected components.

Candidates come from adaptive multi-match prefixes. Shingles are put into one order for all documents, the
rarest first. If two sets of sizes m and n are alike enough, then for every l >= 1 their prefixes of
``size - ceil(t * size) + l`` shingles share at least l. Each document lengthens its own prefix: for every l it
estimates what its candidates would cost (the posting lists it reads, and how many documents could share l of
them, each of which is verified), and takes the cheapest. Two documents must share the smaller l of the two.

Steps, none of which holds an unbounded group or a broadcast:

1. *Shared shingles.* Sets are hashed in Python, by blocks; a first pass counts each shingle over all documents
   and returns, for each document, how many of its shingles occur elsewhere too. Every shingle that two linked
   documents have in common occurs twice, so a document with fewer than t of its shingles shared has no link.
2. *Classes.* Of the rest, rows of one set are one class with a number of its own; from here on only the classes'
   representatives count.
3. *Prefixes* over the exact counts among representatives.
4. *Links.* In a group of near copies all pairs of a posting list would grow with its square. In each round every
   list has one pivot; only a pivot and a member of another component are paired, and what is linked is joined
   into one component. Lists within one component are done: their pairs can join nothing new. After the rounds
   all pairs of different components that are left in a list are decided, with no cap. Every pair must share the
   prefix shingles that its extensions call for (``matched``) before its sets are fetched and compared.
5. *Components* by label propagation with shortcuts over written tables; then labels of rows that have one id are
   joined, and each component gets its smallest id.

The similarity test is exact in integers (100 * shared >= 80 * union) on sets of 64-bit shingle hashes.

Defined cases: a null, empty or word-less text has no shingles and stays alone; fewer words than a shingle make
one shingle; repeated texts are one class; rows with one id are one document that has the links of all of them, and
each row gives its own n_shingles; rows with a null id are documents of their own, through which links run, but
their class_id and component_id are null; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, chunks, mix64, small_batches, written

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
#: Longest extension of a prefix, and the cost of verifying a candidate in posting-list entries a shingle.
EXTEND = 8
VERIFY = 0.25
ROUNDS = 2
#: Pairs of one node that meet its set in one place.
PAIRS = 256
#: Shingles that a bucket of the first pass should hold, and that a block of rows is closed at.
BUCKET = 1 << 18
BLOCK = 1 << 18
#: Shingles of a message at least, and buckets at most; beyond that the buckets grow (2**18 hold 10**13 shingles).
MESSAGE = 64
MOST_BUCKETS = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: An odd multiplier and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles.

    A word's hash is a polynomial over its bytes, taken from running sums over the whole run of texts.
    """
    out: list[np.ndarray] = []
    for _, some in chunks(texts, 400_000):
        raw = [x.encode("utf-8", "surrogatepass") for x in some]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        data = _LOWER[data]
        space = _SPACE[data]
        inside = ~space
        starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data) - 1), dtype=np.uint64)])
        word = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) - 1)[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, np.cumsum([0, *[len(x) + 1 for x in raw]]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = b - a
            k = min(words, n)
            if not k:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.full(n - k + 1, k, np.uint64)
            for i in range(k):
                h = mix64(h ^ word[a + i : b - k + 1 + i]) + np.uint64(0x2545F4914F6CDD1D)
            out.append(np.unique(h))
    return out


def packed(rows: np.ndarray, counts: np.ndarray, n: int) -> bytes:
    """Counts of some of n rows, as pairs or, where that is shorter, as one count a row."""
    if 2 * len(rows) < n:
        return b"p" + rows.astype("<u4").tobytes() + counts.astype("<u4").tobytes()
    dense = np.zeros(n, "<u4")
    dense[rows] = counts
    return b"d" + dense.tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts) in the order of rows."""
    both = np.frombuffer(raw, "<u4", offset=1)
    if raw[:1] == b"p":
        return both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :].astype(np.int64)
    rows = np.flatnonzero(both)
    return rows, both[rows].astype(np.int64)


def _dealt(sets: list[np.ndarray], buckets: int, head: int) -> tuple[np.ndarray, list[tuple[int, bytes, bytes]]]:
    """Of a block of rows: how many of each row's shingles another row of it has, and the messages (bucket, bits,
    packed counts); the bucket ``head`` always gets one."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    del order
    same = np.concatenate([[False], every[1:] == every[:-1]])
    many = same | np.concatenate([same[1:], [False]])
    # A shingle of several rows here is shared already: it is sent once, after the others, and for no row.
    local = np.bincount(owner[many], minlength=len(sets))
    send = np.concatenate([np.flatnonzero(~many), np.flatnonzero(many & ~same)])
    bits, row = every[send], np.concatenate([owner[~many], np.full(np.count_nonzero(many & ~same), len(sets), np.int32)])
    del every, owner, send
    bucket = ((mix64(bits) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    by = np.lexsort((row, bucket))
    bits, row, bucket = bits[by].astype("<u4"), row[by], bucket[by]
    used = np.union1d(bucket, [head])
    cut = np.searchsorted(bucket, np.append(used, buckets))
    out = []
    for k, b in enumerate(used.tolist()):
        mine = row[cut[k] : cut[k + 1]]
        mine = mine[: np.searchsorted(mine, len(sets))]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        out.append((b, bits[cut[k] : cut[k + 1]].tobytes(), packed(mine[first], np.diff(np.append(first, len(mine))), len(sets))))
    return local, out


def count_shared(docs: DataFrame, buckets: int, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n, shared: per row the size of its set and how many of its shingles another row has too.

    A block of rows sends each bucket its shingles as one array of 32 further bits of the hash, row by row, and
    how many are each row's. A bucket answers each block with the counts of what it found twice. Shingles that
    agree in bucket and bits count as one; that only lets a row stay that has no link, and such accidents stay
    rare because the buckets follow the input. A shingle of many rows is sent once a block, so a common one makes
    no bucket large. The ids and sizes of a block travel with its message to a bucket that follows from its number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, sets, held, schema = (TaskContext.get().partitionId() << 32), 0, [], [], 0, None

        def out() -> pa.RecordBatch:
            at = int(mix64(np.array([part + number], np.uint64))[0] % np.uint64(buckets))
            local, messages = _dealt(sets, buckets, at)
            head = [(keys, [len(x) for x in sets], local.astype("<u4").tobytes()) if m[0] == at else (None, None, None) for m in messages]
            columns = [[m[0] for m in messages], [part + number] * len(messages), [m[1] for m in messages], [m[2] for m in messages], *zip(*head, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema({"bucket": pa.int64(), "block": pa.int64(), "bits": pa.binary(), "counts": pa.binary(), "keys": pa.list_(batch.schema.field(0).type), "sizes": pa.list_(pa.int64()), "local": pa.binary()})
            for key, one in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), words), strict=True):
                keys.append(key)
                sets.append(one)
                held += len(one)
                if held >= block:
                    yield out()
                    keys, sets, held, number = [], [], 0, number + 1
        if keys:
            yield out()

    def count(group: pa.Table) -> pa.Table:
        messages, raw = group.column("bits").to_pylist(), group.column("counts").to_pylist()
        bits = np.frombuffer(b"".join(messages), "<u4")
        order = np.argsort(bits, kind="stable")
        same = bits[order][1:] == bits[order][:-1]
        twice = np.zeros(len(bits), bool)
        if len(bits):
            twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        found, at = [], 0
        for one, counts in zip(messages, raw, strict=True):
            rows, sizes = unpacked(counts)
            run = np.concatenate([[0], np.cumsum(twice[at : at + len(one) // 4])])
            ends = np.cumsum(sizes)
            hits = run[ends] - run[ends - sizes]
            found.append(packed(rows[hits > 0], hits[hits > 0], (len(counts) - 1) // 4 if counts[:1] == b"d" else 1 << 32))
            at += len(one) // 4
        return group.select(["block", "keys", "sizes", "local"]).append_column("found", pa.array(found, pa.binary()))

    def total(group: pa.Table) -> pa.Table:
        head = group.filter(pc.is_valid(group.column("keys"))).to_pylist()[0]
        shared = np.frombuffer(head["local"], "<u4").astype(np.int64)
        for raw in group.column("found").to_pylist():
            rows, hits = unpacked(raw)
            shared[rows] += hits
        return pa.table({"doc_id": pa.array(head["keys"], group.schema.field("keys").type.value_type), "n": pa.array(head["sizes"], pa.int64()), "shared": pa.array(shared)})

    dealt = docs.mapInArrow(deal, f"bucket long, block long, bits binary, counts binary, keys array<{kind}>, sizes array<long>, local binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, f"block long, keys array<{kind}>, sizes array<long>, local binary, found binary")
    return counted.groupBy("block").applyInArrow(total, f"doc_id {kind}, n long, shared long")


def dealing(shingles: int) -> tuple[int, int]:
    """(buckets, shingles of a block) for a corpus. Both grow with it, so that a bucket fits a task and a message from
    a block to a bucket keeps some dozens of shingles."""
    buckets = min(max(1, shingles // BUCKET), MOST_BUCKETS)
    return buckets, max(BLOCK, MESSAGE * buckets)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, digest of the set, tokens (the set, as signed integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "tokens"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, digest binary, tokens array<long>")


def extension(n: int, counts: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """(l, how many shared shingles its prefix has) for a set of n with these ascending counts of its shared
    shingles; (0, 0) if no set can be alike enough."""
    first = n + (-percent * n // 100) + 1 - (n - len(counts))
    if first <= 0:
        return 0, 0
    run = np.cumsum(counts, dtype=np.float64)
    best = None
    for more in range(1, EXTEND + 1):
        take = first + more - 1
        if take > len(counts):
            break
        cost = run[take - 1] + VERIFY * n * run[take - 1] / more
        if best is None or cost < best[0]:
            best = cost, more, take
    return best[1:]


def prefixes(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The prefix of each representative that can have a link, a row a shingle that others have too: node, n, l, how
    many shingles it has alone, size of the prefix without those, the place in the order, token."""
    tokens = reps.select("node", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    lists = tokens.join(counts, "token").groupBy("node", "n").agg(F.collect_list("count").alias("counts"), F.collect_list("token").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for row in batch.to_pylist():
                counts, mine = np.array(row["counts"], np.int64), np.array(row["tokens"], np.int64)
                order = np.lexsort((mine, counts))
                more, take = extension(row["n"], counts[order], percent)
                alone = row["n"] - len(counts)
                for col, x in zip(cols, (row["node"], row["n"], more, alone, take), strict=False):
                    col.append(np.full(take, x, np.int64))
                cols[5].append(np.arange(take, dtype=np.int64) + alone)
                cols[6].append(mine[order[:take]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["node", "n", "l", "alone", "size", "at", "token"])

    return lists.select("node", "n", "counts", "tokens").mapInArrow(run, "node long, n long, l long, alone long, size long, at long, token long")


def possible(a: str, b: str, percent: int) -> Column:
    """Whether two sets that share a shingle can be alike enough, from its places in them: before it they share
    at most the shorter stretch of shingles that occur elsewhere at all, behind it the shorter rest."""
    at = lambda side, name: F.col(side.format(name))
    most = F.least(at(a, "at") - at(a, "alone"), at(b, "at") - at(b, "alone")) + F.least(at(a, "n") - at(a, "at"), at(b, "n") - at(b, "at"))
    return most * (100 + percent) >= (at(a, "n") + at(b, "n")) * percent


def hot(pairs: DataFrame) -> DataFrame:
    """b, k: nodes that many pairs have on their side b, and over how many parts those are dealt."""
    n = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("k"))
    return broadcast_if_small(written(n.filter("k > 1"), "hot"), 16)


def both_sides(pairs: DataFrame, rows: DataFrame, many: DataFrame) -> DataFrame:
    """Pairs with the columns of both nodes' rows (node, ...). The pairs of a hot node are dealt over parts, each of which
    meets a copy of that node's row."""
    one, two = (rows.toDF(side, *[f"{c}_{side}" for c in rows.columns[1:]]) for side in "ab")
    k = F.coalesce("k", F.lit(1))
    dealt = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), k).cast("int").alias("part"))
    copies = two.join(many, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), k - 1))).drop("k")
    return dealt.join(one, "a").join(copies, ["b", "part"])


def matched(pairs: DataFrame, whole: DataFrame, many: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of nodes those whose prefixes share as many shingles as the shorter extension calls for.

    Beyond the prefix that ends first in the order, at most the rest of its set is shared.
    """
    common = F.size(F.array_intersect("prefix_a", "prefix_b"))
    enough = (common >= F.least("l_a", "l_b")) & ((common + F.greatest("rest_a", "rest_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return both_sides(pairs, whole, many).filter(enough).select("a", "b")


def verified(pairs: DataFrame, whole: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of nodes those that are alike enough; only pairs that match have their sets fetched."""
    many = hot(pairs)
    pairs = written(matched(pairs, whole, many, percent), "matched")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    alike = both * 100 >= percent * (F.size("tokens_a") + F.size("tokens_b") - both)
    return both_sides(pairs, reps.select("node", "tokens"), many).filter(alike).select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: labels joined along links (a, b between labels), each the smallest it reaches."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    now = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "labels")
    while True:
        # By broadcast where the labels are few, so that a node of many links doesn't make one task large.
        near = edges.join(broadcast_if_small(now, 16).toDF("b", "next"), "b").groupBy("a").agg(F.min("next").alias("next"))
        step = now.join(near, "a").select("a", F.least("to", "next").alias("next"))
        jump = broadcast_if_small(now, 16).toDF("next", "far")
        step = written(step.join(jump, "next").join(now, "a").select("a", F.least("next", "far").alias("to"), (F.least("next", "far") < F.col("to")).alias("moved")), "labels")
        moved = step.filter("moved").limit(1).count()
        now = step.select("a", "to")
        if not moved:
            break
    return written(labels.join(now.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def linked(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label for the representatives that can have a link."""
    posts = written(prefixes(reps, percent), "posts")
    labels = written(posts.select("node").distinct().withColumn("label", F.col("node")), "labels")
    rest = (F.col("n") - F.col("alone") - F.col("size")).alias("rest")
    whole = written(posts.groupBy("node", "n", "l", rest).agg(F.collect_list("token").alias("prefix")), "prefixes")
    # The pivot of a list has the fewest shingles of its own, so it is nearest to the rest; in the second round the
    # pivot is the nearest of those that the first one didn't join.
    nearest = F.min(F.struct("alone", F.xxhash64("node").alias("order"), "node", "n", "at", "label")).alias("pivot")
    for turn in range(ROUNDS):
        here = posts.join(broadcast_if_small(labels, 16), "node")
        lists = here.groupBy("token").agg(nearest, F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        if turn:
            # One row a component of a list: what the first round joined weighs no more, however long the list.
            own = written(here.groupBy("token", "label").agg(nearest), "nearest")
            best = own.groupBy("token").agg(F.min("pivot").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            lists = own.join(best.select("token", F.col("pivot.label").alias("done")), "token").filter("label <> done").groupBy("token").agg(F.min("pivot").alias("pivot"))
        pairs = here.join(lists.select("token", "pivot"), "token").filter((F.col("label") != F.col("pivot.label")) & possible("{}", "pivot.{}", percent))
        pairs = written(pairs.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct(), "pairs")
        labels = merged(labels, verified(pairs, whole, reps, percent))
    # What is left: all pairs of different components in a list. They meet at a shingle within the shorter prefixes that
    # their sizes call for; there the longer prefixes of both must share enough, before anything is put out.
    here = posts.join(broadcast_if_small(labels, 16), "node").withColumn("rest", F.col("n") - F.col("alone") - F.col("size"))
    lists = here.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    here = written(here.filter(f"(n - at) * 100 >= n * {percent}").join(lists, "token", "left_semi"), "open")
    here = here.join(whole.select("node", "prefix"), "node")
    one, two = (here.toDF(*[c if c == "token" else f"{c}_{side}" for c in here.columns]) for side in "ab")
    need = (F.col("n_a") + F.col("n_b")) * percent
    short = (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (100 + percent) >= need) & possible("{}_a", "{}_b", percent)
    common = F.size(F.array_intersect("prefix_a", "prefix_b"))
    enough = (common >= F.least("l_a", "l_b")) & ((common + F.greatest("rest_a", "rest_b")) * (100 + percent) >= need)
    pairs = one.join(two, (one["token"] == two["token"]) & (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & short & enough)
    pairs = written(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    return merged(labels, verified(pairs, whole, reps, percent))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after links between nodes."""
    few = broadcast_if_small(labels, 16)
    links = written(links.join(few.toDF("a", "la"), "a").join(few.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
    return components(labels, links) if links.limit(1).count() else labels


def named(rows: DataFrame) -> DataFrame:
    """doc_id, class_id, component_id of the ids in rows (doc_id, class_id, label): labels that an id has in common are
    joined, and each component is named by its smallest id."""
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("b"), F.max("label").alias("high")).filter("b < high").select("doc_id", "b")
    links = written(rows.join(several, "doc_id").select(F.col("label").alias("a"), "b").filter("a <> b").distinct(), "same-id")
    if links.limit(1).count():
        labels = components(rows.select(F.col("label").alias("node"), "label").distinct(), links)
        rows = rows.join(broadcast_if_small(labels, 16).toDF("label", "to"), "label").select("doc_id", "class_id", F.col("to").alias("label"))
    names = written(rows.groupBy("label").agg(F.min("class_id").alias("component_id")), "names")
    rows = rows.filter("doc_id is not null").join(broadcast_if_small(names, 16), "label")
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))


def similar(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (smallest id of its set), component_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, block = dealing(size // 6)
    every = written(count_shared(docs, buckets, words, block), "sizes")
    stay = written(every.filter(f"n > 0 and shared * 100 >= {percent} * n").select(F.col("doc_id").alias("stay_id")).distinct(), "stay")
    here = docs.join(broadcast_if_small(stay, 16), F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi")
    sets = written(sets_of(here, words), "sets").filter("n > 0")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    # Numbered as it is written: a row's number is settled with the file that holds it.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = linked(classes.select("node", "n", "tokens"), percent)
    mine = sets.select("doc_id", "digest").join(broadcast_if_small(classes.select("digest", "node", "class_id"), 40), "digest").join(broadcast_if_small(labels, 16), "node", "left")
    mine = written(mine.select("doc_id", "class_id", F.coalesce("label", "node").alias("label")), "labelled")
    return every.join(named(mine), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
