"""Packing of documents into sequences of bounded length (best fit, then swap-based local search).

Documents become pieces of at most ``capacity`` tokens; only a longer document is cut. Pieces are dealt at
random over blocks of about ``block`` pieces, the number of which follows the input, and each block is packed
by itself: best fit in decreasing order, then a local search over the underfull bins. The search moves one
piece or two, or swaps one for one or two for one, so that the sum of squared fills grows, until the bins are as
few as the lengths need or no move or swap of any two bins grows it any more. The part-filled bins of all blocks
are then dealt, whole, over blocks of as many pieces and packed once more together, which never takes more bins.

Defined cases: a null text is empty (one piece that holds the end id alone), a null id stays null, repeated
rows are packed as often as they come, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, written
from .tokens import MEMO, encoder

CAPACITY = 4096
#: Pieces packed together by one task.
BLOCK = 8192
#: Most exchanges weighed at once; bounds memory, not the search.
CELLS = 1 << 18


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of a document's ids, four bytes each."""
    n = len(ids) // 4
    for piece, start in enumerate(range(0, n, capacity)):
        part = ids[4 * start : 4 * (start + capacity)]
        yield piece, start, len(part) // 4, part


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. memo: pieces of text that a worker remembers."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, words_only=True, memo=memo).encode
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                for piece, start, length, part in cut(ids + end, capacity):
                    rows.append(i)
                    for col, x in zip(cols, (piece, start, length, zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of a block: the pieces' positions in each, and how full each is."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = [int(x) for x in lengths], capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """In decreasing order, each piece into the fullest bin that still takes it."""
        room: list[tuple[int, int]] = []
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            need = self.lengths[i]
            at = bisect_left(room, (need, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += need
            insort(room, (left - need, b))

    def least(self) -> int:
        return -(-sum(self.lengths) // self.capacity)

    def search(self) -> None:
        """Moves and swaps until none raises the sum of squared fills, or the bins are as few as the lengths need.

        Every underfull bin is a giver: it gives one piece or two and takes one piece or none of another underfull bin.
        Full bins can't gain. A giver that hasn't changed since it was tried meets only bins that have changed since.
        """
        size, n, least = np.array(self.lengths, np.int64), len(self.items), self.least()
        fill, live = np.array(self.fill, np.int64), sum(map(bool, self.items))
        # What a bin may take back: a piece each, and nothing; where each of them is.
        back, home = np.concatenate([size, np.zeros(n, np.int64)]), np.concatenate([np.zeros(len(size), np.int64), np.arange(n)])
        for b, items in enumerate(self.items):
            home[items] = b
        tried, changed, tick = np.full(n, -1), np.zeros(n, np.int64), 0
        while live > least:
            before = tick
            for a in np.argsort(fill, kind="stable").tolist():
                while live > least and 0 < fill[a] < self.capacity:
                    fit = (fill > 0) & (fill < self.capacity)
                    fit[a] = False
                    if changed[a] <= tried[a]:
                        fit &= changed > tried[a]
                    tried[a] = tick
                    found = self.best(a, size, back, home, fill, np.flatnonzero(fit[home]) if fit.any() else ())
                    if found is None:
                        break
                    out, at = found
                    b, tick = int(home[at]), tick + 1
                    for x in out:
                        self.items[a].remove(x)
                        self.items[b].append(x)
                    home[out] = b
                    moved = int(size[out].sum() - back[at])
                    if at < len(size):
                        self.items[b].remove(at)
                        self.items[a].append(at)
                        home[at] = a
                    fill[a], fill[b] = fill[a] - moved, fill[b] + moved
                    changed[a] = changed[b] = tick
                    live -= (not self.items[a]) + (not self.items[b])
            if tick == before:
                break
        self.fill = fill.tolist()

    def best(self, a: int, size: np.ndarray, back: np.ndarray, home: np.ndarray, fill: np.ndarray, near: np.ndarray) -> tuple[list[int], int] | None:
        """The pieces out of bin a and the place in ``back`` that raise the sum of squares most; None if none does."""
        if not len(near):
            return None
        ways = self.ways(a)
        takes = np.fromiter(ways, np.int64, len(ways))
        give, ahead, room = back[near], fill[home[near]] - fill[a], self.capacity - fill[home[near]]
        most, found, step = 0, None, max(1, CELLS // len(near))
        for i in range(0, len(takes), step):
            moved = takes[i : i + step, None] - give
            gain = np.where((moved <= room) & (moved >= fill[a] - self.capacity), moved * (ahead + moved), 0)
            at = int(gain.argmax())
            if gain.flat[at] > most:
                most, found = int(gain.flat[at]), (ways[int(takes[i + at // len(near)])], int(near[at % len(near)]))
        return found

    def ways(self, a: int) -> dict[int, list[int]]:
        """One or two pieces of bin a for each length that they can have together."""
        by: dict[int, list[int]] = {}
        for x in self.items[a]:
            by.setdefault(self.lengths[x], []).append(x)
        ways = {s: xs[:1] for s, xs in by.items()}
        sizes = list(by)
        for i, s in enumerate(sizes):
            if len(by[s]) > 1:
                ways.setdefault(2 * s, by[s][:2])
            for t in sizes[:i]:
                ways.setdefault(s + t, [by[s][0], by[t][0]])
        return ways


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY, packed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0 without gaps. packed: the bin that each piece is in
    already; those bins are where the search starts if best fit takes more."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    if packed is not None:
        names, at = np.unique(packed, return_inverse=True)
        if len(names) < len(bins.items):
            bins.items = [[] for _ in names]
            for i, b in enumerate(at):
                bins.items[b].append(i)
            bins.fill = [sum(bins.lengths[i] for i in items) for items in bins.items]
    bins.search()
    place, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for items in bins.items:
        if items:
            at = 0
            for i in items:
                place[i], offset[i] = n, at
                at += bins.lengths[i]
            n += 1
    return place, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32)."""
    blocks = max(1, -(-pieces.count() // block))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths, first = rows.column("length").to_numpy(), rows.column("block")[0].as_py() << 32
        again = "sequence_id" in rows.column_names
        place, offset = pack_block(lengths, capacity, rows.column("sequence_id").to_numpy() if again else None)
        rows = rows.drop_columns(["block", *(["sequence_id"] if again else [])]).append_column("sequence_id", pa.array(place + first)).append_column("offset", pa.array(offset))
        return rows if again else rows.append_column("full", pa.array((np.bincount(place, lengths) >= capacity)[place]))

    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    # The row's place joins the hash, so that rows of one id, or of none, don't meet in one block.
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)))
    packed = dealt.groupBy("block").applyInArrow(run, StructType([*schema.fields]).add("full", "boolean"))
    if blocks == 1:
        return packed.drop("full")
    packed = written(packed, "packed")
    rest = packed.filter("not full").drop("full", "offset")
    more = max(1, -(-rest.count() // block))
    # Whole bins are dealt, and numbered behind the blocks of the first time.
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("sequence_id"), F.lit(more)) + F.lit(blocks))
    return packed.filter("full").drop("full").unionByName(dealt.groupBy("block").applyInArrow(run, schema))


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK, memo: int = MEMO) -> DataFrame:
    """Packs documents; one row per piece with its sequence and place there. A larger memo saves time for about 200
    bytes of a worker's memory a piece; the default leaves room for the stages of a pipeline."""
    return pack(written(pieces_of(docs, path, end_id, capacity, memo=memo), "pieces"), capacity, block)
