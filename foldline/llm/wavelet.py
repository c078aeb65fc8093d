"""Token files as wavelet matrices: one compressed file per shard, in ascending id order.

``write_tokens`` deals documents into ranges of ids, encodes each range in order and writes its shards; a shard
holds whole documents. ``read_documents`` reads the shards back. A shard's file has a bit plane for each bit of its
own alphabet; a plane keeps the bits that a stable partition by the planes above leaves there. The file also has a
directory of counts for each plane, which gives rank and select, hence access, counting and occurrence lookup, and
the ids and lengths of its documents. Directories are read where they lie; planes are compressed one by one and
only those that a question needs are opened. ``occurrences`` asks all shards for a token so.

File: magic; tokens, size of the alphabet, planes, bytes of the document section, bytes of the alphabet section
(4 bytes each, little endian, as all numbers); of each plane its zeros and the bytes of its bits; of each plane the
ones before every ``RANK_BITS`` bits and in all; the document section (an Arrow stream of ids and lengths), the
alphabet's ids and the planes' bits, each compressed with zstandard. The files are the blobs of a Parquet table.

Defined cases: a null text is empty (its end id alone), rows of one id keep the order of their texts, a null id
comes first, an empty table gives no shards and no rows, further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches
from .tokens import encoder

MAGIC = b"FLW2"
#: A shard ends with the document that brings it to so many tokens.
SHARD_TOKENS = 250_000
#: Pieces that the encoder remembers; pieces with their case and spaces are many.
MEMO = 1_600_000
#: Bits between two entries of the rank directory.
RANK_BITS = 512
#: Rows of one id that may go to one range together.
ID_ROWS = 100
#: Bytes of input, as the scan estimates them, that a range of ids should have at most.
RANGE_BYTES = 64 << 20


class WaveletMatrix:
    """Bit planes from the highest bit down, over codes of the sorted alphabet; planes may be compressed still."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], ranks: list[np.ndarray], planes: list, documents: bytes = b"") -> None:
        self.n, self.alphabet, self.zeros, self.ranks, self.planes, self._documents = n, alphabet, zeros, ranks, planes, documents

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        code = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if len(alphabet) <= 65536 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        now, zeros, planes, ranks = code[ids] if len(ids) else code[:0], [], [], []
        for level in range(levels - 1, -1, -1):
            bits = ((now >> now.dtype.type(level)) & now.dtype.type(1)).astype(bool)
            plane = np.packbits(bits)
            ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), RANK_BITS // 8), dtype=np.int64)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            low = np.compress(~bits, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(bits, now)])
        return cls(len(ids), alphabet.astype("<u4"), zeros, ranks, planes)

    def plane(self, level: int) -> np.ndarray:
        if isinstance(self.planes[level], bytes):
            self.planes[level] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.planes[level]), np.uint8)
        return self.planes[level]

    def tokens(self) -> np.ndarray:
        """All ids, decoded from the lowest plane up."""
        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 65536 else np.uint32)
        for up, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            zeros, bits = self.zeros[level], np.unpackbits(self.plane(level), count=self.n).view(bool)
            out = np.empty_like(code)
            out[np.flatnonzero(~bits)] = code[:zeros]
            out[np.flatnonzero(bits)] = code[zeros:] | code.dtype.type(1 << up)
            code = out
        return self.alphabet[code]

    def to_bytes(self, documents: pa.RecordBatch | None = None) -> bytes:
        """The file; documents: their ids and lengths."""
        pack = zstandard.ZstdCompressor(level=1).compress
        if documents is not None:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, documents.schema) as out:
                out.write_batch(documents)
            self._documents = pack(sink.getvalue().to_pybytes())
        alphabet, planes = pack(self.alphabet.tobytes()), [pack(self.plane(k).tobytes()) for k in range(len(self.planes))]
        head = np.array([self.n, len(self.alphabet), len(planes), len(self._documents), len(alphabet)], "<u4").tobytes()
        sizes = np.array([x for z, p in zip(self.zeros, planes, strict=True) for x in (z, len(p))], "<u4").tobytes()
        return b"".join([MAGIC, head, sizes, *[r.tobytes() for r in self.ranks], self._documents, alphabet, *planes])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, size, levels, documents, alphabet = (int(x) for x in np.frombuffer(blob, "<u4", 5, 4))
        sizes, at, blocks = np.frombuffer(blob, "<u4", 2 * levels, 24).tolist(), 24 + 8 * levels, -(-n // RANK_BITS) + 1
        ranks = [np.frombuffer(blob, "<u4", blocks, at + 4 * blocks * k) for k in range(levels)]
        at += 4 * blocks * levels
        end = at + documents
        ids = zstandard.ZstdDecompressor().decompress(blob[end : end + alphabet])
        planes, end2 = [], end + alphabet
        for length in sizes[1::2]:
            planes.append(blob[end2 : end2 + length])
            end2 += length
        return cls(n, np.frombuffer(ids, "<u4", size), sizes[::2], ranks, planes, blob[at:end])

    def documents(self) -> pa.RecordBatch:
        """Ids and lengths of the shard's documents, in order."""
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._documents)).read_next_batch()

    def rank1(self, level: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        block = at // RANK_BITS
        plane, start = self.plane(level), block * RANK_BITS // 8
        whole = int(np.bitwise_count(plane[start : at // 8]).sum())
        rest = int(plane[at // 8]) >> (8 - at % 8) if at % 8 else 0
        return int(self.ranks[level][block]) + whole + rest.bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        code = 0
        for level in range(len(self.planes)):
            bit = int(self.plane(level)[at // 8]) >> (7 - at % 8) & 1
            ones = self.rank1(level, at)
            code = code << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return int(self.alphabet[code])

    def code(self, token: int) -> int | None:
        code = int(np.searchsorted(self.alphabet, token))
        return code if code < len(self.alphabet) and self.alphabet[code] == token else None

    def _span(self, token: int, end: int) -> tuple[int, int] | None:
        """Where the occurrences before ``end`` lie below the lowest plane."""
        code = self.code(token)
        if code is None:
            return None
        low, high = 0, end
        for level in range(len(self.planes)):
            a, b = self.rank1(level, low), self.rank1(level, high)
            one = code >> (len(self.planes) - 1 - level) & 1
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if one else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before a position."""
        span = self._span(token, end)
        return span[1] - span[0] if span else 0

    def select1(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a plane that equals ``one``: the block by the directory, the bit in it."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * RANK_BITS - ones
        block = int(np.searchsorted(before[:-1], k, side="right")) - 1
        start = block * RANK_BITS
        bits = np.unpackbits(self.plane(level)[start // 8 : (start + RANK_BITS) // 8])
        return start + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        span = self._span(token, self.n)
        if not span or not 0 <= k < span[1] - span[0]:
            raise IndexError(k)
        at, code = span[0] + k, self.code(token)
        for level in range(len(self.planes) - 1, -1, -1):
            one = code >> (len(self.planes) - 1 - level) & 1
            at = self.select1(level, one, at - self.zeros[level] if one else at)
        return at


def write_tokens(docs: DataFrame, path: str, to: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards as a Parquet table at ``to``: one row a shard, in id ranges, with its file and an index (the
    part and place of the shard, its first token within the part, its tokens, first and last id).

    Ranges are cut by the id and, where one has many rows, by how its texts begin, so that those are dealt too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    end = np.array([end_id], dtype="<u4").tobytes()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, words_only=False, memo=MEMO).encode
        ids: list = []
        parts: list[bytes] = []
        held, first, shard = 0, 0, 0

        def shut() -> pa.RecordBatch:
            nonlocal ids, parts, held, first, shard
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u4"))
            documents = pa.RecordBatch.from_arrays([pa.array(ids, kind.field("first_id").type), pa.array([len(x) // 4 for x in parts], pa.int64())], names=["doc_id", "length"])
            row = {"shard": [shard], "first_token": [first], "n_tokens": [matrix.n], "first_id": [ids[0]], "last_id": [ids[-1]], "blob": [matrix.to_bytes(documents)]}
            first, shard = first + matrix.n, shard + 1
            ids, parts, held = [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=kind)

        kind = None
        for batch in batches:
            of = batch.schema.field(0).type
            kind = kind or pa.schema({"shard": pa.int64(), "first_token": pa.int64(), "n_tokens": pa.int64(), "first_id": of, "last_id": of, "blob": pa.binary()})
            for doc_id, x in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                parts.append(x + end)
                held += len(x) // 4 + 1
                if held >= shard_tokens:
                    yield shut()
        if ids:
            yield shut()

    # Texts are sampled for the ranges only where an id has many rows.
    most = narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keys = ["doc_id", *([F.substring("text", 1, 32)] if most > ID_ROWS else [])]
    # The session's count of partitions, unless the scan is too large for it; an estimate that is out of all reason is none.
    size = int(str(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = size // RANGE_BYTES if size < 1 << 50 else 0
    dealt = narrow.repartitionByRange(*([parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []), *keys)
    dealt = dealt.sortWithinPartitions("doc_id", "text")
    shards = dealt.mapInArrow(run, f"shard long, first_token long, n_tokens long, first_id {id_type}, last_id {id_type}, blob binary")
    shards.select(F.spark_partition_id().alias("part"), "*").write.parquet(to)


def _begins(shards: DataFrame) -> dict[int, int]:
    """Tokens before each partition of the writer, of which this is a list."""
    at, out = 0, {}
    for row in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        out[row["part"]] = at
        at += row["n"]
    return out


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document out of the files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    shards = spark.read.parquet(path)
    small_batches(spark)
    id_type, base = shards.schema["first_id"].dataType.simpleString(), _begins(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["blob"])
                documents, tokens = matrix.documents(), matrix.tokens()
                lengths = documents.column("length").to_numpy()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [documents.column("doc_id"), pa.array(starts + (row["first_token"] + base[row["part"]])), documents.column("length"), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array([tokens[a:b].tolist() for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return shards.select("part", "first_token", "blob").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """One row per occurrence of a token: doc_id, at (its place in the document), by select in the files alone; a shard
    without the token in its alphabet opens no plane."""
    shards = spark.read.parquet(path)
    id_type = shards.schema["first_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                matrix = WaveletMatrix.from_bytes(blob)
                n = matrix.rank(token, matrix.n)
                if n:
                    documents = matrix.documents()
                    ends = np.cumsum(documents.column("length").to_numpy())
                    places = np.array([matrix.select(token, k) for k in range(n)], np.int64)
                    at = np.searchsorted(ends, places, side="right")
                    yield pa.RecordBatch.from_arrays([documents.column("doc_id").take(pa.array(at)), pa.array(places - np.concatenate([[0], ends])[at])], names=["doc_id", "at"])

    return shards.select("blob").mapInArrow(run, f"doc_id {id_type}, at long")


def encode_documents(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes documents into shards in the shared folder and reads them back."""
    to = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, to, end_id)
    return read_documents(docs.sparkSession, to)
