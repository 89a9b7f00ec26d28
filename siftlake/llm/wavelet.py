"""Token-id output: every shard of documents is one wavelet matrix in one compressed value.

The value holds the rank directory and every plane by itself, compressed only where that saves a fifth.  A lookup reads
the directory as it lies there and opens the planes that it walks through.

A wavelet matrix keeps one bit plane for each bit of an id, most significant first.  Under each plane the ids are
stably dealt into those with bit 0 and those with bit 1, so a token is read, counted and found by walking down the
planes with rank and up with select.  Shards hold ascending documents and are rows of a Parquet table, which Spark's
committers write whole or not at all.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.encoding import encoder, vocabulary_path, with_end
from siftlake.llm.shared import lean, parts_for, shared_dir, small, table

_HEAD = struct.Struct("<4sBQ")
_BLOCK = 512  # bits between two entries of a rank directory


class WaveletMatrix:
    """Ids with access, rank, select, count and occurrence lookup."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        """``planes``: packed bits, most significant plane first, or compressed ones, which are opened when they are needed."""
        self.n, self._planes = n, list(planes)
        #: For each plane the number of ones before each block.
        self.ranks = ranks if ranks is not None else [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        full = np.zeros(-(-len(plane) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
        full[:len(plane)] = plane
        return np.concatenate([[0], np.cumsum(np.bitwise_count(full.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64))])

    def plane(self, level: int) -> np.ndarray:
        plane = self._planes[level]
        if isinstance(plane, bytes):
            plane = self._planes[level] = np.frombuffer(zstandard.ZstdDecompressor().decompress(plane), np.uint8)
        return plane

    @property
    def bits(self) -> int:
        return len(self._planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        bits = int(ids.max()).bit_length() if len(ids) else 0
        ids = ids.astype(np.uint16) if bits <= 16 else ids
        planes = []
        for b in range(bits - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << b)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            if b:
                # Taking by places is three times as fast as by a mask.
                ids = np.concatenate([ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        """Head, for each plane its size (negative: compressed), the rank directories, the planes."""
        press, parts, sizes = zstandard.ZstdCompressor(level=1), [], []
        for level in range(self.bits):
            raw = self.plane(level).tobytes()
            small = press.compress(raw)
            packed = len(small) < 0.8 * len(raw)
            parts.append(small if packed else raw)
            sizes.append(-len(small) if packed else len(raw))
        # A shard of more ids than 32 bits count keeps wide directories.
        kind = "<u4" if self.n < 1 << 32 else "<u8"
        return _HEAD.pack(b"WVM2", self.bits, self.n) + struct.pack(f"<{self.bits}q", *sizes) + b"".join(r.astype(kind).tobytes() for r in self.ranks) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = _HEAD.unpack_from(data)
        if magic != b"WVM2":
            raise ValueError("not a wavelet matrix")
        sizes = struct.unpack_from(f"<{bits}q", data, _HEAD.size)
        kind = np.dtype("<u4" if n < 1 << 32 else "<u8")
        at, entries = _HEAD.size + 8 * bits, -(-n // _BLOCK) + 1
        ranks = [np.frombuffer(data, kind, entries, at + level * entries * kind.itemsize) for level in range(bits)]
        at += bits * entries * kind.itemsize
        planes: list = []
        for size in sizes:
            planes.append(np.frombuffer(data, np.uint8, size, at) if size >= 0 else bytes(data[at:at - size]))
            at += abs(size)
        return cls(n, planes, ranks)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.plane(level), count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids, by undoing the deals from the last plane to the first."""
        bits = self.bits
        ids = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            ones, bit = self._bits(level), ids.dtype.type(1 << bits - 1 - level)
            if level == bits - 1:
                ids = ones.astype(ids.dtype)
                continue
            zeros = self.n - int(np.count_nonzero(ones))
            dealt, ids = ids, np.empty_like(ids)
            ids[np.flatnonzero(~ones)], ids[np.flatnonzero(ones)] = dealt[:zeros], dealt[zeros:] | bit
        return ids

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _BLOCK
        start = block * (_BLOCK // 8)
        part = self.plane(level)[start:i // 8]
        out = int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())
        return out + int(self.plane(level)[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            one = int(self.plane(level)[i // 8]) >> i % 8 & 1
            ones = self._ones(level, i)
            i = self.n - int(self.ranks[level][-1]) + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first ``i`` ids stand below the last plane."""
        a, b = 0, i
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            zeros = self.n - int(self.ranks[level][-1])
            a, b = (zeros + x, zeros + y) if value >> self.bits - 1 - level & 1 else (a - x, b - y)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        a, b = self._range(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _place(self, level: int, one: bool, k: int) -> int:
        """The place of the ``k``-th bit of that kind in a plane."""
        ranks = self.ranks[level]
        before = ranks if one else np.arange(len(ranks), dtype=np.int64) * _BLOCK - ranks.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * (_BLOCK // 8)
        bits = np.unpackbits(self.plane(level)[start:start + _BLOCK // 8], bitorder="little") == one
        return block * _BLOCK + int(np.flatnonzero(bits)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """The place of the ``k``-th occurrence, from 0, of ``value``."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            zeros = self.n - int(self.ranks[level][-1])
            at = self._place(level, True, at - zeros) if value >> self.bits - 1 - level & 1 else self._place(level, False, at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


SHARDS = "part int, seq int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, matrix binary"


def write_token_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                       end_id: int = 0, shard_tokens: int = 1 << 20, part_bytes: int = 32 << 20) -> None:
    """Encode every text, end each document with ``end_id`` and write shards of about ``shard_tokens`` ids in ascending id order.

    Null text counts as empty.  Null ids come first.  Rows with one id stay in the order of their texts.  A document is
    never cut: a longer one is a shard of its own.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(total, part_bytes, docs.sparkSession.sparkContext.defaultParallelism)
    # Equal ids are told apart by their texts, so that even rows of one id spread over the parts.
    ordered = slim.withColumn("k", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "k").sortWithinPartitions("doc_id", "k", "text").drop("k")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary)
        ids, doc_ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            row = {"part": [part], "seq": [seq], "doc_ids": [doc_ids], "lengths": [lengths], "n_tokens": [sum(lengths)],
                   "matrix": [WaveletMatrix.build(np.concatenate(ids)).to_bytes()]}
            return pa.RecordBatch.from_pydict(row, schema=_arrow_shards())

        for batch in small(batches):
            tokens, offsets = with_end(*encode.encode(batch.column("text")), end_id)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids.append(tokens[a:b])
                doc_ids.append(doc)
                held += b - a
                if held >= shard_tokens:
                    yield flush()
                    ids, doc_ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    ordered.transform(lean).mapInArrow(shards, SHARDS).write.option("compression", "none").parquet(path)


def _arrow_shards() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("matrix", pa.binary())])


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the shards: doc_id, start, n_tokens, ids_crc32, and ids as little-endian unsigned 32-bit integers."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    # Two steps, so that only one row for each part is put in one order: parts before this one, then shards of the same part.
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")
    starts = sizes.join(by_part, "part").selectExpr("part", "seq", "before + sum(n_tokens) OVER (PARTITION BY part ORDER BY seq) - n_tokens AS base")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["matrix"]).decode().astype("<u4")
                ends = np.cumsum(row["lengths"])
                data, cuts = memoryview(ids.tobytes()), [0, *(4 * ends).tolist()]
                own = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = len(own)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "within": pa.array(ends - row["lengths"], pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())})

    rows = shards.select("part", "seq", "doc_ids", "lengths", "matrix").transform(lean).mapInArrow(documents, "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """Every occurrence of the given ids in the shards: token, doc_id, place in the document.  Counted by rank, found by select; nothing is decoded."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix, ends = WaveletMatrix.from_bytes(row["matrix"]), np.cumsum(row["lengths"])
                for token in tokens:
                    at = np.array(matrix.occurrences(token), np.int64)
                    doc = np.searchsorted(ends, at, side="right")
                    ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), ids, pa.array(at - (ends - row["lengths"])[doc])], ["token", "doc_id", "place"])

    return spark.read.schema(SHARDS).parquet(path).select("doc_ids", "lengths", "matrix").transform(lean).mapInArrow(find, "token bigint, doc_id bigint, place bigint")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as shards and read back.  Nulls, repeated rows and ids: see ``write_token_shards``."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_shards(table(spark, sf_dir, "documents"), path)
    return read_token_shards(spark, path)
