"""Best-fit packing of documents into sequences by rounds of local best fit.

Every partition packs its own pieces, longest first, each into the fullest sequence that still has room.  Sequences
that are nearly full are final.  Each group of the first round leaves at most one sequence at most half full, and two
that are fuller never fit together.  The next round's items are therefore the former and as many of the latter, those
with most room: if none of these takes a sequence, no other does.  It ends with a round of one group, after which no two
open sequences fit together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.encoding import encoder, vocabulary_path, with_end
from siftlake.llm.shared import lean, parts_for, small, stored, table

#: Pieces of text whose ids a worker keeps; packing also runs after other steps, whose workers have grown.
CACHED = 300_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, at bigint, fill bigint"


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest first, each into the fullest bin that has room.

    One set of open bins for each amount of room left, and an integer with a bit for each amount that has bins: the
    tightest bin is the lowest set bit at or above the size.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = mask >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
        else:
            left, b = room, len(fills)
            fills.append(0)
        bins[i], at[i] = b, fills[b]
        fills[b] += size
        open_bins[left - size].append(b)
        mask |= 1 << left - size
    return bins, at, np.asarray(fills, np.int64)


def _merger(room: int):
    """Packs open sequences as items; a joined sequence is named after the part that starts it."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        own = pdf["bin"].to_numpy()
        bins, at, fills = best_fit(pdf["fill"].to_numpy(), room)
        name = np.empty(len(fills), np.int64)
        name[bins[at == 0]] = own[at == 0]
        return pd.DataFrame({"bin": own, "into": name[bins], "shift": at, "fill": fills[bins]})

    return merge


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, room: int, end_id: int, chunk: int) -> DataFrame:
    """Encode, cut what is longer than a sequence, and pack within each partition, ``chunk`` pieces at a time."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, n = encoder(vocabulary, CACHED), [], 0
        next_bin = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            nonlocal next_bin
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            bins, at, fills = best_fit(cols[4], room)
            out = [pa.array(cols[0], mask=cols[1]), *map(pa.array, (cols[2], cols[3], cols[4], cols[5], bins + next_bin, at, fills[bins]))]
            next_bin += len(fills)
            return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"])

        for batch in small(batches):
            ids, offsets = with_end(*encode.encode(batch.column("text")), end_id)
            lengths = np.diff(offsets)
            counts = -(-lengths // room)
            doc = np.repeat(np.arange(len(lengths)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * room
            length = np.minimum(lengths[doc] - start, room)
            data = memoryview(ids.astype("<u4").tobytes())
            begin = 4 * (offsets[doc] + start)
            crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)], np.int64)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            own = batch.column("doc_id").fill_null(0).to_numpy()
            held.append((own[doc], null[doc], piece.astype(np.int32), start, length, crc))
            n += len(doc)
            if n >= chunk:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return slim.transform(lean).mapInArrow(pack, PIECES)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, room: int = 2048,
                   end_id: int = 0, slack: int = 16, group: int = 20_000, chunk: int = 200_000) -> DataFrame:
    """Pack all documents into sequences of at most ``room`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null text counts as empty: one piece,
    the end id.  Only documents longer than ``room`` are cut.  Repeated rows and null ids are packed like any other.  A
    sequence with at most ``slack`` tokens of room is final; a round takes ``group`` open sequences to a task.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    pieces = stored(pieces_of(docs, id_col, text_col, vocabulary, room, end_id, chunk), "pieces")
    placed = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "at")
    open_bins = pieces.filter(F.col("fill") < room - slack).groupBy("bin").agg(F.first("fill").alias("fill"))
    count, level = open_bins.count(), 0
    while count > 1:
        level += 1
        groups = parts_for(count, group)
        deal = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("g")
        merged = stored(open_bins.groupBy(deal).applyInPandas(_merger(room), "bin bigint, into bigint, shift bigint, fill bigint"), "merged")
        moved = merged.filter(F.col("bin") != F.col("into")).select("bin", "into", "shift")
        placed = placed.join(moved, "bin", "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"))
        if groups == 1:
            break
        left = merged.filter((F.col("bin") == F.col("into")) & (F.col("fill") < room - slack)).select("bin", "fill")
        low = left.filter(2 * F.col("fill") <= room)
        open_bins = low.unionByName(left.filter(2 * F.col("fill") > room).orderBy("fill", "bin").limit(low.count()))
        count = open_bins.count()
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens.  Nulls, long documents and repeats: see ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"))
