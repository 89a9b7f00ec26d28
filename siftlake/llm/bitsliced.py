"""Exact top-k search by inner product with a bit-sliced index.

Components are quantised to integers.  The index holds blocks of rows; in a block, every component is a set of bit
slices, one bitmap over the rows for each binary digit.  A query adds slices with bitmap arithmetic: digit b of component j
counts 2**(a + b) for each digit a of the query's weight, and full adders reduce all slices of one place value to one, from
the lowest place up.  The sums are again slices.  The best rows are selected from the most significant slice down, and
rows that tie at the boundary are settled by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.shared import parts_for, stored, table


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slices, first slice of each component, least value of each component) of a block: rows x components of integers.

    A slice is a bitmap over the rows, padded to whole 64-bit words.  Component j's digits are those of ``value - least[j]``.
    """
    n, dims = values.shape
    low = values.min(axis=0) if n else np.zeros(dims, np.int64)
    above = (values - low).astype(np.uint64)
    widths = np.array([int(x).bit_length() for x in (above.max(axis=0) if n else np.zeros(dims))], np.int64)
    words = -(-n // 64)
    slices = np.zeros((int(widths.sum()), words * 8), np.uint8)
    first = np.cumsum(widths) - widths
    for j in range(dims):
        for b in range(int(widths[j])):
            bits = np.packbits((above[:, j] >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little")
            slices[first[j] + b, :len(bits)] = bits
    return slices.view(np.uint64), np.append(first, widths.sum()), low


def add_slices(slices: np.ndarray, first: np.ndarray, low: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of the weighted sum from the lowest place up, number to add to each row's sum) for one query.

    For a negative weight the complement of the component is counted, so all that is added is at least 0.
    """
    places: list[list[np.ndarray]] = []
    constant = int((weights * low).sum())
    for j in np.flatnonzero(weights):
        w, a, b = int(weights[j]), int(first[j]), int(first[j + 1])
        if a == b:
            continue
        own = slices[a:b]
        if w < 0:
            own, w, constant = ~own, -w, constant + w * ((1 << b - a) - 1)
        for digit in range(w.bit_length()):
            if w >> digit & 1:
                while len(places) < digit + b - a:
                    places.append([])
                for k in range(b - a):
                    places[digit + k].append(own[k:k + 1])
    out, at = [], 0
    while at < len(places):
        if not places[at]:
            out.append(np.zeros(slices.shape[1], np.uint64))
            at += 1
            continue
        stack = np.concatenate(places[at]) if len(places[at]) > 1 else places[at][0]
        carries = []
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                x, y, z = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                half = x ^ y
                carries.append((x & y) | (half & z))
                stack = np.concatenate([half ^ z, stack[3 * third:]])
            else:
                x, y = stack
                carries.append((x & y)[None])
                stack = (x ^ y)[None]
        out.append(stack[0])
        if carries:
            if at + 1 == len(places):
                places.append([])
            places[at + 1] += carries
        at += 1
    return out, constant


def select_top(sums: list[np.ndarray], eligible: np.ndarray, k: int) -> np.ndarray:
    """The row numbers of the ``k`` largest sums among the eligible rows; of equal sums at the boundary the first rows."""
    sure, maybe = np.zeros_like(eligible), eligible
    for part in reversed(sums):
        both = maybe & part
        trial = sure | both
        count = int(np.bitwise_count(trial).sum())
        if count > k:
            maybe = both
        else:
            sure, maybe = trial, maybe & ~part
            if count == k:
                maybe = np.zeros_like(maybe)
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    ties = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))[:max(0, k - len(chosen))]
    return np.concatenate([chosen, ties])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and the integer vector of each distinct usable row: no null id, vector or component, nothing that is not finite.

    Rows that repeat both id and vector count once.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows; a shorter one has zeros at its end."""
    size = max(map(len, column), default=0)
    out = np.zeros((len(column), size), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rows_per_block: int = 8192, queries_per_block: int = 256, bundles_per_task: int = 4) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``, both (vec_id, v): query_id, rank, vec_id, score.

    Rows with the query's own id are no candidates.  Where an id has several different vectors, each is a query and
    each is a candidate.  Vectors of unequal length are compared as if the shorter had zeros at its end.  A task compares a
    block of rows with ``bundles_per_task`` bundles of queries at most, so the number of tasks follows rows times queries.
    """
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = parts_for(n, rows_per_block), parts_for(m, queries_per_block)
    slots = parts_for(query_blocks, bundles_per_task)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        values = _matrix(pdf["v"])
        slices, first, low = pack(values)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "slices": [slices.tobytes()], "first": [first.astype(np.int64).tobytes()], "low": [low.astype(np.int64).tobytes()]})

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        values = _matrix(pdf["v"])
        return pd.DataFrame({"q": [int(pdf["q"].iloc[0])], "q_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q_no": [pdf["no"].to_numpy(np.int64).tobytes()], "weights": [values.tobytes()], "dims": [values.shape[1]]})

    def dealt(df: DataFrame, count: int, name: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int"))

    packed = dealt(vectors, blocks, "block").groupBy("block").applyInPandas(index, "block int, ids binary, slices binary, first binary, low binary")
    asked = dealt(queries.withColumn("no", F.xxhash64("v")), query_blocks, "q").groupBy("q").applyInPandas(bundle, "q int, q_ids binary, q_no binary, weights binary, dims int")
    # Each bundle of queries meets each block once, by the block's number and the bundles' slot.
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(blocks * slots, "block", "slot")
    right = asked.withColumn("slot", F.pmod(F.col("q"), F.lit(slots))).drop("q").withColumn("block", every).repartition(blocks * slots, "block", "slot")
    pairs = left.join(right, ["block", "slot"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, first, low = (np.frombuffer(x, np.int64) for x in (row.ids, row.first, row.low))
                dims = len(low)
                slices = np.frombuffer(row.slices, np.uint64).reshape(int(first[-1]), -(-len(ids) // 64))
                q_ids, q_no = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_no, np.int64)
                weights = np.frombuffer(row.weights, np.int64).reshape(len(q_ids), row.dims)
                weights = np.pad(weights, ((0, 0), (0, max(0, dims - row.dims))))[:, :dims]
                everyone = np.zeros(slices.shape[1] * 64, bool)
                everyone[:len(ids)] = True
                out = []
                for q, no, w in zip(q_ids.tolist(), q_no.tolist(), weights, strict=True):
                    a, b = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
                    everyone[a:b] = False
                    eligible = np.packbits(everyone, bitorder="little").view(np.uint64)
                    everyone[a:b] = True
                    sums, constant = add_slices(slices, first, low, w)
                    top = select_top(sums, eligible, k)
                    score = np.full(len(top), constant, np.int64)
                    for place, part in enumerate(sums):
                        score += (part[top >> 6] >> (top & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << place
                    out.append((np.full(len(top), q), np.full(len(top), no), ids[top], score))
                yield pd.DataFrame(dict(zip(("query_id", "no", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = pairs.mapInPandas(run, "query_id bigint, no bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every twentieth vector.  Nulls, ties, repeats and unequal lengths: see ``quantised`` and ``search``."""
    rows = stored(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0), "vectors")
    return search(rows, rows.filter("vec_id % 20 = 0"))


OP1_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
