"""Periodic runs of words by suffix trees and Lyndon roots.

A run with period q makes every word after its first q words occur again at most q words later, for at least three
periods.  Only stretches of a document where that holds are looked at further; everything else can hold no run.  For a
stretch, and for its reversal, Ukkonen's algorithm builds the suffix tree.  Its Euler tour, of which the depths between
neighbouring leaves are kept, answers lowest common ancestors, and so longest common extensions, in constant time.  The
longest Lyndon word that starts at each word, in the order of the symbols and in the reversed order, is a candidate for a
root; each is extended to both sides, and every run has a root among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.shared import WORD, lean, small, table

RESULT = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class SuffixTree:
    """Suffixes of a sequence of symbols from 1 on, in order, and their longest common extensions."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        start, end, leaf, kids = _ukkonen(s)
        self.order, shared = _tour(start, end, leaf, kids, False)
        self.rank = _inverse(self.order)
        self.rank_reversed = _inverse(_tour(start, end, leaf, kids, True)[0])
        # Row j has the least of the 2**j depths from each place on.
        self.least = [np.array(shared, np.int32)]
        width = 1
        while 2 * width <= len(s):
            row = self.least[-1]
            self.least.append(np.minimum(row[:-width], row[width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at ``i`` and at other places ``j`` agree."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(b - a)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][a[at]], self.least[k][b[at] - (1 << int(k))])
        return out


def _ukkonen(s: list[int]) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """(first, end of the edge into each node, suffix of each leaf or -1, rows (node, symbol, child)) of the tree of ``s``, whose last symbol is alone."""
    n, width = len(s), max(s) + 1
    start, end, link, leaf = [0], [0], [0], [-1]
    edges: dict[int, int] = {}
    node = edge = length = waiting = leaves = 0
    for i, c in enumerate(s):
        fresh = 0
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = start[child]
                size = min(end[child], i + 1) - first
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                if s[first + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                split = len(start)
                start.append(first)
                end.append(first + length)
                link.append(0)
                leaf.append(-1)
                edges[key] = split
                start[child] = first + length
                edges[split * width + s[first + length]] = child
                edges[split * width + c] = split + 1
                if fresh:
                    link[fresh] = split
                fresh = split
            start.append(i)
            end.append(n)
            link.append(0)
            leaf.append(leaves)
            leaves += 1
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    return start, end, leaf, np.stack([keys // width, keys % width, np.fromiter(edges.values(), np.int64, len(edges))])


def _tour(start: list[int], end: list[int], leaf: list[int], kids: np.ndarray, backwards: bool) -> tuple[list[int], list[int]]:
    """(suffixes in order, depth of the lowest common ancestor of each and the one before); the end of the text is always least."""
    symbols = np.where(kids[1] > 0, -kids[1], kids[1].min() - kids[1].max() - 1) if backwards else kids[1]
    # A stack takes a node's children last first.
    by = np.lexsort((-symbols, kids[0]))
    child = kids[2][by].tolist()
    ends = np.searchsorted(kids[0][by], np.arange(len(start) + 1)).tolist()
    depth = [0] * len(start)
    above = [0] * len(start)
    order, shared, least = [], [], len(start)
    stack = [0]
    while stack:
        node = stack.pop()
        up = depth[above[node]]
        if up < least:
            least = up
        if leaf[node] >= 0:
            order.append(leaf[node])
            shared.append(least)
            least = len(start)
        else:
            depth[node] = up + end[node] - start[node]
            below = child[ends[node]:ends[node + 1]]
            for x in below:
                above[x] = node
            stack += below
    return order, shared


def _inverse(order: list[int]) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one to the right that is smaller: the longest Lyndon word from a place ends before it."""
    ranks = rank.tolist()
    out = [0] * len(ranks)
    for i in range(len(ranks) - 2, -1, -1):
        j, own = i + 1, ranks[i]
        while ranks[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(symbols: list[int], least: int, powers: int) -> np.ndarray:
    """All runs (start, length, period) of at least ``least`` words and ``powers`` periods, by start, then period."""
    n = len(symbols)
    forward = SuffixTree(symbols)
    places = np.arange(n)
    pairs = [(places, _next_smaller(rank)[:n] - places) for rank in (forward.rank, forward.rank_reversed)]
    at, period = (np.concatenate(x) for x in zip(*pairs, strict=True))
    some = (at + period < n) & (powers * period <= n)
    at, period = at[some], period[some]
    right = forward.common(at, at + period)
    del forward
    left = SuffixTree(symbols[::-1]).common(n - at, n - at - period)
    start, length = at - left, period + right + left
    good = length >= np.maximum(least, powers * period)
    return np.unique(np.stack([start[good], length[good], period[good]], 1), axis=0)


def stretches(gaps: np.ndarray, least: int, powers: int) -> list[tuple[int, int]]:
    """Where runs without their first period can lie: each word's gap to its occurrence before is small against the stretch."""
    found, todo = [], [(0, len(gaps))]
    while todo:
        a, b = todo.pop()
        if b - a < least - least // powers:
            continue
        near = gaps[a:b] <= (b - a) // (powers - 1)
        if near.all():
            found.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
        todo += [(a + x, a + y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return found


def document_runs(words: list[bytes], least: int = 6, powers: int = 4) -> np.ndarray:
    """All runs of a document, whose stretches are looked at one by one."""
    none = np.zeros((0, 3), np.int64)
    number = dict.fromkeys(words)
    if len(words) < least or len(number) == len(words):
        return none
    number.update(zip(number, range(len(number)), strict=True))
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    by = np.argsort(codes, kind="stable")
    gaps = np.full(len(words), len(words), np.int64)
    again = codes[by[1:]] == codes[by[:-1]]
    gaps[by[1:][again]] = (by[1:] - by[:-1])[again]
    found = [none]
    for a, b in stretches(gaps, least, powers):
        lead = max(0, a - (b - a) // (powers - 1))
        runs = runs_of((np.unique(codes[lead:b], return_inverse=True)[1] + 1).tolist(), least, powers)
        runs[:, 0] += lead
        # What begins in the lead alone belongs to another stretch or is part of a run there.
        found.append(runs[runs[:, 0] + runs[:, 2] >= a])
    return np.unique(np.concatenate(found), axis=0) if len(found) > 1 else none


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, powers: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (start, length, period in words, by start, then period) and collapsed, the text without repeats.

    Null, empty and blank texts have no runs and collapse to the empty text; words of other texts are joined by one space.
    Null and repeated doc_ids stay rows of their own; other columns are not read.  A run has ``least`` words and ``powers``
    periods (more than one) at least.  A stretch that repeats takes about one kilobyte of memory a word while its tree stands.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, texts = [], []
            for text in pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist():
                words = text.split()
                found.append(document_runs(words, least, powers))
                texts.append(b" ".join(collapse(words, found[-1])).decode())
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.cumsum([0] + [len(x) for x in found]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, structs), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return slim.transform(lean).mapInArrow(find, RESULT)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents by crc32 of their id repeat a stretch of words up to their end.

    With the hash h, g = h div 10 and n words, words from a = g % n on become the p words there over and over, where
    p = 1 + (n - a) div (3 + g % 8).  Documents without an id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))

    def repeated(w):
        n = F.size(w)
        a = F.pmod(F.col("g"), n).cast("int")
        times = (3 + F.pmod(F.col("g"), F.lit(8))).cast("int")
        period = (1 + F.floor((n - a) / times)).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, period), times))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " "))

    hashed = docs.select("doc_id", "text", h.alias("h")).withColumn("g", g)
    # An array of one array, so that the words are cut once and not in every place that names them.
    return hashed.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(F.transform(words, repeated)[0], F.col("text"))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, counted, the longest one, and hashes of all runs and of the text without repeats.

    Nulls, empty texts and repeated rows: see ``periodic_runs``.  Of runs of equal length the first counts, then the shortest period.
    """
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"), (-r["period"]).alias("minus_period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.minus_start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.minus_period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.minus_period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
