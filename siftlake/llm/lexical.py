"""Ranked lexical search turned round: the items' terms are the index, the documents stream through it.

Items are cut into blocks whose inverted index has a bounded number of postings, and the index of a block goes to all
executors.  A first pass over the documents stores each one's length and its counts of the terms that items have.  Numbers of
documents and of terms follow from that table by aggregation.  A second pass streams the counts through the index: each
task adds up the scores of a few hundred documents at a time and keeps one heap of at most ``k`` documents per item.  The
heaps of all tasks are merged by rank.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.shared import lean, parts_for, small, stored, table

#: A term is a run of ASCII letters, ASCII digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For each byte: letters small, other ASCII characters but digits as a space, bytes beyond ASCII as they are.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
_BEST = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, those of about ``step`` bytes at a time."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + step)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _item_postings(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id and words, its terms with repeats, of every item that has any.  One row per row of ``items``."""
    folded = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))
    return items.select(F.col(item_col).alias("item_id"), words.alias("words")).filter(F.size("words") > 0)


def _blocks(items: DataFrame, postings: int) -> list[DataFrame]:
    """The items in blocks of at most ``postings`` term occurrences, or of one item that has more."""
    sizes = items.agg(F.sum(F.size("words"))).first()[0]
    if not sizes:
        return []
    buckets = parts_for(64 * sizes, postings)
    bucket = F.pmod(F.xxhash64("item_id", "words"), F.lit(buckets))
    blocks, room = [], 0
    for b, n in items.groupBy(bucket.alias("b")).agg(F.sum(F.size("words"))).orderBy("b").collect():
        if not blocks or n > room:
            blocks.append([])
            room = postings
        blocks[-1].append(b)
        room -= n
    return [items.filter(bucket.between(x[0], x[-1])) for x in blocks]


class _Index:
    """Inverted index of one block: term numbers, and for each term the items that have it and how often."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(w.encode(), len(self.number)), i) for i, (_, words) in enumerate(rows) for w in words]
        flat = np.array([t * len(rows) + i for t, i in pairs], np.int64)
        keys, self.times = np.unique(flat, return_counts=True)
        self.items = keys % len(rows)
        self.first = np.searchsorted(keys // len(rows), np.arange(len(self.number) + 1))
        self.n_items = len(rows)


def _count(index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.number
        for batch in small(batches):
            lengths, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                n, found = 0, []
                for some in terms_of(text or b""):
                    n += len(some)
                    found += [number[w] for w in some if w in number]
                ids, counts = np.unique(np.array(found, np.int32), return_counts=True)
                lengths.append(n)
                terms.append(ids)
                tfs.append(counts.astype(np.int32))
            offsets = pa.array(np.cumsum([0] + [len(x) for x in terms]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return count


def weights(df_of_term: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in df_of_term], np.int64)


def _search(index, weight, n_docs: int, n_terms: int, k: int, cells: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = index.value, weight.value
        width, per_term = own.n_items, np.diff(own.first)
        heaps: list[list[tuple]] = [[] for _ in range(width)]
        least = np.ones(width, np.int64)
        for batch in batches:
            # Ids are compared as numbers; a null id comes after all others.
            docs = [(1, 0) if x is None else (0, -x) for x in batch.column("doc_id").to_pylist()]
            n = batch.column("n").to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column("terms").value_lengths().to_numpy())])
            terms, tfs = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            m = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            of_doc = np.repeat(np.arange(len(n)), np.diff(ends))
            gain = w[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m[of_doc]))
            # Documents are taken until their scores for all items and the postings they meet are ``cells`` together.
            cost = np.cumsum(np.bincount(of_doc, per_term[terms], len(n)) + width)
            a = b = 0
            while b < len(n):
                a, b = b, max(b + 1, int(np.searchsorted(cost, (cost[b - 1] if b else 0) + cells, side="right")))
                t, g, d = (x[ends[a]:ends[b]] for x in (terms, gain, of_doc))
                times = per_term[t]
                at = np.repeat(own.first[t] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                cell = np.repeat((d - a) * width, times) + own.items[at]
                scores = np.zeros((b - a) * width, np.int64)
                np.add.at(scores, cell, np.repeat(g, times) * own.times[at])
                scores = scores.reshape(b - a, width)
                for row, item in zip(*(x.tolist() for x in np.nonzero(scores >= least)), strict=True):
                    null, minus = docs[a + row]
                    entry, heap = (int(scores[row, item]), -null, minus), heaps[item]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[item] = heap[0][0]
        rows = [(i, None if null else -minus, score) for i, heap in enumerate(heaps) for score, null, minus in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return search


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           postings: int = 1_000_000, cells: int = 1 << 20) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: item_id, rank (from 1), doc_id, score.

    Equal scores go by doc_id, null last; rows of documents are documents each, so repeated ids may take several ranks.  Rows
    of ``items`` are items each, so a repeated item_id has its ranks several times.  Null texts have no terms; items without
    terms and tables without documents give no rows.  Other columns are not read.  Every block of ``postings`` term
    occurrences reads the documents once; about ``cells`` scores and postings are in memory at a time.
    """
    spark = docs.sparkSession
    item_id = items.schema[item_col].dataType
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(lean)
    found = spark.createDataFrame([], f"item_id {item_id.simpleString()}, rank int, doc_id long, score long")
    for block in _blocks(_item_postings(items, item_col, item_text), postings):
        rows = [(r["item_id"], r["words"]) for r in block.collect()]
        index = spark.sparkContext.broadcast(_Index(rows))
        counts = stored(slim.mapInArrow(_count(index), _COUNTS).filter("n > 0"), "counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return found
        holding = np.zeros(len(index.value.number), np.int64)
        for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[term] = df
        weight = spark.sparkContext.broadcast(weights(holding, n_docs))
        best = counts.mapInArrow(_search(index, weight, n_docs, n_terms, k, cells), _BEST)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], f"item int, item_id {item_id.simpleString()}")
        found = found.unionByName(top.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for each benchmark item.  Nulls, ties and repeats: see ``search``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
