"""Exact n-gram Jaccard join with signature trees.

Documents are routed to families, and every family is joined by signature trees.  A tree's nodes hold the OR of their
members' token bitmaps and the range of their sizes.  Two trees are walked together from the top: a pair of nodes is
dropped when no member of one can share enough with a member of the other, by sizes or by the overlap of the bitmaps.
Bitmaps number the tokens that at least two members have, so the overlap of two documents' bitmaps is exact.

Routing uses ``BANDS`` keys of ``ROWS`` minimum hashes each; documents with a key in common, directly or through others, are a
family.  Two documents at similarity 0.8 have no key in common with a probability of (1 - 0.8**5)**64 = 9e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.components import components
from siftlake.llm.shared import lean, parts_for, small, stored, table
from siftlake.llm.shingles import mix, shingle_sets

BANDS, ROWS = 64, 5
#: A tree holds at most about so many documents and tokens; larger families are cut into several.
TREE_DOCS, TREE_TOKENS = 256, 400_000
_FAN = 8
_RNG = np.random.default_rng(7)
_SCALE = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64)


def band_keys(tokens: np.ndarray) -> np.ndarray:
    low = np.full((BANDS * ROWS, 1), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(tokens), 2000):
        part = tokens[at:at + 2000].astype(np.uint32)
        np.minimum(low, (part * _SCALE + _SHIFT).min(axis=1, keepdims=True), out=low)
    keys = (low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, fp, keys) of (doc_id, h, text): size, 128-bit hash and routing keys of the shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, prints, keys = [], [], []
            for tokens in shingle_sets(batch.column("text")):
                sizes.append(len(tokens))
                prints.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                keys.append(band_keys(tokens) if len(tokens) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))], ["doc_id", "h", "n", "fp", "keys"])

    return docs.transform(lean).mapInArrow(run, "doc_id bigint, h bigint, n bigint, fp binary, keys array<bigint>")


class SignatureTree:
    """Documents in order of size; each level's nodes are eight of the level below, with OR bitmap, least and largest size."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        level = (bits[self.order], sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[0]) > _FAN:
            starts = np.arange(0, len(level[0]), _FAN)
            level = (np.bitwise_or.reduceat(level[0], starts, axis=0), np.minimum.reduceat(level[1], starts), np.maximum.reduceat(level[2], starts))
            self.levels.append(level)

    def join(self, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the documents of both trees that are alike: 9 * overlap >= 4 * (size + size), which is a similarity of 0.8."""
        depth = max(len(self.levels), len(other.levels))
        # A tree that ends earlier waits at its top until the other is as low.
        at = [min(depth, len(t.levels)) - 1 for t in (self, other)]
        a, b = np.divmod(np.arange(len(self.levels[-1][0]) * len(other.levels[-1][0])), len(other.levels[-1][0]))
        for level in range(depth - 1, -1, -1):
            x, y = self.levels[min(level, at[0])], other.levels[min(level, at[1])]
            if self is other:
                a, b = a[a <= b], b[a <= b]
            fits = (5 * y[2][b] >= 4 * x[1][a]) & (5 * x[2][a] >= 4 * y[1][b])
            a, b = a[fits], b[fits]
            need = 4 * (x[1][a] + y[1][b])
            step = max(1, (8 << 20) // max(1, x[0].shape[1]))
            near = [np.bitwise_count(x[0][a[k:k + step]] & y[0][b[k:k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), step)]
            keep = 9 * np.concatenate([np.zeros(0, np.int64), *near]) >= need
            a, b = a[keep], b[keep]
            if level:
                a, b = self._children(a, b, level <= at[0], level <= at[1], level, other)
        if self is other:
            a, b = a[a < b], b[a < b]
        return self.order[a], other.order[b]

    def _children(self, a: np.ndarray, b: np.ndarray, down_a: bool, down_b: bool, level: int, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        for side in (0, 1):
            if (down_a, down_b)[side]:
                below = len((self, other)[side].levels[level - 1][0])
                parts = ((a, b)[side][:, None] * _FAN + np.arange(_FAN)).ravel()
                rest = np.repeat((a, b)[1 - side], _FAN)
                real = parts < below
                a, b = (parts[real], rest[real]) if side == 0 else (rest[real], parts[real])
        return a, b


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set over the tokens that at least two of the sets have."""
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = tokens[counts > 1]
    bits = np.zeros((len(sets), max(1, -(-len(shared) // 64)) * 64), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == s)] if len(shared) else at[:0]
        bits[i, at] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """(root of each of ``n`` nodes, numbers of the links that join two parts): what connects, without the other links."""
    root, used = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append(i)
    return [find(x) for x in range(n)], used


def _leaf_join(pdf: pd.DataFrame) -> pd.DataFrame:
    """Joins each tree of a bin with itself.  Rows: links (a, b), and for cut families the documents not connected to the family's pivot (b null)."""
    out = []
    for (family, tree), own in pdf.groupby(["family", "tree"], sort=False):
        own = own.drop_duplicates("node")
        if len(own) < 2:
            if len(own) and own["trees"].iloc[0] > 1 and own["node"].iloc[0] != family:
                out.append((family, int(tree), int(own["node"].iloc[0]), None))
            continue
        sets = [np.frombuffer(x, np.uint64) for x in own["tokens"]]
        nodes = own["node"].to_numpy()
        joined = SignatureTree(bitmaps(sets), np.array([len(s) for s in sets], np.int64))
        a, b = joined.join(joined)
        roots, used = forest(len(nodes), a, b)
        out += [(family, int(tree), int(nodes[a[i]]), int(nodes[b[i]])) for i in used]
        if own["trees"].iloc[0] > 1:
            tied = roots[int(np.flatnonzero(nodes == family)[0])]
            out += [(family, int(tree), int(node), None) for node, r in zip(nodes, roots, strict=True) if r != tied]
    return pd.DataFrame(out, columns=["family", "tree", "a", "b"]).astype({"a": "Int64", "b": "Int64", "tree": "int32"})


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes = np.array([len(x) // 8 for x in pdf["tokens"]], np.int64)
    return pd.DataFrame({"family": [pdf["family"].iloc[0]], "block": [int(pdf["block"].iloc[0])], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "sizes": [sizes.tobytes()], "tokens": [b"".join(pdf["tokens"])]})


def _cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the trees of two blocks of one family."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            sets, nodes = [], []
            for n, s, t in ((row.nodes, row.sizes, row.tokens), (row.nodes2, row.sizes2, row.tokens2)):
                own = np.split(np.frombuffer(t, np.uint64), np.cumsum(np.frombuffer(s, np.int64))[:-1])
                sets.append(own)
                nodes.append(np.frombuffer(n, np.int64))
            bits, cut = bitmaps(sets[0] + sets[1]), len(sets[0])
            sizes = np.array([len(s) for s in sets[0] + sets[1]], np.int64)
            a, b = SignatureTree(bits[:cut], sizes[:cut]).join(SignatureTree(bits[cut:], sizes[cut:]))
            _, used = forest(len(sizes), a, b + cut)
            out += [(int(nodes[0][a[i]]), int(nodes[1][b[i]])) for i in used if nodes[0][a[i]] != nodes[1][b[i]]]
        yield pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the classes (node, n, keys) which all links of similarity 0.8 connect.

    ``docs`` (node, text) holds the text of every node, on one row or on equal ones.
    """
    keyed = classes.select("node", F.explode("keys").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    stars = keyed.join(pivots, "key").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    families = components(stars).select("node", F.col("root").alias("family"))

    sizes = families.join(classes.select("node", "n"), "node")
    pieces = F.greatest(F.ceil(F.count("*") / TREE_DOCS), F.ceil(F.sum("n") / TREE_TOKENS)).cast("int")
    cuts = sizes.groupBy("family").agg(pieces.alias("trees"))
    members = stored(sizes.join(cuts, "family").select("node", "family", "n", "trees", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int").alias("tree")), "members")
    total = members.count()
    if not total:
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "tokens"])

    texts = members.join(docs, "node")
    held = stored(texts.select("node", "family", "trees", "tree", "text").transform(lean).mapInArrow(tokens, "node bigint, family bigint, trees int, tree int, tokens binary"), "tokens")
    # The pivot of a cut family goes to each of its trees.
    pivot = held.filter("trees > 1 AND node = family").select("node", "family", "trees", F.explode(F.expr("sequence(0, trees - 1)")).alias("tree"), "tokens")
    bins = F.pmod(F.xxhash64("family", "tree"), F.lit(parts_for(total, 512)))
    joined = stored(held.unionByName(pivot).withColumn("bin", bins).groupBy("bin").applyInPandas(_leaf_join, "family bigint, tree int, a bigint, b bigint"), "leaves")
    found = joined.filter("b IS NOT NULL").select("a", "b")
    loose = joined.filter("b IS NULL").select("family", F.col("a").alias("node")).distinct()
    if loose.isEmpty():
        return found
    # What a cut family's pivot does not connect meets every tree of the family, in blocks cut by documents and tokens as trees are.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    schema = "family bigint, block int, nodes binary, sizes binary, tokens binary"
    count = members.join(loose, ["family", "node"], "left_semi").groupBy("family").agg(pieces.alias("blocks"))
    own = held.join(loose, ["family", "node"], "left_semi").join(count, "family").select("family", "node", "tokens", "blocks", block)
    left = own.groupBy("family", "block").applyInPandas(_pack, schema)
    right = held.join(count.select("family"), "family", "left_semi").select("family", "node", "tokens", F.col("tree").alias("block")).groupBy("family", "block").applyInPandas(_pack, schema)
    # Each block's pairs are a task's work, not each family's.
    spread = right.join(count, "family").withColumn("slot", F.explode(F.expr("sequence(0, blocks - 1)"))).select("family", "slot", *[F.col(c).alias(f"{c}2") for c in ("nodes", "sizes", "tokens")])
    pairs = left.withColumnRenamed("block", "slot").join(spread, ["family", "slot"])
    return found.unionByName(pairs.mapInPandas(_cross, "a bigint, b bigint"))


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, h (a hash of the text), n_shingles, component_id, first.

    ``first`` says whether (doc_id, h) is the smallest of its component; rows that nothing can link (without words or id) are first.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sketched = stored(sketches(slim.select("doc_id", "h", "text")), "sketches")
    # A class is one shingle set.  Its number is given once, when the table is written: one id may stand on different texts.
    grouped = sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    names = classes.select("node", F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h"))
    texts = slim.join(names, (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "text")
    found = components(links(texts, classes.select("node", "n", "keys")))
    rooted = classes.select("fp", "node", "least").join(found, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("top"))
    known = rooted.join(least, "root").select("fp", "top")
    out = sketched.select("doc_id", "h", "n", "fp").join(known, "fp", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
        (alone | ((F.col("doc_id") == F.col("top.doc_id")) & (F.col("h") == F.col("top.h")))).alias("first"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, the smallest id that links of similarity 0.8 or more reach.

    Texts with one shingle set, such as exact copies, are one class and are joined once.  Without words a text is linked
    with nothing.  Rows with a null id link nothing and have a null component.  Rows with one id and different texts are
    different documents.
    """
    return linked_rows(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates of others: of each component the row with the smallest id, then text hash.

    Of rows equal in id and text one stays, the smallest by its other columns.  Rows without words or id all stay.
    """
    found = linked_rows(docs, id_col, text_col).filter("first").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("n_shingles").alias("_n")).agg(F.count("*").alias("_times"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("_h"))
    kept = docs.join(found, same)
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = (F.col("_times") == 1) | (F.col("_n") == 0) | F.col("_id").isNull()
    once = kept.filter(~single).groupBy("_id", "_h").agg(F.min(F.struct(*own)).alias("_row"))
    return kept.filter(single).select(*own).unionByName(once.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents.  Nulls, texts without words, copies and repeated ids: see ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
k AS (SELECT md5(array_to_string(list_sort(s), '|')) AS fp, s, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY ALL),
t AS (SELECT node, len(s) AS n, unnest(s) AS g FROM k),
o AS (SELECT x.node AS a, y.node AS b FROM t x JOIN t y ON x.g = y.g AND x.node < y.node
      GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT node AS a, node AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS node, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN k ON md5(array_to_string(list_sort(s.s), '|')) = k.fp LEFT JOIN c ON k.node = c.node
"""
