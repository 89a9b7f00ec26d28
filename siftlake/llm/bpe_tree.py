"""Byte-pair encoding of texts of any length by tree concatenation, and decoding.

A text up to ``leaf`` bytes is encoded where it lies.  A longer one is cut into leaves that Spark's tasks encode in
parallel: at ends of the tokenizer's own words where there are some, and inside a word that is longer than a leaf at any
byte.  Neighbouring leaves are then concatenated up a tree.  At an end of a word nothing changes.  Inside a word a window of
a few tokens on both sides of the join is encoded anew, and grows on the side that does not agree yet, until its first token
is the left side's token at that place and its last token the right side's.  This is exact: merges have parts of lower rank
and a token has one merge (checked when a vocabulary is opened), so a sequence of tokens is the encoding of its bytes if
every two neighbours are, and each pair stands in the left side, in the window or in the right side.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.encoding import encoder, vocabulary_path
from siftlake.llm.shared import lean, small, stored, table

RESULT = "doc_id bigint, ids array<int>, decoded string"
_NODE = "key string, k int, glue boolean, ids binary, head int, tail int"
_OPEN: dict[str, BytePairs] = {}


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: visible ones stand for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


def byte_pairs(path: str) -> BytePairs:
    """The vocabulary of this worker process for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = BytePairs(path)
    return _OPEN[path]


class Node(NamedTuple):
    """Ids of neighbouring leaves: whether their first word began before, ids up to the first and from the last end of a word (-1: none inside)."""

    glue: bool
    ids: np.ndarray
    head: int = -1
    tail: int = -1


class BytePairs:
    """A byte-level vocabulary: leaves of a text, concatenation of encoded leaves, bytes of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        rank = {a + b: r for r, (a, b) in enumerate(pairs)}
        if len(rank) < len(pairs) or any(rank.get(part, -1) >= r for r, pair in enumerate(pairs) for part in pair):
            raise ValueError(f"merges out of order: {path}")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.raw = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
        self.letters = dict(enumerate(byte_letters()))
        byte_of = {c: b for b, c in self.letters.items()}
        words = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            texts[i] = bytes(map(byte_of.__getitem__, word)) if all(c in byte_of for c in word) else word.encode()
        self.table = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.sizes = np.array([len(t) for t in texts], np.int64)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.table[np.repeat(self.ends[ids] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD.  ``step`` ids at a time."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join([reader.decode(self.bytes_of(ids[a:a + step])) for a in range(0, len(ids), step)]) + reader.decode(b"", True)

    def encode_bytes(self, data: bytes) -> np.ndarray:
        """Ids of one word's bytes or of a part of them, by merges alone."""
        return np.asarray(self.raw.encode(data.decode("latin-1").translate(self.letters)).ids, np.int32)

    def concatenate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two encoded parts' bytes together: the window around the join grows until both sides agree."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        a = b = 4
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            seam = self.encode_bytes(self.bytes_of(np.concatenate([left[-a:], right[:b]])))
            left_agrees = a == len(left) or seam[0] == left[-a]
            right_agrees = b == len(right) or seam[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return np.concatenate([left[:len(left) - a], seam, right[b:]])
            a, b = a if left_agrees else 2 * a, b if right_agrees else 2 * b

    def tree(self, nodes: list[Node]) -> Node:
        """Neighbouring nodes together, two by two.  Windows stay inside the word that the join cuts."""
        while len(nodes) > 1:
            pairs = [self._pair(x, y) for x, y in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = pairs + nodes[2 * len(pairs):]
        return nodes[0]

    def _pair(self, x: Node, y: Node) -> Node:
        if not y.glue:
            return Node(x.glue, np.concatenate([x.ids, y.ids]), len(x.ids) if x.head < 0 else x.head, len(y.ids) if y.tail < 0 else y.tail)
        open_end, open_start = len(x.ids) if x.tail < 0 else x.tail, len(y.ids) if y.head < 0 else y.head
        cut = len(x.ids) - open_end
        word = self.concatenate(x.ids[cut:], y.ids[:open_start])
        head = x.head if x.head >= 0 else len(word) if y.head >= 0 else -1
        tail = y.tail if y.tail >= 0 else len(word) if x.tail >= 0 else -1
        return Node(x.glue, np.concatenate([x.ids[:cut], word, y.ids[open_start:]]), head, tail)

    def words(self, text: str, window: int) -> Iterator[int]:
        """Where the tokenizer's words end.  A word that ends three letters before a window's end, beyond what its patterns look ahead, ends there in the whole text too."""
        at, room = 0, window
        while at < len(text):
            some = text[at:at + room]
            ends = [e for _, (_, e) in self.splitter.pre_tokenize_str(some)]
            if at + room < len(text):
                ends = [e for e in ends if e <= len(some) - 3]
            if not ends:
                room *= 2
                continue
            yield from (at + e for e in ends)
            at, room = at + ends[-1], window

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[str | None, bytes | None, bool]]:
        """(text of whole words, None, False) or (None, bytes of a part of one word, whether the word began before) of a text."""
        start = 0
        for a, b in self._between_special(text):
            # Ends of words since the last one that does not end with white space: two of white space would be one at a leaf's end.
            ends = [a]
            for word in self.words(text[a:b], leaf):
                word += a
                if word - ends[-1] > leaf:
                    cuts = [start, *(e for e in ends if e > start)]
                    yield from ((text[x:y], None, False) for x, y in zip(cuts, cuts[1:], strict=False))
                    data = text[ends[-1]:word].encode()
                    yield from ((None, data[i:i + leaf], i > 0) for i in range(0, len(data), leaf))
                    start, ends = word, [word]
                elif text[word - 1].isspace():
                    ends.append(word)
                else:
                    if word - start >= leaf:
                        yield text[start:word], None, False
                        start = word
                    ends = [word]
        if len(text) > start:
            yield text[start:], None, False

    def _between_special(self, text: str) -> Iterator[tuple[int, int]]:
        """The stretches of a text without special tokens, which the tokenizer cuts out before it looks for words."""
        found = sorted((at, at + len(s)) for s in self.special if s for at in _places(text, s))
        at = 0
        for a, b in found:
            if a >= at:
                yield at, a
                at = b
        yield at, len(text)


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = 32 << 10, fan: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>) and decoded, the text that the ids stand for.

    Ids are those of the tokenizers library for the whole text, special tokens' strings included.  Null and empty texts have
    no ids and decode to the empty text.  Null and repeated doc_ids stay rows of their own; other columns are not read.  Texts
    of more than ``leaf`` bytes go through the tree; equal ones once.  ``fan`` nodes meet in a task of a round.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > leaf

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pairs = encoder(vocabulary), byte_pairs(vocabulary)
        for batch in small(batches):
            ids, offsets = encode.encode(batch.column("text"))
            texts = pa.array([pairs.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), texts], ["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(vocabulary)
        for batch in small(batches, size=1 << 20):
            rows = [(key, k, *x) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, x in enumerate(pairs.leaves(text, leaf))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.bool_()), strict=True)], ["key", "k", "text", "data", "glue"])

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pairs = encoder(vocabulary), byte_pairs(vocabulary)
        for batch in batches:
            ids, offsets = encode.encode(batch.column("text"))
            data = batch.column("data").to_pylist()
            found = [(ids[a:b] if x is None else pairs.encode_bytes(x)).astype("<i4").tobytes() for x, a, b in zip(data, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            none = pa.array(np.full(len(found), -1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), batch.column("glue"), pa.array(found, pa.binary()), none, none], ["key", "k", "glue", "ids", "head", "tail"])

    def concatenate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        nodes = [Node(bool(g), np.frombuffer(x, "<i4"), h, t) for g, x, h, t in zip(group["glue"], group["ids"], group["head"], group["tail"], strict=True)]
        node = byte_pairs(vocabulary).tree(nodes)
        return pd.DataFrame({"key": group["key"].iloc[:1].tolist(), "k": [int(group["k"].iloc[0]) // fan], "glue": [node.glue], "ids": [node.ids.astype("<i4").tobytes()], "head": [node.head], "tail": [node.tail]})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(vocabulary)
        for batch in batches:
            for doc, blob in zip(batch.column("doc_id"), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(blob, "<i4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), _lists([ids]), pa.array([pairs.decode(ids)], pa.string())], ["doc_id", "ids", "decoded"])

    short = slim.filter(~is_long).transform(lean).mapInArrow(whole, RESULT)
    long = slim.filter(is_long).withColumn("key", F.sha2("text", 256))
    cuts = long.transform(lean).mapInArrow(cut, "key string, k int, text string, data binary, glue boolean")
    once = cuts.groupBy("key", "k").agg(*[F.first(c).alias(c) for c in ("text", "data", "glue")])
    nodes = stored(once.mapInArrow(leaf_ids, _NODE), "leaves")
    last = nodes.agg(F.max("k")).first()[0]
    while last:
        nodes = nodes.groupBy("key", F.expr(f"k div {fan}").alias("up")).applyInPandas(concatenate, _NODE)
        last //= fan
    # Many rows may have the same long text: they are dealt over copies of its ids, so that no task takes them all.
    rows = long.select("doc_id", "key")
    times = rows.groupBy("key").agg(F.ceil(F.count("*") / 64).cast("int").alias("copies"))
    dealt = rows.join(times, "key").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    copies = nodes.select("key", "ids").join(times, "key").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    joined = dealt.join(copies.select("key", "copy", "ids"), ["key", "copy"]).select("doc_id", "ids")
    return short.unionByName(joined.mapInArrow(opened, RESULT))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoded text, as counts and hashes.

    One row per row of ``documents``, null and repeated ids included.  Null counts as the empty text: no ids, hashes of the empty string.
    """
    done = encode_decode(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
