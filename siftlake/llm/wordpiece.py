"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it.  Every
node knows where matching goes on when the next byte has no child, its failure link, and how many pieces the greedy
longest match has certainly taken by then.  A word is walked once and no piece is built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.encoding import vocabulary_path
from siftlake.llm.shared import lean, small, table

_WORK: dict[str, LongestMatch] = {}


class LongestMatch:
    """Numbers of pieces that greedy longest match takes for a word; a word it cannot cut counts as one unknown piece."""

    START, CONTINUE = 0, 1

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        goto: dict[int, int] = {}
        is_piece = bytearray(2)
        for root, pieces in ((self.START, first), (self.CONTINUE, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = goto.get(node << 8 | byte)
                    if nxt is None:
                        nxt = goto[node << 8 | byte] = len(is_piece)
                        is_piece.append(0)
                    node = nxt
                if piece:
                    is_piece[node] = 1
        self.goto = goto
        self.fail: list[int] = [-1] * len(is_piece)
        self.popped: list[int] = [0] * len(is_piece)
        children: list[list[tuple[int, int]]] = [[] for _ in is_piece]
        for key, node in goto.items():
            children[key >> 8].append((key & 255, node))
        queue = deque((self.START, self.CONTINUE))
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if is_piece[node]:
                    self.fail[node], self.popped[node] = self.CONTINUE, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 8 | byte) not in goto:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = goto[at << 8 | byte], count
        self.known: dict[str, int] = {}

    def length(self, word: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        at, count = self.START, 0
        for byte in word:
            while (nxt := goto.get(at << 8 | byte)) is None:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = nxt
        while at != self.CONTINUE:
            count += popped[at]
            at = fail[at]
            if at < 0:
                return 1 if word else 0
        return count

    def lengths(self, words: list[str], room: int = 500_000) -> np.ndarray:
        """Lengths of many words; words seen before are looked up, in a table that is emptied at ``room`` words."""
        known = self.known
        if len(known) + len(words) > room:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.length(w.encode())
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: (beginning a word, continuing one).

    Entries that stand for a space and more begin a word.  The others continue one, and may begin one too, so that
    every word can be cut.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # Byte-level files write printable bytes as themselves and the n-th other byte as code point 256 + n.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = [bytes(map(byte_of.__getitem__, token)) for token in vocabulary if all(c in byte_of for c in token)]
    rest = [p for p in pieces if p[:1] != b" "]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1] + rest, rest


def _automaton(path: str) -> LongestMatch:
    if path not in _WORK:
        _WORK[path] = LongestMatch(*byte_level_pieces(path))
    return _WORK[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row: doc_id, n_words (runs of other than ASCII white space), n_pieces and the longest word's pieces.

    Null or empty text has no words and no pieces.  Ids may repeat or be null.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        for batch in small(batches):
            lists = pc.split_pattern_regex(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), "[ \\t\\n\\x0b\\f\\r]+")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            words = lists.flatten().dictionary_encode()
            names = words.dictionary.to_pylist()
            codes = words.indices.to_numpy()
            pieces = automaton.lengths(names)[codes]
            full = np.array([w != "" for w in names], bool)[codes]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (full, pieces)]
            n_words, n_pieces = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            longest = np.maximum.reduceat(np.append(pieces, 0), np.minimum(ends[:-1], len(pieces))) * (ends[1:] > ends[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_pieces), pa.array(longest)], ["doc_id", "n_words", "n_pieces", "longest"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.transform(lean).mapInArrow(count, "doc_id bigint, n_words bigint, n_pieces bigint, longest bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of all documents.  Nulls, empty texts and repeats: see ``token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"))
