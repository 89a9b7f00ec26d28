"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick in folded text.

Folding undoes disguises: look-alike letters of other scripts and digits that stand for letters become the letter.
The lexicon has words and beginnings of longer words.  A match inside an exception phrase does not count.  The weights of
a text's matches are normalised by its length and calibrated to a probability: a regularised logistic fit of all entries together.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.shared import lean, small, stored, table, unit_interval

#: Look-alikes and the Latin letter they stand for; i, l and 1 are one letter, since 1 stands for both.
LOOKALIKES = str.maketrans(
    "абвгдекмнорстухіјѕԁһαβεικνορτυχ013457@$l",
    "abbrdekmhopctyxijsdhabeiknoptuxoieastasi")
_SPACE = {c: " " for c in [*range(33, 48), *range(58, 64), *range(91, 97), *range(123, 127), *range(0x2010, 0x2060), 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, 9, 10, 11, 12, 13] if chr(c) not in "@$"}
_FOLD = _SPACE | LOOKALIKES
#: Lengths of beginnings of words that may be learned.
STEMS = (4, 5, 6, 7, 8)


def fold(text: str) -> str:
    """Lower case, disguises undone, punctuation as spaces, with a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_FOLD)} "


def entries_of(word: str) -> list[str]:
    """The lexicon entries a folded word could match: itself between spaces, and beginnings that it goes on from, after a space."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    base: float

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for number, entry in enumerate(self.weights):
            auto.add_word(entry, (len(entry), number))
        for phrase in self.exceptions:
            entry = fold(phrase)
            # Spaces around a phrase may belong to a match beside it.
            if entry not in self.weights:
                auto.add_word(entry, (len(entry), -1))
        if len(auto):
            auto.make_automaton()
        return auto

    def matches(self, text: str, auto: ahocorasick.Automaton) -> tuple[list[int], int]:
        """(numbers of the entries that count in the text, words of the text).  Of several at one place the longest counts."""
        if not len(auto) or not text:
            return [], 0
        folded = fold(text)
        found: dict[int, int] = {}
        spared = []
        for end, (size, number) in auto.iter(folded):
            start = end - size + 1
            if number < 0:
                spared.append((start, end))
            elif folded[end] == " " or folded[end + 1] != " ":
                # A beginning counts where its word goes on.  Longer entries of one place end later.
                found[start] = number
        if not spared:
            return list(found.values()), folded.count(" ")
        # Both in order of their starts: one sweep, however many phrases a text has.
        kept, until, at = [], -1, 0
        spared.sort()
        for start in sorted(found):
            while at < len(spared) and spared[at][0] <= start:
                until = max(until, spared[at][1])
                at += 1
            if start >= until:
                kept.append(found[start])
        return kept, folded.count(" ")

    @staticmethod
    def scale(words: int) -> float:
        """What weights are divided by: a text of 100 words counts as it is nearly, longer ones less."""
        return 1 + math.log1p(words / 100)

    def strength(self, text: str, auto: ahocorasick.Automaton) -> float:
        """Weights of the matches by the size of the text."""
        found, words = self.matches(text, auto)
        own = list(self.weights.values()) if found else []
        return sum(own[i] for i in found) / self.scale(words) if found else 0.0

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * strength, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Texts of labelled rows that are not held out: about ``limit`` at most, an even sample by a hash of the id, so the side that is sent to all is bounded."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    one = clean.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    share = min(1.0, limit / max(1, one.count()))
    sample = one.filter(unit_interval("doc_id", F.lit("sample")) < share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, limit: int = 50_000, least: int = 5, odds: float = 1.5, size: int = 20_000, exceptions: tuple[str, ...] = (), ridge: float = 0.3, phrases: int = 5000, confirmed: float = 0.05) -> Lexicon:
    """Fit the lexicon on about ``limit`` labelled rows at most.

    Candidates are the ``size`` entries with the most toxic rows among those in ``least`` toxic rows or more whose log
    odds are ``odds`` or more.  From them entries are picked one by one, each explaining the most toxic rows, by its odds, that none before explains, so
    that a word which only comes along with copies of one text is not taken; then those of twice the odds that a share ``confirmed`` of the toxic rows has.  Words that an entry matches, and two-word phrases
    around a match, that occur in three clean rows and in no toxic one become exceptions, ``phrases`` at most.  All weights are
    then fitted together, with ``ridge`` against large ones and none under 0.  Without toxic rows the lexicon is empty and all scores are 0.
    """
    rows = stored(training_rows(docs, labels, limit), "toxic-train")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update({e for w in set(fold(text).split()) for e in entries_of(w)})
            entries = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"entry": entries, "t": pa.array([seen[1][e] for e in entries], pa.int64()), "c": pa.array([seen[0][e] for e in entries], pa.int64())})

    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_clean = int(totals[0] or 0), int(totals[1] - (totals[0] or 0))
    if not n_toxic:
        return Lexicon({}, exceptions, 1.0, -30.0)
    sums = rows.select("text", "toxic").transform(lean).mapInArrow(tally, "entry string, t bigint, c bigint").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    candidates = sums.withColumn("w", weight).filter((F.col("t") >= least) & (F.col("w") >= odds)).orderBy(F.desc("t"), "entry").limit(size).collect()
    weights = {r["entry"]: r["w"] for r in candidates}
    order = {r["entry"]: i for i, r in enumerate(candidates)}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = set(fold(text).split())
                out.append([order[e] for w in words for e in entries_of(w) if e in order])
            yield pa.RecordBatch.from_pydict({"found": pa.array(out, pa.list_(pa.int32()))})

    # At most ``limit`` rows of entry numbers: what the sample's bound allows on the driver.
    sets = [frozenset(r["found"]) for r in rows.filter("toxic = 1").select("text").transform(lean).mapInArrow(matched, "found array<int>").toLocalIterator()]
    holders = defaultdict(set)
    for i, found in enumerate(sets):
        for e in found:
            holders[e].add(i)
    names, picked, open_rows = list(order), {}, set(range(len(sets)))
    while holders:
        best = max(holders, key=lambda e: (len(holders[e]) * weights[names[e]], weights[names[e]], -e))
        if len(holders[best]) < 2:
            break
        picked[names[best]] = float(weights[names[best]])
        covered = holders.pop(best)
        open_rows -= covered
        for e in {e for i in covered for e in sets[i]}:
            if e in holders:
                holders[e] -= covered
                if not holders[e]:
                    del holders[e]
    # What only confirms is kept too, where it is far from the copies of one text and no picked entry is the same word.
    for r in sorted(candidates, key=lambda r: (-r["t"] * r["w"], r["entry"])):
        known = any(r["entry"].startswith(e.rstrip()) or e.startswith(r["entry"].rstrip()) for e in picked)
        if not known and r["t"] >= max(least, confirmed * n_toxic) and r["w"] >= 2 * odds:
            picked[r["entry"]] = float(r["w"])
    lexicon = Lexicon(picked, exceptions, 1.0, 0.0)
    lexicon = Lexicon(picked, tuple(dict.fromkeys(exceptions + _phrases(rows, lexicon, phrases))), 1.0, 0.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in small(batches):
            found = [lexicon.matches(t, auto) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())], ["toxic", "found", "words"])

    # Numbers of matches of the sample's rows: bounded as the sample is.  Rows with equal matches are one row with a count.
    kinds: Counter = Counter()
    for r in rows.select("toxic", "text").transform(lean).mapInArrow(counted, "toxic int, found array<int>, words bigint").toLocalIterator():
        kinds[(r["toxic"], tuple(sorted(r["found"])), round(lexicon.scale(r["words"]), 1) if r["found"] else 1.0)] += 1
    fitted, base = _fit(kinds, len(picked), ridge)
    kept = {e: w for e, w in zip(picked, fitted, strict=True) if w > 0}
    return Lexicon(kept, lexicon.exceptions, 1.0, base)


def _phrases(rows: DataFrame, lexicon: Lexicon, limit: int) -> tuple[str, ...]:
    """Words that beginnings match, and phrases of two words around a match, that clean rows have and no toxic one."""
    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = fold(text).split()
                own = set()
                for i, w in enumerate(words):
                    if any(e in lexicon.weights for e in entries_of(w)):
                        own |= {w, *(" ".join(words[a:a + 2]) for a in (i - 1, i) if a >= 0 and a + 2 <= len(words))}
                out += [(p, toxic) for p in own]
            yield pd.DataFrame(out, columns=["phrase", "toxic"])

    found = rows.select("text", "toxic").mapInPandas(around, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    return tuple(r["phrase"] for r in found.filter("t = 0 AND n >= 3").orderBy(F.desc("n"), "phrase").limit(limit).collect())


def _fit(kinds: Counter, size: int, ridge: float) -> tuple[np.ndarray, float]:
    """Weights of the entries, none under 0, and the base, by Newton steps over counted kinds of rows (toxic, matches, scale)."""
    rows = list(kinds)
    x = np.zeros((len(rows), size + 1))
    for i, (_, found, scale) in enumerate(rows):
        np.add.at(x[i], list(found), 1 / scale)
    x[:, size] = 1.0
    y, n = np.array([r[0] for r in rows], float), np.array([kinds[r] for r in rows], float)
    beta, free = np.zeros(size + 1), np.ones(size + 1, bool)
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty * beta
        # An entry at 0 that would go below stays there.
        free = (beta > 0) | (slope > 0)
        free[size] = True
        own = x[:, free]
        curve = own.T @ (own * (n * p * (1 - p))[:, None]) + np.diag(penalty[free])
        step = np.linalg.solve(curve, slope[free])
        new = beta.copy()
        new[free] += np.clip(step, -2, 2)
        new[:size] = np.maximum(new[:size], 0)
        done = np.abs(new - beta).max() < 1e-7
        beta = new
        if done:
            break
    return beta[:size], float(beta[size])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.  Null text scores like empty text.  Rows with a null id are never held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in small(batches):
            strength = np.array([lexicon.strength(t or "", auto) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lexicon.score(strength))], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = slim.transform(lean).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon learned from the rows that are not held out.  Nulls, empty texts and repeats: see ``score``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
