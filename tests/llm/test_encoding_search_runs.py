"""Tree concatenation, reversed search and periodic runs against the library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlake.llm import bpe_tree, lexical, runs
from siftlake.llm.encoding import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, k int, ids string, words string, n long, item int, score double, h long, g long, runs string"
CLASH = (None, None, 3, "k", 1, "ids", "words", 7, 2, 0.5, 10, 11, "runs")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOC)


def library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


ALPHABET = ["a", "ab", "é", "漢", "字", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "the", "<|endoftext|>", "!", "😀", "　", "ing", "\x1c", "\x85", "zz", "​", "re"]


@pytest.mark.parametrize("seed", range(4))
def test_leaves_and_joins_give_the_librarys_ids(seed):
    r, pairs, tokenizer = random.Random(seed), bpe_tree.byte_pairs(PATH), Tokenizer.from_file(PATH)
    makers = [
        lambda: "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 80))), lambda: r.choice([*ALPHABET, "=", "-"]) * r.randint(1, 150),
        lambda: "".join(r.choice("abcdethinorse") for _ in range(r.randint(1, 200))), lambda: "".join(r.choice(["in", "th", "ing", "er", "=", "==", "--", "-", " "]) for _ in range(r.randint(1, 100)))]
    for _ in range(400):
        text, leaf = r.choice(makers)(), r.choice([1, 2, 3, 5, 8, 13, 40])
        nodes = [bpe_tree.Node(glue, np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if data is None else pairs.encode_bytes(data)) for t, data, glue in pairs.leaves(text, leaf)]
        assert (pairs.tree(nodes).ids.tolist() if nodes else []) == library(tokenizer, text)[0], (text, leaf)
        ids = [r.randrange(50257) for _ in range(20)]
        assert pairs.decode(np.array(ids, np.int32), 3) == tokenizer.decode(ids, skip_special_tokens=False)


def test_windows_grow_until_both_sides_agree():
    """Runs of one letter take long tokens from the left: the windows must reach the end of the right side."""
    pairs, tokenizer = bpe_tree.byte_pairs(PATH), Tokenizer.from_file(PATH)
    for text in ("=" * 5001, "a" * 4099, "-" * 777 + "=" * 900, "漢字" * 800):
        parts = [pairs.encode_bytes(x) for x in (text.encode()[:1001], text.encode()[1001:])]
        assert pairs.concatenate(*parts).tolist() == library(tokenizer, text)[0]


def test_vocabularies_without_byte_pairs_are_refused():
    with pytest.raises(ValueError):
        bpe_tree.BytePairs(vocabulary_path("word_bpe_49k.json"))


LONG = " ".join(f"word{i % 97} of{'x' * (i % 5)}" for i in range(4000))
ODD = [
    (5, "Some plain text, isn't it?"), (5, "Some plain text, isn't it?"), (5, "another text of 5"), (None, "no id"), (None, LONG), (1, None), (2, ""), (3, " \n\t "), (4, "é ü 漢字 😀 <|endoftext|> x"), (6, LONG), (7, LONG),
    (7, "字" * 9000), (8, "=" * 20000 + " " + "ab" * 9000 + "\n" * 5000 + "<|endoftext|>" + " " * 7000 + "end"), (9, "don't" * 3000), (-3, "the the the the the the the the")]


@pytest.mark.parametrize("leaf", [512, 4096])
def test_encode_decode(spark, leaf):
    tokenizer = Tokenizer.from_file(PATH)
    got = sorted(([r["doc_id"], r["ids"], r["decoded"]] for r in bpe_tree.encode_decode(docs(spark, ODD), leaf=leaf, fan=3).collect()), key=str)
    assert got == sorted(([i, *library(tokenizer, t)] for i, t in ODD), key=str)
    assert bpe_tree.encode_decode(docs(spark, [])).collect() == []


def written(spark, tmp_path, rows, items=()):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_bpe_query(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in ODD:
        ids, text = library(tokenizer, t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe_tree.op11_bpe(spark, written(spark, tmp_path, ODD))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in counts) + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("postings", "cells"), [(1_000_000, 1 << 20), (12, 3)])
def test_search(spark, postings, cells):
    r = random.Random(5)
    vocabulary = ["Apple", "PEAR", "plum-tree", "é", "É", "漢字", "x1", "y_z", "the", "a\x00b", "ÄÖ"]
    rows = [(i % 50, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12)))) for i in range(120)] + [(None, "apple pear"), (None, "apple"), (7, None), (8, ""), (9, "... !"), (10, "the " * 3000)]
    items = [(1, "Apple apple pear"), (2, None), (3, ""), (4, "é 漢字 é É"), (4, "plum tree X1"), (None, "the"), (6, "absent"), (7, "y z a b äÖ")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(9))
    got = lexical.search(docs(spark, rows), df, 5, postings=postings, cells=cells)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, 5)
    assert lexical.search(docs(spark, []), df).collect() == [] and lexical.search(docs(spark, rows), df.limit(0)).collect() == [] and lexical.search(docs(spark, [(1, None)]), df).collect() == []


def test_terms_of_slices():
    text = ("One, two;three é" * 50).encode()
    assert [w.decode() for some in lexical.terms_of(text, 7) for w in some] == terms(text.decode())


def brute_runs(w, least=6, powers=4):
    found = set()
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, powers * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_runs(seed):
    r = random.Random(seed)
    for _ in range(500):
        letters = "abcdefgh"[:r.choice([1, 2, 2, 3, 5])]
        w = [r.choice(letters) for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.6:
            a = r.randrange(len(w))
            p = 1 + (len(w) - a) // r.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            if r.random() < 0.5:
                w = w + [r.choice("abc") for _ in range(5)] + w
        encoded = [x.encode() for x in w]
        assert [tuple(x) for x in runs.document_runs(encoded).tolist()] == brute_runs(w)
        if w:
            number = {}
            whole = runs.runs_of([number.setdefault(x, len(number) + 1) for x in w], 6, 2)
            assert [tuple(x) for x in whole.tolist()] == brute_runs(w, 6, 2)


def test_longest_common_extensions():
    r = random.Random(2)
    s = [r.randint(1, 2) for _ in range(80)]
    tree = runs.SuffixTree(s)
    assert tree.order == sorted(range(81), key=lambda i: [*s, 0][i:])
    i, j = np.array([(a, b) for a in range(80) for b in range(80) if a != b]).T
    assert tree.common(i, j).tolist() == [next(k for k in range(81) if max(a, b) + k == 80 or s[a + k] != s[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def run_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    dropped = {k for s, size, q in found for k in range(s + q, s + size)}
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_runs_query(spark, tmp_path):
    r = random.Random(9)
    repeating = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rows = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 90)))) for i in repeating] + [(i, "\n".join(["line one", "line one two"] * r.randint(0, 5))) for i in range(40)]
    rows += [(None, "x " * 30), (None, None), (repeating[0], None), (repeating[1], ""), (repeating[2], " \t"), (repeating[3], "one"), (3, None), (3, "a\x0bb\x0ca\x0bb a b a b é 漢\xa0x"), (4, "x y " * 40 + "z " * 7), (4, "x y " * 40 + "z " * 7)]
    got = runs.op13_periodic_runs(spark, written(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(got.dtypes)["exponent_milli"] == "bigint" and sorted(map(tuple, got.collect()), key=str) == sorted((run_row(*x) for x in rows), key=str)
    assert runs.periodic_runs(docs(spark, [])).collect() == []
