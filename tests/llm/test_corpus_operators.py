"""Corpus operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import ahocorasick  # noqa: F401
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlake.llm import bitsliced, bwt, encoding, fingerprint, langid, mixing, packing, shared, sigtree, toxicity, wavelet, wordpiece
from siftlake.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, node long, block int, n int, size long, target double, u double"


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, lang, source), with more columns whose names operators use inside."""
    full = [(*r, *(None, None)[: 4 - len(r)], None, 1, "x", 7, 3, 5, 9, 0.5, 0.25) if len(r) < 13 else r for r in rows]
    return spark.createDataFrame(full, DOC)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


BASE = words(120, 1)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
LONG = words(9000, 2)
ROWS = [
    (5, BASE), (3, NEAR), (9, BASE), (9, BASE), (1, None), (2, ""), (4, "one two"), (6, "One TWO"), (7, "one  two "), (8, words(40, 3) + " " + LONG), (10, LONG),
    (11, "\n\t "), (12, "é ü ß 漢字 emoji 😀 <|endoftext|> x"), (None, BASE), (13, "a" * 3000), (14, "ab" * 40 + words(3, 9)), (15, "x " + "ab" * 40),
]


@pytest.fixture(scope="module")
def sample(spark):
    return docs(spark, ROWS).cache()


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.5, -0.3, 0.0, 0.25, 0.9, 3.0]) for _ in range(6)]) for i in range(150)]
    rows += [(20, None), (40, [None, 1.0]), (60, [float("nan")] * 6), (None, [1.0] * 6), (7, rows[7][1]), (200, []), (220, [0.5, 0.5]), (300, rows[3][1]), (301, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "block": F.lit(1)})
    ready = bitsliced.quantised(df, "vec_id", "embedding", 64.0)
    clean = {(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, v in clean:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for c, w in clean if c != q)[:20]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)}
    for size in (16, 8192):
        got = [tuple(r) for r in bitsliced.search(ready, ready.filter("vec_id % 20 = 0"), 20, size, 3).collect()]
        assert len(got) == len(want) and set(got) == want
    assert bitsliced.search(ready.limit(0), ready.limit(0)).collect() == []


def test_jaccard_components(spark, sample):
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    got = sorted((tuple(r) for r in sigtree.jaccard_components(sample).collect()), key=str)
    sets = [(i, shingles(t)) for i, t in ROWS]
    link = defaultdict(set)
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                link[i].add(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    want = sorted(((i, len(s), (reach(i) if s else i) if i is not None else None) for i, s in sets), key=str)
    assert got == want
    assert sigtree.jaccard_components(docs(spark, [])).collect() == []


def test_large_family_is_cut_and_whole(spark, monkeypatch):
    """A family of many trees, where most documents link with the pivot, some only with each other and some with none."""
    monkeypatch.setattr(sigtree, "TREE_DOCS", 8)
    r, base = random.Random(8), words(80, 5).split()

    def edited(w, k):
        w = list(w)
        for at in r.sample(range(len(w)), k):
            w[at] = f"e{r.randrange(10**9)}"
        return w

    other = edited(base, 6)
    rows = [(i, " ".join(edited(base, 1))) for i in range(30)] + [(100 + i, " ".join(edited(other, 1))) for i in range(20)] + [(200 + i, " ".join(edited(base, 4))) for i in range(10)]
    got = {r[0]: r[2] for r in sigtree.jaccard_components(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(76)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root and len(set(root.values())) > 2


def test_loose_blocks_are_cut_by_tokens(spark, monkeypatch):
    """Documents that the pivot of a large family does not connect are joined in blocks of few tokens."""
    def cross(batches, work=sigtree._cross):
        def checked():
            for pdf in batches:
                for sizes in pdf["sizes"]:
                    assert len(sizes) // 8 * 76 <= 1600, "a block with too many tokens"
                yield pdf
        yield from work(checked())

    monkeypatch.setattr(sigtree, "TREE_TOKENS", 800)
    monkeypatch.setattr(sigtree, "_cross", cross)
    r, base = random.Random(8), words(80, 5).split()
    rows = []
    for i in range(60):
        w = list(base)
        for at in r.sample(range(len(w)), 1 if i < 20 else 4):
            w[at] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    got = {r[0]: r[2] for r in sigtree.jaccard_components(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(76)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root and len(set(root.values())) > 20


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(500, i) for i in range(501, 540)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 500 for i in range(500, 540)}


def test_word_pieces(spark, sample):
    first, rest = [b"un", b"aff", b"a", b"u", b"xy"], [b"aff", b"able", b"ab", b"a", b"b", b"l", b"e", b"n", b"f"]
    automaton = wordpiece.LongestMatch(first, rest)

    def greedy(word, at=0, count=0):
        while at < len(word):
            vocab = rest if at else first
            size = max((len(p) for p in vocab if word[at:].startswith(p)), default=0)
            if not size:
                return 1
            at, count = at + size, count + 1
        return count

    r = random.Random(1)
    for _ in range(3000):
        w = bytes(r.choice(b"unafbelxy") for _ in range(r.randint(0, 9)))
        assert automaton.length(w) == greedy(w), w
    pieces = wordpiece.byte_level_pieces(encoding.vocabulary_path("byte_bpe_50k.json"))
    sets, longest = tuple(map(set, pieces)), max(map(len, pieces[0]))

    def count(word):
        at = n = 0
        while at < len(word):
            at += max(k for k in range(1, min(longest, len(word) - at) + 1) if word[at:at + k] in sets[at > 0])
            n += 1
        return n

    want = Counter()
    for i, t in ROWS:
        counts = [count(w.encode()) for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        want[(i, len(counts), sum(counts), max(counts, default=0))] += 1
    assert Counter(tuple(r) for r in wordpiece.token_counts(sample).collect()) == want
    assert wordpiece.token_counts(docs(spark, [])).collect() == []


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, words(r.randint(1, 30), i), "en", r.choice(["a", "b", "b", "c", "é"])) for i in range(1500)] + [(2000 + i, words(3, i), "en", "tiny") for i in range(4)] + [(3000, None, "en", None), (3001, words(5, 1), "en", None), (3002, "", "en", "a"), (None, "x y", "en", "a"), (1, rows_1 := words(4, 77), "en", "a"), (1, rows_1, "en", "a")]
    df = docs(spark, rows)
    got = [tuple(x) for x in mixing.mix(df, block=16).collect()]
    assert sorted(got, key=str) == sorted((tuple(x) for x in mixing.mix(df.repartition(7), block=16).collect()), key=str)
    assert Counter((g[0], g[1], g[5]) for g in got) == Counter((i, len((t or "").split()), s) for i, t, _, s in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted((s for s in sizes if s is not None)) + [None])}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        left = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        for s in over:
            target[s] = 3.0 * sizes[s]
        open_ -= over
        if not over:
            target |= share
            break
    taken = Counter()
    for doc, size, source_size, t, took, s in got:
        assert source_size == sizes[s] and t == pytest.approx(target[s]) and took <= 3 * size and (size == 0 or took % size == 0)
        taken[s] += took
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    assert mixing.mix(docs(spark, [])).collect() == []


def test_mixing_rounds_each_document_fairly(spark):
    df = docs(spark, [(i, words(5 + i % 7, i), "en", "a" if i % 4 else "b") for i in range(40)])
    copies = Counter()
    for k in range(12):
        for r in mixing.mix(df, seed=f"s{k}", block=4).collect():
            copies[r["source"]] += r["taken"] / r["target"] / 12
    assert all(abs(c - 1) < 0.1 for c in copies.values())


@pytest.mark.parametrize("seed", range(3))
def test_merged_transforms_find_equal_windows(seed):
    r = random.Random(seed)
    core = bytes(r.choice(b"abc") for _ in range(200))
    parts = [core[a:a + r.randint(50, 100)] for a in (r.randint(0, 99) for _ in range(25))] + [bytes(r.choice(b"ab") for _ in range(60)), b"a" * 113, b"a" * 90]
    parts = [p for p in dict.fromkeys(parts) if len(p) >= 50]
    ids = np.array([r.randint(0, 9) for _ in parts], np.int64)
    windows = np.array([len(p) - 49 for p in parts], np.int64)
    want, got = {}, bwt.least_ids(np.frombuffer(b"".join(parts), np.uint8), windows, ids)
    for p, i in zip(parts, ids.tolist(), strict=True):
        for k in range(len(p) - 49):
            want[p[k:k + 50]] = min(want.get(p[k:k + 50], 99), i)
    assert got.tolist() == [want[p[k:k + 50]] for p in parts for k in range(len(p) - 49)]


def test_repeat_removal(spark, sample):
    extra = [(20, None), (21, "é" * 40), (22, "x" + "é" * 40), (23, "q" * 49), (24, "q" * 49), (25, "z" * 50), (26, "yy" + "z" * 50 + "y"), (26, BASE[:70]), (0, BASE[100:170] + "!")]
    rows = ROWS + extra
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k:k + 50]] = min(first.get(b[k:k + 50], i), i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if i is not None and first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[(i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)), hashlib.sha256(kept).hexdigest())] += 1
    df = docs(spark, rows)
    for group in (500, 2 << 20):
        assert Counter(tuple(r) for r in bwt.remove_repeats(df, group_bytes=group, part_bytes=4000, least_parts=3).collect()) == want
    assert bwt.remove_repeats(docs(spark, []), least_parts=2).collect() == []


def _passage_rows(n):
    """Documents with one passage between texts of their own, some of which repeat."""
    r, passage = random.Random(11), words(12, 4)
    rows = [(i, "".join(r.choice("qrstuvwxyz ") for _ in range(60)) + passage + "".join(r.choice("qrstuvwxyz ") for _ in range(60))) for i in range(n)]
    return rows + [(n + i, "!" + rows[i][1][20:-20]) for i in range(0, n, 7)]


def _least_by_window(rows):
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k:k + 50]] = min(first.get(t[k:k + 50], i), i)
    return first


@pytest.mark.parametrize(("limit", "bounded"), [(1 << 40, False), (40, True)])
def test_a_hot_anchor_is_dealt_out(limit, bounded, monkeypatch):
    """At the edges of a common passage every document has a fragment of its own: no part may get them all to sort."""
    rows, parts, sorted_bytes = _passage_rows(300), 16, []
    monkeypatch.setattr(bwt, "SORTED", 4000)
    monkeypatch.setattr(bwt, "least_ids", lambda data, *a, f=bwt.least_ids: sorted_bytes.append(len(data)) or f(data, *a))
    tables = {g: pa.table({"doc_id": pa.array([i for i, _ in rows[g::5]], pa.int64()), "text": [t for _, t in rows[g::5]]}) for g in range(5)}
    sent, told, answers = defaultdict(list), defaultdict(list), defaultdict(list)
    for g, t in tables.items():
        for part, blob in bwt._anchor_rows(bwt.Group(t, parts)):
            sent[part].append((g, blob))
    for part, blobs in sent.items():
        for g, blob in bwt._anchor_answers(blobs, limit):
            told[g].append((part, blob))
    groups, sent = {g: bwt.Group(t, parts) for g, t in tables.items()}, defaultdict(list)
    for g, own in groups.items():
        own.fragments(*bwt._known(told[g]))
        for part, blob in own.entry_rows():
            sent[part].append((g, blob))
    for part, blobs in sent.items():
        for g, blob in bwt._answer(blobs):
            answers[g].append((part, blob))
    assert (max(sorted_bytes, default=0) <= 4000 + 40 * 113) == bounded
    first = _least_by_window(rows)
    for g, own in groups.items():
        windows = own.windows[own.first]
        starts = np.cumsum(windows) - windows
        least, at = np.repeat(own.least, windows), own.entry_starts()
        for part, blob in answers[g]:
            entries, values = bwt._open(blob, np.int32, np.int64)
            place = [starts[e + at[part]] + k for e in entries.tolist() for k in range(windows[e + at[part]])]
            least[place] = values
        gone, want = own.covered(least, starts), []
        for i, t in rows[g::5]:
            cover = np.zeros(len(t), bool)
            for k in range(len(t) - 49):
                if first[t[k:k + 50]] < i:
                    cover[k:k + 50] = True
            want.append(cover)
        assert np.array_equal(gone, np.concatenate(want))


def test_repeat_removal_with_crowded_anchors(spark):
    rows = _passage_rows(120) + [(None, _passage_rows(1)[0][1])]
    plain, split = (Counter(tuple(r) for r in bwt.remove_repeats(docs(spark, rows), with_text=True, group_bytes=4000, part_bytes=4000, least_parts=3, crowded=c).collect()) for c in (1 << 40, 5))
    assert plain == split
    first = _least_by_window([r for r in rows if r[0] is not None])
    assert {r[0]: r[2] for r in split} == {i: len({k + j for k in range(len(t) - 49) for j in range(50) if i is not None and first[t[k:k + 50]] < i}) for i, t in rows}


def test_toxicity_learns_words_stems_and_disguises(spark):
    r = random.Random(5)
    plain = [words(1, k) for k in range(200)]
    rows, labels = [], []
    for i in range(1200):
        text, toxic = [r.choice(plain) for _ in range(40)], i % 4 == 0
        if toxic:
            for _ in range(2):
                text[r.randrange(40)] = r.choice(["grobian", "Schuft!", "miesling", "mieslich", "miesora", "gr0bian", "gгobіan"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5001, ""), (None, "grobian"), (5002, "a kind grobian " + words(20, 1))]
    df, marks = docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(df, marks)
    got = toxicity.score(df, lexicon).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    by = {g["doc_id"]: g for g in got}
    held = [i for i in range(1200) if by[i]["held_out"]]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(1200))
    assert sum(by[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held) > 0.97
    assert by[5000]["predicted"] == by[5001]["predicted"] == 0 and by[None]["predicted"] == 1
    kind = toxicity.Lexicon(lexicon.weights, ("kind grobian",), lexicon.slope, lexicon.base)
    assert {g["doc_id"]: g["predicted"] for g in toxicity.score(df, kind).collect()}[5002] == 0
    # Every score again from the lexicon alone: words looked up one by one, the longest entry, no automaton.
    texts = {r[0]: r[1] for r in rows}
    for g in toxicity.score(df, kind).collect():
        text = texts[g["doc_id"]]
        own = toxicity.fold(text or "").split()
        spared = {i + k for x in kind.exceptions for p in [toxicity.fold(x).split()] for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p for k in range(len(p))}
        sums = 0.0
        for i, w in enumerate(own):
            hit = [e for e in kind.weights if e in toxicity.entries_of(w)]
            sums += kind.weights[max(hit, key=len)] if hit and i not in spared else 0.0
        n = toxicity.fold(text or "").count(" ")
        want = 1 / (1 + np.exp(-np.clip(kind.base + kind.slope * sums / toxicity.Lexicon.scale(n if sums else 0), -30, 30)))
        assert abs(g["score"] - want) < 1e-9
    # A long text with very many spared phrases takes one sweep.
    flooded = kind.matches("kind grobian " * 60_000 + "grobian", kind.automaton())
    assert len(flooded[0]) == (1 if any(e in kind.weights for e in toxicity.entries_of(toxicity.fold("grobian").strip())) else 0)
    none = toxicity.learn(df, marks.filter("toxic = 0"))
    assert none.weights == {} and all(g["predicted"] == 0 for g in toxicity.score(df, none).collect())
    assert toxicity.score(docs(spark, []), lexicon).collect() == []


def test_language_identification(spark):
    r = random.Random(2)
    stock = {"en": ["the", "thing", "with", "ation"], "fr": ["le", "élève", "queue", "où"], "de": ["das", "schön", "über", "keit"]}
    rows = [(i, " ".join(r.choice(stock[g]) for _ in range(30)), g, f"src{i % 5}") for i, g in enumerate(["en", "fr", "de"] * 60)]
    train = docs(spark, rows)
    model = langid.learn_text_model(train)
    test = docs(spark, [(900 + i, " ".join(r.choice(stock[g]) for _ in range(20)), g, "new") for i, g in enumerate(["en", "fr", "de"] * 10)] + [(990, None, "en", "new"), (991, "", None, None), (992, "12 34 !!", "en", "new"), (993, "the thing", None, None)])
    found = {r["doc_id"]: r for r in langid.identify(test.withColumn("s", F.lit(None).cast("string")), model, "text", "lang", "s", "source", "s").collect()}
    assert all(found[900 + i]["language"] == g for i, g in enumerate(["en", "fr", "de"] * 10))
    assert all(found[i]["rejected"] and found[i]["language"] is None for i in (990, 991, 992)) and found[993]["language"] == "en"
    kept = langid.keep_identified(test, model)
    assert kept.columns == test.columns and kept.count() == 31
    pages = spark.createDataFrame([(1, "http://u@a.Site.example.fr:80/x", "<html lang='fr-CA'><script>the the the</script><p>élève queue</p>"), (2, "http://h/de/", None), (3, None, "<p>the thing with</p>"), (4, "nonsense", "")], "page_id long, url string, html string")
    seen = {r["page_id"]: r for r in langid.page_evidence(pages).collect()}
    assert (seen[1]["declared"], seen[1]["suffix"], seen[1]["host"], seen[1]["site"]) == ("fr", "fr", "a.site.example.fr", "example.fr") and seen[2]["suffix"] == "de" and "the" not in seen[1]["text"]
    assert langid.learn_text_model(docs(spark, [])).languages == ()
    assert langid.keep_identified(docs(spark, []), model).collect() == []


def test_wavelet_matrix():
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 50257, 3000), r.integers(0, 2, 700), np.zeros(5, int), np.array([], int), np.array([70000, 3, 70000])):
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert w.decode().tolist() == ids.tolist()
        for i in range(0, len(ids), 97):
            assert w.access(i) == ids[i]
        for v in {*ids[:5].tolist(), 1, 99999}:
            where = np.flatnonzero(ids == v).tolist()
            assert w.count(v) == len(where) and w.occurrences(v)[:50] == where[:50]
            assert [w.rank(v, i) for i in range(0, len(ids) + 1, 211)] == [int((ids[:i] == v).sum()) for i in range(0, len(ids) + 1, 211)]


def _ids(name):
    from tokenizers import Tokenizer

    return lambda t, k=Tokenizer.from_file(encoding.vocabulary_path(name)): k.encode(t or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_s_ids(name):
    texts = [t for _, t in ROWS] + ["a  b", " a", "x y z", "it's We'LL 'S", "a<|ENDOFTEXT|> b", "<|endoftext|>", "É é é İ Σς", "tab\tx\r\ny", "don't stop. Now! (ok)", "end. ", "\u0085q w"]
    encode, plain = encoding.Encoder(encoding.vocabulary_path(name), room=50), _ids(name)
    for _ in range(2):
        ids, offsets = encode.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in texts]


def test_token_output(spark, sample, tmp_path):
    plain = _ids("byte_bpe_50k.json")
    wavelet.write_token_shards(sample, str(tmp_path / "shards"), shard_tokens=700, part_bytes=2000)
    got = sorted((tuple(r) for r in wavelet.read_token_shards(spark, str(tmp_path / "shards")).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(x), _crc(x)) for i, x in ((i, plain(t) + [0]) for i, t in ROWS))
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    tokenizer = Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    lists = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in ROWS]
    wanted = [0, 50256, 64, 31337, *Counter(x for _, ids in lists for x in ids).keys()][:40]
    found = Counter(tuple(r) for r in wavelet.find_tokens(spark, str(tmp_path / "shards"), wanted).collect())
    assert found == Counter((x, i, at) for i, ids in lists for at, x in enumerate(ids) for y in wanted if x == y)
    wavelet.write_token_shards(docs(spark, []), str(tmp_path / "none"))
    assert wavelet.read_token_shards(spark, str(tmp_path / "none")).collect() == []


def test_fingerprints(spark, sample):
    def key(row):
        return (row[0] is None, row[0] or 0)

    got = fingerprint.fingerprints(sample).collect()
    order = sorted(ROWS, key=key)
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in ROWS)
    texts = {i: t or "" for i, t in ROWS}
    following = {order[k][0]: order[(k + 1) % len(order)][0] for k in range(len(order)) if order[k][0] != 9}
    for r in got:
        if r["doc_id"] != 9:
            t, n = texts[r["doc_id"]], texts[following[r["doc_id"]]]
            cut = len(t) // 4
            assert r["edited_sha256"] == hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = defaultdict(set)
    for r in got:
        prints[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) >= len(prints) - 1
    assert fingerprint.fingerprints(docs(spark, [])).collect() == []


def test_fingerprints_add_up_and_tell_likeness(spark):
    a, b = [words(8, k) for k in range(60)], [words(8, 100 + k) for k in range(60)]
    rows = spark.createDataFrame([("ab", "\n".join(a + b)), ("ba", "\n".join(b[::-1] + a)), ("a", "\n".join(a)), ("b", "\n".join(b)), ("half", "\n".join(a[:30] + b[:30]))], "name string, t string")
    prints = fingerprint.fingerprint_elements(rows, ["name"], "t").cache()
    wide = prints.groupBy().pivot("name", ["ab", "ba", "a", "b", "half"]).agg(F.first("fp"))
    like = lambda x, y: fingerprint.likeness(F.col(x), F.col(y), fingerprint.vector(F.col(x)), fingerprint.vector(F.col(y)))
    r = wide.select((F.col("ab") == F.col("ba")).alias("order"), (fingerprint.combine(F.col("a"), F.col("b")) == F.col("ab")).alias("sum"), (fingerprint.combine(F.col("ab"), F.col("b"), -1) == F.col("a")).alias("less"),
                    like("a", "half").alias("half"), like("a", "b").alias("none"), like("ab", "ba").alias("same")).first()
    assert r["order"] and r["sum"] and r["less"] and r["same"] == 1 and 0.3 < r["half"] < 0.7 and r["none"] < 0.35


def test_packing(spark, sample):
    plain = _ids("word_bpe_49k.json")
    for group, chunk in ((20_000, 200_000), (4, 3)):
        got = packing.pack_documents(sample, room=256, group=group, chunk=chunk).collect()
        want = Counter()
        for i, t in ROWS:
            ids = plain(t) + [0]
            for k in range(0, len(ids), 256):
                want[(i, k // 256, k, len(ids[k:k + 256]), _crc(ids[k:k + 256]))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for items in bins.values():
            end = 0
            for at, size in sorted(items):
                assert at == end
                end += size
            assert end <= 256
        if group > 4:
            assert len(bins) <= sum(r["length"] for r in got) / 256 * 1.1 + 1
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_packing_leaves_no_two_open_sequences_that_fit_together(spark):
    r = random.Random(6)
    df = docs(spark, [(i, words(r.choice([6, 7, 8, 9, 10, 11, 12]), i)) for i in range(6000)]).repartition(8)
    rows = packing.pack_documents(df, room=64, slack=2, group=30, chunk=10).collect()
    fill, spans = Counter(), defaultdict(list)
    for x in rows:
        fill[x["sequence_id"]] += x["length"]
        spans[x["sequence_id"]].append((x["offset"], x["length"]))
    assert len({x["doc_id"] for x in rows}) == 6000
    assert all(a + n == b for s in map(sorted, spans.values()) for (a, n), (b, _) in zip(s, s[1:]))
    low = sorted(f for f in fill.values() if f < 62)
    assert low[0] + low[1] > 64


def test_best_fit_is_tight():
    bins, at, fills = packing.best_fit(np.array([4, 6, 5, 5, 3, 7, 10]), 10)
    assert len(fills) == 4 and fills.tolist() == [10] * 4
    assert packing.best_fit(np.array([], np.int64), 10)[2].tolist() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_reads_slices_of_large_columns(name):
    """Texts that begin inside another array's buffers give the same ids, in steps of any size."""
    r = random.Random(6)
    texts = pa.array([" ".join(r.choice(["Été", "ñandú", "the", "Thing,", "ÜBER", "x."]) for _ in range(r.randint(1, 400))) for _ in range(900)])
    encode, plain = encoding.Encoder(encoding.vocabulary_path(name)), _ids(name)
    for step in (3000, 6 << 20):
        ids, offsets = encode.encode(texts.slice(250, 600), step=step)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)][::50] == [plain(t) for t in texts.slice(250, 600).to_pylist()[::50]]
    batch = pa.RecordBatch.from_arrays([texts, pa.array(range(900))], ["text", "i"])
    parts = list(shared.small([batch], size=20_000))
    assert len(parts) > 5 and [t for p in parts for t in p.column("text").to_pylist()] == texts.to_pylist() and sum((p.column("i").to_pylist() for p in parts), []) == list(range(900))
    assert langid.pc.utf8_lower(parts[3].column("text")).to_pylist() == [t.lower() for t in parts[3].column("text").to_pylist()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_learns_words_not_pairs_around_line_ends_and_marks(name):
    """What the library encodes follows the different words, not how lines and marks put them together."""
    words = ["thing", "Été", "x1", "Σς", "it's", "ñ", "日本", "<|endoftext|>", "a\tb", "e\u0301", "don'", "yİ", "y\u0958"]
    texts = [f"{v}{m}\n{w}{m} {v}{n} {w}" for v in words for w in words for m, n in (("", "..."), ("$$$", "'"), ("|", ",***"), (").", ">"))]
    texts += ["", None, "\n", "a\r\nb", "$$$", "a\n\nb", "'s\n's", "<|endoftext|>\n<|endoftext|>$", "q'\ns"]
    encode, plain = encoding.Encoder(encoding.vocabulary_path(name)), _ids(name)
    ids, offsets = encode.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in texts]
    assert encode.known < 200


def test_workers_get_about_a_megabyte_at_a_time(spark):
    """Long texts reach Python in small batches, whatever their number of rows, and none is left out."""
    long = spark.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    got = long.transform(shared.lean).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 64 and max(r["size"] for r in got) < 3 << 19


def test_a_smaller_cache_gives_the_same_ids():
    """A worker's encoder keeps to the room it is last asked for."""
    name = "word_bpe_49k.json"
    plain, path = _ids(name), encoding.vocabulary_path(name)
    for room in (2000, 300, 2000):
        encode = encoding.encoder(path, room)
        for k in range(8):
            texts = [words(50, 100 * k + i) for i in range(4)]
            ids, offsets = encode.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in texts]
            assert len(encode.place) <= room
    assert packing.CACHED < 700_000
