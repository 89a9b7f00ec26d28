"""Language identification by fusing evidence: the text, the declared markup language, the address and its host.

The text gives a likelihood for each language from hashed letter trigrams.  How far a declared language or an
address suffix can be trusted is counted: its table is P(declared | language), with languages as the text alone
sees them.  Hosts give a prior, smoothed in levels: all pages, then the site, then the host.  Log terms
add up; the language with the highest posterior is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.shared import lean, small, stored, table, unit_interval
from siftlake.llm.shingles import slices, text_bytes

BUCKETS = 1 << 16
#: What a row says about its language besides its text.
SIGNS = ("declared", "suffix", "host", "site")


def trigrams(texts: pa.Array, step: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each three bytes of lower-cased text in a row, text each belongs to), for about ``step`` bytes of text at a time.

    No trigram crosses texts, and its middle byte belongs to a letter; digits and ASCII marks count as spaces.
    """
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    for a, b in slices(offsets, step):
        part = data[offsets[a]:offsets[b]]
        if len(part) < 3:
            continue
        letter = (part >= 97) & (part <= 122) | (part >= 128)
        plain = np.where(letter, part, np.uint8(32)).astype(np.uint32)
        code = plain[:-2] << np.uint32(16) | plain[1:-1] << np.uint32(8) | plain[2:]
        bucket = (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)
        owner = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(offsets[a:b + 1]))
        keep = (owner[:-2] == owner[2:]) & letter[1:-1]
        yield bucket[keep], owner[:-2][keep]


@dataclass(frozen=True)
class TextModel:
    """Log likelihood of each trigram bucket in each language, less the mean of all languages."""

    languages: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages, float32
    #: Trigrams of one text are far from independent: from this many on, more of them add no certainty.
    certain: int = 50

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods, texts x languages; number of trigrams of each text)."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for bucket, owner in trigrams(texts):
            if len(owner):
                first = int(owner[0])
                at, size = owner - first, int(owner[-1]) - first + 1
                n[first:first + size] += np.bincount(at, minlength=size)
                for k in range(len(self.languages)):
                    sums[first:first + size, k] += np.bincount(at, self.weights[:, k][bucket], minlength=size)
        return sums * np.minimum(1, self.certain / np.maximum(n, 1))[:, None], n


def learn_text_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", limit: int = 20_000) -> TextModel:
    """Count trigrams over about ``limit`` labelled rows at most, an even sample by a hash of the id; the table's size is fixed."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, limit / max(1, docs.filter(F.col(lang_col).isNotNull()).count()))
    sample = rows.filter(unit_interval("i", F.lit("langid")) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for bucket, owner in trigrams(batch.column("text")):
                for lang in set(langs[owner[0]:owner[-1] + 1]) if len(owner) else ():
                    sums[lang] = sums.get(lang, 0) + np.bincount(bucket[langs[owner] == lang], minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "b": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = sample.select("lang", "text").transform(lean).mapInArrow(count, "lang string, b int, n bigint").groupBy("lang", "b").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    grid = np.full((BUCKETS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        grid[own["b"].to_numpy(), k] += own["n"].to_numpy()
    logs = np.log(grid / grid.sum(axis=0, keepdims=True)) if languages else grid
    return TextModel(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if languages else logs.astype(np.float32))


def identify(rows: DataFrame, model: TextModel, text: str, declared: str, suffix: str, host: str, site: str, trust: float = 20.0, floor: float = 0.9) -> DataFrame:
    """Add ``language``, ``confidence`` (its posterior), ``text_language``, ``n_trigrams`` and ``rejected`` to all columns of ``rows``.

    ``declared`` and ``suffix`` name string columns with a language each, ``host`` and ``site`` columns with a host and the
    site it belongs to; null stands for no evidence.  ``trust`` is the weight of a level's parent in the prior, in rows.
    Rejected, with language null, is a row without one letter trigram, or one whose posterior is under ``floor``.
    """
    languages = model.languages
    if not languages:
        return rows.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "text_language": F.lit(None).cast("string"), "n_trigrams": F.lit(0).cast("long"), "rejected": F.lit(True)})

    # Columns go on under names of their own, whatever they are called outside.
    fields = rows.schema.fields
    own = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]
    signs = [F.col(c).cast("string").alias(name) for name, c in (("declared", declared), ("suffix", suffix), ("host", host), ("site", site))]
    inner = rows.select(*own, *signs, F.col(text).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores, n = model.scores(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, len(languages), dtype=np.int32)), pa.array(scores.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(n.astype(np.int64))], [*batch.schema.names[:-1], "s", "n"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), *(f"{c} string" for c in SIGNS), "s array<double>", "n bigint"])
    seen = inner.transform(lean).mapInArrow(scan, schema)
    evidence = rows.select(F.col(text).cast("string").alias("text"), *signs)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores, n = model.scores(batch.column("text"))
            best = pa.array(np.where(n > 0, scores.argmax(axis=1), -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([best, *batch.columns[1:]], ["best", *SIGNS])

    # Counts by (language, declared, suffix, host, site): made within each task before anything is shuffled, and written once.
    looked = evidence.transform(lean).mapInArrow(first_look, ", ".join(["best int", *(f"{c} string" for c in SIGNS)]))
    tally = stored(looked.groupBy("best", *SIGNS).agg(F.count("*").alias("n")), "tally")
    fused = _fuse(seen, tally, languages, trust, floor)
    return fused.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)], "language", "confidence", "text_language", "n_trigrams", "rejected")


def _by_language(key: str, tally: DataFrame, n_languages: int) -> DataFrame:
    """One row per key with its counts of each language, in their order."""
    return tally.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(F.lit(0))).cast("double") for k in range(n_languages)]).alias("c"))


def _look_up(rows: DataFrame, key: str, side: DataFrame) -> DataFrame:
    """Left join on a key; rows without it match nothing and are spread by the rest of their keys."""
    spread = F.concat(F.lit("\0"), F.xxhash64(*SIGNS).cast("string"))
    return rows.withColumn("_key", F.coalesce(F.col(key), spread)).join(side.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def _fuse(seen: DataFrame, tally: DataFrame, languages: tuple[str, ...], trust: float, floor: float) -> DataFrame:
    """Posteriors of all rows.  Evidence is put together for the different combinations of signs, without any text, and joined to the rows once."""
    size = len(languages)
    total = tally.agg(*[F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(F.lit(0))) for k in range(size)]).first()
    all_rows = np.array([float(x or 0) for x in total]) + 1.0
    base = all_rows / all_rows.sum()
    everyone = F.array(*[F.lit(float(x)) for x in base])
    zero = F.array(*[F.lit(0.0)] * size)

    def smooth(counts: Column, parent: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + trust * p) / (n + trust))

    sites = _by_language("site", tally, size).select("site", smooth(F.col("c"), everyone).alias("_site_p"))
    hosts = _by_language("host", tally, size).select("host", F.col("c").alias("_host_c"))
    # P(value | language) up to a factor that all languages share: a value seen as often as chance has it says nothing.
    trust_of = {name: _by_language(name, tally, size).select(name, F.zip_with(smooth(F.col("c"), everyone), everyone, lambda c, p: F.log(c) - F.log(p)).alias(f"_{name}_w")) for name in ("declared", "suffix")}
    some = F.coalesce(*SIGNS).isNotNull()
    combined = tally.filter(some).select(*SIGNS).distinct()
    for key, side in (("site", sites), ("host", hosts), ("declared", trust_of["declared"]), ("suffix", trust_of["suffix"])):
        combined = _look_up(combined, key, side)
    prior = smooth(F.coalesce("_host_c", zero), F.coalesce("_site_p", everyone))
    weight = F.zip_with(F.zip_with(F.transform(prior, lambda p: F.log(p)), F.coalesce("_declared_w", zero), lambda a, b: a + b), F.coalesce("_suffix_w", zero), lambda a, b: a + b)
    known = stored(combined.select(F.xxhash64(*SIGNS).alias("_k"), *[F.col(c).alias(f"_{c}") for c in SIGNS], weight.alias("_e")), "evidence")
    # Rows without any sign match nothing; the hash of their scores spreads them.
    left = seen.withColumn("_k", F.when(some, F.xxhash64(*SIGNS)).otherwise(F.xxhash64("s", "n")))
    same = [left["_k"] == known["_k"], *(left[c].eqNullSafe(known[f"_{c}"]) for c in SIGNS)]
    out = left.join(known, same, "left")
    alone = F.array(*[F.lit(float(x)) for x in np.log(base)])
    out = out.withColumn("_l", F.zip_with(F.coalesce("_e", alone), F.col("s"), lambda a, b: a + b)).withColumn("_m", F.array_max("_l"))
    names = F.array(*[F.lit(x) for x in languages])
    confidence = 1 / F.aggregate(F.transform("_l", lambda x: F.exp(x - F.col("_m"))), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("confidence", confidence).withColumn("rejected", (F.col("n") == 0) | (F.col("confidence") < floor))
    return out.select(
        *[c for c in seen.columns if c[0] == "c"],
        F.when(~F.col("rejected"), F.element_at(names, F.array_position("_l", F.col("_m")).cast("int"))).alias("language"), "confidence",
        F.when(F.col("n") > 0, F.element_at(names, F.array_position("s", F.array_max("s")).cast("int"))).alias("text_language"), F.col("n").alias("n_trigrams"), "rejected")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages with their visible text, the language their markup declares, the language their address names, host and site."""
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([a-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)
    ending = F.regexp_extract(host, r"\.([a-z]{2})$", 1)

    def some(c: Column) -> Column:
        return F.when(c != "", F.lower(c))

    return pages.select(
        F.col("page_id"), visible.alias("text"), some(declared).alias("declared"), F.coalesce(some(segment), some(ending)).alias("suffix"),
        some(host).alias("host"), some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("site"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, language, confidence, text_language, declared, suffix, n_trigrams, rejected."""
    model = learn_text_model(table(spark, sf_dir, "documents"))
    found = identify(page_evidence(table(spark, sf_dir, "pages")), model, "text", "declared", "suffix", "host", "site")
    return found.select("page_id", "language", "confidence", "text_language", "declared", "suffix", "n_trigrams", "rejected")


def keep_identified(docs: DataFrame, model: TextModel) -> DataFrame:
    """Documents whose language is identified, with their own columns: ``lang`` is what they declare and ``source`` their host.

    Without any labelled row there is no model, nothing is known and all documents stay.
    """
    if not model.languages:
        return docs
    marked = docs.withColumn("_none", F.lit(None).cast("string"))
    return identify(marked, model, "text", "lang", "_none", "source", "_none").filter(~F.col("rejected")).select(*docs.columns)
