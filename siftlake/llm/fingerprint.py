"""Document fingerprints: homomorphic multiset hashes, in DataFrame operations only.

The elements of a text are its paragraphs, for equality, and the sentences within them, for likeness.  Every element is
hashed to a wide vector and the vectors are added modulo powers of two.  The order of the elements does not matter, and
elements are inserted or deleted by adding or subtracting their vectors: ``combine`` adds two fingerprints.

A sentence's vector has 128 components of 0 or 1.  Centred by the number of sentences, the sums of two texts are
random projections of their multisets, so the cosine between them estimates how much the multisets share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.shared import table

LANES, _PAIR = 128, (1 << 31) | 1
_FINE = 1 << 14
#: Where phrases end.  A line end also ends a paragraph.
SENTENCE, PARAGRAPH = r"[.,;:!?\n\r]+\s*", r"[\n\r]+"


def _hashes() -> list[Column]:
    """Hashes of an element (sentence, paragraph), 0 for what it lacks, which adds nothing to any sum."""
    def of(c: str, seed: int, name: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c), F.lit(seed))).otherwise(F.lit(0)).alias(name)

    return [F.col("sentence").isNotNull().cast("long").alias("one"), of("sentence", 0, "h0"), of("sentence", 1, "h1"), of("paragraph", 100, "p0"), of("paragraph", 101, "p1")]


def _sums() -> list[Column]:
    """Sums over the elements of a group.  Two components share a long, 31 bits apart, which no text can overflow."""
    out = [F.sum("one").alias("n")]
    for half in (0, 1):
        h = F.col(f"h{half}")
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))).alias(f"v{half}_{i}") for i in range(31)]
        # The bits that the 31 shifts leave out.
        out.append(F.sum(F.shiftrightunsigned(h, 62).bitwiseAND(F.lit(1)) + F.shiftleft(F.shiftrightunsigned(h, 63), 31)).alias(f"v{half}_31"))
    return out + [F.sum(F.shiftrightunsigned(F.col(f"p{i // 2}"), 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"e{i}") for i in range(4)]


def _packed() -> Column:
    """The sums as bytes: 4 sums of paragraphs and the count modulo 2**32, the components modulo 2**16."""
    def hexed(c: Column, digits: int) -> Column:
        return F.lpad(F.hex(c.bitwiseAND(F.lit((1 << 4 * digits) - 1))), digits, "0")

    wide = [hexed(F.col(f"e{i}"), 8) for i in range(4)] + [hexed(F.col("n"), 8)]
    narrow = []
    for half in (0, 1):
        for i in range(32):
            both = F.col(f"v{half}_{i}")
            narrow.append(hexed(F.shiftleft(both.bitwiseAND(F.lit(0xFFFF)), 16) + F.shiftrightunsigned(both, 31).bitwiseAND(F.lit(0xFFFF)), 8))
    return F.unhex(F.concat(*wide, *narrow))


def fingerprint_elements(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One fingerprint ``fp`` (binary) for each row, named by ``keys``; null text counts as empty, whose sums are all zero."""
    paragraphs = rows.select(*keys, F.explode_outer(F.split(F.col(text), PARAGRAPH)).alias("paragraph"))
    elements = paragraphs.select(*keys, F.when(F.col("paragraph") != "", F.col("paragraph")).alias("paragraph")).select(
        *keys, "paragraph", F.posexplode_outer(F.split(F.col("paragraph"), SENTENCE)).alias("i", "sentence"))
    elements = elements.select(*keys, F.when(F.coalesce("i", F.lit(0)) == 0, F.col("paragraph")).alias("paragraph"), F.when(F.trim("sentence") != "", F.col("sentence")).alias("sentence"))
    return elements.select(*keys, *_hashes()).groupBy(*keys).agg(*_sums()).select(*keys, _packed().alias("fp"))


def _numbers(fp: Column, first: int, count: int, digits: int) -> Column:
    text = F.hex(fp)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(F.substring(text, i * digits + first + 1, F.lit(digits)), 16, 10).cast("long"))


def vector(fp: Column) -> Column:
    """The centred components of a fingerprint, each taken as the number nearest to 0 that it can stand for."""
    n = F.conv(F.substring(F.hex(fp), 33, 8), 16, 10).cast("long")
    return F.transform(_numbers(fp, 40, LANES, 4), lambda c: F.pmod(2 * c - n + 32768, F.lit(65536)) - 32768)


def likeness(fp: Column, other: Column, v: Column, w: Column) -> Column:
    """0 to 1: the cosine of the vectors, at least 0; 1 for equal fingerprints, 0 where just one has no direction."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)

    size = F.sqrt(dot(v, v) * dot(w, w))
    return F.when(fp == other, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(v, w) / size)))


def combine(fp: Column, other: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' elements together, or with ``sign`` -1 of the first without the second's."""
    wide = F.zip_with(_numbers(fp, 0, 5, 8), _numbers(other, 0, 5, 8), lambda a, b: F.lpad(F.hex(F.pmod(a + sign * b, F.lit(1 << 32))), 8, "0"))
    narrow = F.zip_with(_numbers(fp, 40, LANES, 4), _numbers(other, 40, LANES, 4), lambda a, b: F.lpad(F.hex(F.pmod(a + sign * b, F.lit(1 << 16))), 4, "0"))
    return F.unhex(F.concat(F.array_join(wide, ""), F.array_join(narrow, "")))


def with_next(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, text and the text of the next document by ascending id, the first one's after the last; with (part, place) naming the row.

    Rows of one id follow in a fixed order of their texts; null ids come last.  Documents are dealt out by range, and
    each part borrows the first document of the next part.  Ranges are made of equal steps of the ids: where most ids lie in one
    step, or are null, one part is larger than its share.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["none", "doc_id", "k", "text"]
    low, high, total = slim.agg(F.min("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text"))).first()
    # Ranges of ids: the ids are cut into ``_FINE`` equal steps, and steps are joined to parts of about equal size.  The
    # table of steps has a fixed size, so it can go to all.
    width = ((high or 0) - (low or 0)) // _FINE + 1
    step = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)).cast("int"), F.lit(_FINE))
    slim = slim.withColumn("none", F.col("doc_id").isNull()).withColumn("k", F.xxhash64("text")).withColumn("step", step)
    each = max(1, min(part_bytes, -(-int(total or 0) // docs.sparkSession.sparkContext.defaultParallelism)))
    sizes = slim.groupBy("step").agg(F.sum(F.octet_length("text")).alias("size"))
    steps = sizes.select("step", F.floor((F.sum("size").over(Window.orderBy("step")) - F.col("size")) / each).alias("part"))
    numbers = steps.groupBy("part").agg(F.min("step").alias("step")).select("part", F.coalesce(
        F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    ranged = slim.join(F.broadcast(steps.join(numbers, "part")), "step")
    firsts = ranged.groupBy("before").agg(F.min(F.struct(*order)).alias("row"))
    borrowed = firsts.select(F.lit(1).alias("extra"), F.col("before").alias("part"), *[F.col(f"row.{c}").alias(c) for c in order])
    rows = ranged.select(F.lit(0).alias("extra"), "part", *order).unionByName(borrowed)
    window = Window.partitionBy("part").orderBy("extra", *order)
    return rows.select("extra", "part", F.row_number().over(window).alias("place"), "doc_id", "text", F.lead("text").over(window).alias("next")).filter("extra = 0").drop("extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, with likenesses.

    One row per row.  Null text counts as empty: the fingerprint of no elements.  Rows of one id follow each other by a hash of
    their texts, null ids come last; equal texts have equal fingerprints, whatever their rows.  A table of one row is its own next.
    Other columns are not read.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next", F.lit(1), moved))
    rows = rows.select("part", "place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next")
    keys = ["part", "place", "doc_id", "n_chars", "edited_sha256"]
    texts = rows.select("part", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited", "next")).alias("which", "t"))
    prints = fingerprint_elements(texts, [*keys, "which"], "t")
    wide = prints.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == i, F.col("fp"))).alias(c) for i, c in enumerate(("fp", "edited_fp", "next_fp"))])
    wide = wide.withColumns({c: vector(F.col(f)) for c, f in (("v", "fp"), ("ve", "edited_fp"), ("vn", "next_fp"))})
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), F.col("v"), F.col("ve")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), F.col("v"), F.col("vn")).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and their likeness.  Nulls, ties and repeats: see ``fingerprints``."""
    return fingerprints(table(spark, sf_dir, "documents"))
