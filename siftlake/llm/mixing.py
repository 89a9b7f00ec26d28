"""Mixing sources to target weights with pivotal dependent rounding, in DataFrame operations only.

Each document of a source should be copied target / source size times.  The whole part of that is certain.  The
fractions are rounded in pairs: words are moved between two documents, one way or the other at random, so that the
expected copies of both stay as they are, the expected words together stay exactly as they are, and one of the two
becomes whole.  Blocks of a source are folded independently; what stays fractional in a block is an item of the next
level, up to one document per source, which is rounded at random.  A source thus misses its target by less than
one document.  Equal rows are interchangeable: as many of them as their fractions add up to get a copy, and only what is
left over is an item, with the words of one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.shared import WORD, stored, table, unit_interval

_EPS = 1e-12


def _key(item: Column) -> Column:
    return F.struct(*[item[c].alias(c) for c in ("doc_id", "size", "h")])


def _carry(ups: Column, item: Column, p: Column) -> Column:
    """The fold's state with ``item`` as the one that is still fractional, or with none where ``p`` is whole."""
    whole = p >= 1 - _EPS
    return F.struct(
        F.when(whole, F.concat(ups, F.array(_key(item)))).otherwise(ups).alias("ups"),
        item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["h"].alias("h"), item["mass"].alias("mass"),
        F.when(whole | (p <= _EPS), F.lit(0.0)).otherwise(p).alias("p"))


def _pair(seed: str, level: int):
    def step(a: Column, x: Column) -> Column:
        up_a, down_a = (1 - a["p"]) * a["mass"], a["p"] * a["mass"]
        up_x, down_x = (1 - x["p"]) * x["mass"], x["p"] * x["mass"]
        into_a, out_of_a = F.least(up_a, down_x), F.least(down_a, up_x)
        raise_a = unit_interval(_key(a), _key(x), F.lit(seed), F.lit(level)) * (into_a + out_of_a) < out_of_a
        plus_a, plus_x = (F.concat(a["ups"], F.array(_key(y))) for y in (a, x))
        return (
            F.when(a["p"] == 0, _carry(a["ups"], x, x["p"]))
            .when(raise_a & (up_a <= down_x), _carry(plus_a, x, x["p"] - into_a / x["mass"]))
            .when(raise_a, _carry(a["ups"], a, a["p"] + into_a / a["mass"]))
            .when(down_a <= up_x, _carry(a["ups"], x, x["p"] + out_of_a / x["mass"]))
            .otherwise(_carry(plus_x, a, a["p"] - out_of_a / a["mass"])))

    return step


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size, n): weights 1 .. ``cycle`` repeating by code point, null last.

    The targets share all sizes by weight, and a source stops at ``cap`` times its size.  What that leaves is shared by
    the others by weight, again and again, until none is above: all others have one rate for each unit of weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = stored(sizes.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1), "sources")
    limit = F.col("source_size") * cap
    total, weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    rate, capped = (total or 0) / weights if weights else 0.0, -1
    while True:
        above = limit <= F.col("weight") * F.lit(float(rate))
        count, full, rest = weighted.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if count == capped or not rest:
            break
        capped, rate = count, ((total or 0) - (full or 0.0)) / rest
    return weighted.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(rate))).cast("double"))


def _rounded(units: DataFrame, seed: str, cap: float, block: int) -> DataFrame:
    """Add source_size, target, certain and extra to units (source, doc_id, size, h, times): each row of a unit gets ``certain`` copies, ``extra`` of them one more."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    targets = source_targets(sizes, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = units.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s", "weight").withColumn("certain", F.floor(rate))
    whole = F.col("times") * (rate - F.floor(rate))
    rated = rated.withColumn("among", F.floor(whole + _EPS)).withColumn("p", F.greatest(whole - F.col("among"), F.lit(0.0)))

    items = rated.filter((F.col("size") > 0) & (F.col("p") > _EPS)).select(
        "source", F.pmod(F.xxhash64("doc_id", "size", "h", F.lit(seed)), F.ceil(F.col("n") / block)).alias("block"),
        F.struct(F.xxhash64("doc_id", "size", "h", F.lit(seed), F.lit(0)).alias("u"), "doc_id", "size", "h", F.col("size").cast("double").alias("mass"), "p").alias("item"))
    widest = -(-(targets.agg(F.max("n")).first()[0] or 0) // block)
    none = F.lit(None).cast("long")
    start = F.struct(
        F.array().cast("array<struct<doc_id:bigint,size:bigint,h:bigint>>").alias("ups"), none.alias("doc_id"), none.alias("size"), none.alias("h"),
        F.lit(1.0).alias("mass"), F.lit(0.0).alias("p"))
    ups, level = [], 0
    while True:
        folded = items.groupBy("source", "block").agg(F.aggregate(F.array_sort(F.collect_list("item")), start, _pair(seed, level)).alias("end"))
        last = widest <= 1
        folded = stored(folded.select("source", "block", F.col("end.ups").alias("ups"), F.struct("end.doc_id", "end.size", "end.h", "end.mass", "end.p").alias("rest")), "folded")
        ups.append(folded.select("source", F.explode("ups").alias("up")))
        rest = folded.filter(F.col("rest.p") > 0)
        if last:
            chance = unit_interval(F.col("rest.doc_id"), F.col("rest.size"), F.col("rest.h"), F.lit(seed), F.lit("last"))
            ups.append(rest.filter(chance < F.col("rest.p")).select("source", _key(F.col("rest")).alias("up")))
            break
        level += 1
        widest = -(-widest // block)
        items = rest.select("source", F.pmod(F.xxhash64("block", F.lit(level)), F.lit(widest)).alias("block"), F.struct(
            F.xxhash64("rest.doc_id", "rest.size", "rest.h", F.lit(seed), F.lit(level)).alias("u"), "rest.doc_id", "rest.size", "rest.h", "rest.mass", "rest.p").alias("item"))
    chosen = ups[0]
    for more in ups[1:]:
        chosen = chosen.unionByName(more)
    chosen = chosen.select(F.col("source").alias("s"), F.col("up.doc_id").alias("d"), F.col("up.size").alias("z"), F.col("up.h").alias("g"), F.lit(1).alias("up"))
    one = F.col("s").eqNullSafe(F.col("source")) & F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("z") == F.col("size")) & (F.col("g") == F.col("h"))
    extra = F.when(F.col("size") > 0, F.col("among") + F.coalesce("up", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rated.join(chosen, one, "left").select("source", "doc_id", "size", "h", "times", "source_size", "target", F.col("certain").cast("long").alias("certain"), extra.alias("extra"))


def _numbered(df: DataFrame, times: Column, deal: list[str], at_once: int = 1024) -> DataFrame:
    """Each row ``times`` times, with a number k from 1.  Rows with many are dealt over tasks by ``deal`` before they are written out."""
    few = df.filter(times <= at_once).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    many = df.filter(times > at_once).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / at_once)))).repartition(*deal, "_c")
    first = F.col("_c") * at_once + 1
    return few.unionByName(many.withColumn("k", F.explode(F.sequence(first, F.least(first + at_once - 1, times)))).drop("_c"))


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, same: list[str]) -> DataFrame:
    """(source, doc_id, size, h) of every row; ``h`` is the hash of the columns that equal rows share."""
    return docs.select(
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in same]).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", cap: float = 3.0, block: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source.

    ``size`` counts words (null text: 0).  Documents without words take nothing.  Rows equal in source, id and text are
    copies: their takes differ by one copy at most.  Null ids are documents like others.  The same rows give the same
    result in every run.  The list of sources is ordered in one task.
    """
    # Copies become one row with a count, before anything is dealt out: no block depends on how often a row repeats.
    units = stored(_units(docs, id_col, text_col, source_col, [text_col]).groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("times")), "units")
    rows = _numbered(_rounded(units, seed, cap, block), F.col("times"), ["doc_id", "size", "h"])
    taken = (F.col("certain") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0)) * F.col("size")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", cap: float = 3.0, block: int = 256) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; documents that it does not take go."""
    own = _units(docs, id_col, text_col, source_col, [text_col])
    units = stored(own.groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("times")), "units")
    wanted = _rounded(units, seed, cap, block).filter("size > 0 AND (certain > 0 OR extra > 0)")
    wanted = wanted.select(*[F.col(c).alias(f"_{c}") for c in ("source", "doc_id", "size", "h", "times", "certain", "extra")])
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("h") == F.col("_h"))
    key = ["_source", "_doc_id", "_size", "_h"]
    found = own.join(wanted, same).select("row", *key, "_times", "_certain", "_extra")
    single = found.filter("_times = 1").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_certain") + F.col("_extra"))).alias("k")).select("row")
    # Rows equal in all columns are taken together, one of them for all; the unit's further copies go to the first ones.
    alike = found.filter("_times > 1").withColumn("_all", F.xxhash64("row")).groupBy(*key, "_all").agg(F.first("row").alias("row"), F.count("*").alias("m"), F.first("_certain").alias("_certain"), F.first("_extra").alias("_extra"))
    before = F.sum("m").over(Window.partitionBy(*key).orderBy("_all")) - F.col("m")
    copies = F.col("_certain") * F.col("m") + F.greatest(F.lit(0).cast("long"), F.least(F.col("m"), F.col("_extra") - before))
    out = single.unionByName(_numbered(alike.withColumn("copies", copies).filter("copies > 0"), F.col("copies"), [*key, "_all"]).select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document.  Nulls, texts without words, repeated rows and ids: see ``mix``."""
    return mix(table(spark, sf_dir, "documents")).drop("source")
