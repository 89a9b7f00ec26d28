"""Order-dependent building blocks that never put a whole key into one task.

A plain window over a key sorts all rows of the key in one task.  These functions cut each
key into buckets that follow the order, work inside the buckets, and settle the bucket
edges on one summary row per bucket.  The results are exactly those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def time_bucket(column: str, seconds: int = 3600) -> Column:
    """Number of the interval a timestamp falls in."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, edges_only: bool = False) -> DataFrame:
    """Pairs of neighbouring rows of each key, as structs ``prev`` and ``cur``.

    ``bucket`` must not decrease along the order.  With ``edges_only`` just the pairs that
    span two buckets are returned, which needs no sort of the rows at all.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, bucket.alias("_bucket"), F.struct(*order).alias("_at"), F.struct(*rest).alias("_row"))
    if edges_only:
        summary = rows.groupBy(*keys, "_bucket").agg(F.min_by("_row", "_at").alias("_first"), F.max_by("_row", "_at").alias("_last"))
        pairs = summary.select(*keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")).alias("prev"), F.col("_first").alias("cur"))
        return pairs.filter(F.col("prev").isNotNull())
    inside = W.partitionBy(*keys, "_bucket").orderBy("_at")
    local = rows.select(*keys, "_at", F.col("_row").alias("cur"), F.lag("_row").over(inside).alias("prev"), F.lead("_at").over(inside).alias("_next"))
    # The first and last row of each bucket, in order: before the first one stands the last of the bucket before.
    edges = local.filter(F.col("prev").isNull() | F.col("_next").isNull())
    across = edges.select(
        *keys, F.lag("cur").over(W.partitionBy(*keys).orderBy("_at")).alias("prev"), "cur", F.col("prev").isNull().alias("_opens"))
    return local.filter(F.col("prev").isNotNull()).select(*keys, "prev", "cur").unionByName(
        across.filter(F.col("_opens") & F.col("prev").isNotNull()).select(*keys, "prev", "cur"))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` along the order of each key, the row itself included."""
    keys, order = list(keys), list(order)
    columns = df.columns
    valued = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    totals = valued.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = valued.withColumn("_local", F.sum("_value").over(inside))
    return local.join(offsets, [*keys, "_bucket"]).select(*columns, (F.col("_local") + F.col("_before")).alias(name))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key.

    Spark limits each key to ``n`` rows before the shuffle, so a key of any size sends at
    most ``n`` rows per task.
    """
    window = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
