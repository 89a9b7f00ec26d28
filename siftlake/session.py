"""Session defaults and small physical-layout helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


def session(app: str = "siftlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects.  On a cluster, leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows that one task of a spread table takes at most, if they are dealt out evenly: a task's memory does not grow with the table.
ROWS_A_TASK = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core when a table arrives in fewer splits than there are cores, and more tasks where splits hold very many rows.

    A table with enough splits of few enough rows passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // ROWS_A_TASK))
    if df.rdd.getNumPartitions() >= max(2 * cores, tasks):
        return df
    return df.repartition(tasks, *keys)


#: Tasks that list folders for each core, and bytes that a file counts as in a task besides its own.
_LISTING_A_CORE, _FILE_BYTES = 4, 64 << 10


def read_small_files(spark: SparkSession, read: Callable[[DataFrameReader], DataFrame]) -> DataFrame:
    """What ``read`` opens with a reader that suits very many small files; larger files are dealt out as ever.

    Folders are listed by some tasks for each core and not by one task each, up to 10,000 a level, and a task reads some thousand
    files and not 32 of them.  Spark takes both from the session that a file table belongs to, so that one is a copy of the caller's.
    """
    own = spark._jsparkSession.cloneSession()
    conf = own.sessionState().conf()
    most = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": _LISTING_A_CORE * spark.sparkContext.defaultParallelism, "spark.sql.files.openCostInBytes": _FILE_BYTES}
    for (name, value), now in zip(most.items(), (conf.parallelPartitionDiscoveryParallelism(), conf.filesOpenCostInBytes()), strict=True):
        own.conf().set(name, str(min(value, now)))
    reader = DataFrameReader(spark)
    reader._jreader = own.read()
    plan = read(reader)._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by its key and never sent through the driver.

    Spark sizes rows made from one row, as lines of a text, by the row they came from, and broadcasts what is many times larger.
    """
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder of the cluster.

    The folder is the one named by ``spark.checkpoint.dir``; only where that is unset, as
    in tests, a folder of this machine is chosen.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(configured or os.path.join(tempfile.mkdtemp(prefix="siftlake-"), "checkpoints"))
    return df.checkpoint(eager=True)
