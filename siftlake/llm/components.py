"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each end of an edge (a, b) the smallest node that its edges reach.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their ends, and goes on with the
    edges between different ends.  A round's tables are written to the shared folder, so lineage stays short.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hooks = stored(edges.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("from"), "to"), "hooks")
        while True:
            # The end of a hook may be hooked itself; following doubles the reach.
            over = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            moved = stored(hooks.join(over, "to", "left").select("from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = moved.select("from", "to")
            if moved.filter("moved").isEmpty():
                break

        def root_of(df: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            side = hooks.select(F.col("from").alias(column), F.col("to").alias("_to"))
            return df.join(side, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        labels = stored(root_of(labels, "root").select("node", "root"), "labels")
        ends = root_of(root_of(edges, "a"), "b")
        edges = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    return labels
