"""Security scores of projects and their trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.sequences import last_per_key

# Points a signal takes, by category and severity.
DEDUCTIONS = {
    "dependency": {"critical": 20, "high": 10, "medium": 5, "low": 2},
    "secret": {"critical": 25, "high": 15, "medium": 8, "low": 3},
    "code": {"critical": 15, "high": 8, "medium": 4, "low": 1},
    "provenance": {"critical": 10, "high": 5, "medium": 2, "low": 1},
    "hallucination": {"critical": 20, "high": 12, "medium": 6, "low": 2},
    "sbom": {"critical": 5, "high": 3, "medium": 1, "low": 0},
}


def security_score(signals: DataFrame) -> DataFrame:
    """Score, grade and sub-scores of each project from (project, category, severity, count) rows.

    Every deduction is at least zero, so clamping the sum equals clamping after each step.
    """
    table = " ".join(f"WHEN category = '{c}' AND severity = '{s}' THEN {p}" for c, row in DEDUCTIONS.items() for s, p in row.items())
    points = signals.withColumn("_points", F.expr(f"coalesce(CASE {table} END, 0) * least(count, 5)"))

    def part(*categories: str):
        return F.sum(F.when(F.col("category").isin(*categories), F.col("_points")).otherwise(0))

    sums = points.groupBy("project").agg(
        F.sum("_points").alias("_all"), part("dependency", "hallucination").alias("_dep"), part("secret").alias("_sec"),
        part("code").alias("_code"), part("provenance").alias("_prov"),
    )
    scored = sums.selectExpr(
        "project", "CAST(greatest(0, 100 - _all) AS INT) AS score",
        *[f"CAST(floor(greatest(0D, 100D - {c} * {f}D) + 0.5D) AS INT) AS {n}" for c, f, n in (
            ("_dep", 1.5, "dependencies_score"), ("_sec", 2.0, "secrets_score"), ("_code", 1.2, "code_score"), ("_prov", 1.0, "provenance_score"))],
    )
    return scored.withColumn("grade", F.expr(
        "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"))


def score_trend(snapshots: DataFrame) -> DataFrame:
    """Mean of the last five scores against the five before them, by project."""
    last = last_per_key(snapshots, ["project"], ["ts", "snapshot_id"], 10)
    means = last.groupBy("project").agg(
        F.avg(F.when(F.col("_rank") <= 5, F.col("score"))).alias("recent"),
        F.avg(F.when(F.col("_rank") > 5, F.col("score"))).alias("previous"),
    )
    return means.withColumn("trend", F.expr(
        "CASE WHEN previous IS NULL THEN 'stable' WHEN recent - previous > 3 THEN 'improving' "
        "WHEN recent - previous < -3 THEN 'declining' ELSE 'stable' END"))


def keep_last(snapshots: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` snapshots of every project."""
    return last_per_key(snapshots, ["project"], ["ts", "snapshot_id"], n).drop("_rank")
