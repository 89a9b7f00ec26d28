"""Shared vocabulary: severities, ecosystems, package keys and risk scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity ranks.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SEVERITIES = tuple(SEVERITY_RANK)

# Spellings of the ecosystems, by their lower-case form.
ECOSYSTEM_SPELLINGS = {
    "crates.io": "cargo", "crates": "cargo", "cargo": "cargo", "rust": "cargo",
    "pypi": "pypi", "pip": "pypi", "python": "pypi",
    "npm": "npm", "node": "npm", "javascript": "npm",
    "go": "go", "golang": "go", "maven": "maven", "nuget": "nuget",
    "gem": "gem", "rubygems": "gem",
}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small built-in table as a local relation, whose size Spark knows when it plans a join."""
    names = [f.split()[0] for f in schema.split(", ")]
    casts = [f"CAST({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in schema.split(", ")]
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {values} AS t({', '.join(names)})")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_rank(col: Column) -> Column:
    """Rank of a severity label; null for labels outside the vocabulary."""
    low = F.lower(col)
    expr = F.when(low == "critical", 4)
    for name in ("high", "medium", "low", "info"):
        expr = expr.when(low == name, SEVERITY_RANK[name])
    return expr


def severity_label(rank: Column) -> Column:
    expr = F.when(rank == 4, "critical")
    for name in ("high", "medium", "low", "info"):
        expr = expr.when(rank == SEVERITY_RANK[name], name)
    return expr


def normalize_ecosystem(col: Column) -> Column:
    low = F.lower(F.trim(col))
    return F.coalesce(F.try_element_at(literal_map(ECOSYSTEM_SPELLINGS), low), low)


def kept(*conditions_and_values) -> Column:
    """Array of the values whose condition holds: ``kept((cond, value), ...)``."""
    return F.array_compact(F.array(*[F.when(c, v) for c, v in conditions_and_values]))
