"""Comparison of two snapshots of a bill of materials, and of two lists of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.versions import version_key

# How restrictive a license is.
RESTRICTIVENESS = {
    "MIT": 1, "ISC": 1, "BSD-2-Clause": 1, "BSD-3-Clause": 1, "Apache-2.0": 2, "LGPL-2.0": 3, "LGPL-2.1": 3,
    "LGPL-3.0": 3, "GPL-2.0": 4, "GPL-3.0": 4, "AGPL-3.0": 5, "SSPL-1.0": 6, "BUSL-1.1": 6,
}


def purl_ecosystem(purl: str) -> str:
    return f"coalesce(nullif(regexp_extract({purl}, '^pkg:([^/]+)/', 1), ''), 'unknown')"


def sbom_drift(baseline: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    """Added, removed and changed components of each project.

    ``key`` is ``name``, for (ecosystem, name), or ``bom_ref``, which contains the version
    and so shows a new version as an addition and a removal.  Both sides: (project, bom_ref,
    ecosystem, name, version, license), one row per key.
    """
    keys = ["project", "ecosystem", "name"] if key == "name" else ["project", "bom_ref"]
    columns = [c for c in ("bom_ref", "ecosystem", "name", "version", "license") if c not in keys]
    b = baseline.select(*keys, F.struct(*columns).alias("b"))
    c = current.select(*keys, F.struct(*columns).alias("c"))
    joined = b.join(c, keys, "full_outer")
    name = "name" if key == "name" else "coalesce(c.name, b.name)"
    eco = "ecosystem" if key == "name" else "coalesce(c.ecosystem, b.ecosystem)"
    rank = "coalesce(CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RESTRICTIVENESS.items()) + " END, 0)"
    lower = f"{version_key('c.version')} < {version_key('b.version')}"
    stricter = f"{rank.format('c.license')} > {rank.format('b.license')}"
    changes = (
        "array_compact(array("
        "IF(b IS NULL, named_struct('change', 'added', 'severity', 'medium', 'previous', CAST(NULL AS STRING), 'current', c.version), NULL), "
        "IF(c IS NULL, named_struct('change', 'removed', 'severity', 'info', 'previous', b.version, 'current', CAST(NULL AS STRING)), NULL), "
        f"IF(b.version <> c.version, named_struct('change', 'version_changed', 'severity', IF({lower}, 'high', 'low'), 'previous', b.version, 'current', c.version), NULL), "
        f"IF(b.license <> c.license, named_struct('change', 'license_changed', 'severity', IF({stricter}, 'high', 'medium'), 'previous', b.license, 'current', c.license), NULL)))"
    )
    return joined.selectExpr("project", f"{eco} AS ecosystem", f"{name} AS name", f"inline({changes})")


def drift_report(drift: DataFrame) -> DataFrame:
    """Summary of each project's changes."""
    return drift.groupBy("project").agg(
        F.count("*").alias("total_changes"),
        *[F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "version_changed", "license_changed")],
        F.bool_or(F.col("severity").isin("critical", "high")).alias("has_high_risk_changes"),
    )


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the left side that the right side lacks, such as packages new since a scan."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def in_both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_semi")


def union_names(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct names of two tables."""
    return first.select(*keys).union(second.select(*keys)).distinct()
