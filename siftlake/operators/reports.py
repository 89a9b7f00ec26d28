"""Crowd reports of packages that do not exist: folding, scoring, confirmation and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["ecosystem", "package_name"]

# Report count and risk by persistence tier.
PERSISTENCE = {"high": (500, 0.85), "medium": (200, 0.65), "low": (50, 0.40)}
# Weights of the report types; any other type weighs a half.
REPORT_WEIGHTS = {"HALLUCINATION": 1.0, "TYPOSQUAT": 0.8, "MALICIOUS": 1.2, "FALSE_POSITIVE": -1.0}
AUTO_CONFIRM = 3
_CONFIRMED = (
    f"status = 'SUSPECTED' AND report_count >= {AUTO_CONFIRM} AND hallucination_reports >= {AUTO_CONFIRM} "
    "AND hallucination_reports > 3 * false_positive_reports"
)


def risk_score(confirmed: str, reports: str, first: str, last: str, claimed: str) -> str:
    """SQL text: half for confirmation, up to three tenths for reports, two tenths for persistence.

    A claimed package is certain; a single report has a value of its own.
    """
    return (
        f"CASE WHEN {claimed} THEN 1.0D WHEN {reports} = 1 THEN IF({confirmed}, 0.9D, 0.5D) ELSE least(1.0D, IF({confirmed}, 0.5D, 0D) + least({reports} / 100D, 0.3D) + "
        f"IF({last} > {first} + INTERVAL 7 DAYS AND {reports} > 5, 0.2D, 0D)) END"
    )


#: Columns that describe a package by one of its reports.
DESCRIPTIVE = ("model", "ide", "agent", "interaction")


def fold_reports(reports: DataFrame, merge_policy: str = "last", with_order: bool = False) -> DataFrame:
    """Append-only reports to one row per package.

    ``merge_policy`` says whether the first or the last known value of the descriptive
    columns wins.  Every aggregate combines partially, so a package with very many reports
    is reduced before the shuffle.  ``with_order`` adds the place of each such value in time,
    which :func:`merge_snapshots` needs.
    """
    pick, end = {"first": (F.min_by, F.min), "last": (F.max_by, F.max)}[merge_policy]

    def known(column: str) -> list:
        order = F.when(F.col(column).isNotNull(), F.struct("created_at", "report_id"))
        return [pick(column, order).alias(column), *([end(order).alias(f"{column}_order")] if with_order else [])]

    folded = reports.groupBy(*KEYS).agg(
        F.count("*").alias("report_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.bool_or("confirmed_nonexistent").alias("confirmed"), *[k for c in DESCRIPTIVE for k in known(c)],
    )
    return folded.withColumn("risk_score", F.expr(risk_score("confirmed", "report_count", "first_seen", "last_seen", "false")))


def merge_snapshots(stored: DataFrame, incoming: DataFrame, merge_policy: str = "last") -> DataFrame:
    """Keyed upsert as a new snapshot: counts add up, times widen, flags join, known values survive.

    Both sides have the columns of :func:`fold_reports` with its order and ``claimed``.  Every descriptive value carries the
    time and id of its own report, so the result equals folding all reports at once, in whatever order batches come.
    """
    pick, end = {"first": (F.min_by, F.min), "last": (F.max_by, F.max)}[merge_policy]
    both = stored.unionByName(incoming)

    merged = both.groupBy(*KEYS).agg(
        F.sum("report_count").alias("report_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.bool_or("confirmed").alias("confirmed"), F.bool_or("claimed").alias("claimed"),
        *[k for c in DESCRIPTIVE for k in (pick(c, f"{c}_order").alias(c), end(f"{c}_order").alias(f"{c}_order"))],
    )
    return merged.withColumn("risk_score", F.expr(risk_score("confirmed", "report_count", "first_seen", "last_seen", "claimed")))


def load_seeds(seeds: DataFrame, stored: DataFrame, as_of: str) -> DataFrame:
    """Snapshot after a research list was loaded: the greater count and risk win, and each row says what happened.

    ``seeds``: (ecosystem, package_name, persistence, attacked); ``stored``: (ecosystem,
    package_name, report_count, risk_score, attacked, first_seen, last_seen).
    """
    count = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in PERSISTENCE.items())
    risk = " ".join(f"WHEN '{k}' THEN {v[1]}D" for k, v in PERSISTENCE.items())
    new = seeds.selectExpr(
        *KEYS, f"CAST(CASE persistence {count} END AS BIGINT) AS _n", f"CASE persistence {risk} END AS _r",
        "attacked AS _a", "persistence",
    ).groupBy(*KEYS).agg(F.max("_n").alias("_n"), F.max("_r").alias("_r"), F.bool_or("_a").alias("_a"), F.max_by("persistence", "_n").alias("persistence"))
    joined = stored.join(new, KEYS, "full_outer")
    return joined.selectExpr(
        *KEYS, "greatest(report_count, _n) AS report_count", "greatest(risk_score, _r) AS risk_score",
        "coalesce(attacked, false) OR coalesce(_a, false) AS attacked", "persistence",
        f"coalesce(first_seen, {as_of} - INTERVAL 90 DAYS) AS first_seen",
        f"IF(_n IS NULL, last_seen, {as_of}) AS last_seen",
        "CASE WHEN _n IS NULL THEN 'kept' WHEN report_count IS NULL THEN 'imported' ELSE 'updated' END AS action",
    )


def merge_outcomes(merged: DataFrame) -> DataFrame:
    """Imported and updated rows of a load, by ecosystem, and how many are highly persistent."""
    return merged.groupBy("ecosystem").agg(
        F.count_if(F.col("action") == "imported").alias("imported"), F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if((F.col("persistence") == "high") & (F.col("action") != "kept")).alias("high_persistence"),
    )


#: What is added up over the reports of a package.
SUMS = ("report_count", "hallucination_reports", "false_positive_reports", "confidence_sum", "weight_sum")
_CONFIDENCE = "greatest(0D, least(1D, confidence_sum / weight_sum))"


def report_sums(reports: DataFrame) -> DataFrame:
    """The sums that confidence and confirmation follow from, with the last report's time."""
    weight = "CASE report_type " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in REPORT_WEIGHTS.items()) + " ELSE 0.5D END"
    return reports.selectExpr("*", f"{weight} AS _w").groupBy(*KEYS).agg(
        F.count("*").alias("report_count"),
        F.count_if(F.col("report_type") == "HALLUCINATION").alias("hallucination_reports"),
        F.count_if(F.col("report_type") == "FALSE_POSITIVE").alias("false_positive_reports"),
        F.sum(F.col("confidence") * F.col("_w")).alias("confidence_sum"), F.sum(F.abs("_w")).alias("weight_sum"),
        *([F.max("created_at").alias("last_seen")] if "created_at" in reports.columns else []),
    )


def report_confidence(reports: DataFrame) -> DataFrame:
    """Weighted confidence and counts by type of each package, in one aggregate."""
    return report_sums(reports).select(*KEYS, *SUMS[:3], F.expr(_CONFIDENCE).alias("confidence"))


def consolidate(packages: DataFrame, reports: DataFrame, as_of: str) -> DataFrame:
    """Packages with recounted reports and confidence; suspected ones with enough reports are confirmed."""
    joined = packages.drop("report_count").join(report_confidence(reports), KEYS, "left")
    confirmed = _CONFIRMED
    return joined.selectExpr(
        *KEYS, "coalesce(report_count, 0) AS report_count", "coalesce(confidence, 0.5D) AS confidence",
        f"coalesce({confirmed}, false) AS auto_confirmed", f"IF(coalesce({confirmed}, false), 'CONFIRMED', status) AS status",
        f"IF(coalesce({confirmed}, false), {as_of}, verified_at) AS verified_at", "last_seen",
    )


def consolidate_batch(packages: DataFrame | None, batch: DataFrame, as_of: str) -> DataFrame:
    """Packages after one more batch of reports: sums by type add up, and status and confidence follow from them.

    ``packages`` is the result of the batch before, or (``KEYS``, status, verified_at, last_seen) with any of ``SUMS`` at the
    beginning, or None.  Applied batch after batch, counts and confidence
    equal those of :func:`consolidate` over all reports; a package confirmed on the way stays confirmed.
    """
    new = report_sums(batch)
    if packages is None:
        packages = new.selectExpr(*KEYS, "'SUSPECTED' AS status", "CAST(NULL AS TIMESTAMP) AS verified_at", "last_seen").limit(0)
    have = packages.selectExpr(*KEYS, "status", "verified_at", "last_seen AS _seen", *[f"{c} AS _{c}" if c in packages.columns else f"CAST(NULL AS DOUBLE) AS _{c}" for c in SUMS])
    added = {c: f"coalesce(_{c}, 0) + coalesce({c}, 0)" for c in SUMS}
    joined = have.join(new, KEYS, "full_outer").selectExpr(
        *KEYS, "coalesce(status, 'SUSPECTED') AS status", "verified_at", "greatest(_seen, last_seen) AS last_seen",
        *[f"CAST({e} AS {'BIGINT' if c in SUMS[:3] else 'DOUBLE'}) AS {c}" for c, e in added.items()])
    return joined.selectExpr(
        *KEYS, *SUMS, f"IF(weight_sum > 0, {_CONFIDENCE}, 0.5D) AS confidence", f"coalesce({_CONFIRMED}, false) AS auto_confirmed",
        f"IF(coalesce({_CONFIRMED}, false), 'CONFIRMED', status) AS status", f"IF(coalesce({_CONFIRMED}, false), {as_of}, verified_at) AS verified_at", "last_seen")


def expire_stale(packages: DataFrame, as_of: str) -> DataFrame:
    """Drop suspected packages with fewer than two reports that were not seen for ninety days."""
    return packages.filter(
        f"NOT (status = 'SUSPECTED' AND report_count < 2 AND last_seen < {as_of} - INTERVAL 90 DAYS)"
    )


def decay(packages: DataFrame, as_of: str) -> DataFrame:
    """Confirmed packages with few reports and no recent verification go back to suspected."""
    due = f"status = 'CONFIRMED' AND report_count < 3 AND verified_at < {as_of} - INTERVAL 30 DAYS"
    return packages.withColumn("status", F.expr(f"IF(coalesce({due}, false), 'SUSPECTED', status)"))


def verify_entries(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Outcome of looking each package up in a registry snapshot; only npm and PyPI can be looked up."""
    listed = registry.select("ecosystem", F.col("name").alias("package_name")).distinct().withColumn("_found", F.lit(True))
    joined = packages.join(listed, KEYS, "left")
    checkable = "ecosystem IN ('npm', 'pypi')"
    return joined.selectExpr(
        *packages.columns,
        f"CASE WHEN NOT {checkable} THEN 'inconclusive' WHEN _found THEN 'false-positive' "
        "WHEN status = 'SUSPECTED' THEN 'confirmed' ELSE 'unchanged' END AS outcome",
        f"CASE WHEN NOT {checkable} THEN status WHEN _found THEN 'FALSE_POSITIVE' ELSE "
        "IF(status = 'SUSPECTED', 'CONFIRMED', status) END AS new_status",
    )


def recheck_candidates(packages: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """Confirmed packages not checked for an hour, the most reported first."""
    due = packages.filter(
        f"confirmed AND NOT claimed AND (last_checked IS NULL OR last_checked < {as_of} - INTERVAL 60 MINUTES)"
    )
    ordered = due.orderBy(F.col("report_count").desc(), F.col("risk_score").desc(), *KEYS)
    return ordered if limit is None else ordered.limit(limit)


def claimed_packages(packages: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """Confirmed packages that a registry now has: alert rows with the publication's data."""
    due = packages.filter(
        f"confirmed AND NOT claimed AND (last_checked IS NULL OR last_checked < {as_of} - INTERVAL 60 MINUTES)"
    )
    found = registry.select(
        "ecosystem", F.col("name").alias("package_name"), F.col("created_at").alias("registered_at"), "publisher",
        F.col("latest").alias("version"), "weekly_downloads", "has_install_scripts",
    )
    return due.join(found, KEYS).select(
        *KEYS, F.lit("attack_detected").alias("event_type"), "registered_at", "publisher", "version", "weekly_downloads",
        "has_install_scripts", F.col("report_count").alias("previous_report_count"), F.lit(1.0).alias("risk_score"),
    )


def page(packages: DataFrame, number: int, size: int, status: str | None = None, ecosystem: str | None = None) -> DataFrame:
    """A page of the most reported packages."""
    kept = packages
    if status is not None:
        kept = kept.filter(F.col("status") == status.upper())
    if ecosystem is not None:
        kept = kept.filter(F.col("ecosystem") == ecosystem.lower())
    return kept.orderBy(F.col("report_count").desc(), *KEYS).offset((number - 1) * size).limit(size)
