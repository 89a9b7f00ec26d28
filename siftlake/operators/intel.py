"""Package intelligence: existence, reputation, trust scores and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.advisories import vulnerability_counts
from siftlake.vocab import local_table, normalize_ecosystem, severity_label, severity_rank

# Packages that belong to one ecosystem and are mistaken for another's.
HOME_ECOSYSTEM = {
    **dict.fromkeys(("beautifulsoup4", "scikit-learn", "sklearn", "numpy", "pandas", "scipy", "matplotlib",
                     "tensorflow", "pytorch", "flask", "django", "fastapi", "uvicorn", "gunicorn", "celery",
                     "sqlalchemy", "pydantic", "pytest"), "pypi"),
    **dict.fromkeys(("react", "react-dom", "next", "vue", "angular", "svelte", "express", "webpack", "vite",
                     "tailwindcss", "jquery", "electron"), "npm"),
}
# A small default list of names that assistants invent; pass a table for the whole list.
KNOWN_INVENTED = {
    "npm": ("ai-super-helper-utils-9999", "easy-auth-optimizer", "iot-protocol-turbo-v3",
            "react-native-super-navigation", "react-super-forms", "react-ai-components", "react-smart-table-pro",
            "next-ai-middleware", "express-ai-router", "node-ai-utils", "vue-ai-components"),
}


def home_ecosystems(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(HOME_ECOSYSTEM.items()), "name string, correct_ecosystem string")


def known_invented(spark: SparkSession) -> DataFrame:
    rows = [(eco, n) for eco, names in KNOWN_INVENTED.items() for n in names]
    return local_table(spark, rows, "ecosystem string, name string")


def _keyed(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("_eco", normalize_ecosystem(F.col("ecosystem"))).withColumn("_name", F.lower(name))


def _lookup(df: DataFrame, columns: list[str], name: str = "name") -> DataFrame:
    return _keyed(df, name).select("_eco", "_name", *columns)


def flag_known(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds whether the package is on a list of packages known not to exist."""
    listed = _lookup(known, []).distinct().withColumn("_listed", F.lit(True))
    joined = _keyed(refs).join(listed, ["_eco", "_name"], "left")
    return joined.select(*refs.columns, F.coalesce("_listed", F.lit(False)).alias("known_hallucination"))


def missing_from_registry(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """References to packages that no registry snapshot row has."""
    return _keyed(refs).join(_lookup(registry, []), ["_eco", "_name"], "left_anti").select(*refs.columns)


def namespace_confusion(refs: DataFrame, homes: DataFrame) -> DataFrame:
    """References that use a package of another ecosystem."""
    home = homes.select(F.lower("name").alias("_name"), "correct_ecosystem")
    joined = _keyed(refs).join(home, "_name")
    return joined.filter(F.col("_eco") != F.col("correct_ecosystem")).select(*refs.columns, "correct_ecosystem")


def risk_level(refs: DataFrame) -> DataFrame:
    """Risk ladder over existence, age, popularity, look-alike and namespace signals."""
    return refs.withColumn("risk_level", F.expr(
        "CASE WHEN NOT exists_in_registry THEN 'critical' WHEN recently_registered AND low_popularity THEN 'high' "
        "WHEN recently_registered THEN 'medium' WHEN low_popularity THEN 'low' "
        "WHEN suggestion IS NOT NULL THEN 'medium' WHEN namespace_confusion THEN 'low' ELSE 'none' END"
    ))


def popularity_signals(refs: DataFrame, as_of: str) -> DataFrame:
    """Low popularity and recent registration; both are only known for npm."""
    npm = F.col("ecosystem") == "npm"
    return refs.select(
        "*", (npm & F.coalesce(F.col("weekly_downloads") < 100, F.lit(False))).alias("low_popularity"),
        (npm & F.coalesce(F.expr(f"created_at > {as_of} - INTERVAL 30 DAYS"), F.lit(False))).alias("recently_registered"),
    )


def provenance_tier(packages: DataFrame) -> DataFrame:
    return packages.withColumn("provenance_tier", F.expr(
        "CASE WHEN NOT exists_in_registry OR known_hallucination OR malware_flagged THEN 'untrusted' "
        "WHEN provenance_verified AND coalesce(weekly_downloads > 100, false) THEN 'verified' "
        "WHEN provenance_verified THEN 'partial' "
        "WHEN coalesce(weekly_downloads < 100, false) AND recently_registered THEN 'suspicious' "
        "WHEN coalesce(weekly_downloads < 500, false) THEN 'suspicious' ELSE 'partial' END"
    ))


def _points(column: str, *steps: tuple[int, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {low} THEN {n}" for low, n in steps) + " ELSE 0 END"


def trust_score(signals: DataFrame) -> DataFrame:
    """Composite score of 0 to 100 with sub-scores, tier and reasons.

    A signal that is null is not scored, which differs from one that is false or zero.
    """
    provenance = "least(25, IF(provenance_verified, 15, 0) + IF(slsa_level IS NULL, 0, least(slsa_level * 3, 6)) + IF(verified_publisher, 4, 0))"
    # Thresholds and points.
    popularity = (
        f"greatest(0, least(25, {_points('weekly_downloads', (1000000, 15), (100000, 12), (10000, 8), (1000, 5), (100, 2))} + "
        f"{_points('github_stars', (10000, 5), (1000, 3), (100, 1))} + IF(has_repository, 2, 0) - "
        "IF(download_velocity = 'spike', 3, 0)))"
    )
    maturity = (
        f"greatest(0, least(20, {_points('publisher_age_days', (365, 8), (90, 5), (30, 2))} + "
        f"{_points('package_age_days', (365, 5), (90, 3))} + {_points('total_versions', (20, 4), (5, 2))} - "
        "IF(recent_ownership_change, 5, 0) - IF(version_spike, 3, 0)))"
    )
    security = (
        "greatest(0, 20 - CASE WHEN coalesce(vulnerability_count, 0) <= 0 THEN 0 WHEN highest_severity = 'critical' THEN 15 "
        "WHEN highest_severity = 'high' THEN 10 ELSE 5 END)"
    )
    quality = (
        "greatest(0, 10 - IF(has_install_scripts, 3, 0) - IF(suspicious_scripts, 7, 0) - "
        "IF(coalesce(typosquat_distance <= 2, false), 5, 0))"
    )
    barred = "(coalesce(malware_flagged, false) OR coalesce(known_hallucination, false) OR coalesce(NOT registry_exists, false))"
    reasons = ", ".join(f"CASE WHEN {condition} THEN '{text}' END" for condition, text in (
        ("coalesce(malware_flagged, false)", "flagged as malware"),
        ("NOT coalesce(malware_flagged, false) AND coalesce(known_hallucination, false)", "known not to exist"),
        ("NOT coalesce(malware_flagged, false) AND NOT coalesce(known_hallucination, false) AND coalesce(NOT registry_exists, false)", "not in the registry"),
        (f"NOT {barred} AND coalesce(provenance_verified, false)", "provenance verified"),
        (f"NOT {barred} AND NOT coalesce(provenance_verified, false)", "no provenance attestation"),
        (f"NOT {barred} AND coalesce(verified_publisher, false)", "publisher verified"),
        (f"NOT {barred} AND coalesce(weekly_downloads < 100, false)", "very few downloads"),
        (f"NOT {barred} AND NOT coalesce(has_repository, false)", "no source repository"),
        (f"NOT {barred} AND download_velocity = 'spike'", "download spike"),
        (f"NOT {barred} AND coalesce(publisher_age_days < 30, false)", "recent publisher"),
        (f"NOT {barred} AND coalesce(package_age_days < 30, false)", "very new package"),
        (f"NOT {barred} AND coalesce(total_versions <= 1, false)", "one version only"),
        (f"NOT {barred} AND coalesce(recent_ownership_change, false)", "ownership change"),
        (f"NOT {barred} AND coalesce(version_spike, false)", "version spike"),
        (f"NOT {barred} AND coalesce(vulnerability_count, 0) > 0", "known vulnerabilities"),
        (f"NOT {barred} AND coalesce(has_install_scripts, false)", "install scripts"),
        (f"NOT {barred} AND coalesce(suspicious_scripts, false)", "suspicious install scripts"),
        (f"NOT {barred} AND coalesce(typosquat_distance <= 2, false)", "name close to a popular package"),
    ))
    parts = {"provenance": provenance, "popularity": popularity, "maturity": maturity, "security": security, "code_quality": quality}
    scored = signals.selectExpr(
        "*", *[f"CAST(IF({barred}, 0, {e}) AS INT) AS {n}_score" for n, e in parts.items()],
        f"array_compact(array({reasons})) AS reasons",
    )
    total = " + ".join(f"{n}_score" for n in parts)
    return scored.withColumn("trust_score", F.expr(f"greatest(0, least(100, {total}))")).withColumn(
        "trust_tier", F.expr("CASE WHEN trust_score >= 80 THEN 'verified' WHEN trust_score >= 50 THEN 'partial' "
                             "WHEN trust_score >= 25 THEN 'suspicious' ELSE 'untrusted' END")
    )


# Order of the tiers, worst first.
TIER_ORDER = {"untrusted": 0, "suspicious": 1, "partial": 2, "verified": 3}


def trust_tier_counts(packages: DataFrame) -> DataFrame:
    return packages.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("trust_tier") == t).alias(t) for t in ("verified", "partial", "suspicious", "untrusted")],
        F.count_if(F.coalesce("vulnerability_count", F.lit(0)) > 0).alias("vulnerable"),
    )


def bulk_check(packages: DataFrame, hallucinations: DataFrame, trust: DataFrame) -> DataFrame:
    """Verdict row of each package; the two keyed lookups replace a query per package."""
    h = _lookup(hallucinations, ["confirmed"], "package_name")
    t = _lookup(trust, ["trust_score", "trust_tier", "vulnerability_count", "highest_severity"], "package_name")
    joined = _keyed(packages).join(h, ["_eco", "_name"], "left").join(t, ["_eco", "_name"], "left")
    return joined.select(
        *packages.columns,
        (~F.coalesce("confirmed", F.lit(False))).alias("exists"),
        F.coalesce("trust_score", F.lit(50)).alias("trust_score"),
        F.coalesce("trust_tier", F.lit("partial")).alias("trust_tier"),
        F.coalesce("confirmed", F.lit(False)).alias("hallucination"),
        (F.coalesce("vulnerability_count", F.lit(0)) > 0).alias("vulnerable"),
        "highest_severity",
    )


def package_intelligence(packages: DataFrame, hallucinations: DataFrame, trust: DataFrame,
                         vulnerabilities: DataFrame) -> DataFrame:
    """Everything known of each package; advisories are aggregated per package before they join."""
    h = _lookup(hallucinations, ["confirmed", "report_count", "risk_score", "first_seen"], "package_name")
    t = _lookup(trust, ["trust_score", "provenance_verified", "publisher_age_days", "has_install_scripts",
                        "download_velocity", "weekly_downloads"], "package_name")
    # Distinct versions first, so that the set of each package is built from partial sets.
    v = _keyed(vulnerabilities, "package_name").groupBy("_eco", "_name").agg(
        F.count("*").alias("_vulns"), severity_label(F.max(severity_rank(F.col("severity")))).alias("highest_severity"),
        F.array_sort(F.collect_set("fixed_version")).alias("patched_versions"),
    )
    joined = _keyed(packages)
    for side in (h, t, v):
        joined = joined.join(side, ["_eco", "_name"], "left")
    confirmed = F.coalesce("confirmed", F.lit(False))
    return joined.select(
        *packages.columns,
        (~confirmed).alias("exists"),
        F.coalesce("trust_score", F.when(confirmed, 0).otherwise(50)).alias("trust_score"),
        confirmed.alias("hallucination"),
        F.col("_vulns").isNotNull().alias("vulnerable"),
        "highest_severity",
        F.coalesce("patched_versions", F.array().cast("array<string>")).alias("patched_versions"),
        F.expr("CASE WHEN provenance_verified THEN 'verified' WHEN trust_score IS NOT NULL THEN 'partial' ELSE 'none' END").alias("provenance"),
        "publisher_age_days", F.coalesce("has_install_scripts", F.lit(False)).alias("has_install_scripts"),
        "download_velocity", "weekly_downloads",
        F.when(confirmed, F.coalesce("report_count", F.lit(0))).alias("report_count"),
        F.when(confirmed, F.coalesce("risk_score", F.lit(0.0))).alias("risk_score"),
        F.when(confirmed, F.col("first_seen")).alias("first_seen"),
    )


def install_verdict(packages: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Whether an install is blocked, warned of or safe.

    ``packages``: (ecosystem, name, confirmed_nonexistent, provenance_tier, script_suspicious,
    script_critical_issues, deprecated).
    """
    counts = vulnerability_counts(vulnerabilities.withColumnRenamed("package_name", "name"), ["ecosystem", "name"])
    joined = packages.join(counts, ["ecosystem", "name"], "left").na.fill(
        0, ["total_vulnerabilities", "critical_count", "high_count", "medium_count", "low_count"])
    blocked = ("coalesce(confirmed_nonexistent, false) OR coalesce(provenance_tier = 'untrusted', false) "
               "OR critical_count > 0 OR (coalesce(script_suspicious, false) AND script_critical_issues > 0)")
    warned = ("coalesce(provenance_tier = 'suspicious', false) OR total_vulnerabilities > 0 "
              "OR coalesce(script_suspicious, false) OR coalesce(deprecated, false)")
    return joined.select(
        *packages.columns, "total_vulnerabilities", "critical_count", "high_count",
        F.expr(f"CASE WHEN {blocked} THEN 'blocked' WHEN {warned} THEN 'warning' ELSE 'safe' END").alias("verdict"),
    )


def dependency_issues(refs: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """One row per reference and issue; a package that does not exist has no other issue.

    ``refs``: (file_id, line_no, ecosystem, name, version, exists_in_registry, suggestion,
    recently_registered, low_popularity).
    """
    v = vulnerabilities.groupBy("ecosystem", F.col("package_name").alias("name")).agg(
        F.count("*").alias("_vulns"), F.max(severity_rank(F.col("severity"))).alias("_rank"),
        F.min_by("fixed_version", "vuln_id").alias("_fix"),
    )
    joined = refs.join(v, ["ecosystem", "name"], "left")

    def issue(condition: str, kind: str, severity: str, fix: str) -> str:
        return f"CASE WHEN {condition} THEN named_struct('issue', '{kind}', 'severity', {severity}, 'fix', {fix}) END"

    issues = ", ".join((
        issue("NOT exists_in_registry", "hallucination", "'error'",
              "IF(suggestion IS NULL, 'remove', concat('replace with ', suggestion))"),
        issue("exists_in_registry AND suggestion IS NOT NULL", "typosquat", "'warning'", "concat('verify against ', suggestion)"),
        issue("exists_in_registry AND recently_registered AND low_popularity", "low-popularity", "'warning'", "'verify'"),
        issue("exists_in_registry AND _vulns > 0", "vulnerability", "IF(_rank >= 3, 'error', 'warning')",
              "IF(_fix IS NULL, 'look for an alternative', concat('update to ', name, '@', _fix))"),
    ))
    exploded = joined.selectExpr(*refs.columns, f"explode(array_compact(array({issues}))) AS _i",
                                 "coalesce(_vulns, 0) AS vulnerability_count")
    return exploded.selectExpr("file_id", "line_no", "ecosystem", "name", "_i.issue", "_i.severity", "_i.fix",
                               "IF(_i.issue = 'vulnerability', vulnerability_count, 0) AS vulnerability_count")


def derive_trust_signals(registry: DataFrame, repositories: DataFrame, previous: DataFrame, as_of: str) -> DataFrame:
    """Trust signals from a registry dump; stars keep their old value when the new one is unknown.

    ``registry``: (ecosystem, name, created_at, version_count, latest_scripts map<string,string>,
    repository_url, weekly_downloads); ``repositories``: (owner, repository, stars);
    ``previous``: (ecosystem, name, github_stars).
    """
    where = "github[.]com/([^/]+)/([^/.]+)"
    r = registry.selectExpr(
        "*", f"nullif(regexp_extract(repository_url, '{where}', 1), '') AS owner",
        f"nullif(regexp_extract(repository_url, '{where}', 2), '') AS repository",
    )
    old = previous.select("ecosystem", "name", F.col("github_stars").alias("_old_stars"))
    joined = r.join(repositories, ["owner", "repository"], "left").join(old, ["ecosystem", "name"], "left")
    scripts = " OR ".join(f"try_element_at(latest_scripts, '{s}') <> ''" for s in ("preinstall", "postinstall", "install"))
    return joined.selectExpr(
        "ecosystem", "name", "weekly_downloads", f"CAST(floor(timestampdiff(SECOND, created_at, {as_of}) / 86400) AS INT) AS package_age_days",
        "version_count AS total_versions", f"coalesce({scripts}, false) AS has_install_scripts",
        "coalesce(repository_url <> '', false) AS has_repository", "coalesce(stars, _old_stars) AS github_stars",
    )
