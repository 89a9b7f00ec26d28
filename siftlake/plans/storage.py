"""Named queries that write a given table in a source's format, read it with the reader and use what was read; and set operations on packages."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import advisories, deps, drift, policy, scan, taint
from siftlake.plans.derived import AS_OF, REFERENCES, SIGNALS, SUSPECTS, VULNERABILITIES
from siftlake.plans.oracle import findings_sql, lines_sql
from siftlake.plans.registry import plan
from siftlake.plans.streams import _append, _ntz, _workspace
from siftlake.plans.tables import planted, planted_sql, table
from siftlake.plans.tooling import _flow_corpus
from siftlake.rules import FAMILIES
from siftlake.sources import readers, sinks
from siftlake.streaming import streams


@plan(
    "stored_findings",
    f"WITH corpus AS ({planted_sql('secret')}), lines AS ({lines_sql('corpus')}), f AS ({findings_sql(FAMILIES['secret'])}) "
    "SELECT 'secret' AS family, rule_id, count(*) AS findings FROM f GROUP BY ALL",
    covers="B1",
)
def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written by family and read back."""
    path = os.path.join(_workspace(spark), "findings")
    sinks.write_findings(scan.scan(planted(spark, sf_dir, "secret").drop("source"), FAMILIES["secret"]), path)
    return spark.read.parquet(path).groupBy("family", "rule_id").agg(F.count("*").alias("findings"))


@plan(
    "published_statistics",
    f"SELECT ecosystem, count(*) AS advisories, count(*) FILTER (WHERE severity = 'critical') AS critical FROM ({VULNERABILITIES.sql}) GROUP BY ecosystem",
    covers="B7",
)
def published_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory counts published, and published again, then read."""
    path = os.path.join(_workspace(spark), "statistics")
    counts = VULNERABILITIES.frame(spark, sf_dir).groupBy("ecosystem").agg(F.count("*").alias("advisories"), F.count_if(F.col("severity") == "critical").alias("critical"))
    for _ in range(2):
        sinks.publish_statistics(counts, path)
    return spark.read.parquet(path)


@plan(
    "osv_dump",
    """SELECT concat('OSV-', p_partkey) AS vuln_id, lower(p_name) AS package_name, CASE p_size % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem,
        CASE p_size % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
        CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE concat('>=', p_size % 5, '.0.0') END AS affected_range,
        CASE WHEN p_size % 7 > 0 THEN concat(p_size % 7, '.1.0') END AS fixed_version, CAST(p_partkey % 2 AS INT) AS cves FROM part""",
    covers="A10 G3 G5 G6",
)
def osv_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an advisory document, dumped as JSON lines, read and flattened."""
    path = os.path.join(_workspace(spark), "osv")
    events = "filter(array(IF(p_size % 5 = 0, NULL, named_struct('introduced', concat(p_size % 5, '.0.0'))), IF(p_size % 7 > 0, named_struct('fixed', concat(p_size % 7, '.1.0')), NULL)), e -> e IS NOT NULL)"
    events = events.replace("named_struct('introduced', concat(p_size % 5, '.0.0'))", "named_struct('introduced', concat(p_size % 5, '.0.0'), 'fixed', CAST(NULL AS STRING))").replace(
        "named_struct('fixed', concat(p_size % 7, '.1.0'))", "named_struct('introduced', CAST(NULL AS STRING), 'fixed', concat(p_size % 7, '.1.0'))")
    documents = table(spark, sf_dir, "part").selectExpr(
        "concat('OSV-', p_partkey) AS id", "p_name AS summary", "IF(p_partkey % 2 = 1, array(concat('CVE-2024-', p_partkey), 'GHSA-x'), array('GHSA-x')) AS aliases",
        "named_struct('severity', CASE p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MODERATE' END) AS database_specific",
        f"array(named_struct('package', named_struct('ecosystem', IF(p_size % 2 = 0, 'npm', 'PyPI'), 'name', lower(p_name)), 'ranges', array(named_struct('type', 'SEMVER', 'events', {events})))) AS affected")
    documents.write.json(path)
    flat = advisories.flatten_osv(readers.read_osv(spark, path))
    return flat.select("vuln_id", "package_name", "ecosystem", "severity", "affected_range", "fixed_version", F.size("cve_ids").alias("cves"))


@plan(
    "registry_dump",
    """SELECT lower(p_name) || '-' || p_partkey AS package, '1.' || v || '.0' AS version, CAST(DATE '2024-01-01' + CAST(p_size % 20 + v AS INTEGER) AS TIMESTAMP) AS published_at,
        'dev' || (p_size % 9 + v) AS publisher, v - 1 AS ordinal FROM part CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2), (3)) t(v)""",
    covers="A11",
)
def registry_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a package document of a registry, dumped as JSON lines; its publication history as read."""
    path = os.path.join(_workspace(spark), "registry")
    table(spark, sf_dir, "part").selectExpr(
        "concat(lower(p_name), '-', p_partkey) AS name", "named_struct('latest', '1.3.0') AS `dist-tags`",
        "map_from_entries(transform(sequence(1, 3), v -> struct(concat('1.', v, '.0'), concat(CAST(date_add(DATE '2024-01-01', CAST(p_size % 20 + v AS INT)) AS STRING), 'T00:00:00Z')))) AS time",
        "map_from_entries(transform(sequence(1, 3), v -> struct(concat('1.', v, '.0'), named_struct('version', concat('1.', v, '.0'), '_npmUser', named_struct('name', concat('dev', p_size % 9 + v)))))) AS versions",
    ).write.json(path)
    return _ntz(readers.registry_versions(readers.read_registry_snapshot(spark, path)).drop("ecosystem"), "published_at")


@plan(
    "sbom_files",
    """SELECT 'nation-' || c_nationkey AS project, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 3 = 1 THEN 'npm' ELSE 'pypi' END AS ecosystem, count(*) AS components,
        count(DISTINCT 'c' || c_custkey % 50) AS names, count(*) FILTER (WHERE c_custkey % 4 > 0) AS licensed FROM customer GROUP BY ALL""",
    covers="A14 H5",
)
def sbom_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bill of materials per nation, a document per file, and its components by the ecosystem of their package addresses."""
    path = os.path.join(_workspace(spark), "sboms")
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey", "struct('library' AS type, concat('r', c_custkey) AS `bom-ref`, concat('c', c_custkey % 50) AS name, '1.0.0' AS version, "
        "CASE c_custkey % 3 WHEN 0 THEN concat('c', c_custkey) WHEN 1 THEN concat('pkg:npm/c', c_custkey, '@1.0.0') ELSE concat('pkg:pypi/c', c_custkey, '@1.0.0') END AS purl, "
        "IF(c_custkey % 4 > 0, array(struct(struct('MIT' AS id) AS license)), CAST(NULL AS ARRAY<STRUCT<license: STRUCT<id: STRING>>>)) AS licenses) AS c")
    # The format is one document per file; a nation has a document for each thousand customer keys, so documents stay small.
    documents = rows.groupBy("c_nationkey", F.expr("CAST(substring(c.`bom-ref`, 2) AS BIGINT) div 1000").alias("b")).agg(F.collect_list("c").alias("components")).selectExpr(
        "c_nationkey AS n", "b", "'CycloneDX' AS bomFormat", "struct(struct(concat('nation-', c_nationkey) AS name, '1' AS version) AS component) AS metadata", "components")
    documents.write.partitionBy("n", "b").json(path)
    read = readers.read_sbom(spark, path).withColumn("ecosystem", F.expr(drift.purl_ecosystem("purl")))
    return read.groupBy("project", "ecosystem").agg(F.count("*").alias("components"), F.countDistinct("name").alias("names"), F.count("license").alias("licensed"))


@plan(
    "references_not_ignored",
    f"SELECT ecosystem, count(*) AS refs FROM ({REFERENCES.sql}) WHERE lower(name) NOT IN ('pkg-1', 'pkg-7') AND NOT starts_with(name, 'pkg-3') GROUP BY ecosystem",
    covers="C2",
)
def references_not_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deps.ignore_packages(REFERENCES.frame(spark, sf_dir), ["PKG-1", "pkg-7"], ["pkg-3"])
    return kept.groupBy("ecosystem").agg(F.count("*").alias("refs"))


@plan(
    "advisories_inserted",
    f"SELECT vuln_id, ecosystem, package_name, min(severity) AS severity FROM ({VULNERABILITIES.sql}) v WHERE NOT EXISTS (SELECT 1 FROM ({VULNERABILITIES.sql}) s WHERE s.vuln_id = v.vuln_id AND s.severity = 'low') GROUP BY ALL",
    covers="K17",
)
def advisories_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories that are not stored yet, from a feed that repeats some."""
    rows = VULNERABILITIES.frame(spark, sf_dir).select("vuln_id", "ecosystem", "package_name", "severity")
    feed = rows.unionByName(rows.filter("severity = 'high'"))
    return advisories.new_advisories(feed, rows.filter("severity = 'low'"))


@plan(
    "policy_scan",
    f"""WITH f AS (SELECT ecosystem AS project, severity, vuln_id AS rule_id FROM ({VULNERABILITIES.sql})),
    p AS (SELECT ecosystem AS project, name FROM ({SIGNALS.sql})), h AS (SELECT DISTINCT ecosystem AS project FROM ({SIGNALS.sql}) WHERE known_hallucination)
    SELECT project, 'POLICY_FORBIDDEN_' || name AS rule_id, 'high' AS severity FROM p WHERE lower(name) IN ('pkg-11', 'pkg-12')
    UNION ALL SELECT project, 'POLICY_VULN_SEV_' || rule_id, 'high' FROM f WHERE severity IN ('critical', 'high')
    UNION ALL SELECT project, 'POLICY_HALLUCINATION_BLOCK', 'high' FROM h""",
    covers="K8",
)
def policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy findings of ecosystems taken as projects."""
    found = VULNERABILITIES.frame(spark, sf_dir).selectExpr("ecosystem AS project", "'vulnerability' AS type", "severity", "vuln_id AS rule_id", "package_name")
    signals = SIGNALS.frame(spark, sf_dir)
    invented = signals.filter("known_hallucination").selectExpr("ecosystem AS project", "'hallucination' AS type", "'critical' AS severity", "'H' AS rule_id", "name AS package_name")
    rules = policy.Policy(forbidden_packages=("pkg-11", "PKG-12"), max_allowed_severity="medium", block_hallucinations=True)
    return policy.scan_violations(found.unionByName(invented), signals.selectExpr("ecosystem AS project", "name"), rules)


@plan(
    "flow_severities",
    """SELECT severity, kind, count(*) AS flows FROM customer CROSS JOIN (VALUES ('local', 'critical'), ('cross', 'critical'), ('cross', 'high'), ('cross-call', 'critical'), ('cross-call', 'critical')) v(kind, severity) GROUP BY ALL""",
    covers="M6",
)
def flow_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.flows_by_severity(taint.analyze(_flow_corpus(spark, sf_dir)))


@plan(
    "stream_recheck",
    f"""SELECT ecosystem, package_name, report_count FROM ({SUSPECTS.sql}) JOIN (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'go' ELSE 'cargo' END AS ecosystem, concat('ghost-', CAST(c_custkey AS STRING)) AS package_name
        FROM customer WHERE c_acctbal > 0) USING (ecosystem, package_name) WHERE confirmed AND NOT claimed AND (last_checked IS NULL OR last_checked < {AS_OF} - INTERVAL 60 MINUTES)""",
    covers="L8",
)
def stream_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspected packages as they arrive, against a registry that lists some of them by now."""
    entries = _suspects(spark, sf_dir)
    registry = table(spark, sf_dir, "customer").filter("c_acctbal > 0").selectExpr(
        "CASE c_custkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'go' ELSE 'cargo' END AS ecosystem", "concat('ghost-', c_custkey) AS name", f"{AS_OF} AS created_at",
        "'p' AS publisher", "'1.0.0' AS latest", "0L AS weekly_downloads", "false AS has_install_scripts")
    found = streams.stream_recheck(entries, registry, AS_OF).select("ecosystem", "package_name", F.col("previous_report_count").alias("report_count"))
    return _append(found, _workspace(spark))


def _suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suspects table as a stream of its files."""
    path = os.path.join(_workspace(spark), "suspects")
    rows = SUSPECTS.frame(spark, sf_dir)
    rows.repartition(3).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
