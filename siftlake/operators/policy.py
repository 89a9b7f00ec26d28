"""Policies over packages, projects and scan results.  A policy is an object the caller passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.scan import quote
from siftlake.vocab import SEVERITY_RANK, severity_rank


@dataclass(frozen=True)
class Policy:
    mode: str = "warn"
    block_unprovenanced_packages: bool = False
    required_provenance_level: str | None = None
    max_allowed_severity: str | None = None
    forbidden_packages: tuple[str, ...] = ()
    allowed_packages: tuple[str, ...] = ()
    max_critical_findings: int | None = None
    max_high_findings: int | None = None
    max_ai_code_ratio: float | None = None
    require_sbom_baseline: bool = False
    require_secrets_scanner: bool = False
    require_sast_scanner: bool = False
    max_mcp_issues: int | None = None
    require_ai_sbom: bool = False
    allowed_ai_sdks: tuple[str, ...] = ()
    forbidden_patterns: tuple[str, ...] = ()
    block_hallucinations: bool = True

    @property
    def severity(self) -> str:
        return "error" if self.mode == "enforce" else "warning"


# Orders of the levels.
PROVENANCE_ORDER = ("verified", "partial", "none")
SEVERITY_ORDER = ("none", "low", "medium", "high", "critical")


def _violation(condition: str, rule: str, severity: str) -> str:
    return f"IF({condition}, named_struct('rule', '{rule}', 'severity', '{severity}'), NULL)"


def _violations(rows: DataFrame, found: list[str], rest: list[str]) -> DataFrame:
    if not found:
        return rows.selectExpr(*rest, "'' AS rule", "'' AS severity").limit(0)
    return rows.selectExpr(*rest, f"inline(array_compact(array({', '.join(found)})))")


def _position(column: str, order: tuple[str, ...]) -> str:
    return "CASE lower({}) {} ELSE -1 END".format(column, " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order)))


def package_violations(packages: DataFrame, policy: Policy) -> DataFrame:
    """Violations of each package; an allowed package has none.

    ``packages``: (name, version, provenance, max_severity).
    """
    found = []
    if policy.forbidden_packages:
        listed = ", ".join(quote(p) for p in policy.forbidden_packages)
        found.append(_violation(f"name IN ({listed}) OR concat(name, '@', version) IN ({listed})", "forbidden_packages", policy.severity))
    if policy.block_unprovenanced_packages:
        found.append(_violation("provenance = 'none'", "block_unprovenanced_packages", policy.severity))
    if policy.required_provenance_level is not None:
        required = PROVENANCE_ORDER.index(policy.required_provenance_level)
        found.append(_violation(f"{_position('provenance', PROVENANCE_ORDER)} > {required}", "required_provenance_level", policy.severity))
    if policy.max_allowed_severity is not None:
        allowed = SEVERITY_ORDER.index(policy.max_allowed_severity)
        found.append(_violation(f"max_severity IS NOT NULL AND {_position('max_severity', SEVERITY_ORDER)} > {allowed}", "max_allowed_severity", policy.severity))
    kept = packages.filter(~F.col("name").isin(*policy.allowed_packages)) if policy.allowed_packages else packages
    return _violations(kept, found, packages.columns)


def forbidden_packages(refs: DataFrame, forbidden: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """References on a table of forbidden names or ``name@version``; allowed names pass."""
    kept = refs if allowed is None else refs.join(allowed.select(F.lower("name").alias("_allowed")), F.lower(refs["name"]) == F.col("_allowed"), "left_anti")
    keyed = kept.select("*", F.explode(F.array_distinct(F.array_compact(F.array(
        F.lower("name"), F.lower(F.concat("name", F.lit("@"), "version")))))).alias("_key"))
    listed = forbidden.select(F.lower("package").alias("_key")).distinct()
    return keyed.join(listed, "_key", "left_semi").drop("_key").distinct()


def project_violations(projects: DataFrame, policy: Policy) -> DataFrame:
    """Violations of each project.

    ``projects``: (project, critical_findings, high_findings, ai_code_ratio, sbom_baseline_exists,
    secrets_scanner_enabled, sast_scanner_enabled, mcp_issues, ai_sbom_exists, ai_sdks array).
    """
    found = []
    for rule, limit, column in (
        ("max_critical_findings", policy.max_critical_findings, "critical_findings"),
        ("max_high_findings", policy.max_high_findings, "high_findings"),
        ("max_ai_code_ratio", policy.max_ai_code_ratio, "ai_code_ratio"),
        ("max_mcp_issues", policy.max_mcp_issues, "mcp_issues"),
    ):
        if limit is not None:
            found.append(_violation(f"coalesce({column} > {limit}, false)", rule, policy.severity))
    if policy.require_sbom_baseline:
        found.append(_violation("NOT sbom_baseline_exists", "require_sbom_baseline", policy.severity))
    if policy.require_secrets_scanner:
        found.append(_violation("NOT secrets_scanner_enabled", "require_secrets_scanner", "warning"))
    if policy.require_sast_scanner:
        found.append(_violation("NOT sast_scanner_enabled", "require_sast_scanner", "warning"))
    if policy.require_ai_sbom:
        found.append(_violation("coalesce(NOT ai_sbom_exists, false)", "require_ai_sbom", policy.severity))
    if policy.allowed_ai_sdks:
        listed = ", ".join(quote(s) for s in policy.allowed_ai_sdks)
        found.append(_violation(f"size(array_except(coalesce(ai_sdks, array()), array({listed}))) > 0", "allowed_ai_sdks", policy.severity))
    return _violations(projects, found, ["project"])


def passed(projects: DataFrame, violations: DataFrame) -> DataFrame:
    """Whether each project passes: it does unless a violation is an error."""
    errors = violations.groupBy("project").agg(
        F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"))
    return projects.select("project").distinct().join(errors, "project", "left").na.fill(0).withColumn(
        "passed", F.col("errors") == 0)


def scan_violations(findings: DataFrame, packages: DataFrame, policy: Policy) -> DataFrame:
    """Policy findings of a scan: forbidden packages, severities over the limit, invented packages.

    ``findings``: (project, type, severity, rule_id, package_name); ``packages``: (project, name).
    """
    result = None
    if policy.forbidden_packages:
        listed = [p.lower() for p in policy.forbidden_packages]
        result = packages.filter(F.lower("name").isin(*listed)).select(
            "project", F.concat(F.lit("POLICY_FORBIDDEN_"), "name").alias("rule_id"), F.lit("high").alias("severity"))
    if policy.max_allowed_severity is not None:
        limit = SEVERITY_RANK.get(policy.max_allowed_severity, 2)
        over = findings.filter((F.col("type") == "vulnerability") & (F.coalesce(severity_rank(F.col("severity")), F.lit(0)) > limit)).select(
            "project", F.concat(F.lit("POLICY_VULN_SEV_"), "rule_id").alias("rule_id"), F.lit("high").alias("severity"))
        result = over if result is None else result.unionByName(over)
    if policy.block_hallucinations:
        invented = findings.filter("type = 'hallucination'").groupBy("project").agg(F.count("*").alias("_n")).select(
            "project", F.lit("POLICY_HALLUCINATION_BLOCK").alias("rule_id"), F.lit("high").alias("severity"))
        result = invented if result is None else result.unionByName(invented)
    return findings.select("project", "rule_id", "severity").limit(0) if result is None else result
