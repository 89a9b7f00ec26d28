"""Named queries over publication histories, telemetry and crowd reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import history, reports, telemetry
from siftlake.plans.derived import (
    AS_OF, EVENT_PUBLICATIONS, PUBLICATIONS, REGISTRY, REPORTS, SIGNALS, SUSPECTS, TELEMETRY,
)
from siftlake.plans.registry import plan
from siftlake.operators.scan import quote
from siftlake.plans.tables import fill, sql_text, table
from siftlake.vocab import local_table

# --- publication histories -------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = PUBLICATIONS.frame(spark, sf_dir).unionByName(EVENT_PUBLICATIONS.frame(spark, sf_dir).withColumn("package", F.concat("package", F.lit("-ev"))))
    return both


VERSIONS_SQL = f"({PUBLICATIONS.sql} UNION ALL SELECT ecosystem, package || '-ev', version, published_at, publisher, ordinal FROM ({EVENT_PUBLICATIONS.sql}))"
_VKEY = "list_transform(string_split(version, '.'), lambda x: CAST(x AS BIGINT))"
_ANOMALIES_SQL = f"""
    keyed AS (SELECT *, {_VKEY} AS k, CAST(string_split(version, '.')[1] AS BIGINT) AS major FROM {VERSIONS_SQL}),
    seq AS (SELECT *, lag(k) OVER w AS pk, lag(published_at) OVER w AS pt, lag(publisher) OVER w AS pp, lag(published_at, 4) OVER w AS p4
        FROM keyed WINDOW w AS (PARTITION BY ecosystem, package ORDER BY published_at, ordinal)),
    gaps AS (SELECT ecosystem, package, arg_min(publisher <> pp, (published_at, ordinal)) AS changed FROM seq WHERE published_at - pt > INTERVAL 365 DAYS GROUP BY ALL),
    steps AS (SELECT ecosystem, package, major - lag(major) OVER (PARTITION BY ecosystem, package ORDER BY k, published_at, ordinal) AS d FROM keyed),
    shape AS (SELECT ecosystem, package, count(DISTINCT version) AS nv, count(DISTINCT publisher) AS np, bool_or(version LIKE '0.%') AS z, bool_or(version = '1.0.0') AS o FROM keyed GROUP BY ALL),
    found AS (SELECT DISTINCT ecosystem, package, 'CG_PANOM_001' AS anomaly_id, 'high' AS severity FROM seq WHERE k < pk
        UNION ALL SELECT DISTINCT ecosystem, package, 'CG_PANOM_002', 'high' FROM seq WHERE published_at - p4 <= INTERVAL 6 HOURS
        UNION ALL SELECT ecosystem, package, CASE WHEN changed THEN 'CG_PANOM_003a' ELSE 'CG_PANOM_003b' END, CASE WHEN changed THEN 'critical' ELSE 'medium' END FROM gaps
        UNION ALL SELECT DISTINCT ecosystem, package, 'CG_PANOM_004', 'medium' FROM steps WHERE d >= 10
        UNION ALL SELECT ecosystem, package, 'CG_PANOM_005', 'low' FROM shape WHERE nv <= 3 AND z AND o
        UNION ALL SELECT ecosystem, package, 'CG_PANOM_006', 'medium' FROM shape WHERE np >= 3)"""


@plan("publish_anomalies", f"WITH {_ANOMALIES_SQL} SELECT * FROM found", covers="I2 J1 J2 J3 J4 J5")
def publish_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.publish_anomalies(_versions(spark, sf_dir)).drop("evidence")


@plan(
    "publish_risk",
    f"""WITH {_ANOMALIES_SQL}, v AS (SELECT ecosystem, package, count(*) AS version_count FROM {VERSIONS_SQL} GROUP BY ALL),
    p AS (SELECT ecosystem, package, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 45 WHEN 'high' THEN 25 WHEN 'medium' THEN 12 ELSE 5 END) AS s FROM found GROUP BY ALL)
    SELECT ecosystem, package, version_count, coalesce(n, 0) AS anomalies, CAST(least(100, coalesce(s, 0)) AS BIGINT) AS risk_score FROM v LEFT JOIN p USING (ecosystem, package)""",
    covers="J6",
)
def publish_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    return history.publish_risk(versions, history.publish_anomalies(versions))


@plan(
    "burst_publications",
    f"""SELECT ecosystem, package, ordinal FROM (SELECT *, lag(published_at, 4) OVER (PARTITION BY ecosystem, package ORDER BY published_at, ordinal) AS p4
    FROM {VERSIONS_SQL}) WHERE published_at - p4 <= INTERVAL 6 HOURS""",
    covers="J2",
)
def burst_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bursts(_versions(spark, sf_dir)).select("ecosystem", "package", "ordinal")


_PUBLISHERS_SQL = f"""per AS (SELECT ecosystem, package, publisher, count(*) AS n, max((published_at, ordinal)) AS last, max(published_at) AS last_at FROM ({PUBLICATIONS.sql}) GROUP BY ALL),
    pub AS (SELECT ecosystem, package, arg_max(publisher, last) AS latest_publisher, max(last_at) AS latest_published_at, arg_max(n, last) AS latest_n, count(*) AS publisher_count FROM per GROUP BY ALL)"""
# Maintainers of a package: one or two accounts, some with throw-away mail.
_OWNERS = ("CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 3 = 0 THEN {two} ELSE {one} END")
_MAIL = "CASE WHEN p_size % 4 = 1 THEN 'a@mailinator.com' WHEN p_size % 4 = 2 THEN 'b@Gmail.com' ELSE 'c@corp.example' END"


def _maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(n: str) -> str:
        return f"named_struct('name', concat('dev', CAST({n} AS STRING)), 'email', {_MAIL})"

    first, second = one("p_size % 7"), one("(p_size + 1) % 7")
    owners = _OWNERS.format(one=f"array({first})", two=f"array({first}, {second})")
    part = table(spark, sf_dir, "part")
    extra = part.selectExpr("concat('pkg-', CAST(p_partkey AS STRING)) AS package", f"{owners} AS maintainers", "p_partkey % 53 <> 0 AS found")
    return SIGNALS.frame(spark, sf_dir).withColumnRenamed("name", "package").join(extra, "package")


_OWNERS_SQL = _OWNERS.format(one="['dev' || (p_size % 7)]", two="['dev' || (p_size % 7), 'dev' || ((p_size + 1) % 7)]")
_MAINTAINED_SQL = f"""SELECT s.*, s.name AS package, {_OWNERS_SQL} AS owners, {_MAIL} AS mail, p_partkey % 53 <> 0 AS found
    FROM ({SIGNALS.sql}) s JOIN part ON s.name = 'pkg-' || p_partkey"""


@plan(
    "ownership_change",
    f"""WITH {_PUBLISHERS_SQL}, m AS ({_MAINTAINED_SQL})
    SELECT pub.ecosystem, pub.package, latest_publisher, publisher_count,
        CASE WHEN coalesce(list_contains(owners, latest_publisher), false) THEN 'CG_MAINT_006' ELSE 'CG_MAINT_005' END AS signal_id,
        CASE WHEN coalesce(list_contains(owners, latest_publisher), false) THEN 'medium' ELSE 'critical' END AS severity
    FROM pub JOIN m USING (ecosystem, package) WHERE publisher_count > 1""",
    covers="J9 J12",
)
def ownership_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ownership_change(PUBLICATIONS.frame(spark, sf_dir), _maintained(spark, sf_dir))


_HISTORY_END = "TIMESTAMP '2001-03-01 00:00:00'"


@plan(
    "rare_publisher",
    f"""WITH {_PUBLISHERS_SQL} SELECT ecosystem, package, latest_publisher, latest_n AS latest_publisher_versions, publisher_count
    FROM pub WHERE publisher_count > 1 AND latest_n <= 2 AND latest_published_at > {_HISTORY_END} - INTERVAL 48 HOURS""",
    covers="J11",
)
def rare_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = history.recent_rare_publisher(PUBLICATIONS.frame(spark, sf_dir), _HISTORY_END)
    return rare.select("ecosystem", "package", "latest_publisher", "latest_publisher_versions", "publisher_count")


_AGE = f"floor(epoch({AS_OF} - created_at) / 86400)"
_MAINT_RULES = (
    ("CG_MAINT_001", 8, "owners IS NULL"), ("CG_MAINT_002", 3, "npm AND len(owners) = 1"),
    ("CG_MAINT_005", 40, "npm AND pc > 1 AND NOT coalesce(list_contains(owners, latest_publisher), false)"),
    ("CG_MAINT_006", 8, "npm AND pc > 1 AND coalesce(list_contains(owners, latest_publisher), false)"),
    ("CG_MAINT_007", 20, f"{_AGE} < 30"), ("CG_MAINT_008", 8, f"{_AGE} BETWEEN 30 AND 179"),
    ("CG_MAINT_009", 20, f"npm AND pc > 1 AND latest_n <= 2 AND latest_published_at > {AS_OF} - INTERVAL 48 HOURS"),
    ("CG_MAINT_010", 8, "coalesce(repository_url, '') = ''"),
    ("CG_MAINT_011", 3, "npm AND repository_url <> '' AND NOT regexp_matches(repository_url, 'github\\.com')"),
    ("CG_MAINT_012", 3, "npm AND readme_length < 100"), ("CG_MAINT_013", 8, "npm AND weekly_downloads < 20"),
    ("CG_MAINT_014", 3, "npm AND weekly_downloads BETWEEN 20 AND 999"),
)
_MAINT_SQL = " + ".join(f"CASE WHEN {c} THEN {{0}} ELSE 0 END".replace("{0}", str(p)) for _, p, c in _MAINT_RULES)
_MAINT_COUNT_SQL = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, _, c in _MAINT_RULES)


@plan(
    "maintainer_report",
    f"""WITH {_PUBLISHERS_SQL}, m AS ({_MAINTAINED_SQL}),
    j AS (SELECT m.*, m.ecosystem = 'npm' AS npm, latest_publisher, latest_n, latest_published_at, coalesce(publisher_count, 0) AS pc,
        CASE WHEN lower(split_part(mail, '@', 2)) = 'mailinator.com' THEN coalesce(len(owners), 0) ELSE 0 END AS thrown FROM m LEFT JOIN pub USING (ecosystem, package)),
    s AS (SELECT ecosystem, package, found, CASE WHEN found THEN greatest(0, 95 - 20 * thrown - ({_MAINT_SQL})) ELSE 0 END AS score,
        CASE WHEN found THEN thrown + {_MAINT_COUNT_SQL} ELSE 1 END AS signals FROM j)
    SELECT ecosystem, package, score, signals, CASE WHEN NOT found THEN 'unknown' WHEN score >= 80 THEN 'trusted' WHEN score >= 55 THEN 'caution' ELSE 'suspect' END AS verdict FROM s""",
    covers="E19 H11 K5",
)
def maintainer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = _maintained(spark, sf_dir).select(
        "ecosystem", "package", "found", "maintainers", "created_at", "repository_url", "readme_length", "weekly_downloads")
    report = history.maintainer_report(packages, PUBLICATIONS.frame(spark, sf_dir), AS_OF)
    return report.select("ecosystem", "package", "score", F.size("signals").alias("signals"), "verdict")


# --- telemetry ---------------------------------------------------------------------------------

_AGENTS_SQL = "(VALUES " + ", ".join(f"({sql_text(a)}, {sql_text(b)}, {sql_text(c)})" for a, b, c in telemetry.AI_AGENTS) + ") a(ai_agent, agent_name, agent_vendor)"
_IDES_SQL = "(VALUES " + ", ".join(f"({sql_text(a)}, {sql_text(b)})" for a, b, _ in telemetry.IDES) + ") i(ide, ide_name)"
_EVENTS_SQL = f"e AS (SELECT t.*, agent_name, agent_vendor, ide_name FROM ({TELEMETRY.sql}) t LEFT JOIN {_AGENTS_SQL} ON a.ai_agent = t.ai_agent LEFT JOIN {_IDES_SQL} ON i.ide = t.ide)"
_H, _B = "event_type = 'hallucination_detected'", "action_taken = 'blocked'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = local_table(spark, list(telemetry.AI_AGENTS), "slug string, display_name string, vendor string")
    ides = local_table(spark, list(telemetry.IDES), "slug string, display_name string, vendor string")
    return telemetry.enrich_events(TELEMETRY.frame(spark, sf_dir), agents, ides)


@plan(
    "agent_block_stats",
    f"""WITH {_EVENTS_SQL} SELECT agent_name AS ai_agent, agent_vendor, ide_name AS ide, event_type, count(*) AS event_count,
        count(*) FILTER (WHERE {_B}) AS blocked_count, count(*) FILTER (WHERE action_taken = 'allowed') AS allowed_count,
        count(*) FILTER (WHERE action_taken = 'patched') AS patched_count FROM e GROUP BY ALL""",
    covers="A16 E1 F2",
)
def agent_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.agent_block_stats(_events(spark, sf_dir))


_FOLDED_SQL = f"""folded AS (SELECT ecosystem, package_name, count(*) AS report_count, min(created_at) AS first_seen, max(created_at) AS last_seen,
    bool_or(confirmed_nonexistent) AS confirmed, arg_max(model, (created_at, report_id)) FILTER (WHERE model IS NOT NULL) AS model,
    arg_max(ide, (created_at, report_id)) FILTER (WHERE ide IS NOT NULL) AS ide, arg_max(agent, (created_at, report_id)) FILTER (WHERE agent IS NOT NULL) AS agent,
    arg_max(interaction, (created_at, report_id)) FILTER (WHERE interaction IS NOT NULL) AS interaction FROM ({REPORTS.sql}) GROUP BY ALL)"""
_RISK_SQL = """CASE WHEN report_count = 1 THEN CASE WHEN confirmed THEN 0.9 ELSE 0.5 END ELSE least(1.0, CASE WHEN confirmed THEN 0.5 ELSE 0 END + least(report_count / 100, 0.3)
    + CASE WHEN last_seen > first_seen + INTERVAL 7 DAYS AND report_count > 5 THEN 0.2 ELSE 0 END) END"""


@plan(
    "hallucination_stats",
    f"""WITH {_FOLDED_SQL} SELECT agent_name AS ai_agent, ide_name AS ide, ecosystem, count(*) AS total_hallucinations, count(*) FILTER (WHERE confirmed) AS confirmed,
        round(avg(report_count), 1) AS avg_reports, max(last_seen) AS latest_report
    FROM folded f LEFT JOIN {_AGENTS_SQL} ON a.ai_agent = f.agent LEFT JOIN {_IDES_SQL} ON i.ide = f.ide GROUP BY ALL""",
    covers="E1 F1 B7",
)
def hallucination_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = reports.fold_reports(REPORTS.frame(spark, sf_dir)).withColumnRenamed("agent", "ai_agent")
    agents = local_table(spark, list(telemetry.AI_AGENTS), "slug string, display_name string, vendor string")
    ides = local_table(spark, list(telemetry.IDES), "slug string, display_name string, vendor string")
    return telemetry.hallucination_stats(telemetry.enrich_events(folded, agents, ides))


@plan(
    "agent_leaderboard",
    f"""WITH {_EVENTS_SQL}, c AS (SELECT agent_name, ecosystem, count(*) AS n FROM e WHERE agent_name IS NOT NULL AND ecosystem IS NOT NULL GROUP BY ALL),
    m AS (SELECT agent_name, arg_min(ecosystem, (-n, ecosystem)) AS top_ecosystem FROM c GROUP BY ALL)
    SELECT agent_name AS agent, count(*) FILTER (WHERE {_H}) AS hallucinations_reported, count(*) FILTER (WHERE {_B}) AS installs_blocked,
        coalesce(any_value(top_ecosystem), 'npm') AS top_ecosystem
    FROM e JOIN m USING (agent_name) GROUP BY agent_name ORDER BY hallucinations_reported DESC, agent LIMIT 20""",
    covers="F3",
)
def agent_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.agent_leaderboard(_events(spark, sf_dir))


@plan(
    "ide_leaderboard",
    f"WITH {_EVENTS_SQL} SELECT ide_name AS ide, count(*) AS total_events, count(*) FILTER (WHERE {_B}) AS blocked FROM e WHERE ide_name IS NOT NULL GROUP BY ALL",
    covers="F4",
)
def ide_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.ide_leaderboard(_events(spark, sf_dir))


_CH = "severity IN ('critical', 'high')"


@plan(
    "developer_stats",
    f"""SELECT client_id AS developer, count(*) AS total_events, count(*) FILTER (WHERE {_H}) AS hallucinations, count(*) FILTER (WHERE {_B}) AS blocked,
        count(*) FILTER (WHERE {_CH}) AS critical_high, max(created_at) AS last_active FROM ({TELEMETRY.sql}) GROUP BY ALL""",
    covers="F17",
)
def developer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.developer_stats(TELEMETRY.frame(spark, sf_dir))


@plan(
    "overview_totals",
    f"""SELECT count(*) AS events, count(*) FILTER (WHERE {_B}) AS blocked, count(*) FILTER (WHERE {_H}) AS hallucinations,
        count(*) FILTER (WHERE event_type = 'vulnerability_found') AS vulnerabilities, count(DISTINCT client_id) AS developers,
        round(avg(trust_score), 2) AS avg_trust_score FROM ({TELEMETRY.sql})""",
    covers="F18",
)
def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.overview_totals(TELEMETRY.frame(spark, sf_dir))


@plan("event_severity_counts", f"SELECT severity, count(*) AS events FROM ({TELEMETRY.sql}) GROUP BY ALL", covers="F18")
def event_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.severity_counts(TELEMETRY.frame(spark, sf_dir))


@plan(
    "recent_events",
    f"SELECT event_id, event_type, package_name, created_at FROM ({TELEMETRY.sql}) ORDER BY created_at DESC, event_id DESC LIMIT 20",
    covers="F18 K18",
)
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.recent_events(TELEMETRY.frame(spark, sf_dir)).select("event_id", "event_type", "package_name", "created_at")


_DAILY = f"""count(*) AS total, count(*) FILTER (WHERE {_H}) AS hallucinations, count(*) FILTER (WHERE {_B}) AS blocked, count(*) FILTER (WHERE {_CH}) AS critical_high"""


@plan("trends_daily", f"SELECT CAST(created_at AS DATE) AS day, {_DAILY} FROM ({TELEMETRY.sql}) GROUP BY ALL", covers="K22")
def trends_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.daily_trends(TELEMETRY.frame(spark, sf_dir))


@plan("trends_daily_by_agent", f"WITH {_EVENTS_SQL} SELECT agent_name, CAST(created_at AS DATE) AS day, {_DAILY} FROM e GROUP BY ALL", covers="K22")
def trends_daily_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.daily_trends(_events(spark, sf_dir), ["agent_name"])


@plan(
    "top_packages",
    f"WITH {_FOLDED_SQL} SELECT ecosystem, package_name, report_count, round({_RISK_SQL}, 6) AS risk_score FROM folded ORDER BY report_count DESC, ecosystem, package_name LIMIT 20",
    covers="F7 K18",
)
def top_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = reports.fold_reports(REPORTS.frame(spark, sf_dir)).select("ecosystem", "package_name", "report_count", F.round("risk_score", 6).alias("risk_score"))
    return telemetry.top_packages(folded, [F.col("report_count").desc()], 20)


@plan(
    "ecosystem_totals",
    f"WITH {_FOLDED_SQL} SELECT ecosystem, count(*) AS packages, count(*) FILTER (WHERE confirmed) AS confirmed, max(last_seen) AS last_updated FROM folded GROUP BY ROLLUP (ecosystem)",
    covers="F7",
)
def ecosystem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.ecosystem_totals(reports.fold_reports(REPORTS.frame(spark, sf_dir)))


_META = '{"summary":{"totalFindings":@F@,"critical":@C@},"securityScore":@S@}'
_SCANS_END = "TIMESTAMP '1999-06-01 00:00:00'"
_META_FILL = {"@F@": "CAST(o_orderkey % 23 AS STRING)", "@C@": "CAST(o_orderkey % 3 AS STRING)", "@S@": "CAST(o_orderkey % 101 AS STRING)"}


@plan(
    "scan_trends",
    f"""SELECT o_custkey % 100 AS project, count(*) AS total_scans, arg_max(o_orderkey % 101, (o_orderdate, o_orderkey)) AS latest_score,
        CAST(floor(avg(o_orderkey % 23) + 0.5) AS BIGINT) AS average_findings, CAST(sum(o_orderkey % 3) AS BIGINT) AS critical_findings
    FROM orders WHERE o_orderdate >= {_SCANS_END} - INTERVAL 30 DAYS GROUP BY ALL""",
    covers="G2 J13",
)
def scan_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 100 AS project", "o_orderdate AS started_at", "o_orderkey AS scan_id", f"{fill(quote(_META), _META_FILL)} AS metadata")
    return telemetry.scan_trends(scans, _SCANS_END)


@plan(
    "system_stats",
    f"""SELECT 'users' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'teams', count(*) FROM nation UNION ALL SELECT 'scans', count(*) FROM orders
    UNION ALL SELECT 'scans_last_day', count(*) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 1 DAY FROM orders)
    UNION ALL SELECT 'packages', count(*) FROM ({SUSPECTS.sql}) UNION ALL SELECT 'reports', count(*) FROM ({REPORTS.sql})""",
    covers="F15",
)
def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    recent = orders.filter(F.col("o_orderdate") >= newest - F.expr("INTERVAL 1 DAY"))
    return telemetry.system_stats({
        "users": table(spark, sf_dir, "customer"), "teams": table(spark, sf_dir, "nation"), "scans": orders, "scans_last_day": recent,
        "packages": SUSPECTS.frame(spark, sf_dir), "reports": REPORTS.frame(spark, sf_dir)})


# --- crowd reports --------------------------------------------------------------------------------


@plan(
    "fold_reports",
    f"WITH {_FOLDED_SQL} SELECT *, round({_RISK_SQL}, 6) AS risk_score FROM folded",
    covers="F8 F9",
)
def fold_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fold_reports(REPORTS.frame(spark, sf_dir)).withColumn("risk_score", F.round("risk_score", 6))


@plan(
    "fold_reports_first",
    f"""SELECT ecosystem, package_name, arg_min(model, (created_at, report_id)) FILTER (WHERE model IS NOT NULL) AS model,
        arg_min(agent, (created_at, report_id)) FILTER (WHERE agent IS NOT NULL) AS agent FROM ({REPORTS.sql}) GROUP BY ALL""",
    covers="F8",
)
def fold_reports_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fold_reports(REPORTS.frame(spark, sf_dir), "first").select("ecosystem", "package_name", "model", "agent")


@plan(
    "merge_snapshots",
    f"WITH {_FOLDED_SQL} SELECT ecosystem, package_name, report_count, first_seen, last_seen, confirmed, model, ide, agent, interaction FROM folded",
    covers="B6 F8 L2",
)
def merge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the reports folded apart and merged give what folding them at once gives."""
    all_reports = REPORTS.frame(spark, sf_dir)
    one, other = (reports.fold_reports(all_reports.filter(F.col("report_id") % 2 == k), with_order=True).withColumn("claimed", F.lit(False)) for k in (0, 1))
    return reports.merge_snapshots(one, other).drop("claimed", "risk_score", *[f"{c}_order" for c in reports.DESCRIPTIVE])


_W = "CASE report_type WHEN 'HALLUCINATION' THEN 1.0 WHEN 'TYPOSQUAT' THEN 0.8 WHEN 'MALICIOUS' THEN 1.2 WHEN 'FALSE_POSITIVE' THEN -1.0 ELSE 0.5 END::DOUBLE"
_CONF_SQL = f"""conf AS (SELECT ecosystem, package_name, count(*) AS report_count, count(*) FILTER (WHERE report_type = 'HALLUCINATION') AS hallucination_reports,
    count(*) FILTER (WHERE report_type = 'FALSE_POSITIVE') AS false_positive_reports, round(greatest(0, least(1, sum(confidence * {_W}) / sum(abs({_W})))), 6) AS confidence
    FROM ({REPORTS.sql}) GROUP BY ALL)"""


@plan("report_confidence", f"WITH {_CONF_SQL} SELECT * FROM conf", covers="E21 F10")
def report_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_confidence(REPORTS.frame(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@plan(
    "auto_confirm",
    f"""WITH {_CONF_SQL}, j AS (SELECT s.ecosystem, s.package_name, s.status, coalesce(c.report_count, 0) AS n, coalesce(c.confidence, 0.5) AS confidence,
        coalesce(status = 'SUSPECTED' AND hallucination_reports >= 3 AND hallucination_reports > 3 * false_positive_reports, false) AS yes
        FROM ({SUSPECTS.sql}) s LEFT JOIN conf c USING (ecosystem, package_name))
    SELECT ecosystem, package_name, n AS report_count, confidence, yes AS auto_confirmed, CASE WHEN yes THEN 'CONFIRMED' ELSE status END AS status FROM j""",
    covers="E21 F11 L11",
)
def auto_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reports.consolidate(SUSPECTS.frame(spark, sf_dir), REPORTS.frame(spark, sf_dir), AS_OF)
    return done.select("ecosystem", "package_name", "report_count", F.round("confidence", 6).alias("confidence"), "auto_confirmed", "status")


@plan(
    "expire_stale",
    f"""SELECT ecosystem, package_name, CASE WHEN status = 'CONFIRMED' AND report_count < 3 AND verified_at < {AS_OF} - INTERVAL 30 DAYS THEN 'SUSPECTED' ELSE status END AS status
    FROM ({SUSPECTS.sql}) WHERE NOT (status = 'SUSPECTED' AND report_count < 2 AND last_seen < {AS_OF} - INTERVAL 90 DAYS)""",
    covers="F12",
)
def expire_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reports.expire_stale(SUSPECTS.frame(spark, sf_dir), AS_OF)
    return reports.decay(kept, AS_OF).select("ecosystem", "package_name", "status")


@plan(
    "verify_entries",
    f"""WITH r AS (SELECT DISTINCT ecosystem, name FROM ({REGISTRY.sql})), j AS (SELECT s.*, r.name IS NOT NULL AS there, s.ecosystem IN ('npm', 'pypi') AS can
        FROM ({SUSPECTS.sql}) s LEFT JOIN r ON r.ecosystem = s.ecosystem AND r.name = s.package_name)
    SELECT ecosystem, package_name, CASE WHEN NOT can THEN 'inconclusive' WHEN there THEN 'false-positive' WHEN status = 'SUSPECTED' THEN 'confirmed' ELSE 'unchanged' END AS outcome,
        CASE WHEN NOT can THEN status WHEN there THEN 'FALSE_POSITIVE' WHEN status = 'SUSPECTED' THEN 'CONFIRMED' ELSE status END AS new_status FROM j""",
    covers="F24",
)
def verify_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reports.verify_entries(SUSPECTS.frame(spark, sf_dir), REGISTRY.frame(spark, sf_dir))
    return done.select("ecosystem", "package_name", "outcome", "new_status")


_SEEDS = ("CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'go' ELSE 'cargo' END AS ecosystem", "concat('ghost-', CAST(p_partkey AS STRING)) AS package_name",
          "CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS persistence", "p_partkey % 10 = 0 AS attacked")
_LOADED_SQL = f"""loaded AS (SELECT ecosystem, package_name, greatest(report_count, n) AS report_count, round(greatest(risk_score, r), 6) AS risk_score,
    coalesce(claimed, false) OR coalesce(attacked, false) AS attacked, CASE WHEN n IS NULL THEN 'kept' WHEN report_count IS NULL THEN 'imported' ELSE 'updated' END AS action, persistence
    FROM ({SUSPECTS.sql}) s FULL OUTER JOIN (SELECT *, CASE persistence WHEN 'high' THEN 500 WHEN 'medium' THEN 200 ELSE 50 END AS n,
        CASE persistence WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.65 ELSE 0.4 END::DOUBLE AS r FROM (SELECT {', '.join(_SEEDS)} FROM part)) x USING (ecosystem, package_name))"""


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = SUSPECTS.frame(spark, sf_dir).withColumnRenamed("claimed", "attacked").select(
        "ecosystem", "package_name", "report_count", "risk_score", "attacked", "first_seen", "last_seen")
    return reports.load_seeds(table(spark, sf_dir, "part").selectExpr(*_SEEDS), stored, AS_OF)


@plan("load_seeds", f"WITH {_LOADED_SQL} SELECT ecosystem, package_name, report_count, risk_score, attacked, action FROM loaded", covers="A18 B6 K17")
def load_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).select("ecosystem", "package_name", "report_count", F.round("risk_score", 6).alias("risk_score"), "attacked", "action")


@plan(
    "seed_load_outcomes",
    f"""WITH {_LOADED_SQL} SELECT ecosystem, count(*) FILTER (WHERE action = 'imported') AS imported, count(*) FILTER (WHERE action = 'updated') AS updated,
        count(*) FILTER (WHERE persistence = 'high' AND action <> 'kept') AS high_persistence FROM loaded GROUP BY ALL""",
    covers="F23",
)
def seed_load_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merge_outcomes(_loaded(spark, sf_dir))


_DUE_SQL = f"confirmed AND NOT claimed AND (last_checked IS NULL OR last_checked < {AS_OF} - INTERVAL 60 MINUTES)"


@plan(
    "recheck_candidates",
    f"SELECT ecosystem, package_name, report_count, risk_score FROM ({SUSPECTS.sql}) WHERE {_DUE_SQL}",
    covers="K19 L8",
)
def recheck_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recheck_candidates(SUSPECTS.frame(spark, sf_dir), AS_OF).select("ecosystem", "package_name", "report_count", "risk_score")


@plan(
    "claimed_packages",
    f"""SELECT s.ecosystem, s.package_name, r.created_at AS registered_at, r.publisher, r.latest AS version, s.report_count AS previous_report_count
    FROM ({SUSPECTS.sql}) s JOIN ({REGISTRY.sql}) r ON r.ecosystem = s.ecosystem AND r.name = s.package_name WHERE {_DUE_SQL}""",
    covers="E20",
)
def claimed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.claimed_packages(SUSPECTS.frame(spark, sf_dir), REGISTRY.frame(spark, sf_dir), AS_OF)
    return found.select("ecosystem", "package_name", F.col("registered_at").cast("timestamp_ntz").alias("registered_at"), "publisher", "version", "previous_report_count")


@plan(
    "paged_packages",
    f"""SELECT ecosystem, package_name, report_count FROM ({SUSPECTS.sql}) WHERE status = 'SUSPECTED' AND ecosystem = 'npm'
    ORDER BY report_count DESC, ecosystem, package_name LIMIT 50 OFFSET 50""",
    covers="C10",
)
def paged_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page(SUSPECTS.frame(spark, sf_dir), 2, 50, "suspected", "npm").select("ecosystem", "package_name", "report_count")


# --- alerts ----------------------------------------------------------------------------------------

_SUBS = ("n_nationkey AS id", "CASE n_nationkey % 4 WHEN 0 THEN 'slack' WHEN 1 THEN 'teams' WHEN 2 THEN 'jira' ELSE 'generic' END AS type",
         "concat('https://hooks.example/', n_name) AS url", "n_nationkey % 5 <> 0 AS enabled")
_SUB_EVENTS = "CASE n_nationkey % 3 WHEN 0 THEN {none} WHEN 1 THEN {a} ELSE {b} END"
_ALERTS_SQL = f"""alerts AS (SELECT t.event_id, t.event_type, t.severity, t.package_name, t.ecosystem, s.id AS subscription_id, s.type AS channel
    FROM ({TELEMETRY.sql}) t JOIN (SELECT {', '.join(_SUBS)}, {_SUB_EVENTS.format(none='[]', a="['vulnerability_found']", b="['hallucination_detected', 'package_patched']")} AS events FROM nation) s
    ON s.enabled AND (len(s.events) = 0 OR list_contains(s.events, t.event_type)))"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscriptions = table(spark, sf_dir, "nation").selectExpr(
        *_SUBS, "concat('K', CAST(n_nationkey AS STRING)) AS project_key", "CAST(NULL AS STRING) AS issue_type",
        _SUB_EVENTS.format(none="CAST(array() AS ARRAY<STRING>)", a="array('vulnerability_found')", b="array('hallucination_detected', 'package_patched')") + " AS events")
    return telemetry.match_subscriptions(TELEMETRY.frame(spark, sf_dir), subscriptions)


@plan("match_subscriptions", f"WITH {_ALERTS_SQL} SELECT event_id, subscription_id, channel FROM alerts", covers="E15 L9")
def match_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select("event_id", "subscription_id", "channel")


@plan(
    "alert_payloads",
    f"""WITH {_ALERTS_SQL} SELECT event_id, subscription_id, CASE channel WHEN 'slack' THEN replace(event_type, '_', ' ')
        WHEN 'teams' THEN CASE severity WHEN 'critical' THEN 'FF0000' WHEN 'high' THEN 'FF8C00' ELSE 'FFD700' END
        WHEN 'jira' THEN CASE severity WHEN 'critical' THEN 'Highest' WHEN 'high' THEN 'High' ELSE 'Medium' END ELSE package_name END AS shown FROM alerts""",
    covers="B8",
)
def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = telemetry.alert_payloads(_alerts(spark, sf_dir).withColumn("message", F.concat_ws(" ", "event_type", "package_name")))
    paths = {"slack": "$.blocks[0].text.text", "teams": "$.themeColor", "jira": "$.fields.priority.name"}
    shown = F.get_json_object("payload", "$.package_name")
    for channel, path in paths.items():
        shown = F.when(F.col("channel") == channel, F.get_json_object("payload", path)).otherwise(shown)
    return bodies.select("event_id", "subscription_id", shown.alias("shown"))
