"""Statistics over the telemetry stream, alert routing and alert payloads.

Dimension tables are joined without a broadcast hint: Spark broadcasts them when their size
is below its threshold and shuffles them when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Product dimensions: slug, display name, vendor.
IDES = (
    ("vscode", "VS Code", "microsoft"), ("cursor", "Cursor", "anysphere"), ("windsurf", "Windsurf", "codeium"),
    ("jetbrains", "JetBrains IDEs", "jetbrains"), ("neovim", "Neovim", "community"),
    ("vscode-web", "VS Code Web", "microsoft"), ("github-codespaces", "GitHub Codespaces", "github"),
)
AI_AGENTS = (
    ("copilot", "GitHub Copilot", "github"), ("copilot-chat", "Copilot Chat", "github"), ("chatgpt", "ChatGPT", "openai"),
    ("claude", "Claude", "anthropic"), ("cursor-ai", "Cursor AI", "anysphere"),
    ("windsurf-cascade", "Windsurf Cascade", "codeium"), ("codewhisperer", "Amazon CodeWhisperer", "amazon"),
    ("cody", "Sourcegraph Cody", "sourcegraph"), ("gemini-code-assist", "Gemini Code Assist", "google"),
    ("tabnine", "Tabnine", "tabnine"), ("manual", "Manual (no AI)", "none"),
)


def enrich_events(events: DataFrame, agents: DataFrame, ides: DataFrame) -> DataFrame:
    """Adds agent, vendor and IDE names by slug; unknown slugs keep their event."""
    a = agents.select(F.col("slug").alias("ai_agent"), F.col("display_name").alias("agent_name"), F.col("vendor").alias("agent_vendor"))
    i = ides.select(F.col("slug").alias("ide"), F.col("display_name").alias("ide_name"))
    return events.join(a, "ai_agent", "left").join(i, "ide", "left")


def hallucination_stats(hallucinations: DataFrame) -> DataFrame:
    """By agent, IDE and ecosystem; packages without either keep a group of their own."""
    return hallucinations.groupBy(F.col("agent_name").alias("ai_agent"), F.col("ide_name").alias("ide"), "ecosystem").agg(
        F.count("*").alias("total_hallucinations"), F.count_if("confirmed").alias("confirmed"),
        F.round(F.avg("report_count"), 1).alias("avg_reports"), F.max("last_seen").alias("latest_report"),
    )


def agent_block_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("agent_name").alias("ai_agent"), "agent_vendor", F.col("ide_name").alias("ide"), "event_type").agg(
        F.count("*").alias("event_count"),
        *[F.count_if(F.col("action_taken") == a).alias(f"{a}_count") for a in ("blocked", "allowed", "patched")],
    )


def most_common(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The most frequent value per key, the smallest on a tie, from partial counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), column)).alias(name))


def agent_leaderboard(events: DataFrame, limit: int = 20) -> DataFrame:
    known = events.filter("agent_name IS NOT NULL").withColumnRenamed("agent_name", "agent")
    totals = known.groupBy("agent").agg(
        F.count_if(F.col("event_type") == "hallucination_detected").alias("hallucinations_reported"),
        F.count_if(F.col("action_taken") == "blocked").alias("installs_blocked"),
    )
    joined = totals.join(most_common(known, ["agent"], "ecosystem", "top_ecosystem"), "agent", "left")
    return joined.withColumn("top_ecosystem", F.coalesce("top_ecosystem", F.lit("npm"))).orderBy(
        F.col("hallucinations_reported").desc(), "agent").limit(limit)


def ide_leaderboard(events: DataFrame) -> DataFrame:
    return events.filter("ide_name IS NOT NULL").groupBy(F.col("ide_name").alias("ide")).agg(
        F.count("*").alias("total_events"), F.count_if(F.col("action_taken") == "blocked").alias("blocked")
    )


def _critical_or_high() -> Column:
    return F.col("severity").isin("critical", "high")


def developer_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("client_id").alias("developer")).agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("event_type") == "hallucination_detected").alias("hallucinations"),
        F.count_if(F.col("action_taken") == "blocked").alias("blocked"),
        F.count_if(_critical_or_high()).alias("critical_high"), F.max("created_at").alias("last_active"),
    )


def overview_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("events"), F.count_if(F.col("action_taken") == "blocked").alias("blocked"),
        F.count_if(F.col("event_type") == "hallucination_detected").alias("hallucinations"),
        F.count_if(F.col("event_type") == "vulnerability_found").alias("vulnerabilities"),
        F.count_distinct("client_id").alias("developers"), F.round(F.avg("trust_score"), 2).alias("avg_trust_score"),
    )


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count("*").alias("events"))


def recent_events(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)


def daily_trends(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events per day, and per day and agent when asked."""
    return events.groupBy(*(by or []), F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "hallucination_detected").alias("hallucinations"),
        F.count_if(F.col("action_taken") == "blocked").alias("blocked"), F.count_if(_critical_or_high()).alias("critical_high"),
    )


def top_packages(packages: DataFrame, by: list[Column], limit: int) -> DataFrame:
    """The first packages of an order that ends in the package's name."""
    return packages.orderBy(*by, "ecosystem", "package_name").limit(limit)


def ecosystem_totals(hallucinations: DataFrame) -> DataFrame:
    """Packages per ecosystem and overall, from one scan; the overall row has no ecosystem."""
    return hallucinations.rollup("ecosystem").agg(
        F.count("*").alias("packages"), F.count_if("confirmed").alias("confirmed"), F.max("last_seen").alias("last_updated")
    )


def scan_trends(scans: DataFrame, as_of: str) -> DataFrame:
    """Thirty days of scans of each project: number, latest score and mean findings.

    ``scans``: (project, started_at, scan_id, metadata), the metadata being JSON.
    """
    recent = scans.filter(f"started_at >= {as_of} - INTERVAL 30 DAYS").selectExpr(
        "project", "started_at", "scan_id",
        "coalesce(CAST(get_json_object(metadata, '$.summary.totalFindings') AS BIGINT), 0) AS findings",
        "coalesce(CAST(get_json_object(metadata, '$.summary.critical') AS BIGINT), 0) AS critical",
        "CAST(get_json_object(metadata, '$.securityScore') AS BIGINT) AS score",
    )
    return recent.groupBy("project").agg(
        F.count("*").alias("total_scans"), F.max_by("score", F.struct("started_at", "scan_id")).alias("latest_score"),
        F.floor(F.avg("findings") + 0.5).alias("average_findings"), F.sum("critical").alias("critical_findings"),
    )


def system_stats(counts: dict[str, DataFrame]) -> DataFrame:
    """One row per named table with its number of rows."""
    rows = None
    for name, df in counts.items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows


# --- alerts ----------------------------------------------------------------------------

WILDCARD_SALTS = 32


def match_subscriptions(events: DataFrame, subscriptions: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with every enabled subscription that asks for their type or for all types.

    Both kinds become one equality join under salted keys: event types are few, so neither one type nor the
    wildcard is a key that holds a large share of the events.
    """
    salt = F.pmod(F.xxhash64(key), F.lit(WILDCARD_SALTS)).cast("int")
    left = events.select("*", F.explode(F.array(
        F.struct(F.lit("type").alias("k"), F.col("event_type").alias("v"), salt.alias("s")),
        F.struct(F.lit("any").alias("k"), F.lit("").alias("v"), salt.alias("s")),
    )).alias("_key"))
    enabled = subscriptions.filter("enabled").select(
        F.col("id").alias("subscription_id"), F.col("type").alias("channel"), "url", "project_key", "issue_type", "events"
    )
    exact = enabled.filter("size(events) > 0").withColumn(
        "_key", F.expr(f"explode(flatten(transform(array_distinct(events), e -> transform(sequence(0, {WILDCARD_SALTS - 1}), i -> named_struct('k', 'type', 'v', e, 's', i)))))"))
    every = enabled.filter("size(events) = 0").withColumn("_key", F.expr(
        f"explode(transform(sequence(0, {WILDCARD_SALTS - 1}), i -> named_struct('k', 'any', 'v', '', 's', i)))"))
    return left.join(exact.unionByName(every), "_key").drop("_key", "events")


def alert_payloads(alerts: DataFrame) -> DataFrame:
    """Adds the JSON body each channel expects; delivery is left to the reader of the outbox."""
    title = "replace(event_type, '_', ' ')"
    package = "package_name IS NOT NULL"
    eco = "coalesce(ecosystem, 'unknown')"
    when = "date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    # The shape of each body.
    slack = (
        "concat('{\"blocks\":[', concat_ws(',', array_compact(array("
        f"to_json(named_struct('type', 'header', 'text', named_struct('type', 'plain_text', 'text', {title}))), "
        "to_json(named_struct('type', 'section', 'text', named_struct('type', 'mrkdwn', 'text', message))), "
        f"IF({package}, to_json(named_struct('type', 'section', 'fields', array("
        "named_struct('type', 'mrkdwn', 'text', concat('*Package:* ', package_name)), "
        f"named_struct('type', 'mrkdwn', 'text', concat('*Ecosystem:* ', {eco})), "
        "named_struct('type', 'mrkdwn', 'text', concat('*Severity:* ', severity)), "
        f"named_struct('type', 'mrkdwn', 'text', concat('*Time:* ', {when}))))), NULL)))), ']}}')"
    ).replace("']}}')", "']}')")
    teams = (
        "to_json(named_struct('@type', 'MessageCard', '@context', 'http://schema.org/extensions', "
        "'themeColor', CASE severity WHEN 'critical' THEN 'FF0000' WHEN 'high' THEN 'FF8C00' ELSE 'FFD700' END, "
        f"'summary', event_type, 'sections', array(named_struct('activityTitle', {title}, 'activitySubtitle', message, "
        f"'facts', array_compact(array(IF({package}, named_struct('name', 'Package', 'value', package_name), NULL), "
        "IF(ecosystem IS NOT NULL, named_struct('name', 'Ecosystem', 'value', ecosystem), NULL), "
        f"named_struct('name', 'Severity', 'value', severity), named_struct('name', 'Time', 'value', {when})))))))"
    )
    jira = (
        "to_json(named_struct('fields', named_struct('project', named_struct('key', project_key), "
        f"'summary', concat(upper(severity), ': ', {title}, IF({package}, concat(' — ', package_name), '')), "
        f"'description', concat(message, ' | Severity: ', severity, ' | Detected at: ', {when}), "
        "'issuetype', named_struct('name', coalesce(issue_type, 'Bug')), "
        "'priority', named_struct('name', CASE severity WHEN 'critical' THEN 'Highest' WHEN 'high' THEN 'High' ELSE 'Medium' END), "
        "'labels', array('security', severity))))"
    )
    plain = (
        "to_json(named_struct('event_type', event_type, 'severity', severity, 'package_name', package_name, "
        f"'ecosystem', ecosystem, 'message', message, 'timestamp', {when}))"
    )
    return alerts.withColumn("payload", F.expr(
        f"CASE channel WHEN 'slack' THEN {slack} WHEN 'teams' THEN {teams} WHEN 'jira' THEN {jira} ELSE {plain} END"))
