"""Domain tables derived row by row from the given tables.

The column expressions read the same in Spark and in the checking database, but for a time
some days before the reference date, which is written ``@AGO{days}``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from siftlake.plans.tables import table

AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"


@dataclass(frozen=True)
class Derived:
    source: str
    columns: tuple[str, ...]
    where: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.source)
        if self.where is not None:
            df = df.filter(self.where)
        ago = rf"timestampadd(DAY, -(\1), {AS_OF})"
        return df.selectExpr(*[re.sub(r"@AGO\{([^}]*)\}", ago, c) for c in self.columns])

    @property
    def sql(self) -> str:
        ago = rf"({AS_OF} - to_days(CAST(\1 AS INTEGER)))"
        listed = ", ".join(re.sub(r"@AGO\{([^}]*)\}", ago, c) for c in self.columns)
        return f"SELECT {listed} FROM {self.source}" + (f" WHERE {self.where}" if self.where else "")


def _ecosystem(key: str) -> str:
    return f"CASE {key} % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'go' ELSE 'cargo' END"


def _package(key: str) -> str:
    return f"concat('pkg-', CAST({key} AS STRING))"


# Every part is a package; its numbers become its reputation.
SIGNALS = Derived("part", (
    f"{_ecosystem('p_partkey')} AS ecosystem", f"{_package('p_partkey')} AS name", f"{_package('p_partkey')} AS package_name",
    "p_partkey % 97 = 0 AS malware_flagged", "p_partkey % 41 = 0 AS known_hallucination", "p_partkey % 37 <> 0 AS registry_exists",
    "p_partkey % 37 <> 0 AS exists_in_registry", "p_partkey % 3 = 0 AS provenance_verified",
    "CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST(p_partkey % 4 AS INT) END AS slsa_level", "p_size % 5 = 0 AS verified_publisher",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 7919) % 1500000 * (p_partkey % 3) + p_partkey % 150 END AS weekly_downloads",
    "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 400 END AS github_stars", "p_partkey % 6 <> 0 AS has_repository",
    "CASE WHEN p_partkey % 13 = 0 THEN 'spike' ELSE 'stable' END AS download_velocity",
    "CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size * 12 END AS publisher_age_days", "CAST(p_partkey % 800 AS INT) AS package_age_days",
    "p_size % 25 AS total_versions", "p_partkey % 19 = 0 AS recent_ownership_change", "p_partkey % 23 = 0 AS version_spike",
    "CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size % 4 END AS vulnerability_count",
    "CASE p_size % 4 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'low' END AS highest_severity",
    "p_partkey % 7 = 0 AS has_install_scripts", "p_partkey % 29 = 0 AS suspicious_scripts",
    "CASE WHEN p_partkey % 9 = 0 THEN p_size % 5 END AS typosquat_distance",
    "p_partkey % 17 = 0 AS deprecated", "concat(CAST(p_size % 9 AS STRING), '.', CAST(p_size AS STRING), '.0') AS latest",
    "@AGO{p_partkey % 400} AS created_at", "concat('dev', CAST(p_size AS STRING)) AS publisher",
    "CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN concat('https://code.example/', p_name) "
    "ELSE concat('https://github.com/o', CAST(p_size AS STRING), '/r', CAST(p_partkey % 50 AS STRING), '.git') END AS repository_url",
    "CAST(p_partkey % 300 AS INT) AS readme_length",
))
# A third of the packages have one advisory, some two.
VULNERABILITIES = Derived("part", (
    "concat('ADV-', CAST(p_partkey AS STRING)) AS vuln_id", f"{_ecosystem('(p_partkey - p_partkey % 2)')} AS ecosystem",
    f"{_package('(p_partkey - p_partkey % 2)')} AS package_name",
    "CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity",
    "CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat(CAST(p_size % 4 AS STRING), '.0.0') END AS introduced",
    "CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat(CAST(p_size % 9 AS STRING), '.', CAST(p_size % 11 AS STRING), '.0') END AS fixed_version",
), where="p_partkey % 6 < 2")
# Every line item is a reference from a project to a package.
REFERENCES = Derived("lineitem", (
    "l_orderkey AS project", "l_orderkey AS file_id", "l_linenumber AS line_no", f"{_ecosystem('l_partkey')} AS ecosystem",
    f"{_package('l_partkey')} AS name",
    "concat(CAST(l_linenumber AS STRING), '.', CAST(CAST(l_quantity AS INT) % 12 AS STRING), '.', CAST(l_suppkey % 5 AS STRING)) AS version",
))
# Line items again, as publications: the part is the package, the supplier its publisher.
PUBLICATIONS = Derived("lineitem", (
    f"{_ecosystem('l_partkey')} AS ecosystem", f"{_package('l_partkey')} AS package",
    "concat(CAST(l_linenumber * (l_suppkey % 4) AS STRING), '.', CAST(CAST(l_quantity AS INT) % 3 AS STRING), '.0') AS version",
    "l_shipdate AS published_at", "concat('dev', CAST(l_suppkey % 7 AS STRING)) AS publisher", "l_orderkey * 10 + l_linenumber AS ordinal",
))
# Events as publications, for histories with many rows a day.
EVENT_PUBLICATIONS = Derived("events", (
    "'npm' AS ecosystem", "concat('pkg-', CAST(user_id % 40 AS STRING)) AS package",
    "concat(CAST(event_id % 3 AS STRING), '.', CAST(CAST(floor(value) AS BIGINT) % 20 AS STRING), '.0') AS version",
    "ts AS published_at", "event_type AS publisher", "event_id AS ordinal",
))
_EVENT_KIND = ("CASE event_type WHEN 'view' THEN 'install_checked' WHEN 'click' THEN 'hallucination_detected' WHEN 'error' THEN 'vulnerability_found' "
               "WHEN 'purchase' THEN 'package_patched' ELSE 'scan_completed' END")
# Events as telemetry.
TELEMETRY = Derived("events", (
    "event_id", f"{_EVENT_KIND} AS event_type",
    "CASE user_id % 8 WHEN 0 THEN 'vscode' WHEN 1 THEN 'cursor' WHEN 2 THEN 'windsurf' WHEN 3 THEN 'jetbrains' WHEN 4 THEN 'neovim' WHEN 5 THEN 'emacs' ELSE NULL END AS ide",
    "CASE event_id % 9 WHEN 0 THEN 'copilot' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'claude' WHEN 3 THEN 'cody' WHEN 4 THEN 'tabnine' WHEN 5 THEN 'manual' WHEN 6 THEN 'homegrown' ELSE NULL END AS ai_agent",
    f"{_ecosystem('event_id')} AS ecosystem", f"{_package('(event_id % 97)')} AS package_name",
    "CASE event_id % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'allowed' WHEN 2 THEN 'patched' ELSE 'none' END AS action_taken",
    "CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE NULL END AS severity",
    "concat('client-', CAST(user_id AS STRING)) AS client_id", "ts AS created_at", "CAST(event_id % 101 AS INT) AS trust_score",
))
# Events as crowd reports about 500 packages.
REPORTS = Derived("events", (
    "event_id AS report_id", f"{_ecosystem('(event_id % 500)')} AS ecosystem", "concat('ghost-', CAST(event_id % 500 AS STRING)) AS package_name",
    "CASE event_type WHEN 'view' THEN 'HALLUCINATION' WHEN 'click' THEN 'HALLUCINATION' WHEN 'error' THEN 'FALSE_POSITIVE' WHEN 'signup' THEN 'TYPOSQUAT' "
    "ELSE CASE WHEN event_id % 2 = 0 THEN 'MALICIOUS' ELSE 'OTHER' END END AS report_type",
    "CAST(CAST(floor(value) AS BIGINT) % 11 AS DOUBLE) / 10 AS confidence", "user_id % 9 = 0 AS confirmed_nonexistent", "ts AS created_at",
    "CASE WHEN event_id % 3 = 0 THEN concat('model-', CAST(user_id AS STRING)) END AS model",
    "CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'vscode' END AS ide", "CASE WHEN event_id % 7 = 0 THEN 'copilot' WHEN event_id % 7 = 1 THEN 'claude' END AS agent",
    "CASE WHEN event_id % 2 = 0 THEN 'chat' END AS interaction",
))
# Customers as packages under suspicion.
SUSPECTS = Derived("customer", (
    f"{_ecosystem('c_custkey')} AS ecosystem", "concat('ghost-', CAST(c_custkey AS STRING)) AS package_name",
    "CASE c_nationkey % 3 WHEN 0 THEN 'SUSPECTED' WHEN 1 THEN 'CONFIRMED' ELSE 'FALSE_POSITIVE' END AS status",
    "CAST(c_custkey % 7 AS BIGINT) AS report_count", "c_nationkey % 3 = 1 AS confirmed", "c_custkey % 31 = 0 AS claimed",
    "CAST(c_custkey % 100 AS DOUBLE) / 100 AS risk_score", "@AGO{c_custkey % 200} AS last_seen", "@AGO{c_custkey % 200 + 10} AS first_seen",
    "@AGO{c_custkey % 60} AS verified_at", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE @AGO{c_custkey % 2} END AS last_checked",
))
REGISTRY = Derived("part", (
    f"{_ecosystem('p_partkey')} AS ecosystem", "concat('ghost-', CAST(p_partkey AS STRING)) AS name", "@AGO{p_partkey % 30} AS created_at",
    "concat('dev', CAST(p_size AS STRING)) AS publisher", "concat(CAST(p_size AS STRING), '.0.0') AS latest",
    "CAST(p_partkey AS BIGINT) AS weekly_downloads", "p_partkey % 7 = 0 AS has_install_scripts",
), where="p_partkey % 5 = 0")
