"""Named queries over manifests, bills of materials, licenses, policies and scores."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import deps, drift, exports, licenses, policy, scan, scoring
from siftlake.operators.files import guess_language
from siftlake.operators.scan import quote
from siftlake.plans.derived import REFERENCES, SIGNALS, VULNERABILITIES
from siftlake.plans.oracle import findings_sql, lines_sql
from siftlake.plans.registry import plan
from siftlake.plans.streams import _workspace
from siftlake.plans.tables import fill, pick, planted, planted_sql, sql_pick, sql_text, table
from siftlake.rules import FAMILIES
from siftlake.session import read_small_files, spread
from siftlake.sources import readers, sinks

# --- manifests, one per order ---------------------------------------------------------------

_FILL = {"@A@": "CAST(o_custkey % 50 AS STRING)", "@B@": "CAST(o_orderkey % 40 AS STRING)", "@V@": "CAST(o_orderkey % 9 AS STRING)",
         "@W@": "CAST(o_custkey % 12 AS STRING)"}
PACKAGE_JSON = """{
  "name": "app-@B@",
  "dependencies": {
    "lib-@A@": "^@V@.@W@.1",
    "@scope/tool-@B@": "~@W@.0.0",
    "git-dep": "github:org/repo"
  },
  "devDependencies": {
    "test-@A@": ">=@V@.1.0 <9"
  },
  "peerDependencies": {"peer-@B@": "*"}
}"""
PACKAGE_LOCK = """{"packages":{"":{"version":"1.0.0"},"node_modules/lib-@A@":{"version":"@V@.@W@.1","license":"MIT"},"node_modules/lib-@A@/node_modules/@scope/deep-@B@":{"version":"2.@W@.0"}}}"""
REQUIREMENTS = "# pinned\nLib_@A@==@V@.@W@.0\nTool-@B@>=@W@.1,<9\n-r other.txt\nplain-@A@\nother_@B@~=1.@V@\n"
CARGO = "[package]\nname = \"x\"\n[dependencies]\nlib-@A@ = \"@V@.@W@\"\ntool-@B@ = { version = \"@W@.1\" }\n# comment\n[dev-dependencies]\nskipped = \"1\"\n"
GO_MOD = "module m\n\ngo 1.22\n\nrequire (\n\texample.com/lib-@A@ v1.@V@.@W@\n\texample.com/tool-@B@ v0.@W@.0-rc1 // indirect\n)\n\nrequire example.com/one-@A@ v2.@V@.0\n"
JS_SOURCE = "import a from 'lib-@A@';\nimport { b } from '@scope/tool-@B@/sub';\nimport './local';\nconst c = require('lib-@A@/x');\nconst d = await import('lazy-@B@');\nimport 'side-@A@';\n"
PY_SOURCE = "# import ignored\nimport os\nimport lib_@A@ as x\nfrom tool_@B@.sub import y\nfrom . import z\nimport lib_@A@\nfrom _private import q\n"


def _files(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey AS file_id", f"{fill(quote(template), _FILL)} AS text")


_O = "(SELECT o_orderkey AS file_id, {A} AS a, {B} AS b, {V} AS v, {W} AS w FROM orders)".format(
    A=_FILL["@A@"], B=_FILL["@B@"], V=_FILL["@V@"], W=_FILL["@W@"])


@plan(
    "manifest_deps",
    f"""SELECT file_id, 4 AS line_no, 'dependencies' AS section, 'lib-' || a AS name, v || '.' || w || '.1' AS version FROM {_O}
    UNION ALL SELECT file_id, 5, 'dependencies', '@scope/tool-' || b, w || '.0.0' FROM {_O} UNION ALL SELECT file_id, 6, 'dependencies', 'git-dep', NULL FROM {_O}
    UNION ALL SELECT file_id, 9, 'devDependencies', 'test-' || a, v || '.1.0 <9' FROM {_O} UNION ALL SELECT file_id, 11, 'peerDependencies', 'peer-' || b, NULL FROM {_O}""",
    covers="A5 C7 G1",
)
def manifest_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.read_package_json(_files(spark, sf_dir, PACKAGE_JSON)).select("file_id", "line_no", "section", "name", "version")


@plan(
    "lockfile_deps",
    f"""SELECT file_id, 'lib-' || a AS name, v || '.' || w || '.1' AS version, 'MIT' AS license FROM {_O}
    UNION ALL SELECT file_id, '@scope/deep-' || b, '2.' || w || '.0', NULL FROM {_O}""",
    covers="A6",
)
def lockfile_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.read_package_lock(_files(spark, sf_dir, PACKAGE_LOCK)).select("file_id", "name", "version", "license")


@plan(
    "requirements_deps",
    f"""SELECT file_id, 2 AS line_no, 'lib-' || a AS name, v || '.' || w || '.0' AS version FROM {_O} UNION ALL SELECT file_id, 3, 'tool-' || b, w || '.1' FROM {_O}
    UNION ALL SELECT file_id, 5, 'plain-' || a, NULL FROM {_O} UNION ALL SELECT file_id, 6, 'other-' || b, '1.' || v FROM {_O}""",
    covers="A7 C8",
)
def requirements_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.read_requirements(_files(spark, sf_dir, REQUIREMENTS), only_pinned_files=True).select("file_id", "line_no", "name", "version")


@plan(
    "cargo_deps",
    f"SELECT file_id, 'lib-' || a AS name, v || '.' || w AS version FROM {_O} UNION ALL SELECT file_id, 'tool-' || b, w || '.1' FROM {_O}",
    covers="A8",
)
def cargo_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.read_cargo_toml(_files(spark, sf_dir, CARGO)).select("file_id", "name", "version")


@plan(
    "gomod_deps",
    f"""SELECT file_id, 'example.com/lib-' || a AS name, 'v1.' || v || '.' || w AS version FROM {_O} UNION ALL SELECT file_id, 'example.com/tool-' || b, 'v0.' || w || '.0-rc1' FROM {_O}
    UNION ALL SELECT file_id, 'example.com/one-' || a, 'v2.' || v || '.0' FROM {_O}""",
    covers="A9",
)
def gomod_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.read_go_mod(_files(spark, sf_dir, GO_MOD)).select("file_id", "name", "version")


@plan(
    "imports_extract",
    f"""SELECT file_id, 'lib-' || a AS name, 1 AS line_no, 'npm' AS ecosystem FROM {_O} UNION ALL SELECT file_id, '@scope/tool-' || b, 2, 'npm' FROM {_O}
    UNION ALL SELECT file_id, 'lazy-' || b, 5, 'npm' FROM {_O} UNION ALL SELECT file_id, 'side-' || a, 6, 'npm' FROM {_O}
    UNION ALL SELECT file_id, 'lib-' || a, 3, 'pypi' FROM {_O} UNION ALL SELECT file_id, 'tool-' || b, 4, 'pypi' FROM {_O}""",
    covers="C8 C9 H7",
)
def imports_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    js, py = deps.js_imports(_files(spark, sf_dir, JS_SOURCE)), deps.python_imports(_files(spark, sf_dir, PY_SOURCE))
    return js.unionByName(py)


_COMMANDS = ("npm install -D lib-@A@@^@V@.0 @scope/tool-@B@", "pip install -r x.txt Lib_@A@>=@V@.1 tool-@B@", "cargo add lib-@A@ --dev", "yarn add lib-@A@", "ls -la lib-@A@")


@plan(
    "install_commands",
    f"""WITH c AS (SELECT *, file_id % 5 AS k FROM {_O}) SELECT file_id, 'npm' AS manager, 'npm' AS ecosystem, true AS is_dev, unnest(['lib-' || a, '@scope/tool-' || b]) AS name FROM c WHERE k = 0
    UNION ALL SELECT file_id, 'pip', 'pypi', false, unnest(['Lib_' || a, 'tool-' || b]) FROM c WHERE k = 1 UNION ALL SELECT file_id, 'cargo', 'cargo', true, 'lib-' || a FROM c WHERE k = 2
    UNION ALL SELECT file_id, 'yarn', 'npm', false, 'lib-' || a FROM c WHERE k = 3""",
    covers="H9",
)
def install_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "orders").withColumn("_t", pick(_COMMANDS, "o_orderkey"))
    commands = chosen.selectExpr("o_orderkey AS file_id", f"{fill('_t', _FILL)} AS command")
    return deps.parse_install_commands(commands).select("file_id", "manager", "ecosystem", "is_dev", "name")


# --- resolution and bills of materials -----------------------------------------------------------

_REFS_SQL = REFERENCES.sql
_FIRST_SQL = f"SELECT project, ecosystem, name, arg_min(version, (line_no, version)) AS version FROM ({_REFS_SQL}) WHERE {{}} GROUP BY ALL"


@plan(
    "resolve_versions",
    f"""WITH r AS (SELECT DISTINCT project, ecosystem, name FROM ({_REFS_SQL})), m AS ({_FIRST_SQL.format('line_no % 3 = 1')}), k AS ({_FIRST_SQL.format('line_no % 3 = 2')}),
    g AS (SELECT ecosystem, name, latest, deprecated FROM ({SIGNALS.sql}) WHERE registry_exists)
    SELECT r.project, r.ecosystem, r.name, coalesce(m.version, k.version, g.latest) AS version,
        CASE WHEN m.version IS NOT NULL THEN 'manifest' WHEN k.version IS NOT NULL THEN 'lockfile' WHEN g.latest IS NOT NULL THEN 'registry-latest' ELSE 'none' END AS version_source,
        m.version IS NULL AND k.version IS NULL AND coalesce(g.deprecated, false) AS is_deprecated
    FROM r LEFT JOIN m USING (project, ecosystem, name) LEFT JOIN k USING (project, ecosystem, name) LEFT JOIN g USING (ecosystem, name)""",
    covers="E10 J9",
)
def resolve_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = REFERENCES.frame(spark, sf_dir)
    keys = ["project", "ecosystem", "name"]
    manifest, lock = (deps.first_per_key(refs.filter(f"line_no % 3 = {n}"), keys, ["line_no", "version"]).select(*keys, "version") for n in (1, 2))
    registry = SIGNALS.frame(spark, sf_dir).filter("registry_exists").select("ecosystem", "name", "latest", "deprecated")
    return deps.resolve_versions(refs.select(*keys).distinct(), manifest, lock, registry)


_LICENSES = ("MIT", "Apache-2.0 OR MIT", "GPL-3.0-only", "(LGPL-2.1 AND MIT)", "agpl-3.0-only", "SSPL-1.0", "UNLICENSED", "Custom", "", "GPL", "BSD 3-Clause",
             "GPL-2.0 WITH Classpath-exception-2.0", "SEE_LICENSE_IN_FILE")
_PURL_SQL = "'pkg:' || CASE ecosystem WHEN 'go' THEN 'golang' ELSE ecosystem END || '/' || name || '@' || version"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = REFERENCES.frame(spark, sf_dir).select(
        "project", F.col("line_no").alias("source_order"), "ecosystem", "name", "version", pick(_LICENSES, "project").alias("license"), F.expr("line_no % 2 = 0 AS dev"))
    return deps.build_sbom(parts)


_SBOM_SQL = f"""SELECT project, {_PURL_SQL} AS bom_ref, ecosystem, name, version, {sql_pick(_LICENSES, 'project')} AS license, arg_min(line_no % 2 = 0, line_no) AS dev
    FROM ({_REFS_SQL}) GROUP BY project, bom_ref, ecosystem, name, version, license"""


@plan("build_sbom", _SBOM_SQL, covers="K21 J9")
def build_sbom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).drop("purl")


@plan(
    "sbom_vulnerabilities",
    f"SELECT DISTINCT project, bom_ref, vuln_id, severity AS vuln_severity FROM ({_SBOM_SQL}) c JOIN ({VULNERABILITIES.sql}) v ON v.ecosystem = c.ecosystem AND lower(v.package_name) = lower(c.name)",
    covers="K21",
)
def sbom_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deps.attach_vulnerabilities(_components(spark, sf_dir), VULNERABILITIES.frame(spark, sf_dir))
    return found.select("project", "bom_ref", "vuln_id", "vuln_severity")


# Baseline and current snapshot: the same components by (project, name), some changed, some on one side only.
_SNAP = (f"(SELECT l_orderkey % 1000 AS project, 'npm' AS ecosystem, 'pkg-' || (l_partkey % 60) AS name, arg_min(CAST(l_linenumber AS STRING) || '.' || (l_suppkey % 10) || '.0', (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS version, "
         "arg_min(['MIT','Apache-2.0','GPL-3.0','ISC'][l_suppkey % 4 + 1], (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS license FROM lineitem WHERE l_linenumber % 2 = {} GROUP BY ALL)")


def _snapshot(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(f"l_linenumber % 2 = {odd}").selectExpr(
        "l_orderkey % 1000 AS project", "'npm' AS ecosystem", "concat('pkg-', l_partkey % 60) AS name", "concat(l_linenumber, '.', l_suppkey % 10, '.0') AS version",
        "element_at(array('MIT', 'Apache-2.0', 'GPL-3.0', 'ISC'), CAST(l_suppkey % 4 + 1 AS INT)) AS license", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = deps.first_per_key(rows, ["project", "ecosystem", "name"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return first.select("project", F.expr("concat('pkg:npm/', name, '@', version)").alias("bom_ref"), "ecosystem", "name", "version", "license")


_LR = "CASE {}.license WHEN 'GPL-3.0' THEN 4 WHEN 'Apache-2.0' THEN 2 ELSE 1 END"
_VK = "list_transform(string_split({}.version, '.'), lambda x: CAST(x AS BIGINT))"
_DRIFT_SQL = f"""j AS (SELECT project, name, b, c FROM {_SNAP.format(1)} b FULL OUTER JOIN {_SNAP.format(0)} c USING (project, ecosystem, name)),
    drift AS (SELECT project, name, 'added' AS change, 'medium' AS severity, NULL AS previous, c.version AS current FROM j WHERE b.version IS NULL
    UNION ALL SELECT project, name, 'removed', 'info', b.version, NULL FROM j WHERE c.version IS NULL
    UNION ALL SELECT project, name, 'version_changed', CASE WHEN {_VK.format('c')} < {_VK.format('b')} THEN 'high' ELSE 'low' END, b.version, c.version FROM j WHERE b.version <> c.version
    UNION ALL SELECT project, name, 'license_changed', CASE WHEN {_LR.format('c')} > {_LR.format('b')} THEN 'high' ELSE 'medium' END, b.license, c.license FROM j WHERE b.license <> c.license)"""


@plan("sbom_drift", f"WITH {_DRIFT_SQL} SELECT * FROM drift", covers="A14 E14 H5 K3 P9")
def sbom_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.sbom_drift(_snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 0)).drop("ecosystem")


@plan(
    "sbom_drift_report",
    f"""WITH {_DRIFT_SQL} SELECT project, count(*) AS total_changes, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
        count(*) FILTER (WHERE change = 'version_changed') AS version_changed, count(*) FILTER (WHERE change = 'license_changed') AS license_changed,
        bool_or(severity IN ('critical', 'high')) AS has_high_risk_changes FROM drift GROUP BY ALL""",
    covers="K3",
)
def sbom_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(drift.sbom_drift(_snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 0)))


_PN = "SELECT DISTINCT project, name FROM {}"


@plan("new_packages", f"{_PN.format(_SNAP.format(0))} EXCEPT {_PN.format(_SNAP.format(1))}", covers="K15")
def new_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.only_in(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), ["project", "name"])


@plan("common_packages", f"{_PN.format(_SNAP.format(0))} INTERSECT {_PN.format(_SNAP.format(1))}", covers="K16")
def common_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.in_both(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), ["project", "name"])


@plan("union_package_names", f"SELECT name FROM {_SNAP.format(0)} UNION SELECT package_name FROM ({VULNERABILITIES.sql})", covers="K14")
def union_package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    vulnerable = VULNERABILITIES.frame(spark, sf_dir).select(F.col("package_name").alias("name"))
    return drift.union_names(_snapshot(spark, sf_dir, 0), vulnerable, ["name"])


# --- licenses ----------------------------------------------------------------------------------------

# The findings each of the planted licenses has under the default policy with an MIT project.
_LICENSE_RESULTS = {
    "GPL-3.0-only": (("CG_LIC_020", "high"),), "agpl-3.0-only": (("CG_LIC_021", "high"), ("CG_LIC_040", "high")),
    "SSPL-1.0": (("CG_LIC_022", "critical"), ("CG_LIC_040", "high")), "UNLICENSED": (("CG_LIC_023", "high"),), "Custom": (("CG_LIC_002", "medium"),),
    "": (("CG_LIC_001", "high"),), "GPL": (("CG_LIC_020", "high"), ("CG_LIC_030", "medium")),
    "GPL-2.0 WITH Classpath-exception-2.0": (("CG_LIC_020", "high"), ("CG_LIC_040", "high")), "SEE_LICENSE_IN_FILE": (("CG_LIC_024", "medium"),),
}
_LICENSE_VALUES = ", ".join(f"({sql_text(k)}, '{r}', '{s}')" for k, v in _LICENSE_RESULTS.items() for r, s in v)


@plan(
    "license_findings",
    f"""SELECT s_suppkey, l AS license, rule_id, severity FROM (SELECT s_suppkey, {sql_pick(_LICENSES, 's_suppkey')} AS l FROM supplier)
    JOIN (VALUES {_LICENSE_VALUES}) v(l2, rule_id, severity) ON l = l2""",
    covers="E17 H8 K6 P8",
)
def license_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "supplier").select("s_suppkey", pick(_LICENSES, "s_suppkey").alias("license"))
    return licenses.license_findings(declared, licenses.LicensePolicy(project_license="MIT")).drop("resolved")


_PROJECT_LICENSES, _DEPENDENCY_LICENSES = ("MIT", "Apache-2.0", "UNLICENSED", "GPL-3.0-only"), ("GPL-2.0-only", "AGPL-3.0-only", "SSPL-1.0", "MIT", "MPL-2.0")


@plan(
    "license_compat",
    f"""SELECT s_suppkey, p AS project_license, d AS dependency_license, (p IN ('MIT', 'Apache-2.0') AND d IN ('GPL-2.0-only', 'SSPL-1.0')) OR (p <> 'GPL-3.0-only' AND d = 'AGPL-3.0-only') AS incompatible
    FROM (SELECT s_suppkey, {sql_pick(_PROJECT_LICENSES, 's_suppkey')} AS p, {sql_pick(_DEPENDENCY_LICENSES, 's_suppkey')} AS d FROM supplier)""",
    covers="K7",
)
def license_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "supplier").select(
        "s_suppkey", pick(_PROJECT_LICENSES, "s_suppkey").alias("project_license"), pick(_DEPENDENCY_LICENSES, "s_suppkey").alias("dependency_license"))
    return pairs.withColumn("incompatible", F.expr(licenses.incompatible("project_license", "dependency_license")))


# --- policies -------------------------------------------------------------------------------------------

_POLICY = policy.Policy(
    mode="enforce", block_unprovenanced_packages=True, required_provenance_level="partial", max_allowed_severity="medium",
    forbidden_packages=("pkg-7", "pkg-11@2.11.0"), allowed_packages=("pkg-14",), max_critical_findings=2, max_high_findings=5, max_ai_code_ratio=0.6,
    require_sbom_baseline=True, require_secrets_scanner=True, require_sast_scanner=True, max_mcp_issues=3, require_ai_sbom=True, allowed_ai_sdks=("OpenAI SDK", "LangChain"))
_PKG = ("name", "latest AS version", "CASE WHEN provenance_verified THEN 'verified' WHEN has_repository THEN 'partial' ELSE 'none' END AS provenance", "highest_severity AS max_severity")


@plan(
    "policy_package",
    f"""WITH p AS (SELECT {', '.join(_PKG)} FROM ({SIGNALS.sql}) WHERE name <> 'pkg-14')
    SELECT name, 'forbidden_packages' AS rule, 'error' AS severity FROM p WHERE name = 'pkg-7' OR name || '@' || version = 'pkg-11@2.11.0'
    UNION ALL SELECT name, 'block_unprovenanced_packages', 'error' FROM p WHERE provenance = 'none' UNION ALL SELECT name, 'required_provenance_level', 'error' FROM p WHERE provenance = 'none'
    UNION ALL SELECT name, 'max_allowed_severity', 'error' FROM p WHERE max_severity IN ('high', 'critical')""",
    covers="C2 E16 K8",
)
def policy_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.package_violations(SIGNALS.frame(spark, sf_dir).selectExpr(*_PKG), _POLICY).select("name", "rule", "severity")


_PROJ = ("c_custkey AS project", "c_custkey % 5 AS critical_findings", "c_custkey % 8 AS high_findings", "CAST(c_custkey % 10 AS DOUBLE) / 10 AS ai_code_ratio",
         "c_custkey % 3 <> 0 AS sbom_baseline_exists", "c_custkey % 7 <> 0 AS secrets_scanner_enabled", "c_custkey % 11 <> 0 AS sast_scanner_enabled", "c_custkey % 6 AS mcp_issues", "c_custkey % 4 <> 0 AS ai_sbom_exists")


@plan(
    "policy_full",
    f"""WITH p AS (SELECT {', '.join(_PROJ)} FROM customer), v AS (
        SELECT project, 'error' AS s FROM p WHERE critical_findings > 2 UNION ALL SELECT project, 'error' FROM p WHERE high_findings > 5 UNION ALL SELECT project, 'error' FROM p WHERE ai_code_ratio > 0.6
        UNION ALL SELECT project, 'error' FROM p WHERE NOT sbom_baseline_exists UNION ALL SELECT project, 'warning' FROM p WHERE NOT secrets_scanner_enabled
        UNION ALL SELECT project, 'warning' FROM p WHERE NOT sast_scanner_enabled UNION ALL SELECT project, 'error' FROM p WHERE mcp_issues > 3
        UNION ALL SELECT project, 'error' FROM p WHERE NOT ai_sbom_exists UNION ALL SELECT project, 'error' FROM p WHERE project % 9 = 0)
    SELECT project, count(s) AS violations, count(*) FILTER (WHERE s = 'error') AS errors, count(*) FILTER (WHERE s = 'error') = 0 AS passed FROM p LEFT JOIN v USING (project) GROUP BY project""",
    covers="K8",
)
def policy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").selectExpr(*_PROJ, "IF(c_custkey % 9 = 0, array('OpenAI SDK', 'CrewAI'), array('LangChain')) AS ai_sdks")
    return policy.passed(projects, policy.project_violations(projects, _POLICY))


@plan(
    "forbidden_packages",
    f"""WITH f AS (SELECT 'pkg-' || p_partkey AS k FROM part WHERE p_partkey % 50 = 3 UNION SELECT 'pkg-' || p_partkey || '@1.' || (p_size % 12) || '.2' FROM part WHERE p_partkey % 10 = 1),
    a AS (SELECT 'pkg-' || p_partkey AS k FROM part WHERE p_partkey % 100 = 3)
    SELECT DISTINCT project, name, version FROM ({_REFS_SQL}) WHERE (lower(name) IN (SELECT k FROM f) OR lower(name || '@' || version) IN (SELECT k FROM f)) AND lower(name) NOT IN (SELECT k FROM a)""",
    covers="E16",
)
def forbidden_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    forbidden = part.filter("p_partkey % 50 = 3").selectExpr("concat('pkg-', p_partkey) AS package").union(
        part.filter("p_partkey % 10 = 1").selectExpr("concat('pkg-', p_partkey, '@1.', p_size % 12, '.2')"))
    allowed = part.filter("p_partkey % 100 = 3").selectExpr("concat('pkg-', p_partkey) AS name")
    return policy.forbidden_packages(REFERENCES.frame(spark, sf_dir).select("project", "name", "version"), forbidden, allowed)


# --- scores ---------------------------------------------------------------------------------------------

_CATS = tuple(scoring.DEDUCTIONS)
_SIGNALS = ("l_orderkey AS project", "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATS)) + " END AS category",
            "CASE l_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity", "CAST(CAST(l_quantity AS INT) % 8 AS BIGINT) AS count")
_POINTS_SQL = "CASE " + " ".join(f"WHEN category = '{c}' AND severity = '{s}' THEN {p}" for c, row in scoring.DEDUCTIONS.items() for s, p in row.items()) + " END * least(count, 5)"


@plan(
    "security_score",
    f"""WITH s AS (SELECT *, {_POINTS_SQL} AS p FROM (SELECT {', '.join(_SIGNALS)} FROM lineitem)),
    t AS (SELECT project, sum(p) AS a, sum(CASE WHEN category IN ('dependency', 'hallucination') THEN p ELSE 0 END) AS d, sum(CASE WHEN category = 'secret' THEN p ELSE 0 END) AS x,
        sum(CASE WHEN category = 'code' THEN p ELSE 0 END) AS c, sum(CASE WHEN category = 'provenance' THEN p ELSE 0 END) AS v FROM s GROUP BY ALL)
    SELECT project, CAST(greatest(0, 100 - a) AS INT) AS score, CAST(floor(greatest(0, 100 - d * 1.5::DOUBLE) + 0.5) AS INT) AS dependencies_score,
        CAST(floor(greatest(0, 100 - x * 2.0::DOUBLE) + 0.5) AS INT) AS secrets_score, CAST(floor(greatest(0, 100 - c * 1.2::DOUBLE) + 0.5) AS INT) AS code_score, CAST(greatest(0, 100 - v) AS INT) AS provenance_score,
        CASE WHEN a <= 10 THEN 'A' WHEN a <= 25 THEN 'B' WHEN a <= 40 THEN 'C' WHEN a <= 60 THEN 'D' ELSE 'F' END AS grade FROM t""",
    covers="K4",
)
def security_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.security_score(table(spark, sf_dir, "lineitem").selectExpr(*_SIGNALS))


_SNAPSHOTS = ("user_id AS project", "ts", "event_id AS snapshot_id", "CAST(floor(value) AS BIGINT) % 101 AS score")


@plan(
    "score_trend",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, snapshot_id DESC) AS n FROM (SELECT {', '.join(_SNAPSHOTS)} FROM events)),
    t AS (SELECT project, avg(score) FILTER (WHERE n <= 5) AS recent, avg(score) FILTER (WHERE n BETWEEN 6 AND 10) AS previous FROM r WHERE n <= 10 GROUP BY ALL)
    SELECT *, CASE WHEN previous IS NULL THEN 'stable' WHEN recent - previous > 3 THEN 'improving' WHEN recent - previous < -3 THEN 'declining' ELSE 'stable' END AS trend FROM t""",
    covers="J7",
)
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_trend(table(spark, sf_dir, "events").selectExpr(*_SNAPSHOTS))


@plan(
    "keep_last_snapshots",
    f"SELECT project, snapshot_id, score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, snapshot_id DESC) AS n FROM (SELECT {', '.join(_SNAPSHOTS)} FROM events)) WHERE n <= 20",
    covers="J8",
)
def keep_last_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.keep_last(table(spark, sf_dir, "events").selectExpr(*_SNAPSHOTS), 20).select("project", "snapshot_id", "score")


# --- findings of a scan ---------------------------------------------------------------------------------

_FOUND_SQL = f"WITH corpus AS ({planted_sql('secret')}), lines AS ({lines_sql('corpus', columns='file_id, lang, source')}), found AS ({findings_sql(FAMILIES['secret'], 'file_id, source')})"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(planted(spark, sf_dir, "secret"), FAMILIES["secret"])


@plan(
    "scan_gate",
    f"""{_FOUND_SQL} SELECT source, count(*) AS total_findings, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
        count(*) FILTER (WHERE severity = 'critical') > 0 OR count(*) FILTER (WHERE severity = 'high') > 0 AS failed,
        greatest(0, 100 - 15 * count(*) FILTER (WHERE severity = 'critical') - 5 * count(*) FILTER (WHERE severity <> 'critical')) AS context_score FROM found GROUP BY ALL""",
    covers="F5 F19 F21",
)
def scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = scan.security_context_score(scan.summarize(_found(spark, sf_dir), ["source"]))
    return scan.gate(summary, "pre-commit").select("source", "total_findings", "critical", "high", "failed", "context_score")


@plan(
    "severity_threshold",
    f"{_FOUND_SQL} SELECT severity, count(*) AS findings FROM found WHERE severity IN ('critical', 'high') GROUP BY ALL",
    covers="C1 K20",
)
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.severity_at_least(_found(spark, sf_dir), "high").groupBy("severity").agg(F.count("*").alias("findings"))


@plan(
    "severity_by_category",
    f"""{_FOUND_SQL} SELECT rule_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
        0 AS low, 0 AS info FROM found GROUP BY ALL""",
    covers="F6",
)
def severity_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.severity_by_category(_found(spark, sf_dir), ["rule_id"])


@plan(
    "finding_density",
    f"""{_FOUND_SQL}, l AS (SELECT source, count(*) AS lines FROM lines GROUP BY ALL), f AS (SELECT source, count(*) AS n FROM found GROUP BY ALL)
    SELECT source, lines, coalesce(n, 0) AS findings, round(coalesce(n, 0) * 1000.0 / lines, 4) AS per_thousand_lines FROM l LEFT JOIN f USING (source)""",
    covers="D19",
)
def finding_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = planted(spark, sf_dir, "secret")
    return scan.finding_density(scan.scan(corpus, FAMILIES["secret"]), corpus, ["source"])


@plan(
    "findings_by_label",
    f"{_FOUND_SQL} SELECT quality, toxic, severity, count(*) AS findings FROM found JOIN labels ON doc_id = file_id GROUP BY ALL",
    covers="F6",
)
def findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")
    return _found(spark, sf_dir).join(labels, "file_id").groupBy("quality", "toxic", "severity").agg(F.count("*").alias("findings"))


_MERGE_SQL = f"""WITH corpus AS ({planted_sql('sast')}), lines AS ({lines_sql('corpus')}), a AS ({findings_sql(FAMILIES['sast'])}), b AS ({findings_sql(FAMILIES['code_vuln'])}),
    pn AS (SELECT * FROM (VALUES {', '.join(f"({sql_text(r.rule_id)}, lower({sql_text(r.title)}))" for r in FAMILIES['sast'].rules)}) x(rule_id, title)),
    sn AS (SELECT * FROM (VALUES {', '.join(f"({sql_text(r.rule_id)}, lower({sql_text(r.title.split(' ')[0])}))" for r in FAMILIES['code_vuln'].rules)}) x(rule_id, word))"""


@plan(
    "merge_detectors",
    f"""{_MERGE_SQL} SELECT file_id, line_no, rule_id FROM a UNION ALL SELECT file_id, line_no, rule_id FROM b JOIN sn USING (rule_id)
    WHERE NOT EXISTS (SELECT 1 FROM a JOIN pn USING (rule_id) WHERE a.file_id = b.file_id AND a.line_no = b.line_no AND contains(pn.title, sn.word))""",
    covers="E24",
)
def merge_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = planted(spark, sf_dir, "sast").withColumn("lang", guess_language(F.col("path")))
    merged = scan.merge_detectors(scan.scan(corpus, FAMILIES["sast"]), scan.scan(corpus, FAMILIES["code_vuln"]))
    return merged.select("file_id", "line_no", "rule_id")


# --- documents ------------------------------------------------------------------------------------------


@plan(
    "sarif_export",
    f"{_FOUND_SQL} SELECT source AS project, count(*) AS results, count(DISTINCT rule_id) AS rules FROM found GROUP BY ALL",
    covers="B1 B2",
)
def sarif_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).withColumnRenamed("source", "project").withColumn("fix", F.lit(None).cast("string"))
    pieces = exports.to_sarif(found)
    rows = pieces.filter("section IN (1, 3)").select("project", "section", F.from_json(F.ltrim("text", F.lit(",")), "ruleId STRING, id STRING").alias("_r"))
    return rows.groupBy("project").agg(F.count("_r.ruleId").alias("results"), F.count("_r.id").alias("rules"))


@plan(
    "cyclonedx_export",
    f"SELECT project, name, version FROM ({_SBOM_SQL})",
    covers="A14 B3",
)
def cyclonedx_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = exports.to_cyclonedx(_components(spark, sf_dir)).filter("section = 1")
    parsed = pieces.withColumn("_c", F.from_json(F.ltrim("text", F.lit(",")), "name STRING, version STRING"))
    return parsed.select("project", "_c.name", "_c.version")


_SARIF = ("version STRING, runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<rules: ARRAY<STRUCT<id: STRING>>>>, results: ARRAY<STRUCT<ruleId: STRING, level: STRING, "
          "locations: ARRAY<STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT>>>>>>>>")


@plan(
    "sarif_files",
    f"""WITH corpus AS (SELECT *, source || '-' || (file_id // 100) AS project FROM ({planted_sql('secret')})), lines AS ({lines_sql('corpus', columns='file_id, project, path, lang')}),
    found AS ({findings_sql(FAMILIES['secret'], 'file_id, project, path', False)}), n AS (SELECT project, count(DISTINCT rule_id) AS rules FROM found GROUP BY ALL)
    SELECT project, '2.1.0' AS version, rules, rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
        path AS uri, line_no, count(*) AS results FROM found JOIN n USING (project) GROUP BY ALL""",
    covers="B1 B2",
)
def sarif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SARIF log per project, written as a file, read back whole and parsed."""
    path = os.path.join(_workspace(spark), "sarif")
    corpus = planted(spark, sf_dir, "secret").withColumn("project", F.expr("concat(source, '-', CAST(file_id div 100 AS STRING))")).withColumn("lang", guess_language(F.col("path")))
    found = scan.scan(corpus, FAMILIES["secret"]).withColumn("fix", F.lit(None).cast("string"))
    sinks.write_documents(exports.to_sarif(found), path)
    logs = readers.whole_texts(spark, path, "project").select("project", F.from_json("text", _SARIF).alias("log"))
    runs = logs.select("project", "log.version", F.inline("log.runs"))
    results = runs.select("project", "version", F.size("tool.driver.rules").cast("long").alias("rules"), F.explode("results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    flat = results.select("project", "version", "rules", F.col("r.ruleId").alias("rule_id"), "r.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line_no"))
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("results"))


_SUPPLIED = tuple(c if c != "l_orderkey AS project" else "l_suppkey AS project" for c in REFERENCES.columns)


@plan(
    "cyclonedx_files",
    f"""SELECT project, 'CycloneDX' AS format, name, version, count(*) AS components, min(license) AS license
    FROM (SELECT DISTINCT project, ecosystem, name, version, {sql_pick(_LICENSES, 'project')} AS license FROM (SELECT {', '.join(_SUPPLIED)} FROM lineitem)) GROUP BY ALL""",
    covers="A14 B3 K21",
)
def cyclonedx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CycloneDX document per project, written as a file and read with the reader of such documents."""
    path = os.path.join(_workspace(spark), "bom")
    parts = table(spark, sf_dir, "lineitem").selectExpr(*_SUPPLIED).select(
        "project", F.col("line_no").alias("source_order"), "ecosystem", "name", "version", pick(_LICENSES, "project").alias("license"), F.expr("line_no % 2 = 0 AS dev"))
    # One task writes a project's file: dealt out by project once, here, its parts need no other shuffle on the way, and its pieces no other order.
    sinks.write_documents(exports.to_cyclonedx(deps.build_sbom(parts.repartition("project"))), path, dealt=True, in_order=True)
    documents = read_small_files(spark, lambda reader: reader.schema(f"{readers.SBOM_SCHEMA}, project LONG").json(path, multiLine=True))
    flat = documents.select("project", F.col("bomFormat").alias("format"), F.explode("components").alias("c"))
    return flat.groupBy("project", "format", "c.name", "c.version").agg(F.count("*").alias("components"), F.min(F.col("c.licenses")[0]["license"]["id"]).alias("license"))


@plan(
    "compliance_csv",
    f"""SELECT 'Vulnerability' AS section, coalesce(vuln_id, '') AS a, coalesce(package_name, '') AS b, severity AS c, count(*) AS n FROM ({VULNERABILITIES.sql}) GROUP BY ALL
    UNION ALL SELECT 'Dependency', latest, name, CAST(provenance_verified AS VARCHAR), count(*) FROM ({SIGNALS.sql}) GROUP BY ALL
    UNION ALL SELECT 'Hallucination', ecosystem, name, 'quoted "a, b"', count(*) FROM ({SIGNALS.sql}) WHERE known_hallucination GROUP BY ALL
    UNION ALL SELECT 'Summary', 'Dependencies', CAST(count(*) AS VARCHAR), '', 1 FROM ({SIGNALS.sql})""",
    covers="B4",
)
def compliance_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sectioned table written as CSV, read back and compared row by row."""
    path = os.path.join(_workspace(spark), "compliance")
    signals, known = SIGNALS.frame(spark, sf_dir), VULNERABILITIES.frame(spark, sf_dir)
    written = exports.compliance_table(
        known.selectExpr("vuln_id AS id", "package_name AS package", "ecosystem", "severity", "'open' AS status"),
        signals.selectExpr("name AS package", "latest AS version", "provenance_verified AS provenance", "vulnerability_count AS vulnerabilities"),
        signals.filter("known_hallucination").selectExpr("name AS package", "ecosystem", "'quoted \"a, b\"' AS ai_agent"),
        signals.agg(F.count("*").alias("value")).selectExpr("'Dependencies' AS metric", "value"))
    sinks.write_compliance_csv(written, path)
    schema = ", ".join(f"{c} STRING" for c in written.columns if c != "section")
    rows = spark.read.schema(f"{schema}, section STRING").csv(path, header=True, escape="\\")
    first = {"Vulnerability": ("id", "package", "severity"), "Dependency": ("version", "package", "provenance"), "Hallucination": ("ecosystem", "package", "ai_agent"), "Summary": ("metric", "value", "id")}

    def column(i: int):
        chosen = F.lit(None).cast("string")
        for section, names in first.items():
            chosen = F.when(F.col("section") == section, F.col(names[i])).otherwise(chosen)
        return F.coalesce(chosen, F.lit(""))

    return rows.groupBy("section", *[column(i).alias(c) for i, c in enumerate("abc")]).agg(F.count("*").alias("n"))


@plan(
    "compliance_export",
    f"""SELECT 'Vulnerability' AS section, count(*) AS "rows" FROM ({VULNERABILITIES.sql}) UNION ALL SELECT 'Dependency', count(*) FROM ({SIGNALS.sql})
    UNION ALL SELECT 'Hallucination', count(*) FROM ({SIGNALS.sql}) WHERE known_hallucination UNION ALL SELECT 'Summary', 1""",
    covers="B4",
)
def compliance_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, advisories = SIGNALS.frame(spark, sf_dir), VULNERABILITIES.frame(spark, sf_dir)
    sections = exports.compliance_table(
        advisories.selectExpr("vuln_id AS id", "package_name AS package", "ecosystem", "severity", "'open' AS status"),
        signals.selectExpr("name AS package", "latest AS version", "provenance_verified AS provenance", "vulnerability_count AS vulnerabilities"),
        signals.filter("known_hallucination").selectExpr("name AS package", "ecosystem", "created_at AS detected_at"),
        signals.agg(F.count("*").alias("value")).selectExpr("'Dependencies' AS metric", "value"))
    return sections.groupBy("section").agg(F.count("*").alias("rows"))
