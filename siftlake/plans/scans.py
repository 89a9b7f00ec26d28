"""Named queries over the rule scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import files, scan
from siftlake.operators.rule_table import rejected_rules, scan_rules
from siftlake.plans.examples import EXAMPLES
from siftlake.plans.oracle import findings_sql, lines_sql
from siftlake.plans.registry import plan
from siftlake.plans.tables import (
    pick, planted, planted_pages, planted_pages_sql, planted_sql, planted_turns, planted_turns_sql, sql_pick, sql_text, table,
)
from siftlake.rules import FAMILIES
from siftlake.session import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("lang").alias("text_lang"), "source", "text"
    )
    return spread(docs, "file_id")


def _document_lines(columns: str) -> str:
    return (
        "corpus AS (SELECT doc_id AS file_id, lang AS text_lang, source, text FROM documents), "
        f"lines AS ({lines_sql('corpus', columns=columns)})"
    )


SECRET = FAMILIES["secret"]


@plan(
    "secret_scan",
    f"WITH {_document_lines('file_id, text_lang')}, found AS ({findings_sql(SECRET, 'file_id, text_lang', False)}) "
    "SELECT text_lang, severity, rule_id, count(*) AS findings, count(DISTINCT file_id) AS files "
    "FROM found GROUP BY ALL",
    covers="A4 D1 D3 F5",
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(_documents(spark, sf_dir), SECRET)
    return found.groupBy("text_lang", "severity", "rule_id").agg(
        F.count("*").alias("findings"), F.countDistinct("file_id").alias("files")
    )


@plan(
    "secret_findings",
    f"WITH corpus AS ({planted_sql('secret')}), lines AS ({lines_sql('corpus')}), "
    f"found AS ({findings_sql(SECRET, with_evidence=True)}) SELECT * FROM found",
    covers="A4 C5 D1 D3",
)
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(planted(spark, sf_dir, "secret"), SECRET)
    return found.select("file_id", "line_no", "rule_id", "severity", "category", "evidence")


@plan(
    "secret_scan_pages",
    f"WITH corpus AS ({planted_pages_sql('secret')}), lines AS ({lines_sql('corpus', columns='file_id')}), "
    f"found AS ({findings_sql(SECRET, with_language=False, with_evidence=True)}) SELECT * FROM found",
    covers="A4 D1 D3",
)
def secret_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(planted_pages(spark, sf_dir, "secret"), SECRET)
    return found.select("file_id", "line_no", "rule_id", "severity", "category", "evidence")


def _rule_scan(name: str, family_name: str, covers: str) -> None:
    family = FAMILIES[family_name]
    framework = any(r.frameworks for r in family.rules)
    by_extension = family_name == "cli_sast"
    routed = planted_sql(family_name)
    if framework:
        # The frameworks of the planted paths.
        routed = (
            f"SELECT *, CASE WHEN path IN ('Dockerfile', 'docker/x.dockerfile') THEN 'dockerfile' "
            f"WHEN path LIKE 'infra/%' THEN 'terraform' "
            f"WHEN path LIKE '%.y%ml' AND regexp_matches(text, '(?i)\\bapiVersion\\s*:\\s*') "
            f"AND regexp_matches(text, '(?i)\\bkind\\s*:\\s*') THEN 'kubernetes' END AS framework "
            f"FROM (SELECT * REPLACE (CASE WHEN path = 'deploy/app.yaml' THEN 'apiVersion: v1' || chr(10) || "
            f"'kind: Pod' || chr(10) || text ELSE text END AS text) FROM ({routed}))"
        )
    if by_extension:
        routed = (f"SELECT * REPLACE (CASE WHEN contains(path, '.') THEN string_split(path, '.')[-1] END AS lang) "
                  f"FROM ({routed})")
    columns = "file_id, lang, framework" if framework else "file_id, lang"
    body = findings_sql(family, with_framework=framework)
    if framework:
        body += (
            "\nUNION ALL\nSELECT file_id, 1 AS line_no, 'CG_IAC_DOCKER_000' AS rule_id, 'high' AS severity, "
            "'dockerfile' AS category FROM corpus WHERE framework = 'dockerfile' "
            "AND NOT regexp_matches(text, '(?im)^\\s*USER\\s+\\S+')"
        )
    sql = f"WITH corpus AS ({routed}), lines AS ({lines_sql('corpus', columns)}) {body}"

    @plan(name, sql, covers=covers)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = planted(spark, sf_dir, family_name)
        if framework:
            manifest = F.when(F.col("path") == "deploy/app.yaml", F.lit("apiVersion: v1\nkind: Pod\n")).otherwise("")
            corpus = corpus.withColumn("text", F.concat(manifest, "text"))
            found = scan.scan_infrastructure(corpus)
        elif by_extension:
            last = F.when(F.col("path").contains("."), F.substring_index("path", ".", -1))
            found = scan.scan(corpus.withColumn("lang", last), family)
        else:
            found = scan.scan(corpus.withColumn("lang", files.guess_language(F.col("path"))), family)
        return found.select("file_id", "line_no", "rule_id", "severity", "category")


_rule_scan("rule_scan_sast", "sast", "A3 C3 C4 D1 D4")
_rule_scan("rule_scan_code_vuln", "code_vuln", "C3 C4 D4")
_rule_scan("rule_scan_cli_sast", "cli_sast", "C3 D4")
_rule_scan("rule_scan_jailbreak", "jailbreak", "D5")
_rule_scan("rule_scan_cryptojack", "cryptojack", "D6")
_rule_scan("rule_scan_iac", "iac", "A2 C3 D7")
_rule_scan("rule_scan_api", "api", "A3 C3 D8")
_rule_scan("rule_scan_model_load", "model_load", "D9")
_rule_scan("rule_scan_taint_sources", "taint_source", "M1")
_rule_scan("rule_scan_taint_sinks", "taint_sink", "M1")
_rule_scan("rule_scan_intent", "intent", "D18")
_rule_scan("rule_scan_ai_sdk_lines", "ai_sdk", "D17")


@plan(
    "rule_scan_conversations",
    f"WITH corpus AS ({planted_turns_sql('jailbreak')}), "
    f"lines AS ({lines_sql('corpus', 'conv_id, turn, role')}), "
    f"found AS ({findings_sql(FAMILIES['jailbreak'], 'conv_id, turn, role', False)} UNION ALL "
    f"{findings_sql(SECRET, 'conv_id, turn, role', False)}) SELECT * FROM found",
    covers="D3 D5 K13",
)
def rule_scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(planted_turns(spark, sf_dir, "jailbreak"), FAMILIES["jailbreak"], SECRET)
    return found.select("conv_id", "turn", "role", "line_no", "rule_id", "severity", "category")


# Pattern of a license line.
LICENSE_LINE = r"(?i)\b(?:licen[sc]e|copyright|spdx-license-identifier)\b"


@plan(
    "license_line_scan",
    f"WITH {_document_lines('file_id, source')} SELECT source, count(*) AS license_lines, "
    "count(DISTINCT file_id) AS files FROM lines WHERE regexp_matches(line, "
    + sql_text(LICENSE_LINE) + ") GROUP BY source",
    covers="A4 D2",
)
def license_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_patterns(_documents(spark, sf_dir), [LICENSE_LINE.removeprefix("(?i)")])
    return found.groupBy("source").agg(
        F.count("*").alias("license_lines"), F.countDistinct("file_id").alias("files")
    )


@plan(
    "policy_pattern_scan",
    f"WITH {_document_lines('file_id, source')} "
    "SELECT file_id, line_no, 'POLICY_PATTERN_1' AS rule_id FROM lines WHERE regexp_matches(line, '(?i)password\\s*=') "
    "UNION ALL SELECT file_id, line_no, 'POLICY_PATTERN_3' AS rule_id FROM lines WHERE regexp_matches(line, '(?i)\\bfrom\\b')",
    covers="D2",
)
def policy_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_patterns(_documents(spark, sf_dir), [r"password\s*=", "([", r"\bfrom\b"])
    return found.select("file_id", "line_no", "rule_id")


# Neighbouring words of the benchmark's passages as rules: six forms, of which one does not compile and one has no literal.
_RULES = (
    "SELECT concat('R', CAST(item_id AS STRING), '-', CAST(k AS STRING)) AS rule_id, element_at({severities}, CAST(k % 4 + 1 AS INT)) AS severity, form, "
    "CASE form WHEN 0 THEN concat(a, '\\s+', b) WHEN 1 THEN concat('\\b', a, '[ ,.]+(?:and\\s+)?', b, '\\b') WHEN 2 THEN concat('(?:', a, '|', b, 'x)\\s', b) "
    "WHEN 3 THEN concat('(', a, ' (', b) WHEN 4 THEN concat('^', substring(a, 1, 1), '[a-z]?[a-z]? ', '.?.?$') ELSE concat(a, '(?: ', b, ')+\\W') END AS pattern, a, b FROM pairs"
)
_RULE_PAIRS = "SELECT item_id, k, CAST((item_id + k) % 6 AS INT) AS form, lower(w[k]) AS a, lower(w[k + 1]) AS b"
_RULES_SQL = (
    "words AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), "
    f"pairs AS ({_RULE_PAIRS} FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM words) WHERE len(w[k]) >= 3), "
    "rules AS (" + _RULES.format(severities="['low', 'medium', 'high', 'critical']").replace("CAST(k AS STRING)", "CAST(k AS VARCHAR)").replace("element_at(", "list_extract(") + ")"
)


def _rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").selectExpr("item_id", "regexp_extract_all(text, '[A-Za-z]+', 0) AS w")
    pairs = words.selectExpr("item_id", "w", "explode(sequence(1, greatest(size(w) - 1, 1))) AS k").filter("k < size(w)")
    pairs = pairs.selectExpr("item_id", "k", "CAST((item_id + k) % 6 AS INT) AS form", "lower(element_at(w, k)) AS a", "lower(element_at(w, k + 1)) AS b").filter("length(a) >= 3")
    text = _RULES.format(severities="array('low', 'medium', 'high', 'critical')").replace("\\", "\\\\").replace("FROM pairs", "FROM {pairs}")
    return spark.sql(text, pairs=pairs).select("rule_id", "severity", "pattern")


@plan(
    "rule_table_scan",
    f"""WITH {_document_lines('file_id, source')}, {_RULES_SQL}
    SELECT rule_id, severity, count(*) AS findings, count(DISTINCT file_id) AS files, CAST(sum(length(regexp_extract(line, pattern, 0, 'i'))) AS BIGINT) AS letters
    FROM (SELECT *, lower(line) AS low FROM lines) JOIN rules ON CASE WHEN form = 3 THEN false WHEN form = 4 AND length(line) > 6 THEN false
        WHEN form <> 4 AND NOT contains(low, b) THEN false WHEN form NOT IN (2, 4) AND NOT contains(low, a) THEN false ELSE regexp_matches(line, pattern, 'i') END GROUP BY ALL""",
    covers="D2",
)
def rule_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules in a table against every line of the documents."""
    found = scan_rules(_documents(spark, sf_dir), _rule_rows(spark, sf_dir))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file_id").alias("files"), F.sum(F.col("col_end") - F.col("col_start")).alias("letters"))


@plan("rejected_rule_rows", f"WITH {_RULES_SQL} SELECT rule_id, severity, pattern FROM rules WHERE form = 3", covers="D2")
def rejected_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the same table whose patterns do not compile."""
    return rejected_rules(_rule_rows(spark, sf_dir))


_ALL_TEXT = tuple(FAMILIES)
_MIXED = tuple(e for n in _ALL_TEXT for e in EXAMPLES[n])
_MIXED_SQL = (
    f"SELECT 'documents' AS origin, CAST(doc_id AS STRING) AS file_id, text || chr(10) || {sql_pick(_MIXED, 'doc_id')} AS text FROM documents UNION ALL "
    f"SELECT 'pages', CAST(page_id AS STRING), html || chr(10) || {sql_pick(_MIXED, 'page_id * 3')} FROM pages UNION ALL "
    f"SELECT 'conversations', conv_id || ':' || turn, text || chr(10) || {sql_pick(_MIXED, 'conv_id * 11 + turn')} FROM conversations"
)
_ALL_SQL = " UNION ALL ".join(
    f"SELECT origin, '{n}' AS family, rule_id, severity FROM ({findings_sql(FAMILIES[n], 'origin', False)})" for n in _ALL_TEXT)


def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three text tables, each row with one example line of any family."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("file_id"),
        F.concat("text", F.lit("\n"), pick(_MIXED, "doc_id")).alias("text"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").cast("string").alias("file_id"),
        F.concat("html", F.lit("\n"), pick(_MIXED, "page_id * 3")).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), F.concat_ws(":", "conv_id", "turn").alias("file_id"),
        F.concat("text", F.lit("\n"), pick(_MIXED, "conv_id * 11 + turn")).alias("text"))
    return spread(docs.unionByName(pages).unionByName(turns), "file_id")


@plan(
    "scan_all_families",
    f"""WITH corpus AS ({_MIXED_SQL}), lines AS ({lines_sql('corpus', 'origin')}), found AS ({_ALL_SQL})
    SELECT origin, family, rule_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
        count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info
    FROM found GROUP BY ALL""",
    covers="D1 K13 F6",
)
def scan_all_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalogues over three text tables in one pass."""
    found = scan.scan(mixed_corpus(spark, sf_dir), *[FAMILIES[n] for n in _ALL_TEXT])
    return scan.severity_by_category(found, ["origin", "family", "rule_id"])
