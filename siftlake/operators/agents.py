"""AI tooling: configuration text, tool-server configuration, component discovery, intent checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.versions import satisfies
from siftlake.operators.files import base_name
from siftlake.operators.scan import _hits, _or, may_match, quote, scan, scan_text_once, to_lines
from siftlake.operators.sequences import consecutive
from siftlake.rules import agents as catalogue
from siftlake.rules.model import Rule, jvm_regex
from siftlake.rules.prompts import AI_CONFIG, HIDDEN_CHARACTERS, HIDDEN_TEXT
from siftlake.rules.scripts import (
    CODE_IMPORT, CURRENCY_CODE, INSTALL_SCRIPT, INTENT, INTENT_KEYWORDS, NETWORK_CODE, PERMISSION, SUSPICIOUS_IMPORTS,
)
from siftlake.vocab import local_table

# --- AI configuration text ---------------------------------------------------------------

LONG_LINE, PRINTABLE_SHARE = 500, 0.8


def scan_ai_config(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Injection patterns, every hidden character, and long lines of mostly unprintable text."""
    rest = [c for c in corpus.columns if c != text]
    patterns = scan(corpus, AI_CONFIG, text=text).select(
        *rest, "line_no", "rule_id", "severity", "category", "col_start", "evidence")
    names = "map(" + ", ".join(f"{quote(c)}, {quote(n)}" for c, n in HIDDEN_CHARACTERS) + ")"

    def hides(column: str) -> str:
        return _or(f"contains({column}, {quote(c)})" for c, _ in HIDDEN_CHARACTERS)

    suspect = corpus.filter(f"{hides(f'`{text}`')} OR exists(split(`{text}`, '\\n'), l -> length(l) > {LONG_LINE})")
    lines = to_lines(suspect, text=text)
    characters = lines.filter(hides("line")).selectExpr(*rest, "line_no", "posexplode(split(line, '')) AS (_pos, _char)")
    hidden = characters.filter(f"contains({quote(HIDDEN_TEXT)}, _char) AND _char <> ''").selectExpr(
        *rest, "line_no", "'AICFG_HIDDEN' AS rule_id", "'critical' AS severity", "'hidden-unicode' AS category",
        "_pos + 1 AS col_start", f"{names}[_char] AS evidence")
    share = "length(regexp_replace(line, '[^\\\\x20-\\\\x7E]', '')) / length(line)"
    dense = lines.filter(f"length(line) > {LONG_LINE} AND {share} < {PRINTABLE_SHARE}").selectExpr(
        *rest, "line_no", "'AICFG_DENSE' AS rule_id", "'high' AS severity", "'obfuscated-payload' AS category",
        "1 AS col_start", "concat(substring(line, 1, 60), '...') AS evidence")
    return patterns.unionByName(hidden).unionByName(dense)


def sanitize_hidden(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Text without hidden characters, and how many were removed."""
    rest = [c for c in corpus.columns if c != text]
    cleaned = f"translate(`{text}`, {quote(HIDDEN_TEXT)}, '')"
    return corpus.selectExpr(*rest, f"{cleaned} AS cleaned", f"length(`{text}`) - length({cleaned}) AS removed")


# --- install scripts and permissions -------------------------------------------------------


def install_script_verdicts(packages: DataFrame, keys: list[str], text: str = "script") -> DataFrame:
    """Issues by severity of each package's install script; suspicious with one critical or two high ones.

    Packages whose script raises nothing are kept with zero counts.
    """
    found = scan(packages.select(*keys, text), INSTALL_SCRIPT, text=text).groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in ("critical", "high", "medium")])
    joined = packages.select(*keys).distinct().join(found, keys, "left").na.fill(0)
    return joined.withColumn("suspicious", F.expr("critical_issues >= 1 OR high_issues >= 2"))


def package_permissions(packages: DataFrame, keys: list[str], text: str = "script") -> DataFrame:
    """One row per package, kind and description, with the first line that shows it."""
    found = scan(packages.select(*keys, text), PERMISSION, text=text)
    return found.groupBy(*keys, F.col("category").alias("kind"), F.col("message").alias("description")).agg(
        F.max("severity").alias("severity"), F.min("line_no").alias("line_no"),
        F.min_by("evidence", "line_no").alias("evidence"))


def permission_risk(packages: DataFrame, permissions: DataFrame, keys: list[str]) -> DataFrame:
    """Risk level of each package from its permissions; ``packages`` has ``has_install_scripts``."""
    flags = permissions.groupBy(*keys).agg(
        F.count("*").alias("permissions"), F.bool_or(F.col("severity") == "critical").alias("_critical"),
        F.bool_or(F.col("severity") == "high").alias("_high"),
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in ("process", "network", "env")])
    joined = packages.select(*keys, "has_install_scripts").join(flags, keys, "left").na.fill(0, ["permissions"])
    joined = joined.na.fill(False, ["_critical", "_high", "_process", "_network", "_env"])
    return joined.selectExpr(
        *keys, "permissions",
        "CASE WHEN permissions = 0 AND NOT has_install_scripts THEN 'safe' WHEN _critical OR (_process AND _network) THEN 'critical' "
        "WHEN _high OR (has_install_scripts AND (_network OR _env)) THEN 'high' "
        "WHEN permissions >= 3 OR has_install_scripts THEN 'medium' ELSE 'low' END AS risk_level")


# --- tool servers --------------------------------------------------------------------------

SERVER_SCHEMA = ("command STRING, args ARRAY<STRING>, env MAP<STRING, STRING>, url STRING, transport STRING, version STRING, "
                 "tools ARRAY<STRUCT<name: STRING, description: STRING, inputSchema: STRING>>")


def read_mcp_configs(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Servers of configuration files in any of the three layouts; each keeps its JSON."""
    rest = [c for c in corpus.columns if c != text]
    layout = "mcpServers MAP<STRING, STRING>, servers MAP<STRING, STRING>, mcp STRUCT<servers: MAP<STRING, STRING>>"
    parsed = corpus.selectExpr(*rest, f"from_json(`{text}`, '{layout}') AS _j")
    servers = parsed.selectExpr(*rest, "explode(coalesce(_j.mcpServers, _j.servers, _j.mcp.servers)) AS (server, raw)")
    shaped = servers.filter("startswith(ltrim(raw), '{')").selectExpr("*", f"from_json(raw, '{SERVER_SCHEMA}') AS _s")
    return shaped.selectExpr(*rest, "server", "_s.*", "raw")


def _issue(condition: str, rule: Rule, severity: str | None = None) -> str:
    shown = severity or quote(rule.severity)
    return (f"IF({condition}, named_struct('category', {quote(rule.category)}, 'rule_id', {quote(rule.rule_id)}, "
            f"'severity', {shown}), NULL)")


def scan_mcp_servers(servers: DataFrame) -> DataFrame:
    """Issues of each server: command, remote code, credentials, poisoned tools, transport."""
    command = "concat_ws(' ', coalesce(command, ''), coalesce(args, array()))"
    with_command = servers.withColumn("_cmd", F.expr(command))
    simple = [_issue(f"_cmd RLIKE {quote(r.jvm)}", r) for r in catalogue.COMMAND_RULES]
    simple += [_issue(f"_cmd RLIKE {quote(r.jvm)} OR coalesce(url RLIKE {quote(r.jvm)}, false)", r) for r in catalogue.RUG_PULL_RULES]
    plain = Rule("MCP_HTTP", "high", "unverified", "", "Plain HTTP")
    empty = Rule("MCP_EMPTY", "medium", "unverified", "", "Neither command nor URL")
    simple.append(_issue("startswith(url, 'http://') AND NOT contains(url, 'localhost') AND NOT contains(url, '127.0.0.1')", plain))
    simple.append(_issue("coalesce(command, '') = '' AND coalesce(url, '') = ''", empty))
    raw = [_issue(f"size(coalesce(tools, array())) = 0 AND raw RLIKE {quote(r.jvm)}", r) for r in catalogue.POISON_RULES]
    hard = "e.value <> '' AND NOT startswith(e.value, '$')"
    env = ", ".join(_issue(f"e.key RLIKE {quote(r.jvm)}", r, f"IF(coalesce({hard}, false), {quote(r.severity)}, 'low')") for r in catalogue.ENV_RULES)
    described = "concat(coalesce(t.description, ''), ' ', coalesce(t.inputSchema, '{}'))"
    tools = ", ".join(_issue(f"{described} RLIKE {quote(r.jvm)}", r) for r in catalogue.POISON_RULES)
    issues = (
        f"concat(array_compact(array({', '.join(simple + raw)})), "
        f"flatten(transform(map_entries(coalesce(env, map())), e -> array_compact(array({env})))), "
        f"flatten(transform(coalesce(tools, array()), t -> array_compact(array({tools})))))"
    )
    rest = [c for c in servers.columns if c not in ("args", "env", "tools", "raw", "transport", "version")]
    return with_command.selectExpr(*rest, f"inline({issues})")


def match_mcp_cves(servers: DataFrame) -> DataFrame:
    """Known advisories, known-bad servers and risky endpoints of each server.

    Candidate package names are taken from the configuration's tokens and joined with the
    advisory tables; a version that is not stated counts as affected.
    """
    spark = servers.sparkSession
    tools = ", ".join(quote(t) for t in catalogue.TOOL_WORDS)
    scoped, plain = quote(jvm_regex(catalogue.SCOPED_TOKEN)), quote(jvm_regex(catalogue.PLAIN_TOKEN))
    tokens = "concat(coalesce(args, array()), array(coalesce(command, ''), coalesce(url, '')))"
    candidates = (
        f"array_distinct(concat(array(server), flatten(transform({tokens}, t -> concat(regexp_extract_all(t, {scoped}, 1), "
        f"filter(transform(regexp_extract_all(t, {plain}, 0), u -> split(u, '@')[0]), u -> NOT lower(u) IN ({tools})))))))"
    )
    rest = [c for c in servers.columns if c not in ("args", "env", "tools", "raw", "transport", "command", "url")]
    named = servers.selectExpr(*rest, f"explode({candidates}) AS _candidate").withColumn("_key", F.lower("_candidate"))
    cves = local_table(spark, [(c, p.lower(), a, f, s) for c, p, a, f, s, _ in catalogue.SERVER_CVES],
                                 "reference string, _key string, affected string, fixed_in string, severity string")
    bad = local_table(spark, [(n, a.lower(), s) for n, a, _, s, _ in catalogue.KNOWN_BAD_SERVERS],
                                "reference string, _key string, severity string")
    keys = [c for c in rest if c != "version"]
    by_cve = named.join(cves, "_key").filter(satisfies("version", "affected")).select(
        *keys, F.lit("cve").alias("kind"), "reference", "severity")
    by_name = named.join(bad, "_key").select(*keys, F.lit("known-bad").alias("kind"), "reference", "severity")
    combined = "concat_ws(' ', coalesce(url, ''), coalesce(command, ''), coalesce(args, array()))"
    risky = ", ".join(
        f"IF({combined} RLIKE {quote(r.jvm)}, named_struct('kind', 'risky-url', 'reference', {quote(r.rule_id)}, 'severity', {quote(r.severity)}), NULL)"
        for r in catalogue.RISKY_URL_RULES)
    by_url = servers.selectExpr(*keys, f"inline(array_compact(array({risky})))")
    return by_cve.unionByName(by_name).unionByName(by_url).distinct()


# --- components ------------------------------------------------------------------------------


def discover_ai_components(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """AI configuration files, SDK imports and model files of each project.

    ``corpus``: (project, file_id, path, lang, text).
    """
    keys = ["project", "file_id", path]
    configs = ", ".join(
        f"IF(`{path}` RLIKE {quote(p)}, named_struct('name', {quote(n)}, 'type', '{t}', 'risk', '{r}'), NULL)"
        for p, n, t, r in catalogue.CONFIG_FILES)
    by_config = corpus.selectExpr(*keys, f"inline(array_compact(array({configs})))", "0 AS line_no")
    sdk = scan_text_once(corpus.select(*keys, "lang", text), catalogue.AI_SDK, text=text).selectExpr(
        *keys, "rule_id AS name", "IF(contains(category, 'Agent'), 'agent-framework', 'ai-sdk') AS type",
        "severity AS risk", "line_no")
    models = " ".join(f"WHEN endswith(lower(`{path}`), '{e}') THEN '{n}'" for e, n in catalogue.MODEL_FILES)
    by_model = corpus.select(*keys, F.expr(f"CASE {models} END").alias("_format"), base_name(F.col(path)).alias("_base")).filter(
        "_format IS NOT NULL").selectExpr(*keys, "concat(_format, ': ', _base) AS name", "'model-file' AS type", "'low' AS risk", "0 AS line_no")
    found = by_config.unionByName(sdk).unionByName(by_model)
    # Of several mentions of one component in a file the first line counts, and on one line the first type.
    first = F.min(F.struct("line_no", "type", "risk", path))
    return found.groupBy("project", "file_id", "name").agg(first.alias("_f")).select(
        "project", "file_id", F.col(f"_f.{path}").alias(path), "name", "_f.type", "_f.risk", "_f.line_no")


def ai_sbom_summary(components: DataFrame) -> DataFrame:
    kinds = (("coding_tool_configs", "coding-tool-config"), ("mcp_servers", "mcp-server"), ("ai_sdks", "ai-sdk"),
             ("agent_frameworks", "agent-framework"), ("model_files", "model-file"))
    return components.groupBy("project").agg(
        F.count("*").alias("total_components"), *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds],
        F.count_if(F.col("risk") == "high").alias("high_risk"))


# --- intent ------------------------------------------------------------------------------------


def request_answer_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that directly follows it."""
    pairs = consecutive(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], F.floor(F.col("turn") / 256))
    return pairs.filter("prev.role = 'user' AND cur.role = 'assistant'").selectExpr(
        "conv_id", "cur.turn AS turn", "prev.text AS request", "cur.text AS answer")


def intent_check(pairs: DataFrame) -> DataFrame:
    """Suspicious elements of each answer, whether it keeps to the request, and the confidence.

    Everything is computed within the row of the pair.
    """
    low = "lower(request)"
    in_category = {c: _or(f"contains({low}, '{w}')" for w in words) for c, words in INTENT_KEYWORDS.items()}
    ranks = [r.severity for r in INTENT.rules]
    hits = _hits("l", "lower(l)", [INTENT], [], True, False)
    severity = "element_at(array(" + ", ".join(quote(s) for s in ranks) + "), h)"
    by_line = f"flatten(transform(split(answer, '\\n'), l -> transform({hits}, h -> {severity})))"
    patterns = F.when(may_match("answer", INTENT), F.expr(by_line)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    imports = quote(CODE_IMPORT)
    # The pattern has a group per import form; only one of them is filled.
    named = f"concat(regexp_extract_all(answer, {imports}, 1), regexp_extract_all(answer, {imports}, 2))"
    bad = " + ".join(f"size(filter({named}, i -> i RLIKE {quote(p)}))" for p, _ in SUSPICIOUS_IMPORTS)
    counted = pairs.withColumn("_found", patterns).selectExpr(
        "*",
        f"NOT {in_category['crypto']} AND answer RLIKE {quote(CURRENCY_CODE)} AS off_topic_currency",
        f"{in_category['ui']} AND NOT {in_category['http-server']} AND NOT {in_category['database']} AND answer RLIKE {quote(NETWORK_CODE)} AS off_topic_network",
        f"{bad} AS suspicious_imports")
    totals = counted.selectExpr(
        "*", "size(filter(_found, s -> s = 'critical')) + suspicious_imports AS critical",
        "size(filter(_found, s -> s = 'high')) + IF(off_topic_currency, 1, 0) AS high",
        "size(filter(_found, s -> s = 'medium')) + IF(off_topic_network, 1, 0) AS medium").drop("_found")
    return totals.selectExpr(
        "*", "critical = 0 AND high = 0 AS aligned",
        "greatest(0D, round(1D - (critical * 0.3D + high * 0.15D + medium * 0.05D), 6)) AS confidence")
