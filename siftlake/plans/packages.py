"""Named queries over package names, references, advisories and reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import advisories, intel, similarity
from siftlake.operators.scan import quote
from siftlake.plans.derived import AS_OF, REFERENCES, SIGNALS, SUSPECTS, VULNERABILITIES
from siftlake.plans.registry import plan
from siftlake.plans.tables import fill, spark_list, sql_list, sql_text, table

# --- derived package names -------------------------------------------------------------

_NPM, _PYPI = list(similarity.POPULAR_NPM), list(similarity.POPULAR_PYPI)


def _mutated(base: str, by: str) -> str:
    """A popular name changed in one of twelve ways; reads the same in both dialects."""
    return (
        f"CASE ({by}) % 12 WHEN 0 THEN {base} WHEN 1 THEN concat(substring({base}, 1, 1), substring({base}, 3)) "
        f"WHEN 2 THEN concat(substring({base}, 2, 1), substring({base}, 1, 1), substring({base}, 3)) "
        f"WHEN 3 THEN concat({base}, 's') WHEN 4 THEN replace({base}, 'o', '0') WHEN 5 THEN replace({base}, '-', '') "
        f"WHEN 6 THEN concat({base}, '-js') WHEN 7 THEN replace(replace({base}, '@', ''), '/', '-') "
        f"WHEN 8 THEN upper({base}) WHEN 9 THEN replace({base}, 'a', 's') WHEN 10 THEN concat('real-', {base}) "
        f"ELSE replace({base}, 'c', 'kx') END"
    )


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package names derived from the part table: popular names with mistakes."""
    npm = f"element_at({spark_list(_NPM)}, CAST(p_partkey % {len(_NPM)} + 1 AS INT))"
    pypi = f"element_at({spark_list(_PYPI)}, CAST(p_partkey % {len(_PYPI)} + 1 AS INT))"
    part = table(spark, sf_dir, "part")
    named = part.selectExpr(
        "p_partkey", "IF(p_partkey % 2 = 0, 'npm', 'pypi') AS ecosystem", f"IF(p_partkey % 2 = 0, {npm}, {pypi}) AS base"
    )
    return named.selectExpr("p_partkey", "ecosystem", f"{_mutated('base', 'CAST(floor(p_partkey / 7) AS BIGINT)')} AS name")


PACKAGE_NAMES_SQL = (
    f"SELECT p_partkey, ecosystem, {_mutated('base', 'CAST(floor(p_partkey / 7) AS BIGINT)')} AS name FROM ("
    f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, "
    f"CASE WHEN p_partkey % 2 = 0 THEN ({sql_list(_NPM)})[p_partkey % {len(_NPM)} + 1] "
    f"ELSE ({sql_list(_PYPI)})[p_partkey % {len(_PYPI)} + 1] END AS base FROM part)"
)
TARGETS_SQL = (
    f"SELECT 'npm' AS ecosystem, unnest({sql_list(_NPM)}) AS target, unnest(range(0, {len(_NPM)})) AS ord UNION ALL "
    f"SELECT 'pypi', unnest({sql_list(_PYPI)}), unnest(range({len(_NPM)}, {len(_NPM) + len(_PYPI)}))"
)


@plan(
    "nearest_popular",
    f"""WITH names AS (SELECT DISTINCT ecosystem, name FROM ({PACKAGE_NAMES_SQL})), targets AS ({TARGETS_SQL}),
    fresh AS (SELECT * FROM names n WHERE NOT EXISTS (
        SELECT 1 FROM targets t WHERE t.ecosystem = n.ecosystem AND lower(t.target) = lower(n.name))),
    pairs AS (SELECT n.ecosystem, n.name, t.target, t.ord, levenshtein(lower(n.name), lower(t.target)) AS distance
        FROM fresh n JOIN targets t ON t.ecosystem = n.ecosystem)
    SELECT ecosystem, name, arg_min(target, distance * 10000 + ord) AS suggestion, min(distance) AS distance
    FROM pairs WHERE distance BETWEEN 1 AND 2 GROUP BY ecosystem, name""",
    covers="E7 H1",
)
def nearest_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest_popular(package_names(spark, sf_dir), similarity.popular_packages(spark))


def _phonetic_sql(x: str) -> str:
    key = f"substring({x}, 1, 1) || regexp_replace(substring({x}, 2), '[aeiou]', '', 'g')"
    for pattern, replacement in (("ph", "f"), ("ck", "k"), ("ght", "t"), ("[cq]", "k"), ("z", "s"), ("y", "i")):
        key = f"regexp_replace({key}, '{pattern}', '{replacement}', 'g')"
    # Runs of a letter, one letter at a time: the checking database has no back-references.
    for c in "abcdefghijklmnopqrstuvwxyz0123456789@/._-":
        key = f"regexp_replace({key}, '[{c}]{{2,}}', '{c}', 'g')" if c != "-" else f"regexp_replace({key}, '-{{2,}}', '-', 'g')"
    return key


def _map_sql(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


_SUFFIX_SQL = " OR ".join(f"n = t || '{s}'" for s in similarity.SUFFIXES)
_PREFIX_SQL = " OR ".join(f"n = '{p}' || t" for p in similarity.PREFIXES)
_STRIP = "regexp_replace({}, '[-_.]', '', 'g')"
# The checking database lets two swapped characters take a third between them; such pairs are one edit further apart.
_SPLIT_SWAP = (
    "list_bool_or(list_transform(range(0, greatest(length({a}) - 1, 0)), lambda i: left({a}, i) = left({b}, i) "
    "AND substring({a}, i + 3) = substring({b}, i + 4) AND substring({a}, i + 1, 1) = substring({b}, i + 3, 1) "
    "AND substring({a}, i + 2, 1) = substring({b}, i + 1, 1)))"
)
_OSA = (
    "damerau_levenshtein(n, t) + CASE WHEN levenshtein(n, t) = 3 AND damerau_levenshtein(n, t) = 2 AND "
    f"((length(t) = length(n) + 1 AND {_SPLIT_SWAP.format(a='n', b='t')}) OR "
    f"(length(n) = length(t) + 1 AND {_SPLIT_SWAP.format(a='t', b='n')})) THEN 1 ELSE 0 END"
)
_DIFF = "list_filter(list_zip(string_split(n, ''), string_split(t, '')), lambda c: c[1] <> c[2])"


@plan(
    "typosquat_matches",
    f"""WITH names AS (SELECT DISTINCT ecosystem, name, lower(name) AS n FROM ({PACKAGE_NAMES_SQL})),
    targets AS (SELECT *, lower(target) AS t FROM ({TARGETS_SQL})),
    sound AS (SELECT x, {_phonetic_sql('x')} AS ph FROM (SELECT n AS x FROM names UNION SELECT t FROM targets)),
    pairs AS (SELECT names.*, target, ord, t, levenshtein(n, t) AS lev, {_OSA} AS osa,
        sn.ph = st.ph AS same_sound
        FROM names JOIN targets USING (ecosystem) JOIN sound sn ON sn.x = n JOIN sound st ON st.x = t
        WHERE target <> name AND target <> n),
    signals AS (SELECT *, [
        CASE WHEN osa = 1 THEN 'levenshtein-1' END, CASE WHEN osa = 2 AND length(t) >= 6 THEN 'levenshtein-2' END,
        CASE WHEN length(n) = length(t) AND len({_DIFF}) BETWEEN 1 AND 2
            AND list_bool_and(list_transform({_DIFF}, lambda c: contains(coalesce({_map_sql(similarity.KEYBOARD)}[c[1]], ''), c[2]))) THEN 'keyboard-adjacent' END,
        CASE WHEN length(n) = length(t) AND len({_DIFF}) > 0
            AND list_bool_and(list_transform({_DIFF}, lambda c: contains(coalesce({_map_sql(similarity.HOMOGLYPHS)}[c[2]], ''), c[1]))) THEN 'homoglyph' END,
        CASE WHEN same_sound AND n <> t AND osa <= 3 THEN 'phonetic' END,
        CASE WHEN osa < lev THEN 'transposition' END,
        CASE WHEN {_STRIP.format('n')} = {_STRIP.format('t')} AND n <> t THEN 'separator' END,
        CASE WHEN osa = 1 AND length(n) > length(t) THEN 'insertion' END,
        CASE WHEN osa = 1 AND length(n) < length(t) THEN 'deletion' END,
        CASE WHEN {_SUFFIX_SQL} THEN 'suffix-trick' END, CASE WHEN {_PREFIX_SQL} THEN 'prefix-trick' END,
        CASE WHEN n = t || 's' OR t = n || 's' OR n = t || 'es' OR t = n || 'es' THEN 'plural-flip' END,
        CASE WHEN starts_with(target, '@') AND n IN (replace(target[2:], '/', '-'), replace(target[2:], '/', '_'), replace(target[2:], '/', '')) THEN 'scope-drop' END,
        CASE WHEN name <> target AND n = t THEN 'case-variant' END] AS signals FROM pairs),
    scored AS (SELECT *, least(round({' + '.join(f"CASE WHEN list_contains(signals, '{s}') THEN {w}::DOUBLE ELSE 0 END" for s, w in similarity.WEIGHTS)}
        + CASE WHEN length(t) >= 8 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN length(t) >= 12 THEN 0.05::DOUBLE ELSE 0 END, 10), 1) AS score
        FROM signals),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY score DESC, ord) AS rank FROM scored WHERE score >= 0.55)
    SELECT ecosystem, name, target, round(score, 4) AS score, rank,
        CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS severity
    FROM ranked WHERE rank <= 5""",
    covers="E8 H2 H3 H4",
)
def typosquat_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.typosquat_matches(package_names(spark, sf_dir), similarity.popular_packages(spark))
    return found.select("ecosystem", "name", "target", F.round("score", 4).alias("score"), "rank", "severity")


# --- advisories ----------------------------------------------------------------------------

REFS_SQL, VULNS_SQL, SIGNALS_SQL = REFERENCES.sql, VULNERABILITIES.sql, SIGNALS.sql


def _key_sql(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda x: CAST(x AS BIGINT))"


@plan(
    "vuln_range_join",
    f"""WITH r AS ({REFS_SQL}), v AS ({VULNS_SQL})
    SELECT r.ecosystem, v.severity, v.vuln_id, count(*) AS refs, count(DISTINCT project) AS projects
    FROM r JOIN v ON r.ecosystem = v.ecosystem AND lower(r.name) = lower(v.package_name)
    WHERE (introduced IS NULL OR {_key_sql('version')} >= {_key_sql('introduced')})
      AND (fixed_version IS NULL OR {_key_sql('version')} < {_key_sql('fixed_version')})
    GROUP BY ALL""",
    covers="E9 H6",
)
def vuln_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advisories.vulnerable_packages(REFERENCES.frame(spark, sf_dir), VULNERABILITIES.frame(spark, sf_dir))
    return found.groupBy("ecosystem", "severity", "vuln_id").agg(
        F.count("*").alias("refs"), F.countDistinct("project").alias("projects"))


# Advisories of four forms: several pairs in one range, two ranges with a last affected version, events out of order, listed versions.
_TIMED_RANGES = (
    """[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"1.@A@.0"},{"introduced":"2.0.0"},{"fixed":"2.@B@.1"}]}]""",
    """[{"type":"SEMVER","events":[{"introduced":"1.@A@.0"},{"last_affected":"3.@B@.2"}]},{"type":"SEMVER","events":[{"introduced":"5.0.0"}]}]""",
    """[{"type":"SEMVER","events":[{"fixed":"4.@A@.0"},{"introduced":"4.0.0"},{"last_affected":"6.@B@.0"},{"introduced":"4.9.0"},{"fixed":"7.0.0"}]}]""",
    "[]",
)
_TIMED_ECOSYSTEM = "CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Go' ELSE 'crates.io' END"
_TIMED = """{"id":"TIMED-@K@","summary":"s","severity":[],"database_specific":{"severity":"HIGH"},"affected":[{"package":{"ecosystem":"@ECO@","name":"PKG-@K@"},"versions":@VERSIONS@,"ranges":@RANGES@}]}"""
_TIMED_FORM = "(p_partkey + p_size) % 4"
_TIMED_EVENTS = (
    (0, 0, "introduced", "'0'"), (0, 0, "fixed", "'1.' || a || '.0'"), (0, 0, "introduced", "'2.0.0'"), (0, 0, "fixed", "'2.' || b || '.1'"),
    (1, 0, "introduced", "'1.' || a || '.0'"), (1, 0, "last_affected", "'3.' || b || '.2'"), (1, 1, "introduced", "'5.0.0'"),
    (2, 0, "introduced", "'4.0.0'"), (2, 0, "fixed", "'4.' || a || '.0'"), (2, 0, "introduced", "'4.9.0'"), (2, 0, "last_affected", "'6.' || b || '.0'"), (2, 0, "fixed", "'7.0.0'"),
)


def timed_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = "element_at(array(" + ", ".join(quote(r) for r in _TIMED_RANGES) + f"), CAST({_TIMED_FORM} + 1 AS INT))"
    versions = f"IF({_TIMED_FORM} = 3, '[\"1.@A@.0\",\"2.@B@.1\"]', '[]')"
    marks = {"@ECO@": _TIMED_ECOSYSTEM, "@VERSIONS@": versions, "@RANGES@": forms, "@K@": "CAST(p_partkey AS STRING)", "@A@": "CAST(p_size % 9 AS STRING)", "@B@": "CAST(p_partkey % 7 AS STRING)"}
    return table(spark, sf_dir, "part").selectExpr(f"from_json({fill(quote(_TIMED), marks)}, '{advisories.OSV_SCHEMA}') AS j").select("j.*")


@plan(
    "osv_timeline_join",
    f"""WITH r AS ({REFS_SQL}), p AS (SELECT p_partkey, {_TIMED_FORM} AS form, CAST(p_size % 9 AS VARCHAR) AS a, CAST(p_partkey % 7 AS VARCHAR) AS b FROM part),
    e AS ({" UNION ALL ".join(f"SELECT p_partkey, {n} AS rng, '{kind}' AS kind, {v} AS version FROM p WHERE form = {form}" for form, n, kind, v in _TIMED_EVENTS)}),
    k AS (SELECT *, {_key_sql('version')} AS key, CASE kind WHEN 'introduced' THEN 1 ELSE 0 END AS late FROM e),
    v AS (SELECT DISTINCT name, version, {_key_sql('version')} AS vkey, CAST(substr(name, 5) AS BIGINT) AS p_partkey FROM r),
    s AS (SELECT name, v.version, p_partkey, rng, arg_max(kind, (key, late)) FILTER (WHERE key <= vkey) AS kind, max(key) FILTER (WHERE key <= vkey) AS latest,
        min((key, k.version)) FILTER (WHERE kind = 'fixed' AND key > vkey) AS fix, any_value(vkey) AS vkey FROM v JOIN k USING (p_partkey) GROUP BY ALL),
    hit AS (SELECT name, version, p_partkey, fix FROM s WHERE kind = 'introduced' OR kind = 'last_affected' AND latest = vkey
        UNION ALL SELECT name, version, p_partkey, NULL FROM v JOIN p USING (p_partkey) WHERE form = 3 AND version IN ('1.' || a || '.0', '2.' || b || '.1')),
    h AS (SELECT name, version, p_partkey, min(fix) AS fix FROM hit GROUP BY ALL)
    SELECT 'TIMED-' || p_partkey AS vuln_id, r.ecosystem, version, (fix)[2] AS fixed_version, count(*) AS refs, count(DISTINCT project) AS projects
    FROM r JOIN h USING (name, version) GROUP BY ALL""",
    covers="A10 E9 G6 H6",
)
def osv_timeline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose version an advisory's time lines cover: several pairs, ranges, last affected and listed versions."""
    found = advisories.affected_references(REFERENCES.frame(spark, sf_dir), advisories.affected_ranges(timed_advisories(spark, sf_dir)))
    return found.groupBy("vuln_id", "ecosystem", "version", "fixed_version").agg(F.count("*").alias("refs"), F.countDistinct("project").alias("projects"))


# Advisories as documents: two affected packages, the first with two ranges.
_OSV = """{"id":"OSV-@K@","summary":"s","aliases":["CVE-2024-@K@","GHSA-@K@"],"severity":[@SEV@],"database_specific":{"severity":"@DB@"},"affected":[{"package":{"ecosystem":"@ECO@","name":"pkg-@K@"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"1.@S@.0"}]},{"type":"SEMVER","events":[{"introduced":"2.0.0"},{"fixed":"2.@S@.1"}]}]},{"package":{"ecosystem":"npm","name":"twin-@K@"},"ranges":[{"type":"SEMVER","events":[{"introduced":"3.@S@.0"}]}]}]}"""
_OSV_FILL = {
    "@K@": "CAST(p_partkey AS STRING)", "@S@": "CAST(p_size AS STRING)",
    "@SEV@": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '{\"type\":\"CVSS_V3\",\"score\":\"9.8\"}' WHEN 2 THEN '{\"type\":\"CVSS_V3\",\"score\":\"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N\"}' ELSE '{\"type\":\"CVSS_V2\",\"score\":\"5.0\"}' END",
    "@DB@": "CASE p_partkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE '' END",
    "@ECO@": "CASE p_partkey % 3 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'crates.io' ELSE 'npm' END",
}


def osv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fill(quote(_OSV), _OSV_FILL)
    parsed = table(spark, sf_dir, "part").selectExpr(f"from_json({text}, '{advisories.OSV_SCHEMA}') AS j")
    return parsed.select("j.*")


_NUM_SQL = "try_cast({} AS DOUBLE)"
_VECTOR_SQL = "least(10, 5 + " + " + ".join(
    f"CASE WHEN contains({{0}}, '{f}') THEN {w} ELSE 0 END" for f, w in advisories.VECTOR_WEIGHTS) + ")"
_LADDER_SQL = "CASE WHEN {0} >= 9 THEN 'critical' WHEN {0} >= 7 THEN 'high' WHEN {0} >= 4 THEN 'medium' ELSE 'low' END"
OSV_SQL = f"""
    SELECT id AS vuln_id, lower(db) AS db, first, v3, a->>'$.package.name' AS package_name,
        CASE a->>'$.package.ecosystem' WHEN 'PyPI' THEN 'pypi' WHEN 'crates.io' THEN 'cargo' ELSE 'npm' END AS ecosystem,
        a->>'$.ranges[*].events[*].introduced' AS intro, a->>'$.ranges[*].events[*].fixed' AS fixed
    FROM (SELECT j->>'$.id' AS id, j->>'$.database_specific.severity' AS db, j->>'$.severity[0].score' AS first,
        CASE WHEN j->>'$.severity[0].type' = 'CVSS_V3' THEN j->>'$.severity[0].score' END AS v3, unnest(json_extract(j, '$.affected[*]')) AS a
        FROM (SELECT CAST({fill(sql_text(_OSV), _OSV_FILL)} AS JSON) AS j FROM part))"""


@plan(
    "osv_flatten",
    f"""WITH o AS ({OSV_SQL})
    SELECT vuln_id, package_name, ecosystem, intro[-1] AS introduced, coalesce('>=' || intro[-1], 'unknown') AS affected_range,
        len(fixed) AS fixes, fixed[-1] AS fixed_version,
        CASE WHEN db IN ('critical', 'high', 'medium', 'low') THEN db WHEN db = 'moderate' THEN 'medium'
            WHEN {_NUM_SQL.format('first')} IS NOT NULL THEN {_LADDER_SQL.format(_NUM_SQL.format('first'))}
            WHEN first LIKE 'CVSS:%' THEN {_LADDER_SQL.format(_VECTOR_SQL.format('first'))} ELSE 'unknown' END AS severity
    FROM o""",
    covers="A10 G3 G5 G6 G7 G9 I4",
)
def osv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = advisories.flatten_osv(osv_documents(spark, sf_dir))
    return flat.select("vuln_id", "package_name", "ecosystem", "introduced", "affected_range",
                       F.size("fixed_versions").alias("fixes"), "fixed_version", "severity")


@plan(
    "osv_severity_policies",
    f"""WITH o AS (SELECT DISTINCT vuln_id, db, first, v3 FROM ({OSV_SQL}))
    SELECT vuln_id,
        CASE WHEN first IS NOT NULL THEN CASE WHEN {_NUM_SQL.format('first')} > 0 THEN {_LADDER_SQL.format(_NUM_SQL.format('first'))} ELSE 'unknown' END
            WHEN db IN ('critical', 'high', 'medium', 'low') THEN db ELSE 'unknown' END AS first_score,
        CASE WHEN db IN ('critical', 'high', 'medium', 'low') THEN db WHEN db = 'moderate' THEN 'medium'
            WHEN first IS NOT NULL THEN {_LADDER_SQL.format(_NUM_SQL.format('first'))} ELSE 'medium' END AS scanner,
        CASE WHEN v3 IS NULL THEN 'medium' ELSE {_LADDER_SQL.format(_NUM_SQL.format('v3'))} END AS ingest
    FROM o""",
    covers="G7",
)
def osv_severity_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osv_documents(spark, sf_dir).selectExpr(
        "id AS vuln_id", *[f"{advisories.osv_severity(p)} AS {n}" for p, n in (
            ("first-score", "first_score"), ("scanner", "scanner"), ("ingest", "ingest"))])


_RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_LABEL_SQL = "CASE max({}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' WHEN 0 THEN 'info' END"


@plan(
    "highest_severity",
    f"SELECT ecosystem, package_name, {_LABEL_SQL.format(_RANK_SQL)} AS highest_severity FROM ({VULNS_SQL}) GROUP BY ALL",
    covers="F13 K20",
)
def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisories.highest_severity(VULNERABILITIES.frame(spark, sf_dir), ["ecosystem", "package_name"])


_BEST_SQL = f"arg_max(fixed_version, {_key_sql('fixed_version')}) FILTER (WHERE fixed_version IS NOT NULL)"
_COUNTS_SQL = f"""SELECT ecosystem, package_name AS name, count(*) AS total_vulnerabilities,
    count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
    count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
    {_BEST_SQL} AS best_safe_version FROM ({VULNS_SQL}) GROUP BY ALL"""


@plan(
    "patch_plan",
    f"""WITH c AS ({_COUNTS_SQL}), j AS (SELECT p.ecosystem, p.name, latest, deprecated, coalesce(total_vulnerabilities, 0) AS total_vulnerabilities,
        coalesce(critical_count, 0) AS critical_count, best_safe_version, coalesce(best_safe_version, latest) AS t
        FROM ({SIGNALS_SQL}) p LEFT JOIN c USING (ecosystem, name))
    SELECT ecosystem, name, total_vulnerabilities, critical_count, best_safe_version,
        CASE WHEN total_vulnerabilities > 0 THEN CASE ecosystem WHEN 'npm' THEN 'npm install ' || name || '@' || t
            WHEN 'pypi' THEN 'pip install "' || name || '>=' || t || '"' WHEN 'go' THEN 'go get ' || name || '@v' || t
            ELSE 'cargo update -p ' || name || ' --precise ' || t END END AS patch_command,
        CASE WHEN total_vulnerabilities > 0 AND best_safe_version IS NOT NULL THEN 'Update to ' || name || '@' || best_safe_version
            WHEN total_vulnerabilities > 0 THEN 'Update to ' || name || '@' || latest || ' (latest)'
            WHEN deprecated THEN 'Consider replacing deprecated package ' || name
            ELSE 'No action needed — no known vulnerabilities' END AS recommended_action FROM j""",
    covers="F14 H10 K11",
)
def patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = SIGNALS.frame(spark, sf_dir).select("ecosystem", "name", "latest", "deprecated")
    planned = advisories.patch_plan(packages, VULNERABILITIES.frame(spark, sf_dir))
    return planned.select("ecosystem", "name", "total_vulnerabilities", "critical_count", "best_safe_version", "patch_command", "recommended_action")


# --- existence and namespaces ------------------------------------------------------------------

_REGISTERED = "SELECT ecosystem, name FROM ({}) WHERE registry_exists".format(SIGNALS_SQL)


@plan(
    "known_package_check",
    f"""WITH k AS (SELECT ecosystem, lower(name) AS n FROM ({SIGNALS_SQL}) WHERE known_hallucination)
    SELECT r.ecosystem, r.name, k.n IS NOT NULL AS known_hallucination, count(*) AS refs
    FROM ({REFS_SQL}) r LEFT JOIN k ON k.ecosystem = r.ecosystem AND k.n = lower(r.name) GROUP BY ALL""",
    covers="E4 C8",
)
def known_package_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = SIGNALS.frame(spark, sf_dir).filter("known_hallucination").select("ecosystem", "name")
    flagged = intel.flag_known(REFERENCES.frame(spark, sf_dir), known)
    return flagged.groupBy("ecosystem", "name", "known_hallucination").agg(F.count("*").alias("refs"))


@plan(
    "missing_from_registry",
    f"""SELECT ecosystem, name, count(*) AS refs FROM ({REFS_SQL}) r
    WHERE NOT EXISTS (SELECT 1 FROM ({_REGISTERED}) p WHERE p.ecosystem = r.ecosystem AND lower(p.name) = lower(r.name)) GROUP BY ALL""",
    covers="E5",
)
def missing_from_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = SIGNALS.frame(spark, sf_dir).filter("registry_exists").select("ecosystem", "name")
    missing = intel.missing_from_registry(REFERENCES.frame(spark, sf_dir), registry)
    return missing.groupBy("ecosystem", "name").agg(F.count("*").alias("refs"))


_HOMES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{e}')" for n, e in intel.HOME_ECOSYSTEM.items()) + ") h(name, correct_ecosystem)"


@plan(
    "namespace_confusion",
    f"""SELECT p_partkey, p.ecosystem, p.name, h.correct_ecosystem
    FROM (SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'cargo' ELSE ecosystem END AS ecosystem) FROM ({PACKAGE_NAMES_SQL})) p
    JOIN ({_HOMES_SQL}) h ON lower(p.name) = h.name WHERE p.ecosystem <> h.correct_ecosystem""",
    covers="E6",
)
def namespace_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = package_names(spark, sf_dir).withColumn("ecosystem", F.expr("IF(p_partkey % 3 = 0, 'cargo', ecosystem)"))
    return intel.namespace_confusion(swapped, intel.home_ecosystems(spark))


# --- reputation ------------------------------------------------------------------------------

def _steps_sql(column: str, *steps: tuple[int, int]) -> str:
    return "(CASE " + " ".join(f"WHEN {column} >= {a} THEN {b}" for a, b in steps) + " ELSE 0 END)"


_BARRED = "(malware_flagged OR known_hallucination OR NOT registry_exists)"
_TRUST_SQL = f"""SELECT *, CASE WHEN trust_score >= 80 THEN 'verified' WHEN trust_score >= 50 THEN 'partial' WHEN trust_score >= 25 THEN 'suspicious' ELSE 'untrusted' END AS trust_tier
    FROM (SELECT *, CASE WHEN {_BARRED} THEN 0 ELSE least(100, provenance_raw + popularity_raw + maturity_raw + security_raw + quality_raw) END AS trust_score
    FROM (SELECT *,
    least(25, CASE WHEN provenance_verified THEN 15 ELSE 0 END + CASE WHEN slsa_level IS NULL THEN 0 WHEN slsa_level >= 2 THEN 6 ELSE slsa_level * 3 END + CASE WHEN verified_publisher THEN 4 ELSE 0 END) AS provenance_raw,
    greatest(0, least(25, {_steps_sql('weekly_downloads', (1000000, 15), (100000, 12), (10000, 8), (1000, 5), (100, 2))} + {_steps_sql('github_stars', (10000, 5), (1000, 3), (100, 1))}
        + CASE WHEN has_repository THEN 2 ELSE 0 END - CASE WHEN download_velocity = 'spike' THEN 3 ELSE 0 END)) AS popularity_raw,
    greatest(0, least(20, {_steps_sql('publisher_age_days', (365, 8), (90, 5), (30, 2))} + {_steps_sql('package_age_days', (365, 5), (90, 3))} + {_steps_sql('total_versions', (20, 4), (5, 2))}
        - CASE WHEN recent_ownership_change THEN 5 ELSE 0 END - CASE WHEN version_spike THEN 3 ELSE 0 END)) AS maturity_raw,
    greatest(0, 20 - CASE WHEN coalesce(vulnerability_count, 0) = 0 THEN 0 WHEN highest_severity = 'critical' THEN 15 WHEN highest_severity = 'high' THEN 10 ELSE 5 END) AS security_raw,
    greatest(0, 10 - CASE WHEN has_install_scripts THEN 3 ELSE 0 END - CASE WHEN suspicious_scripts THEN 7 ELSE 0 END - CASE WHEN typosquat_distance <= 2 THEN 5 ELSE 0 END) AS quality_raw
    FROM ({SIGNALS_SQL})))"""


@plan(
    "trust_score",
    f"""SELECT ecosystem, name, trust_score, trust_tier, CASE WHEN {_BARRED} THEN 0 ELSE provenance_raw END AS provenance_score,
        CASE WHEN {_BARRED} THEN 0 ELSE popularity_raw END AS popularity_score, CASE WHEN {_BARRED} THEN 0 ELSE maturity_raw END AS maturity_score,
        CASE WHEN {_BARRED} THEN 0 ELSE security_raw END AS security_score, CASE WHEN {_BARRED} THEN 0 ELSE quality_raw END AS code_quality_score
    FROM ({_TRUST_SQL})""",
    covers="G4 I3 K1",
)
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = intel.trust_score(SIGNALS.frame(spark, sf_dir))
    return scored.select("ecosystem", "name", "trust_score", "trust_tier", "provenance_score", "popularity_score", "maturity_score",
                         F.col("security_score"), "code_quality_score")


@plan(
    "trust_tier_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE trust_tier = 'verified') AS verified, count(*) FILTER (WHERE trust_tier = 'partial') AS partial,
        count(*) FILTER (WHERE trust_tier = 'suspicious') AS suspicious, count(*) FILTER (WHERE trust_tier = 'untrusted') AS untrusted,
        count(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable FROM ({_TRUST_SQL})""",
    covers="F22 K20",
)
def trust_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.trust_tier_counts(intel.trust_score(SIGNALS.frame(spark, sf_dir)))


_RECENT_SQL = f"(ecosystem = 'npm' AND created_at > {AS_OF} - INTERVAL 30 DAYS)"
_TIER_SQL = f"""CASE WHEN NOT exists_in_registry OR known_hallucination OR malware_flagged THEN 'untrusted'
    WHEN provenance_verified THEN CASE WHEN weekly_downloads > 100 THEN 'verified' ELSE 'partial' END
    WHEN weekly_downloads < 100 AND {_RECENT_SQL} THEN 'suspicious' WHEN weekly_downloads > 50000 THEN 'partial'
    WHEN weekly_downloads < 500 THEN 'suspicious' ELSE 'partial' END"""


@plan(
    "provenance_tier",
    f"SELECT ecosystem, name, {_TIER_SQL} AS provenance_tier FROM ({SIGNALS_SQL})",
    covers="K2",
)
def provenance_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = intel.popularity_signals(SIGNALS.frame(spark, sf_dir), AS_OF)
    return intel.provenance_tier(signals).select("ecosystem", "name", "provenance_tier")


@plan(
    "install_verdict",
    f"""WITH c AS ({_COUNTS_SQL}), j AS (SELECT s.*, {_TIER_SQL} AS tier, coalesce(total_vulnerabilities, 0) AS n, coalesce(critical_count, 0) AS cc
        FROM ({SIGNALS_SQL}) s LEFT JOIN c USING (ecosystem, name))
    SELECT ecosystem, name, n AS total_vulnerabilities,
        CASE WHEN known_hallucination OR tier = 'untrusted' OR cc > 0 OR (suspicious_scripts AND has_install_scripts) THEN 'blocked'
            WHEN tier = 'suspicious' OR n > 0 OR suspicious_scripts OR deprecated THEN 'warning' ELSE 'safe' END AS verdict FROM j""",
    covers="K9",
)
def install_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = intel.provenance_tier(intel.popularity_signals(SIGNALS.frame(spark, sf_dir), AS_OF))
    packages = tiers.selectExpr("ecosystem", "name", "known_hallucination AS confirmed_nonexistent", "provenance_tier",
                                "suspicious_scripts AS script_suspicious", "IF(has_install_scripts, 1, 0) AS script_critical_issues", "deprecated")
    return intel.install_verdict(packages, VULNERABILITIES.frame(spark, sf_dir)).select("ecosystem", "name", "total_vulnerabilities", "verdict")


_SUGGESTION = "CASE WHEN typosquat_distance BETWEEN 1 AND 2 THEN concat('real-', name) END"
_LOW_SQL = "(ecosystem = 'npm' AND coalesce(weekly_downloads < 100, false))"


@plan(
    "hallucination_risk_level",
    f"""SELECT ecosystem, name, CASE WHEN NOT exists_in_registry THEN 'critical' WHEN {_RECENT_SQL} AND {_LOW_SQL} THEN 'high' WHEN {_RECENT_SQL} THEN 'medium'
        WHEN {_LOW_SQL} THEN 'low' WHEN typosquat_distance BETWEEN 1 AND 2 THEN 'medium' WHEN version_spike THEN 'low' ELSE 'none' END AS risk_level
    FROM ({SIGNALS_SQL})""",
    covers="K10",
)
def hallucination_risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = intel.popularity_signals(SIGNALS.frame(spark, sf_dir), AS_OF)
    return intel.risk_level(signals.selectExpr("*", f"{_SUGGESTION} AS suggestion", "version_spike AS namespace_confusion")).select(
        "ecosystem", "name", "risk_level")


_HALLUC_SQL = "SELECT ecosystem, replace(package_name, 'ghost', 'pkg') AS package_name, confirmed, report_count, risk_score, first_seen FROM ({})".format(SUSPECTS.sql)


def _hallucinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SUSPECTS.frame(spark, sf_dir).withColumn("package_name", F.expr("replace(package_name, 'ghost', 'pkg')"))


@plan(
    "bulk_check",
    f"""WITH refs AS (SELECT DISTINCT ecosystem, name FROM ({REFS_SQL})), h AS ({_HALLUC_SQL}), t AS ({_TRUST_SQL})
    SELECT r.ecosystem, r.name, NOT coalesce(h.confirmed, false) AS exists, coalesce(t.trust_score, 50) AS trust_score,
        coalesce(t.trust_tier, 'partial') AS trust_tier, coalesce(h.confirmed, false) AS hallucination,
        coalesce(t.vulnerability_count, 0) > 0 AS vulnerable, t.highest_severity
    FROM refs r LEFT JOIN h ON h.ecosystem = r.ecosystem AND lower(h.package_name) = lower(r.name)
    LEFT JOIN t ON t.ecosystem = r.ecosystem AND t.name = r.name AND t.registry_exists""",
    covers="E2",
)
def bulk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = REFERENCES.frame(spark, sf_dir).select("ecosystem", "name").distinct()
    trust = intel.trust_score(SIGNALS.frame(spark, sf_dir).filter("registry_exists"))
    return intel.bulk_check(refs, _hallucinations(spark, sf_dir), trust)


@plan(
    "package_intelligence",
    f"""WITH refs AS (SELECT DISTINCT ecosystem, name FROM ({REFS_SQL})), h AS ({_HALLUC_SQL}), t AS (SELECT * FROM ({_TRUST_SQL}) WHERE registry_exists),
    v AS (SELECT ecosystem, lower(package_name) AS n, {_LABEL_SQL.format(_RANK_SQL)} AS hs, list_sort(list(DISTINCT fixed_version) FILTER (WHERE fixed_version IS NOT NULL)) AS fixes
        FROM ({VULNS_SQL}) GROUP BY ALL)
    SELECT r.ecosystem, r.name, NOT coalesce(confirmed, false) AS exists,
        coalesce(trust_score, CASE WHEN coalesce(confirmed, false) THEN 0 ELSE 50 END) AS trust_score, coalesce(confirmed, false) AS hallucination,
        v.n IS NOT NULL AS vulnerable, hs AS highest_severity, coalesce(array_to_string(fixes, '|'), '') AS patched_versions,
        CASE WHEN provenance_verified THEN 'verified' WHEN trust_score IS NOT NULL THEN 'partial' ELSE 'none' END AS provenance,
        CASE WHEN confirmed THEN report_count END AS report_count, CASE WHEN confirmed THEN risk_score END AS risk_score
    FROM refs r LEFT JOIN h ON h.ecosystem = r.ecosystem AND lower(h.package_name) = lower(r.name)
    LEFT JOIN t ON t.ecosystem = r.ecosystem AND t.name = r.name LEFT JOIN v ON v.ecosystem = r.ecosystem AND v.n = lower(r.name)""",
    covers="E3 F13 G3",
)
def package_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = REFERENCES.frame(spark, sf_dir).select("ecosystem", "name").distinct()
    trust = intel.trust_score(SIGNALS.frame(spark, sf_dir).filter("registry_exists"))
    known = intel.package_intelligence(refs, _hallucinations(spark, sf_dir), trust, VULNERABILITIES.frame(spark, sf_dir))
    return known.select("ecosystem", "name", "exists", "trust_score", "hallucination", "vulnerable", "highest_severity",
                        F.concat_ws("|", "patched_versions").alias("patched_versions"), "provenance", "report_count", "risk_score")


@plan(
    "dependency_issues",
    f"""WITH s AS (SELECT * REPLACE (name AS name), {_SUGGESTION} AS suggestion, {_RECENT_SQL} AS recent, {_LOW_SQL} AS low FROM ({SIGNALS_SQL})),
    v AS (SELECT ecosystem, package_name AS name, count(*) AS n, max({_RANK_SQL}) AS rk, arg_min(coalesce(fixed_version, ''), vuln_id) AS fix FROM ({VULNS_SQL}) GROUP BY ALL),
    j AS (SELECT r.file_id, r.line_no, r.ecosystem, r.name, s.exists_in_registry AS ok, s.suggestion, s.recent, s.low, v.n, v.rk, v.fix
        FROM ({REFS_SQL}) r JOIN s USING (ecosystem, name) LEFT JOIN v USING (ecosystem, name))
    SELECT file_id, line_no, ecosystem, name, 'hallucination' AS issue, 'error' AS severity, CASE WHEN suggestion IS NULL THEN 'remove' ELSE 'replace with ' || suggestion END AS fix, 0 AS vulnerability_count FROM j WHERE NOT ok
    UNION ALL SELECT file_id, line_no, ecosystem, name, 'typosquat', 'warning', 'verify against ' || suggestion, 0 FROM j WHERE ok AND suggestion IS NOT NULL
    UNION ALL SELECT file_id, line_no, ecosystem, name, 'low-popularity', 'warning', 'verify', 0 FROM j WHERE ok AND recent AND low
    UNION ALL SELECT file_id, line_no, ecosystem, name, 'vulnerability', CASE WHEN rk >= 3 THEN 'error' ELSE 'warning' END,
        CASE WHEN fix = '' THEN 'look for an alternative' ELSE 'update to ' || name || '@' || fix END, n FROM j WHERE ok AND n > 0""",
    covers="E22",
)
def dependency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = intel.popularity_signals(SIGNALS.frame(spark, sf_dir), AS_OF).selectExpr(
        "ecosystem", "name", "exists_in_registry", f"{_SUGGESTION} AS suggestion", "recently_registered", "low_popularity")
    refs = REFERENCES.frame(spark, sf_dir).join(signals, ["ecosystem", "name"])
    return intel.dependency_issues(refs, VULNERABILITIES.frame(spark, sf_dir))


@plan(
    "derive_trust_signals",
    f"""WITH p AS ({SIGNALS_SQL}), repo AS (SELECT *, nullif(regexp_extract(repository_url, 'github[.]com/([^/]+)/([^/.]+)', 1), '') AS o,
        nullif(regexp_extract(repository_url, 'github[.]com/([^/]+)/([^/.]+)', 2), '') AS r FROM p),
    stars AS (SELECT 'o' || (p_size % 50) AS o, 'r' || p_partkey AS r, p_size * 10 AS stars FROM part)
    SELECT ecosystem, name, weekly_downloads, CAST(floor(epoch({AS_OF} - created_at) / 86400) AS INT) AS package_age_days, total_versions,
        has_install_scripts, coalesce(repository_url <> '', false) AS has_repository, coalesce(stars, github_stars) AS github_stars
    FROM repo LEFT JOIN stars USING (o, r)""",
    covers="A11 E23 I1",
)
def derive_trust_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SIGNALS.frame(spark, sf_dir)
    registry = p.selectExpr("ecosystem", "name", "created_at", "total_versions AS version_count", "repository_url", "weekly_downloads",
                            "IF(has_install_scripts, map('postinstall', 'node x.js'), map('test', 'jest')) AS latest_scripts")
    repositories = table(spark, sf_dir, "part").selectExpr(
        "concat('o', p_size % 50) AS owner", "concat('r', p_partkey) AS repository", "p_size * 10 AS stars")
    return intel.derive_trust_signals(registry, repositories, p.select("ecosystem", "name", "github_stars"), AS_OF)
