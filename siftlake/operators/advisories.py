"""Security advisories: nested documents to flat rows, severities, matching and patch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.versions import version_key
from siftlake.operators.scan import quote
from siftlake.vocab import normalize_ecosystem, severity_label, severity_rank

OSV_SCHEMA = (
    "id STRING, summary STRING, aliases ARRAY<STRING>, severity ARRAY<STRUCT<type: STRING, score: STRING>>, "
    "database_specific STRUCT<severity: STRING>, "
    "affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>, versions: ARRAY<STRING>, "
    "ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<STRUCT<introduced: STRING, fixed: STRING, last_affected: STRING>>>>>>"
)

# What each part of a CVSS vector adds to the base of five.
VECTOR_WEIGHTS = (("AV:N", 1.5), ("AC:L", 0.5), ("PR:N", 0.5), ("UI:N", 0.5), ("S:C", 0.5), ("C:H", 0.5), ("I:H", 0.5), ("A:H", 0.5))

# Packages with a known replacement; the first is the one to recommend.
ALTERNATIVES = {
    "request": ("axios", "node-fetch", "got", "undici"), "node-uuid": ("uuid",),
    "querystring": ("qs", "URLSearchParams (built-in)"), "colors": ("chalk", "picocolors", "kleur"),
    "moment": ("dayjs", "date-fns", "luxon"), "underscore": ("lodash", "ramda"), "bower": ("npm", "pnpm", "yarn"),
    "left-pad": ("String.prototype.padStart (built-in)",), "nomnom": ("commander", "yargs", "meow"),
    "optimist": ("yargs", "minimist", "commander"),
    "mkdirp": ("fs.mkdirSync with recursive option (built-in Node 10+)",),
    "rimraf": ("fs.rmSync with recursive option (built-in Node 14+)",), "node-sass": ("sass (dart-sass)",),
    "tslint": ("eslint with @typescript-eslint",), "istanbul": ("nyc", "c8"), "jade": ("pug",),
    "coffee-script": ("TypeScript", "plain JavaScript"), "pycrypto": ("pycryptodome", "cryptography"),
    "optparse": ("argparse (stdlib)", "click", "typer"), "BeautifulSoup": ("beautifulsoup4",),
    "distribute": ("setuptools",), "PIL": ("Pillow",), "pydns": ("dnspython",),
    "mysql-python": ("mysqlclient", "PyMySQL"), "nose": ("pytest",), "fabric": ("fabric2", "invoke"),
}


def cvss_vector_score(vector: str) -> str:
    """Approximate base score of a CVSS vector, from the flags it contains."""
    parts = " + ".join(f"IF(contains({vector}, '{flag}'), {w}D, 0D)" for flag, w in VECTOR_WEIGHTS)
    return f"least(10D, 5D + {parts})"


def _ladder(score: str, lowest: str) -> str:
    return (f"CASE WHEN {score} >= 9 THEN 'critical' WHEN {score} >= 7 THEN 'high' WHEN {score} >= 4 THEN 'medium' "
            f"ELSE {lowest} END")


def osv_severity(policy: str = "database") -> str:
    """Severity of an advisory, as SQL text over ``severity`` and ``database_specific``.

    ``database``: the database's word, else the score or the vector, else unknown.
    ``first-score``: the first score, a vector counting as unknown; without one the database's word.
    ``scanner``: the database's word, else the first score with a vector counting as low, else medium.
    ``ingest``: the CVSS v3 score with a vector counting as low, else medium.
    """
    number = "try_cast(regexp_extract({0}, '^ *[-+]?[0-9]*[.]?[0-9]+', 0) AS DOUBLE)"
    first = "try_element_at(filter(transform(severity, s -> s.score), x -> x <> ''), 1)"
    third = "try_element_at(filter(severity, s -> s.type = 'CVSS_V3'), 1).score"
    word = "lower(database_specific.severity)"
    named = f"CASE WHEN {word} IN ('critical', 'high', 'medium', 'low') THEN {word} WHEN {word} = 'moderate' THEN 'medium' END"
    if policy == "database":
        scored = number.format(first)
        value = f"coalesce({scored}, IF({first} LIKE 'CVSS:%', {cvss_vector_score(first)}, NULL))"
        return f"coalesce({named}, CASE WHEN {value} IS NOT NULL THEN {_ladder(value, quote('low'))} END, 'unknown')"
    if policy == "first-score":
        scored = number.format(first)
        plain = f"CASE WHEN {word} IN ('critical', 'high', 'medium', 'low') THEN {word} END"
        ladder = f"CASE WHEN {scored} > 0 THEN {_ladder(scored, quote('low'))} ELSE 'unknown' END"
        return f"CASE WHEN {first} IS NOT NULL THEN {ladder} ELSE coalesce({plain}, 'unknown') END"
    if policy == "scanner":
        return f"coalesce({named}, CASE WHEN {first} IS NOT NULL THEN {_ladder(number.format(first), quote('low'))} END, 'medium')"
    if policy == "ingest":
        return f"CASE WHEN {third} IS NULL THEN 'medium' ELSE {_ladder(number.format(third), quote('low'))} END"
    raise ValueError(f"unknown severity policy {policy}")


def flatten_osv(osv: DataFrame, policy: str = "database", fix_pick: str = "last") -> DataFrame:
    """One row per advisory and affected package."""
    if fix_pick not in ("first", "last"):
        raise ValueError("fix_pick is first or last")
    entries = osv.selectExpr(
        "id AS vuln_id", "summary", f"{osv_severity(policy)} AS severity",
        "try_cast(try_element_at(filter(severity, s -> s.type = 'CVSS_V3'), 1).score AS DOUBLE) AS cvss_score",
        "filter(coalesce(aliases, array()), a -> startswith(a, 'CVE-')) AS cve_ids", "explode(affected) AS a",
    ).filter("a.package.name <> ''")
    events = entries.selectExpr("*", "flatten(transform(coalesce(a.ranges, array()), r -> r.events)) AS _events")
    bounds = events.selectExpr(
        "*", "filter(transform(_events, e -> e.introduced), x -> x <> '') AS _introduced",
        "filter(transform(_events, e -> e.fixed), x -> x <> '') AS fixed_versions",
    )
    pick = 1 if fix_pick == "first" else -1
    return bounds.select(
        "vuln_id", "summary", "severity", "cvss_score", "cve_ids",
        F.col("a.package.name").alias("package_name"),
        normalize_ecosystem(F.col("a.package.ecosystem")).alias("ecosystem"),
        F.expr("try_element_at(_introduced, -1)").alias("introduced"),
        F.expr("coalesce(concat('>=', try_element_at(_introduced, -1)), 'unknown')").alias("affected_range"),
        "fixed_versions",
        F.expr(f"try_element_at(fixed_versions, {pick})").alias("fixed_version"),
        F.expr("coalesce(a.versions, array())").alias("versions"),
    )


def github_advisory(advisories: DataFrame, name: str = "package_name") -> DataFrame:
    """Vulnerable range and first patched version of the advisory's entry for the row's package.

    Input: ``vulnerabilities array<struct<package: struct<name>, vulnerable_version_range,
    patched_versions, first_patched_version: struct<identifier>>>``.
    """
    entry = f"try_element_at(filter(vulnerabilities, v -> lower(v.package.name) = lower(`{name}`)), 1)"
    rest = [c for c in advisories.columns if c != "vulnerabilities"]
    return advisories.selectExpr(
        *rest, f"{entry}.vulnerable_version_range AS affected_range",
        f"coalesce({entry}.first_patched_version.identifier, {entry}.patched_versions) AS fixed_version",
    )


def new_advisories(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-if-absent by the natural key of an advisory."""
    keys = ["vuln_id", "ecosystem", "package_name"]
    rest = [c for c in incoming.columns if c not in keys]
    # Of several rows with one key the least by its other columns is inserted.
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in incoming.columns])
    return one.join(stored.select(*keys), keys, "left_anti")


def vulnerable_packages(refs: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """References whose version lies in an advisory's range, one row per pair.

    Version keys are computed once per side before the join; the range is a residual of the
    equality join on the package.
    """
    left = refs.filter("version IS NOT NULL").withColumn("_name", F.lower("name"))
    right = vulnerabilities.select(
        "ecosystem", F.lower("package_name").alias("_name"), "vuln_id", "severity", "fixed_version",
        F.expr(f"IF(introduced IS NULL OR introduced = '0', NULL, {version_key('introduced')})").alias("_from"),
        F.expr(f"IF(fixed_version IS NULL, NULL, {version_key('fixed_version')})").alias("_to"),
    )
    # A version of a package is keyed and compared once, however many references it has.
    versions = left.select("ecosystem", "_name", "version").distinct().withColumn("_key", F.expr(version_key("version")))
    hits = versions.join(right, ["ecosystem", "_name"]).filter("(_from IS NULL OR _key >= _from) AND (_to IS NULL OR _key < _to)").drop("_key", "_from", "_to")
    return left.join(hits, ["ecosystem", "_name", "version"]).select(*refs.columns, "vuln_id", "severity", "fixed_version")


def affected_ranges(osv: DataFrame, policy: str = "database") -> DataFrame:
    """Stretches of affected versions, every one of every range: vuln_id, severity, ecosystem, package_name, low, high, with_high, listed, fixed_version.

    A range is a time line of events.  From an ``introduced`` on versions are affected until the next event: before it, or up to
    and with it where that is a ``last_affected``.  Events come in any order; of equal versions ``introduced`` is the last.
    ``low`` and ``high`` are version keys, null beyond the last event.  A version that an advisory lists by name is a
    row with ``listed``.  ``fixed_version`` is the first fix behind the start of the stretch.
    """
    entries = osv.selectExpr("id AS vuln_id", f"{osv_severity(policy)} AS severity", "explode(affected) AS a").filter("a.package.name <> ''")
    named = entries.select("vuln_id", "severity", normalize_ecosystem(F.col("a.package.ecosystem")).alias("ecosystem"), F.col("a.package.name").alias("package_name"), "a")
    kinds = ("fixed", "last_affected", "introduced")
    event = " ".join(f"WHEN e.{k} <> '' THEN named_struct('key', {version_key(f'e.{k}')}, 'rank', {i}, 'version', e.{k})" for i, k in enumerate(kinds))
    lines = named.selectExpr("*", "explode(a.ranges) AS _range").selectExpr("*", f"array_sort(array_compact(transform(_range.events, e -> CASE {event} END))) AS _events")
    found = lines.selectExpr(
        "vuln_id", "severity", "ecosystem", "package_name",
        "inline(filter(transform(_events, (e, i) -> named_struct('rank', e.rank, 'low', e.key, 'next', get(_events, i + 1), "
        "'fixed_version', get(filter(slice(_events, i + 2, size(_events)), x -> x.rank = 0), 0).version)), x -> x.rank = 2))")
    stretches = found.selectExpr("vuln_id", "severity", "ecosystem", "package_name", "low", "next.key AS high", "coalesce(next.rank = 1, false) AS with_high", "CAST(NULL AS STRING) AS listed", "fixed_version")
    none = "CAST(NULL AS ARRAY<BIGINT>)"
    listed = named.selectExpr("vuln_id", "severity", "ecosystem", "package_name", f"{none} AS low", f"{none} AS high", "false AS with_high", "explode(a.versions) AS listed", "CAST(NULL AS STRING) AS fixed_version")
    return stretches.unionByName(listed.filter("listed IS NOT NULL"))


def affected_references(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """References to affected versions, one row per reference and advisory, with severity and fixed_version, the lowest fix.

    Each version of a package meets the package's stretches once, however many references it has; names listed by an
    advisory are an equality join of their own.
    """
    left = refs.filter("version IS NOT NULL").withColumn("_name", F.lower("name"))
    versions = left.select("ecosystem", "_name", "version").distinct().withColumn("_key", F.expr(version_key("version")))
    right = ranges.withColumn("_name", F.lower("package_name")).drop("package_name")
    inside = versions.join(right.filter("listed IS NULL"), ["ecosystem", "_name"]).filter("_key >= low AND (high IS NULL OR _key < high OR with_high AND _key = high)")
    named = versions.join(right.filter("listed IS NOT NULL").withColumnRenamed("listed", "version"), ["ecosystem", "_name", "version"])
    columns = ["ecosystem", "_name", "version", "vuln_id", "severity", "fixed_version"]
    fix = F.when(F.col("fixed_version").isNotNull(), F.struct(F.expr(version_key("fixed_version")).alias("key"), "fixed_version"))
    hits = inside.select(columns).unionByName(named.select(columns)).groupBy(*columns[:4]).agg(F.max("severity").alias("severity"), F.min(fix).getField("fixed_version").alias("fixed_version"))
    return left.join(hits, ["ecosystem", "_name", "version"]).select(*refs.columns, "vuln_id", "severity", "fixed_version")


def highest_severity(vulnerabilities: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.max(severity_rank(F.col("severity")))
    return vulnerabilities.groupBy(*keys).agg(severity_label(rank).alias("highest_severity"))


def vulnerability_counts(vulnerabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity and the highest fixed version of each package, reduced before the shuffle."""
    fixed = F.expr(version_key("fixed_version"))
    return vulnerabilities.groupBy(*keys).agg(
        F.count("*").alias("total_vulnerabilities"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")],
        F.max_by("fixed_version", F.when(F.col("fixed_version").isNotNull(), fixed)).alias("best_safe_version"),
    )


def patch_command(name: str, version: str, ecosystem: str) -> str:
    """SQL text of the command that installs a version; null without one."""
    # The commands.
    return (
        f"CASE WHEN {version} IS NULL THEN NULL "
        f"WHEN {ecosystem} = 'npm' THEN concat('npm install ', {name}, '@', {version}) "
        f"WHEN {ecosystem} = 'pypi' THEN concat('pip install \"', {name}, '>=', {version}, '\"') "
        f"WHEN {ecosystem} = 'go' THEN concat('go get ', {name}, '@v', {version}) "
        f"WHEN {ecosystem} = 'cargo' THEN concat('cargo update -p ', {name}, ' --precise ', {version}) "
        f"WHEN {ecosystem} = 'maven' THEN concat('Update ', {name}, ' version to ', {version}, ' in pom.xml') "
        f"ELSE concat('Update ', {name}, ' to version ', {version}) END"
    )


def _alternative(name: str) -> str:
    pairs = ", ".join(f"{quote(k)}, {quote(v[0])}" for k, v in ALTERNATIVES.items())
    return f"try_element_at(map({pairs}), {name})"


def patch_plan(packages: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Advisory counts, target version, command and recommended action of each package.

    ``packages``: (ecosystem, name, latest, deprecated).
    """
    counts = vulnerability_counts(
        vulnerabilities.withColumnRenamed("package_name", "name"), ["ecosystem", "name"]
    )
    joined = packages.join(counts, ["ecosystem", "name"], "left").na.fill(
        0, ["total_vulnerabilities", "critical_count", "high_count", "medium_count", "low_count"]
    )
    target = "coalesce(best_safe_version, latest)"
    action = (
        f"CASE WHEN deprecated AND {_alternative('name')} IS NOT NULL "
        f"THEN concat('Replace ', name, ' with ', {_alternative('name')}, ' (deprecated)') "
        "WHEN total_vulnerabilities > 0 AND best_safe_version IS NOT NULL THEN concat('Update to ', name, '@', best_safe_version) "
        "WHEN total_vulnerabilities > 0 AND latest IS NOT NULL THEN concat('Update to ', name, '@', latest, ' (latest)') "
        "WHEN total_vulnerabilities > 0 THEN concat('Review vulnerabilities and update ', name) "
        "WHEN deprecated THEN concat('Consider replacing deprecated package ', name) "
        "ELSE 'No action needed — no known vulnerabilities' END"
    )
    return joined.select(
        "*", F.expr(f"IF(total_vulnerabilities > 0, {patch_command('name', target, 'ecosystem')}, NULL)").alias("patch_command"),
        F.expr(action).alias("recommended_action"),
    )
