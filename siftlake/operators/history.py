"""Publication histories and maintainers: anomalies, ownership, reputation.

Input ``versions``: (ecosystem, package, version, published_at, publisher, ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftlake.functions.versions import major, version_key
from siftlake.operators.sequences import consecutive, time_bucket
from siftlake.session import checkpointed

KEYS = ["ecosystem", "package"]
ORDER = ["published_at", "ordinal"]
BURST_SECONDS = 6 * 3600
BURST_SIZE = 5

# Points of a publication anomaly by severity.
ANOMALY_POINTS = {"critical": 45, "high": 25, "medium": 12, "low": 5}
# Points a maintainer signal takes by severity, and the starting score.
SIGNAL_POINTS = {"critical": 40, "high": 20, "medium": 8, "low": 3}
STARTING_SCORE = 95
# Throw-away mail domains and accounts with a public incident.
DISPOSABLE_DOMAINS = (
    "mailinator.com", "10minutemail.com", "tempmail.com", "guerrillamail.com", "throwawaymail.com", "maildrop.cc",
    "yopmail.com", "sharklasers.com", "getnada.com", "trashmail.com", "dispostable.com", "fakeinbox.com",
    "inboxalias.com", "mintemail.com", "spam4.me", "spamgourmet.com", "mohmal.com", "emailondeck.com",
    "temp-mail.org", "mail-temp.com",
)
FLAGGED_ACCOUNTS = ("right9ctrl",)
# Usual source hosts.
SOURCE_HOSTS = r"(?i)github\\.com|gitlab\\.com|bitbucket\\.org|codeberg\\.org"


def _anomaly(df: DataFrame, anomaly: str, severity: str, evidence: str) -> DataFrame:
    return df.selectExpr(*KEYS, f"{anomaly} AS anomaly_id", f"{severity} AS severity", f"{evidence} AS evidence")


#: A package with more publications than this is cut into intervals; the others are put in order by one task each.
LONG_HISTORY = 100_000
#: Interval of the blocks in which neighbours are found, long enough that most rows of a daily history are inside one.
_WEEK = 7 * 86400


def _neighbours_found(first: DataFrame) -> DataFrame:
    """The anomalies of ``o`` and ``d``, the first pairs of neighbours out of order and with a long gap."""
    changed = "coalesce(d.prev.publisher <> d.cur.publisher, false)"
    found = (
        "array_compact(array(IF(o IS NULL, NULL, named_struct('id', 'CG_PANOM_001', 'severity', 'high', 'evidence', concat(o.prev.version, ' > ', o.cur.version))), "
        f"IF(d IS NULL, NULL, named_struct('id', IF({changed}, 'CG_PANOM_003a', 'CG_PANOM_003b'), 'severity', IF({changed}, 'critical', 'medium'), "
        "'evidence', concat(d.prev.version, ' > ', d.cur.version)))))"
    )
    return _anomaly(first.selectExpr(*KEYS, f"explode({found}) AS a"), "a.id", "a.severity", "a.evidence")


def _first_neighbours() -> list[Column]:
    """Of structs ``prev`` and ``cur``: the first that are out of order, as ``o``, and the first with a gap of more than a year, as ``d``."""
    at = F.struct("cur.published_at", "cur.ordinal")
    gap = F.unix_micros(F.col("cur.published_at").cast("timestamp")) - F.unix_micros(F.col("prev.published_at").cast("timestamp"))
    both = F.struct(F.struct("prev.version", "prev.publisher").alias("prev"), F.struct("cur.version", "cur.publisher").alias("cur"))
    return [F.min_by(both, F.when(F.expr("cur._key < prev._key"), at)).alias("o"), F.min_by(both, F.when(gap > 365 * 86_400_000_000, at)).alias("d")]


def neighbour_anomalies(versions: DataFrame) -> DataFrame:
    """What two publications in a row show: the first lower version after a higher one, and the first gap of more than a year.

    One pass finds the neighbours, and one aggregate per package the first of each kind.  The gap is worse when the
    publisher changed.
    """
    keyed = versions.withColumn("_key", F.expr(version_key("version", 3)))
    pairs = consecutive(keyed, KEYS, ORDER, time_bucket("published_at", _WEEK))
    return _neighbours_found(pairs.groupBy(*KEYS).agg(*_first_neighbours()))


def out_of_order(versions: DataFrame) -> DataFrame:
    """The first version of each package that is lower than the one published before it."""
    return neighbour_anomalies(versions).filter("anomaly_id = 'CG_PANOM_001'")


def bursts(versions: DataFrame) -> DataFrame:
    """Every publication that is the fifth within six hours.

    A row joins its own six-hour interval and the next one, so that the four publications
    before it are in the same partition whenever they lie within six hours.
    """
    own = time_bucket("published_at", BURST_SECONDS)
    spread = versions.select("*", own.alias("_own"), F.explode(F.array(own, own + 1)).alias("_bucket"))
    window = W.partitionBy(*KEYS, "_bucket").orderBy(*ORDER)
    lagged = spread.withColumn("window_start", F.lag("published_at", BURST_SIZE - 1).over(window))
    close = F.unix_micros(F.col("published_at").cast("timestamp")) - F.unix_micros(F.col("window_start").cast("timestamp"))
    return lagged.filter((F.col("_own") == F.col("_bucket")) & (close <= BURST_SECONDS * 1_000_000)).drop("_own", "_bucket")


def burst_publish(versions: DataFrame) -> DataFrame:
    return _burst_found(bursts(versions).groupBy(*KEYS).agg(
        F.min_by(F.struct("window_start", "published_at"), F.struct(*ORDER)).alias("f")
    ))


def _burst_found(first: DataFrame) -> DataFrame:
    return _anomaly(first, "'CG_PANOM_002'", "'high'", "concat(CAST(f.window_start AS STRING), ' > ', CAST(f.published_at AS STRING))")


def dormant_then_active(versions: DataFrame) -> DataFrame:
    """The first gap of more than a year; worse when the publisher changed."""
    return neighbour_anomalies(versions).filter("anomaly_id IN ('CG_PANOM_003a', 'CG_PANOM_003b')")


def version_jump(versions: DataFrame) -> DataFrame:
    """The first step in version order that skips ten or more majors.

    Only the lowest and highest version of each major matter, so the history is reduced to
    its majors before it is put in order.
    """
    placed = versions.selectExpr(*KEYS, "version", f"{major('version')} AS _major", f"struct({version_key('version', 3)} AS k, published_at, ordinal) AS _at")
    majors = placed.groupBy(*KEYS, "_major").agg(F.min_by("version", "_at").alias("_lowest"), F.max_by("version", "_at").alias("_highest"))
    window = W.partitionBy(*KEYS).orderBy("_major")
    steps = majors.select(*KEYS, "_major", "_lowest", F.lag("_major").over(window).alias("_from"),
                          F.lag("_highest").over(window).alias("_before"))
    first = steps.filter("_major - _from >= 10").groupBy(*KEYS).agg(F.min_by(F.struct("_before", "_lowest"), "_major").alias("f"))
    return _anomaly(first, "'CG_PANOM_004'", "'medium'", "concat(f._before, ' > ', f._lowest)")


def history_shape(versions: DataFrame) -> DataFrame:
    """Straight from 0.x to 1.0.0, and many publishers."""
    shape = versions.groupBy(*KEYS).agg(
        F.count_distinct("version").alias("_versions"), F.count_distinct("publisher").alias("_publishers"),
        F.bool_or(F.expr("version LIKE '0.%'")).alias("_zero"), F.bool_or(F.expr("version = '1.0.0'")).alias("_one"),
    )
    return _shape_found(shape)


def _shape_found(shape: DataFrame) -> DataFrame:
    found = (
        "array_compact(array(IF(_zero AND _one AND _versions <= 3, named_struct('id', 'CG_PANOM_005', 'severity', 'low', "
        "'evidence', concat(_versions, ' versions')), NULL), IF(_publishers >= 3, named_struct('id', 'CG_PANOM_006', "
        "'severity', 'medium', 'evidence', concat(_publishers, ' publishers')), NULL)))"
    )
    return _anomaly(shape.selectExpr(*KEYS, f"explode({found}) AS a"), "a.id", "a.severity", "a.evidence")


def _short_anomalies(versions: DataFrame) -> DataFrame:
    """All anomalies of packages whose history one task can put in order.

    Rows are dealt out by package once; inside a package they are sorted by version and by publisher, to count different
    ones, and by time, to find neighbours.
    """
    dealt = versions.select(*KEYS, "version", "published_at", "publisher", "ordinal").repartition(*KEYS)
    rows = dealt.withColumn("_key", F.expr(version_key("version", 3)))
    for column in ("version", "publisher"):
        window = W.partitionBy(*KEYS, column).orderBy(column)
        rows = rows.withColumn(f"_new_{column}", F.col(column).isNotNull() & (F.row_number().over(window) == 1))
    order = W.partitionBy(*KEYS).orderBy(*ORDER)
    row = F.struct("version", "publisher", "published_at", "ordinal", "_key")
    rows = rows.select(
        *KEYS, "_new_version", "_new_publisher", row.alias("cur"), F.lag(row).over(order).alias("prev"), F.lag("published_at", BURST_SIZE - 1).over(order).alias("_start"))
    close = F.unix_micros(F.col("cur.published_at").cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp")) <= BURST_SECONDS * 1_000_000
    burst = F.struct(F.col("_start").alias("window_start"), F.col("cur.published_at").alias("published_at"))
    # Computed once and written: four kinds of anomalies read it.
    packages = checkpointed(rows.groupBy(*KEYS).agg(
        *_first_neighbours(), F.min_by(burst, F.when(close, F.struct("cur.published_at", "cur.ordinal"))).alias("f"),
        F.count_if("_new_version").alias("_versions"), F.count_if("_new_publisher").alias("_publishers"),
        F.bool_or(F.expr("cur.version LIKE '0.%'")).alias("_zero"), F.bool_or(F.expr("cur.version = '1.0.0'")).alias("_one")))
    found = _neighbours_found(packages).unionByName(_burst_found(packages.filter("f IS NOT NULL"))).unionByName(_shape_found(packages))
    return found.unionByName(version_jump(dealt))


def publish_anomalies(versions: DataFrame, long_history: int = LONG_HISTORY) -> DataFrame:
    """All anomalies, at most one of each kind per package.

    Packages with more than ``long_history`` publications, of which there are few, are cut into intervals.
    """
    long = checkpointed(versions.groupBy(*KEYS).agg(F.count("*").alias("_n")).filter(F.col("_n") > long_history).select(*[F.col(k).alias(f"_{k}") for k in KEYS]))
    if long.isEmpty():
        return _short_anomalies(versions)
    same = F.expr(" AND ".join(f"{k} <=> _{k}" for k in KEYS))
    found, others = _short_anomalies(versions.join(F.broadcast(long), same, "left_anti")), versions.join(F.broadcast(long), same, "left_semi")
    for kind in (neighbour_anomalies, burst_publish, version_jump, history_shape):
        found = found.unionByName(kind(others))
    return found


def publish_risk(versions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Versions, anomalies and risk of every package."""
    points = "CASE severity " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in ANOMALY_POINTS.items()) + " END"
    scored = anomalies.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.sum(F.expr(points)).alias("_points"))
    packages = versions.groupBy(*KEYS).agg(F.count("*").alias("version_count"))
    return packages.join(scored, KEYS, "left").selectExpr(
        *KEYS, "version_count", "coalesce(_n, 0) AS anomalies", "least(100, coalesce(_points, 0)) AS risk_score"
    )


def publishers(versions: DataFrame) -> DataFrame:
    """Latest publisher of each package, how often it published, and how many publishers there are."""
    per_publisher = versions.filter("publisher IS NOT NULL").groupBy(*KEYS, "publisher").agg(
        F.count("*").alias("_n"), F.max(F.struct(*ORDER)).alias("_last")
    )
    return per_publisher.groupBy(*KEYS).agg(
        F.max_by("publisher", "_last").alias("latest_publisher"), F.max("_last.published_at").alias("latest_published_at"),
        F.max_by("_n", "_last").alias("latest_publisher_versions"), F.count("*").alias("publisher_count"),
    )


def ownership_change(versions: DataFrame, packages: DataFrame) -> DataFrame:
    """Latest version by an account that is not a maintainer, or several publishers.

    ``packages``: (ecosystem, package, maintainers array<struct<name, email>>).
    """
    joined = publishers(versions).join(packages.select(*KEYS, "maintainers"), KEYS)
    listed = "array_contains(transform(maintainers, m -> m.name), latest_publisher)"
    return joined.filter("publisher_count > 1").selectExpr(
        *KEYS, "latest_publisher", "publisher_count",
        f"IF(coalesce({listed}, false), 'CG_MAINT_006', 'CG_MAINT_005') AS signal_id",
        f"IF(coalesce({listed}, false), 'medium', 'critical') AS severity",
    )


def recent_rare_publisher(versions: DataFrame, as_of: str) -> DataFrame:
    """Latest version less than two days old, by one of several publishers who published at most twice."""
    return publishers(versions).filter(
        f"publisher_count > 1 AND latest_publisher_versions <= 2 AND latest_published_at > {as_of} - INTERVAL 48 HOURS"
    )


def email_domain(email: str) -> str:
    return f"lower(split({email}, '@')[1])"


def maintainer_report(packages: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """Signals, score and verdict of every package; a package without metadata is unknown.

    ``packages``: (ecosystem, package, found, maintainers array<struct<name, email>>,
    created_at, repository_url, readme_length, weekly_downloads).
    """
    joined = packages.join(publishers(versions), KEYS, "left")
    domains = "(" + ", ".join(f"'{d}'" for d in DISPOSABLE_DOMAINS) + ")"
    flagged = "(" + ", ".join(f"'{a}'" for a in FLAGGED_ACCOUNTS) + ")"
    npm = "ecosystem = 'npm'"
    age = f"floor(timestampdiff(SECOND, created_at, {as_of}) / 86400)"
    listed = "coalesce(array_contains(transform(maintainers, m -> m.name), latest_publisher), false)"
    several = "coalesce(publisher_count, 0) > 1"
    # Signals, severities and thresholds.
    single = (
        ("CG_MAINT_001", "medium", "coalesce(size(maintainers), 0) <= 0"),
        ("CG_MAINT_002", "low", f"{npm} AND size(maintainers) = 1"),
        ("CG_MAINT_005", "critical", f"{npm} AND {several} AND NOT {listed}"),
        ("CG_MAINT_006", "medium", f"{npm} AND {several} AND {listed}"),
        ("CG_MAINT_007", "high", f"{age} < 30"),
        ("CG_MAINT_008", "medium", f"{age} >= 30 AND {age} < 180"),
        ("CG_MAINT_009", "high", f"{npm} AND {several} AND latest_publisher_versions <= 2 AND latest_published_at > {as_of} - INTERVAL 48 HOURS"),
        ("CG_MAINT_010", "medium", "coalesce(repository_url, '') = ''"),
        ("CG_MAINT_011", "low", f"{npm} AND repository_url <> '' AND NOT repository_url RLIKE '{SOURCE_HOSTS}'"),
        ("CG_MAINT_012", "low", f"{npm} AND coalesce(readme_length, 0) < 100"),
        ("CG_MAINT_013", "medium", f"{npm} AND weekly_downloads < 20"),
        ("CG_MAINT_014", "low", f"{npm} AND weekly_downloads >= 20 AND weekly_downloads < 1000"),
    )
    signals = ", ".join(
        f"IF({condition}, named_struct('id', '{i}', 'severity', '{s}'), NULL)" for i, s, condition in single
    )
    disposable = f"transform(filter(maintainers, m -> {email_domain('m.email')} IN {domains}), m -> named_struct('id', 'CG_MAINT_003', 'severity', 'high'))"
    incident = f"transform(filter(maintainers, m -> {npm} AND lower(m.name) IN {flagged}), m -> named_struct('id', 'CG_MAINT_004', 'severity', 'critical'))"
    none = "CAST(array() AS ARRAY<STRUCT<id: STRING, severity: STRING>>)"
    all_signals = f"concat(array_compact(array({signals})), coalesce({disposable}, {none}), coalesce({incident}, {none}))"
    points = "CASE s.severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SIGNAL_POINTS.items()) + " ELSE 0 END"
    unknown = "array(named_struct('id', 'CG_MAINT_999', 'severity', 'info'))"
    reported = joined.selectExpr(*KEYS, "found", f"IF(found, {all_signals}, {unknown}) AS signals")
    scored = reported.withColumn("score", F.expr(
        f"IF(found, greatest(0, {STARTING_SCORE} - aggregate(signals, 0, (t, s) -> t + {points})), 0)"))
    return scored.withColumn("verdict", F.expr(
        "CASE WHEN NOT found THEN 'unknown' WHEN score >= 80 THEN 'trusted' WHEN score >= 55 THEN 'caution' ELSE 'suspect' END"
    )).drop("found")
