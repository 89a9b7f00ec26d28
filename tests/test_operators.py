"""Operators against hand-computed cases and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftlake.operators import (
    attribution, deps, diffs, exports, history, intel, licenses, policy, reports, scoring, sequences, similarity, taint, telemetry,
)

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def hot(spark, n=3000):
    """Rows of which one key holds more than a third."""
    random.seed(7)
    rows = [("hot" if i % 5 < 2 else f"k{i % 40}", T0 + dt.timedelta(seconds=random.randrange(5_000_000)), i, i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts timestamp, id long, v long")


def test_consecutive_equals_a_plain_window(spark):
    df = hot(spark)
    got = sequences.consecutive(df, ["k"], ["ts", "id"], sequences.time_bucket("ts")).select("k", "prev.id", F.col("cur.id").alias("next"))
    lag = F.lag("id").over(W.partitionBy("k").orderBy("ts", "id"))
    want = df.select("k", lag.alias("id"), F.col("id").alias("next")).filter("id IS NOT NULL")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_running_total_equals_a_plain_window(spark):
    df = hot(spark)
    got = sequences.running_total(df, ["k"], ["ts", "id"], sequences.time_bucket("ts"), F.col("v"), "total").select("id", "total")
    window = W.partitionBy("k").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(window).alias("total"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_last_per_key_limits_before_the_shuffle(spark):
    df = sequences.last_per_key(hot(spark), ["k"], ["ts", "id"], 3)
    assert df.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_bursts_equal_brute_force(spark):
    df = hot(spark).select(F.lit("npm").alias("ecosystem"), F.col("k").alias("package"), F.lit("1.0.0").alias("version"),
                           F.col("ts").alias("published_at"), F.lit("p").alias("publisher"), F.col("id").alias("ordinal"))
    got = {r.ordinal for r in history.bursts(df).collect()}
    by_key: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.published_at, r.ordinal)):
        by_key.setdefault(r.package, []).append(r)
    want = {rs[i].ordinal for rs in by_key.values() for i in range(4, len(rs)) if rs[i].published_at - rs[i - 4].published_at <= dt.timedelta(hours=6)}
    assert got == want and want


def versions(spark, *rows):
    return spark.createDataFrame([("npm", "p", v, T0 + dt.timedelta(hours=h), who, i) for i, (v, h, who) in enumerate(rows)],
                                 "ecosystem string, package string, version string, published_at timestamp, publisher string, ordinal long")


@pytest.mark.parametrize("rows, found, risk", [
    ([("5.0.0", 0, "a"), ("2.10.1", 24, "a")], {"CG_PANOM_001": "high"}, 25),
    ([(f"1.0.{i}", i * 1.5, "a") for i in range(5)], {"CG_PANOM_002": "high"}, 25),
    ([("1.0.0", 0, "a"), ("1.0.1", 400 * 24, "b")], {"CG_PANOM_003a": "critical"}, 45),
    ([("1.0.0", 0, "a"), ("1.0.1", 400 * 24, "a")], {"CG_PANOM_003b": "medium"}, 12),
    ([("1.2.3", 0, "a"), ("99.0.0", 24, "a")], {"CG_PANOM_004": "medium"}, 12),
    ([("0.9.0", 0, "a"), ("1.0.0", 24, "a")], {"CG_PANOM_005": "low"}, 5),
    ([("1.1.0", 0, "a"), ("1.2.0", 24, "b"), ("1.3.0", 48, "c")], {"CG_PANOM_006": "medium"}, 12),
    ([("1.1.0", 0, "a"), ("1.2.0", 24, "a")], {}, 0),
])
def test_publish_anomalies(spark, rows, found, risk):
    df = versions(spark, *rows)
    anomalies = history.publish_anomalies(df)
    assert {r.anomaly_id: r.severity for r in anomalies.collect()} == found
    assert history.publish_risk(df, anomalies).first().risk_score == risk


def names(spark, *values):
    return spark.createDataFrame([("npm", v) for v in values], "ecosystem string, name string")


def test_lookalike_cases(spark):
    targets = similarity.popular_packages(spark)
    found = {(r.name, r.target): r for r in similarity.typosquat_matches(names(spark, "raect", "react-official", "react", "l0dash"), targets).collect()}
    r = found[("raect", "react")]
    assert r.score == 1.0 and set(r.signals) == {"levenshtein-1", "transposition", "phonetic"}
    assert ("react-official", "react") not in found and "react" not in {k[0] for k in found}
    assert found[("l0dash", "lodash")].severity == "critical"
    free = similarity.typosquat_matches(names(spark, "official-react"), targets, threshold=0.45, length_guard=False)
    assert ("official-react", "react") in {(r.name, r.target) for r in free.collect()}


def test_blocking_finds_what_all_pairs_find(spark):
    random.seed(3)
    letters = "abcdeklo01-"
    pool = list(similarity.POPULAR_NPM[:40])
    mutants = set()
    for _ in range(150):
        name = list(random.choice(pool))
        for _ in range(random.randrange(1, 4)):
            i = random.randrange(len(name))
            random.choice((lambda: name.insert(i, random.choice(letters)), lambda: name.__setitem__(i, random.choice(letters)), lambda: len(name) > 2 and name.pop(i)))()
        mutants.add("".join(name))
    df = names(spark, *mutants).withColumn("_low", F.lower("name"))
    targets = similarity.popular_packages(spark).filter("ecosystem = 'npm' AND ord < 40").withColumn("_target_low", F.lower("target"))
    pairs = df.join(targets, "ecosystem").filter("target <> name AND target <> _low AND abs(length(_low) - length(_target_low)) <= 4")
    weights = dict(similarity.WEIGHTS)

    def score(r):
        total = sum(weights[s] for s in r.signals)
        return round(min(1.0, total + 0.05 * (len(r._target_low) >= 8) + 0.05 * (len(r._target_low) >= 12)), 6)

    want = {(r.name, r.target): score(r) for r in similarity.similarity_signals(pairs).collect()}
    want = {k: v for k, v in want.items() if v >= 0.55}
    got = similarity.typosquat_matches(names(spark, *mutants), targets.drop("_target_low"), best=1000)
    assert {(r.name, r.target): round(r.score, 6) for r in got.collect()} == want


def test_osa_distance_edits_each_piece_once(spark):
    df = spark.createDataFrame([("ca", "abc"), ("ab", "ba"), ("", "abc"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(similarity.osa_distance("a", "b")).collect()] == [3, 1, 3, 0]


def test_trust_score_of_unknown_package(spark):
    columns = ("malware_flagged known_hallucination registry_exists provenance_verified verified_publisher has_repository recent_ownership_change "
               "version_spike has_install_scripts suspicious_scripts").split()
    numbers = "slsa_level weekly_downloads github_stars publisher_age_days package_age_days total_versions vulnerability_count typosquat_distance".split()
    schema = ", ".join([f"{c} boolean" for c in columns] + [f"{c} int" for c in numbers] + ["download_velocity string", "highest_severity string"])
    r = intel.trust_score(spark.createDataFrame([(None,) * 20], schema)).first()
    assert (r.trust_score, r.trust_tier) == (30, "suspicious")


def test_scores_and_trend(spark):
    r = scoring.security_score(spark.createDataFrame([("p", "secret", "critical", 3)], "project string, category string, severity string, count int")).first()
    assert (r.score, r.grade, r.secrets_score, r.code_score) == (25, "F", 0, 100)
    rows = [("p", T0 + i * DAY, i, 60 if i < 5 else 70) for i in range(10)] + [("q", T0, 99, 10)]
    trend = {r.project: r.trend for r in scoring.score_trend(spark.createDataFrame(rows, "project string, ts timestamp, snapshot_id long, score int")).collect()}
    assert trend == {"p": "improving", "q": "stable"}


def test_license_policies(spark):
    df = spark.createDataFrame([("MIT OR GPL-3.0-only",), ("GPL-3.0-only",), ("MIT AND AGPL-3.0",), (None,)], "license string")

    def found(**kw):
        return {(r.license, r.rule_id) for r in licenses.license_findings(df, licenses.LicensePolicy(**kw)).collect()}

    assert found() == {("GPL-3.0-only", "CG_LIC_020"), (None, "CG_LIC_001")}
    assert ("MIT AND AGPL-3.0", "CG_LIC_021") in found(strict_and=True)
    assert found(deny=("MIT", "GPL-3.0-only"), allow_unknown=True) == {("MIT OR GPL-3.0-only", "CG_LIC_010"), ("GPL-3.0-only", "CG_LIC_010")}
    assert found(deny_categories=("strong-copyleft",), allow=("GPL-3.0-only",), allow_unknown=True) == set()


def test_reports(spark):
    rows = [(1, "H", "HALLUCINATION", .9), (2, "H", "HALLUCINATION", .7), (3, "H", "FALSE_POSITIVE", .5)]
    df = spark.createDataFrame([("npm", n, t, c) for _, n, t, c in rows], "ecosystem string, package_name string, report_type string, confidence double")
    assert reports.report_confidence(df).first().confidence == pytest.approx((.9 + .7 - .5) / 3)
    many = spark.createDataFrame([("npm", "x", True, T0 + i * DAY / 5, i, None, "m" if i == 3 else None) for i in range(51)],
                                 "ecosystem string, package_name string, confirmed_nonexistent boolean, created_at timestamp, report_id long, ide string, model string")
    r = reports.fold_reports(many.withColumn("agent", F.lit("a")).withColumn("interaction", F.lit(None).cast("string"))).first()
    assert (r.report_count, r.confirmed, r.risk_score, r.model) == (51, True, 1.0, "m")


def test_subscriptions(spark):
    events = spark.createDataFrame([(1, "vuln_found")], "event_id long, event_type string")
    subs = spark.createDataFrame([("a", [], True), ("b", ["vuln_found", "vuln_found"], True), ("c", ["x"], True), ("d", [], False)], "id string, events array<string>, enabled boolean")
    full = subs.withColumn("type", F.lit("slack")).withColumn("url", F.lit("u")).withColumn("project_key", F.lit(None).cast("string")).withColumn("issue_type", F.lit(None).cast("string"))
    assert sorted(r.subscription_id for r in telemetry.match_subscriptions(events, full).collect()) == ["a", "b"]


def test_policy_ladder(spark):
    df = spark.createDataFrame([("a", "1", "none", "high"), ("b", "1", "verified", None)], "name string, version string, provenance string, max_severity string")
    strict = policy.Policy(mode="enforce", forbidden_packages=("b@1",), required_provenance_level="partial", max_allowed_severity="medium")
    got = {(r.name, r.rule, r.severity) for r in policy.package_violations(df, strict).collect()}
    assert got == {("a", "required_provenance_level", "error"), ("a", "max_allowed_severity", "error"), ("b", "forbidden_packages", "error")}
    assert policy.package_violations(df, policy.Policy()).count() == 0


def test_attribution_of_a_line(spark):
    regions = spark.createDataFrame([(1, 5, 9, "ai", .9)], "file_id long, start_line int, end_line int, source string, confidence double")
    found = spark.createDataFrame([(1, 7), (1, 20)], "file_id long, line_no int")
    assert {(r.line_no, r.source) for r in attribution.attribute_findings(found, regions).collect()} == {(7, "ai"), (20, "unknown")}


def speed(rows):
    """The counters as a person would step through them."""
    flags, last, reset, n = {}, None, None, 0
    for ts, i, text in sorted(rows):
        last, reset = (ts if last is None else last), (ts if reset is None else reset)
        n += len(text)
        flags[i] = (ts - last).total_seconds() * 1000 < 200 and n > 150
        last = ts
        if (ts - reset).total_seconds() * 1000 > 5000:
            n, reset = 0, ts
    return flags


def typing(spark):
    random.seed(11)
    rows, at = [], {d: T0 for d in "abc"}
    for i in range(600):
        d = random.choice("aaab" "c")
        at[d] += dt.timedelta(milliseconds=random.choice((20, 50, 150, 300, 900, 5100, 7000)))
        rows.append((d, at[d], i, "x" * random.randrange(1, 90)))
    return rows, spark.createDataFrame(rows, "document_id string, ts timestamp, change_id long, text string")


def test_typing_velocity_equals_brute_force(spark):
    rows, df = typing(spark)
    want = {}
    for d in "abc":
        want |= speed([(ts, i, text) for doc, ts, i, text in rows if doc == d])
    assert {r.change_id: r.high_speed for r in attribution.typing_velocity(df).collect()} == want
    assert any(want.values())


def test_change_signals(spark):
    rows = [(1, "a\nb\nc"), (2, "x"), (3, "y" * 80 + "\n" + "z" * 30), (4, "import a\nimport b")]
    got = {r.i: set(r.signals) for r in attribution.change_signals(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got == {1: {"burst-insertion"}, 2: set(), 3: {"multi-line-single-event", "paste-detected"}, 4: {"import-heavy"}}


def test_regions_are_folded_in_order(spark):
    """Neighbours joined before a later write go with the region they became; a later write replaces all it touches."""
    rows = [(1, 1, 1, 5, "ai", 0.5, ["a"], 1), (1, 2, 6, 10, "ai", 0.9, ["b"], 2), (1, 3, 8, 12, "human", 0.1, None, 3), (2, 4, 1, 5, "ai", 0.5, ["a"], 1), (2, 5, 6, 10, "ai", 0.9, ["b"], 2),
            (None, 6, 3, 3, "human", 0.2, ["c"], 1), (2, 7, 20, 21, "human", 0.3, ["a"], 3), (2, 8, 11, 11, "ai", 0.2, ["b"], 4)]
    df = spark.createDataFrame(rows, "file_id long, region_id long, start_line int, end_line int, source string, confidence double, signals array<string>, ts long")
    got = {(r.file_id, r.start_line, r.end_line, r.source, r.confidence, tuple(r.signals)) for r in attribution.merge_regions(df).collect()}
    assert got == {(1, 8, 12, "human", 0.1, ()), (2, 1, 11, "ai", 0.9, ("a", "b")), (2, 20, 21, "human", 0.3, ("a",)), (None, 3, 3, "human", 0.2, ("c",))}
    assert attribution.merge_regions(df.limit(0)).collect() == []


def test_snapshot_merge_is_a_fold_in_any_order(spark):
    r = random.Random(3)
    rows = [("npm", f"p{r.randrange(6)}", bool(r.randrange(2)), f"2024-01-{r.randrange(1, 28):02d} 00:00:00", i, *[r.choice([None, "x", "y", "z"]) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "ecosystem string, package_name string, confirmed_nonexistent boolean, t string, report_id long, model string, ide string, agent string, interaction string").withColumn("created_at", F.col("t").cast("timestamp"))
    for policy in ("first", "last"):
        parts = [reports.fold_reports(df.filter(F.col("report_id") % 3 == k), policy, True).withColumn("claimed", F.lit(False)) for k in (2, 0, 1)]
        merged = reports.merge_snapshots(reports.merge_snapshots(parts[0], parts[1], policy), parts[2], policy)
        whole = reports.fold_reports(df, policy)
        keep = ["ecosystem", "package_name", "report_count", "first_seen", "last_seen", "confirmed", *reports.DESCRIPTIVE, "risk_score"]
        assert sorted(map(str, merged.select(*keep).collect())) == sorted(map(str, whole.select(*keep).collect()))


def test_consolidation_adds_batches_up(spark):
    r = random.Random(4)
    rows = [("npm", f"p{r.randrange(8)}", r.choice(["HALLUCINATION", "HALLUCINATION", "FALSE_POSITIVE", "TYPOSQUAT"]), r.choice([0.5, 0.9]), "2024-03-01 00:00:00") for _ in range(90)]
    df = spark.createDataFrame(rows, "ecosystem string, package_name string, report_type string, confidence double, t string").withColumn("created_at", F.col("t").cast("timestamp")).withColumn("n", F.monotonically_increasing_id())
    stored = spark.sql("SELECT 'npm' AS ecosystem, 'old' AS package_name, 'CONFIRMED' AS status, TIMESTAMP '2024-01-01' AS verified_at, TIMESTAMP '2024-01-01' AS last_seen, 900L AS report_count, 800L AS hallucination_reports, 0L AS false_positive_reports, 700D AS confidence_sum, 900D AS weight_sum")
    as_of = "TIMESTAMP '2024-03-02'"
    step = stored
    for k in range(3):
        step = reports.consolidate_batch(step, df.filter(F.col("n") % 3 == k), as_of)
    got = {x.package_name: (x.report_count, x.status, round(x.confidence, 9)) for x in step.collect()}
    assert got.pop("old") == (900, "CONFIRMED", round(700 / 900, 9))
    base = df.select("ecosystem", "package_name").distinct().selectExpr("*", "'SUSPECTED' AS status", "CAST(NULL AS TIMESTAMP) AS verified_at", "TIMESTAMP '2024-03-01' AS last_seen", "0 AS report_count")
    want = {x.package_name: (x.report_count, x.status, round(x.confidence, 9)) for x in reports.consolidate(base, df, as_of).collect()}
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert all(got[k][1] == "CONFIRMED" for k, v in want.items() if v[1] == "CONFIRMED")
    assert {x.package_name for x in reports.consolidate_batch(None, df, as_of).collect()} == set(got)


def test_taint_takes_long_words(spark):
    """A minified word of twenty thousand characters neither grows the rows nor hides a name in it."""
    long = "x" * 20_000 + "secret_q" + "y" * 20_000
    rows = [(1, "javascript", "p", "a.js", f"const secret_q = req.query.id\nconst other = {long}\ndb.raw({long}); \ndb.raw(other)\n")]
    corpus = spark.createDataFrame(rows, "file_id long, lang string, project string, path string, text string")
    flows = {(r.sink_line, r["var"]) for r in taint.analyze(corpus).collect()}
    assert (3, "secret_q") in flows and (4, "other") in flows


def test_taint_sends_nothing_through_the_driver(spark, monkeypatch):
    """Lines are sized by the file they come from, so no join of the data flow may rest on such an estimate."""
    text = "const q = req.query.id\nconst r = q\ndb.raw(r)\nexport function run(c) {}"
    caller = "import { q } from './a';\nconst { run } = require('./a')\ndb.raw(q)\nrun(req.body)"
    rows = [(1, "javascript", "p", "a.js", text), (2, "javascript", "p", "b.js", caller)]
    corpus = spark.createDataFrame(rows, "file_id long, lang string, project string, path string, text string")
    plans, plain = [], taint.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(taint, "checkpointed", seen)
    flows = taint.analyze(corpus)
    plans.append(flows._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans[:-1]) and "SortMergeJoin" in plans[-1]
    assert not any("Broadcast" in p for p in plans)
    assert {(r.kind, r.source_file, r.sink_file, r.sink_line) for r in flows.collect()} >= {("local", 1, 1, 3), ("cross", 1, 2, 3)}


@pytest.mark.parametrize("name", ["namespace_confusion", "nearest_popular", "mcp_cve_matches", "agent_leaderboard"])
def test_built_in_tables_have_a_known_size(spark, name):
    from siftlake.plans import PLANS

    plan = PLANS[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan


def test_documents_are_whole_and_in_order(spark):
    """A project of any size is one valid document, put together from its pieces in order."""
    import json

    rows = [("big", f"d\\f{i % 7}.js", i % 900, None if i % 5 else 3, f"R{i % 4}", "high", f'm: "q" {i % 4}', None if i % 2 else "do") for i in range(6000)]
    rows += [("big", "x", 1, 1, "R1", "low", "m", None)] * 3 + [("small", "y", 2, None, "R9", "odd", "n", None)]
    df = spark.createDataFrame(rows, "project string, path string, line_no int, col_start int, rule_id string, severity string, message string, fix string")

    def documents(pieces):
        text = {}
        for r in pieces.orderBy("project", "section", "at").collect():
            text[r.project] = text.get(r.project, "") + r.text
        return {k: json.loads(v) for k, v in text.items()}

    logs = documents(exports.to_sarif(df))
    run = logs["big"]["runs"][0]
    assert len(run["results"]) == 6003 and sorted(r["id"] for r in run["tool"]["driver"]["rules"]) == ["R0", "R1", "R2", "R3"]
    uris = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]]
    assert uris == sorted(uris) and uris[0] == "d/f0.js" and run["results"][-1]["level"] == "note"
    assert [r["ruleId"] for r in logs["small"]["runs"][0]["results"]] == ["R9"]
    parts = spark.createDataFrame([("p", f"r{i}", f"n{i}", "1", None, "MIT" if i % 2 else None, i % 3 == 0) for i in range(50)], "project string, bom_ref string, name string, version string, purl string, license string, dev boolean")
    bom = documents(exports.to_cyclonedx(parts))["p"]
    assert [c["bom-ref"] for c in bom["components"]] == sorted(f"r{i}" for i in range(50))
    assert documents(exports.to_sarif(df.limit(0))) == {}


def test_downgrades_are_not_broadcast(spark):
    lines = spark.createDataFrame([(1, "-", 1, '"a": "^2.0.0"'), (1, "+", 1, '"a": "^1.9.0"')], "commit long, op string, line_no int, text string")
    found = diffs.dependency_downgrades(lines, ["commit"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.previous, r.version) for r in found.collect()] == [("^2.0.0", "^1.9.0")]


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    from siftlake import session

    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    assert session.spread(spark.range(5000, numPartitions=1), "id").rdd.getNumPartitions() == 50
    assert session.spread(spark.range(5000, numPartitions=16), "id").rdd.getNumPartitions() == 50
    assert session.spread(spark.range(500, numPartitions=16), "id").rdd.getNumPartitions() == 16
    assert session.spread(spark.range(0), "id").count() == 0


def test_sarif_computes_its_findings_once(spark):
    """Sections read what was written; none scans the corpus again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    schema = "project string, path string, line_no int, col_start int, rule_id string, severity string, message string, fix string"
    rows = [("p", "a.js", i, 1, f"R{i}", "high", "m", None) for i in range(5)]
    found = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).mapPartitions(counted), schema)
    assert exports.to_sarif(found).count() == 3 + 5 + 5
    assert seen.value == 5


def test_short_and_long_histories_show_the_same_anomalies(spark):
    r = random.Random(11)
    versions = ["0.1.0", "1.0.0", "1.2.0", "2.0.0", "15.0.1", "v3.1.0", None, "rc1.2"]
    rows = [("npm", r.choice(["a", "b", "c", "d", None]), r.choice(versions), dt.datetime(2020, 1, 1) + dt.timedelta(minutes=r.choice([r.randint(0, 2_000_000), r.randint(0, 3000)])), r.choice(["p", "q", "s", None]), i) for i in range(160)]
    rows += [("npm", f"one{i}", r.choice(versions), dt.datetime(2020, 1, 1), "p", 1000 + i) for i in range(5)] + [("npm", "odd", "0.1.0", None, "p", 2000), ("npm", "odd", "1.0.0", dt.datetime(2021, 1, 1), "q", None)]
    df = spark.createDataFrame(rows, "ecosystem string, package string, version string, published_at timestamp, publisher string, ordinal long")
    short, mixed, cut = (sorted(map(str, history.publish_anomalies(df, n).collect())) for n in (10**9, 20, 0))
    assert short == mixed == cut and len({x.split("anomaly_id='")[1][:13] for x in short}) >= 5
    # What is left after the aggregate that is written: the rows of the jump between versions, dealt out by package.
    assert history.publish_anomalies(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_components_dealt_out_by_project_are_shuffled_once(spark):
    import json

    rows = [(p, n % 5, "npm", f"n{n % 40}", f"1.{n % 3}.0", "MIT", n % 2 == 0) for p in (1, 2, 3, None) for n in range(200)] + [(4, 0, "npm", "x", "1.0.0", None, None)]
    parts = spark.createDataFrame(rows, "project long, source_order int, ecosystem string, name string, version string, license string, dev boolean")
    bom = deps.build_sbom(parts.repartition("project"))
    pieces = exports.to_cyclonedx(bom)
    assert pieces._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for found in (pieces, exports.to_cyclonedx(deps.build_sbom(parts))):
        texts = {}
        for x in found.filter("project IS NOT NULL").orderBy("project", "section", "at").collect():
            texts[x["project"]] = texts.get(x["project"], "") + x["text"]
        got = {p: [(c["bom-ref"], c.get("licenses")) for c in json.loads(t)["components"]] for p, t in texts.items()}
        want = {}
        for x in bom.filter("project IS NOT NULL").collect():
            want.setdefault(x["project"], []).append((x["bom_ref"], x["license"] and [{"license": {"id": x["license"]}}]))
        assert got == {p: sorted(v, key=lambda c: c[0]) for p, v in want.items()} and found.filter("project IS NULL AND section = 1").isEmpty()
