"""Readers, sinks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_operators import T0, hot, typing

from siftlake.operators import deps, exports, history, reports
from siftlake.sources import readers, sinks
from siftlake.streaming import streams


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_documents_are_one_plain_file_each_in_folders_as_spark_names_them(spark, tmp_path):
    projects = ["a", "b/c=d", "50%", "é:{x}[y]^", "q'\"#*?\\\\", "tab\there", "\x7f", None, "", "z" * 90]
    rows = [(p, s, f"{n:03d}", None if n == 7 else f"{s}-{n}é" * (n % 5)) for p in projects for s in (0, 1) for n in range(20)]
    for kind in ("string", "long"):
        own = rows if kind == "string" else [(None if p is None else len(p), *x) for p, *x in rows]
        pieces = spark.createDataFrame(own, f"project {kind}, section int, at string, text string").repartition(3, "project")
        wanted, root = str(tmp_path / f"spark-{kind}"), str(tmp_path / f"own-{kind}")
        pieces.coalesce(1).sortWithinPartitions("project", "section", "at").select("project", "text").write.partitionBy("project").text(wanted)
        for dealt in (True, False, False):
            # Writing again replaces everything.
            sinks.write_documents(pieces, root, dealt=dealt)
            found = _files(root)
            assert "_SUCCESS" in found and not [f for f in found if f.endswith(".txt.crc")] and not [f for f in found if os.path.basename(f).startswith(".part")]
            texts = {}
            for f, x in found.items():
                if f.endswith(".txt"):
                    texts.setdefault(os.path.dirname(f), []).append(x)
            want = {os.path.dirname(f): x for f, x in _files(wanted).items() if f.endswith(".txt")}
            lines = {d: sorted(b"".join(x).split(b"\n")) for d, x in texts.items()}
            assert lines == {d: sorted(x.split(b"\n")) for d, x in want.items()}
            assert all(len(x) == 1 and x[0] == want[d] for d, x in texts.items() if "HIVE" not in d)
            back = [sorted(map(tuple, spark.read.text(x, wholetext=True).select("project").distinct().collect()), key=str) for x in (root, wanted)]
            assert back[0] == back[1]


def test_pieces_in_order_are_not_ordered_again(spark, tmp_path):
    rows = [(n % 3, 0, f"{n:03d}", f"t{n}") for n in range(30)]
    pieces = spark.createDataFrame(rows, "project long, section int, at string, text string").repartition(2, "project")
    sinks.write_documents(pieces.sortWithinPartitions("project", F.desc("at")), str(tmp_path / "x"), dealt=True, in_order=True)
    found = {os.path.dirname(f): x.decode().split() for f, x in _files(str(tmp_path / "x")).items() if f.endswith(".txt")}
    assert found == {f"project={p}": [f"t{n}" for n in reversed(range(p, 30, 3))] for p in range(3)}
    # The pieces of components come in their order.
    parts = spark.createDataFrame([(p, n % 5, "npm", f"n{n % 40}", f"1.{n % 3}.0", "MIT", True) for p in (1, 2, 3, None) for n in range(200)], "project long, source_order int, ecosystem string, name string, version string, license string, dev boolean")
    bom = exports.to_cyclonedx(deps.build_sbom(parts.repartition(5, "project")))
    for dealt, in_order in ((True, True), (True, False)):
        sinks.write_documents(bom, str(tmp_path / f"bom-{in_order}"), dealt=dealt, in_order=in_order)
    one, other = ({os.path.dirname(f): x for f, x in _files(str(tmp_path / f"bom-{k}")).items() if f.endswith(".txt")} for k in (True, False))
    assert one == other and [len(json.loads(one[f"project={p}"])["components"]) for p in (1, 2, 3)] == [120] * 3


def test_whole_texts_are_the_bytes_of_files(spark, tmp_path):
    import gzip

    (tmp_path / "k=7").mkdir()
    for name, content in {"a.py": b"x\r\ny\n", "b.py": b"\xff\xfe\xc3", "c.py": "é\u2028".encode(), "empty.py": b"", "_hidden.py": b"h", "d e%.py": b"\xef\xbb\xbfbom", "z.txt.gz": gzip.compress(b"packed")}.items():
        (tmp_path / "k=7" / name).write_bytes(content)
    seen = [sorted((r.k, r.path, r.bytes, bytes(r.b)) for r in readers.whole_texts(spark, str(tmp_path), "k", packed=packed).withColumn("b", F.col("text").cast("binary")).collect() if not r.path.endswith(".gz")) for packed in (True, False)]
    assert seen[0] == seen[1] and len(seen[0]) == 4 and {os.path.basename(x[1]) for x in seen[0]} == {"a.py", "b.py", "c.py", "d%20e%25.py"}
    # Without a list of endings files are unpacked as before.
    assert "packed" in {r.text for r in readers.read_corpus(spark, str(tmp_path), extensions=()).collect()}
    plan = readers.read_corpus(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan.replace("BinaryFile", "binaryFile")


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for n in range(60):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "x.py").write_text(f"a{n}")
    context, before = spark.sparkContext, spark.conf.get("spark.sql.files.openCostInBytes")
    context.setJobGroup("listing", "folders of small files")
    # A file counts as much as a split, so each is one.
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        corpus = readers.read_corpus(spark, str(tmp_path))
        tracker = context.statusTracker()
        listed = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert listed and max(listed) <= 4 * context.defaultParallelism < 60
        assert corpus.rdd.getNumPartitions() <= 4 * context.defaultParallelism
        assert sorted(r.text for r in corpus.collect()) == sorted(f"a{n}" for n in range(60))
        assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        context.setLocalProperty("spark.jobGroup.id", None)


def test_read_corpus_leaves_out_directories_and_no_file_by_size(spark, tmp_path):
    for name in ("src/a.js", "node_modules/x/b.js", ".git/c.py", "src/d.py", "src/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("eval(x)\n")
    (tmp_path / "src/big.py").write_text("x" * (6 << 20))
    corpus = readers.read_corpus(spark, str(tmp_path))
    found = {(os.path.basename(r.path), r.lang, r.n) for r in corpus.withColumn("n", F.length("text")).drop("text").collect()}
    assert found == {("a.js", "javascript", 8), ("d.py", "python", 8), ("big.py", "python", 6 << 20)}
    limited = {os.path.basename(r.path): (r.skipped, r.text is None) for r in readers.read_corpus(spark, str(tmp_path), max_bytes=100).collect()}
    assert limited == {"a.js": (False, False), "d.py": (False, False), "big.py": (True, True)}


def test_read_registry_snapshot(spark, tmp_path):
    doc = {"name": "p", "dist-tags": {"latest": "1.1.0"}, "time": {"created": "2024-01-01T00:00:00Z", "1.0.0": "2024-01-01T00:00:00Z", "1.1.0": "2024-02-01T00:00:00Z"},
           "versions": {"1.0.0": {"_npmUser": {"name": "a"}}, "1.1.0": {"_npmUser": {"name": "b"}, "scripts": {"postinstall": "x"}}},
           "maintainers": [{"name": "a", "email": "a@x.y"}], "repository": {"url": "https://github.com/o/r"}, "readme": "hi"}
    (tmp_path / "dump.json").write_text(json.dumps(doc) + "\n")
    documents = readers.read_registry_snapshot(spark, str(tmp_path))
    p = readers.registry_packages(documents).first()
    assert (p.latest, p.version_count, p.latest_scripts, p.deprecated) == ("1.1.0", 2, {"postinstall": "x"}, False)
    assert {(r.version, r.publisher) for r in readers.registry_versions(documents).collect()} == {("1.0.0", "a"), ("1.1.0", "b")}


def test_read_sbom_and_model_artifacts(spark, tmp_path):
    bom = {"metadata": {"component": {"name": "app"}}, "components": [{"bom-ref": "pkg:npm/a@1", "name": "a", "version": "1", "purl": "pkg:npm/a@1", "licenses": [{"license": {"id": "MIT"}}]}]}
    (tmp_path / "bom.json").write_text(json.dumps(bom, indent=1))
    r = readers.read_sbom(spark, str(tmp_path / "bom.json")).first()
    assert (r.project, r.ecosystem, r.name, r.license) == ("app", "npm", "a", "MIT")
    (tmp_path / "m.pkl").write_bytes(b"cos\nsystem\n.")
    from siftlake.operators.artifacts import scan_model_artifacts

    assert [r.rule_id for r in scan_model_artifacts(readers.read_model_artifacts(spark, str(tmp_path))).collect()] == ["CG_MODEL_PKL_001"]


def _reports(spark, n, offset=0):
    return spark.range(offset, offset + n).selectExpr(
        "'npm' AS ecosystem", "concat('p', id % 3) AS package_name", "true AS confirmed_nonexistent", "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP '2024-01-01') AS created_at",
        "id AS report_id", "'m' AS model", "'i' AS ide", "'a' AS agent", "'x' AS interaction")


def test_snapshot_upsert_is_idempotent(spark, tmp_path):
    table = sinks.Snapshots(spark, str(tmp_path / "t"), ["ecosystem", "package_name"])
    first, second = (reports.fold_reports(_reports(spark, 30, o), with_order=True).withColumn("claimed", F.lit(False)) for o in (0, 30))
    table.upsert(first, 0, reports.merge_snapshots)
    for _ in range(2):
        table.upsert(second, 1, reports.merge_snapshots)
    assert table.versions() == [0, 1]
    assert table.read().agg(F.sum("report_count")).first()[0] == 60


def test_upserts_rewrite_touched_buckets_and_versions_end(spark, tmp_path):
    """Ten keys rewrite ten buckets at most; old versions go; a failed merge leaves the table as it was."""
    table = sinks.Snapshots(spark, str(tmp_path / "t"), ["k"], keep=3)
    schema = "k long, n long"

    def add(stored, batch):
        return stored.unionByName(batch).groupBy("k").agg(F.sum("n").alias("n"))

    table.write(spark.range(1000).selectExpr("id AS k", "1L AS n"), 0)
    want = {k: 1 for k in range(1000)}
    for version in range(1, 9):
        keys = [(version * 37 + i * 11) % 1200 for i in range(10)]
        before = table.manifest(version - 1)["folders"]
        for _ in range(2):
            table.upsert(spark.createDataFrame([(k, 5) for k in keys], schema), version, add)
        after = table.manifest(version)["folders"]
        assert 0 < sum(after[b] != before.get(b) for b in after) <= 10 and len(after) == 64
        for k in keys:
            want[k] = want.get(k, 0) + 5
    assert {r.k: r.n for r in table.read().collect()} == want
    assert table.versions() == [6, 7, 8]
    folders = {f for v in table.versions() for f in table.manifest(v)["folders"].values()}
    assert set(os.listdir(tmp_path / "t" / "data")) == folders and len(folders) <= 9
    with pytest.raises(Exception, match="broken"):
        table.upsert(spark.createDataFrame([(1, 1)], schema), 9, lambda a, b: a.withColumn("n", F.raise_error(F.lit("broken")).cast("long")))
    assert table.versions() == [6, 7, 8] and {r.k: r.n for r in table.read().collect()} == want
    assert table.read(before=8).count() >= 1000 and sinks.Snapshots(spark, str(tmp_path / "none"), ["k"]).read() is None


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """A batch drops what is late by the watermark of the batch before it."""
    schema = "event_id long, event_type string, created_at timestamp"
    for i, days in enumerate(((20, 25), (26,), (1,))):
        folder = tmp_path / "in"
        rows = [(10 * i + d, "a", T0.replace(day=d)) for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if os.path.getmtime(folder / name) > 1_750_000_000:
                os.utime(folder / name, (1_700_000_000 + i * 1000, 1_700_000_000 + i * 1000))
    stream = streams.stream_counts(readers.read_events_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1))
    query = streams.run_to_end(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    days = {r.window_start.day for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert 1 not in days and streams.late_rows(query) == 1


def test_stream_typing_velocity_equals_batch(spark, tmp_path):
    from siftlake.operators.attribution import typing_velocity

    _, df = typing(spark)
    changes = df.withColumnRenamed("ts", "created_at")
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_typing_velocity(readers.read_events_stream(spark, str(tmp_path / "in"), changes.schema))
    streams.run_to_end(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {(r.change_id, r.high_speed) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.change_id, r.high_speed) for r in typing_velocity(df).collect()}


def test_exact_stream_bursts_equal_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    published = hot(spark, 800).selectExpr("k AS package", "ts AS published_at", "id AS ordinal")
    published.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_exact_bursts(readers.read_events_stream(spark, str(tmp_path / "in"), published.schema))
    streams.run_to_end(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    batch = history.bursts(published.selectExpr("'npm' AS ecosystem", "package", "'1.0.0' AS version", "published_at", "'p' AS publisher", "ordinal"))
    assert {(r.package, r.published_at) for r in got.collect()} == {(r.package, r.published_at) for r in batch.collect()}
