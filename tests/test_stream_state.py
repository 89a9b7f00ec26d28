"""Streams whose state ends: cached answers, late rows over many batches."""

import datetime as dt
import random
import time

import pytest

from siftlake.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def batches(spark, path, rows, schema):
    """Each list of rows as one file, in order."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", range(2))
def test_answers_equal_a_cache_with_a_time_to_live(spark, tmp_path, seed):
    """Five batches with gaps of hours; a request after expiry is answered anew, one before it is not."""
    r = random.Random(seed)
    parts = [[(r.choice("abc"), T0 + dt.timedelta(hours=5 * k, minutes=r.randrange(200))) for _ in range(25)] for k in range(5)]
    stream = batches(spark, str(tmp_path / "in"), parts, "name string, created_at timestamp")
    streams.run_to_end(streams.stream_answers(stream, "name"), str(tmp_path / "c"), str(tmp_path / "out"))
    want = []
    for key in "abc":
        last = None
        for t in sorted({t for part in parts for k, t in part if k == key}):
            if last is None or t >= last + dt.timedelta(hours=1):
                want.append((key, t))
                last = t
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(want) and len(want) > 12


def test_late_rows_are_counted_over_more_than_a_hundred_batches(spark, tmp_path):
    r, planted, n = random.Random(3), 0, 0
    parts = []
    for k in range(115):
        late = r.randrange(3) if k > 1 else 0
        planted += late
        parts.append([(n + i, T0 + dt.timedelta(days=k, minutes=i)) for i in range(3)] + [(n + 3 + i, T0 - dt.timedelta(days=9)) for i in range(late)])
        n += 3 + late
    path = str(tmp_path / "in")
    import pandas as pd

    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        pd.DataFrame(part, columns=["id", "created_at"]).astype({"created_at": "datetime64[us]"}).to_parquet(f"{path}/{k:04}.parquet")
        # Files are taken in order of their times.
        time.sleep(0.01)
    stream = spark.readStream.schema("id long, created_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)
    stream = stream.withColumn("created_at", streams.F.col("created_at").cast("timestamp"))
    listener = streams.LateRows()
    spark.streams.addListener(listener)
    try:
        query = streams.run_to_end(streams.stream_unique(stream, ["id"], "1 hour"), str(tmp_path / "c"), str(tmp_path / "out"))
        row = listener.table(spark, query).filter(f"query_id = '{query.id}'").first()
    finally:
        spark.streams.removeListener(listener)
    assert planted > 80 and row.late_rows == planted and row.input_rows == n and row.batches >= 115
    assert spark.read.parquet(str(tmp_path / "out")).count() == n - planted


def test_state_of_bursts_ends_with_the_watermark(spark, tmp_path):
    """A busy package over forty days: equal to a window over all rows, with a state of some hours."""
    r = random.Random(8)
    parts = [[("hot" if r.random() < 0.8 else "cold", T0 + dt.timedelta(days=k, minutes=r.randrange(1440))) for _ in range(40)] for k in range(40)]
    stream = batches(spark, str(tmp_path / "in"), parts, "package string, published_at timestamp")
    query = streams.run_to_end(streams.stream_exact_bursts(stream, "6 hours"), str(tmp_path / "c"), str(tmp_path / "out"))
    want = []
    for name in ("hot", "cold"):
        times = sorted(t for part in parts for k, t in part if k == name)
        want += [(name, t) for i, t in enumerate(times) if i >= 4 and t - times[i - 4] <= dt.timedelta(hours=6)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want) and len(want) > 500
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) < 400
