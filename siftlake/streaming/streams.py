"""Continuous versions of the batch operators.

Streams read with an event-time watermark; late rows are dropped once their window is
closed; :class:`LateRows` counts them while a query runs, :func:`late_rows` over its last batches.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftlake.operators import reports, scan, telemetry
from siftlake.operators.attribution import RESET_MILLISECONDS, SPEED_CHARACTERS, SPEED_MILLISECONDS
from siftlake.operators.history import BURST_SECONDS, BURST_SIZE
from siftlake.rules.model import Family
from siftlake.sources.sinks import Snapshots

WATERMARK = "1 day"
IDLE_MILLISECONDS = 3_600_000
# Pauses after which a person's and a machine's edits are scanned.
HUMAN_PAUSE, MACHINE_PAUSE = "500 milliseconds", "100 milliseconds"


def stream_scan(files: DataFrame, *families: Family) -> DataFrame:
    """Findings of files as they arrive; stateless, the same plan as in batch."""
    return scan.scan(files, *families)


def stream_counts(events: DataFrame, width: str = "1 day", by: tuple[str, ...] = ("event_type",), delay: str = WATERMARK) -> DataFrame:
    """Events per tumbling window and key."""
    window = F.window("created_at", width)
    return events.withWatermark("created_at", delay).groupBy(window, *by).agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("window_start"), *by, "events")


def stream_bursts(versions: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Packages with five publications in a sliding six-hour window that moves by the hour."""
    window = F.window("published_at", f"{BURST_SECONDS} seconds", "1 hour")
    counted = versions.withWatermark("published_at", delay).groupBy(window, "package").agg(F.count("*").alias("publications"))
    return counted.filter(F.col("publications") >= BURST_SIZE).select(F.col("window.start").alias("window_start"), "package", "publications")


class ExactBursts(StatefulProcessor):
    """Reports each publication of a package that is the fifth, or later, within six hours, as soon as that is known.

    A key is a package and an interval of six hours.  It holds the publications of the interval and of the one before, with
    whether they were reported: a late row within the watermark can complete the burst of one that came before it.  A
    timer ends a key's state when the watermark reaches the end of its interval.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts bigint, told boolean, own boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(row) for row in self.times.get()]
        new = [(int(t), False, bool(own)) for pdf in rows for t, own in zip(pdf["published_at"].astype("datetime64[us]").astype("int64"), pdf["own"], strict=True)]
        # Of equal times those already reported come first.
        held = sorted(before + new, key=lambda x: (x[0], not x[1]))
        kept, found = [], []
        for i, (t, told, own) in enumerate(held):
            if own and not told and i >= BURST_SIZE - 1 and t - held[i - BURST_SIZE + 1][0] <= BURST_SECONDS * 1_000_000:
                found.append((key[0], pd.Timestamp(t, unit="us")))
                told = True
            kept.append((t, told, own))
        if not before:
            self.handle.registerTimer((int(key[1]) + 1) * BURST_SECONDS * 1000)
        self.times.put(kept)
        yield pd.DataFrame(found, columns=["package", "published_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"package": pd.Series([], dtype=object), "published_at": pd.Series([], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def stream_exact_bursts(versions: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Exact bursts per package; rows may be late by ``delay``.  Needs the RocksDB state store.

    A publication goes to its own interval of six hours and, for those behind it, to the next one: no key holds more than
    twelve hours of a package.
    """
    interval = F.floor(F.unix_micros("published_at") / F.lit(BURST_SECONDS * 1_000_000))
    both = F.inline(F.array(*[F.struct((interval + k).cast("long").alias("interval"), F.lit(k == 0).alias("own")) for k in (0, 1)]))
    return versions.withWatermark("published_at", delay).select("package", "published_at", both).groupBy("package", "interval").transformWithStateInPandas(
        statefulProcessor=ExactBursts(), outputStructType="package string, published_at timestamp", outputMode="Append", timeMode="EventTime")


def stream_debounce(edits: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """One row per burst of edits of a document; the pause depends on who edits."""
    gap = F.when(F.col("is_generated"), F.lit(MACHINE_PAUSE)).otherwise(F.lit(HUMAN_PAUSE))
    session = F.session_window("created_at", gap)
    return edits.withWatermark("created_at", delay).groupBy(session, "document_id").agg(F.count("*").alias("edits")).select(
        "document_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "edits")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = WATERMARK, key: str = "client_id") -> DataFrame:
    session = F.session_window("created_at", gap)
    return events.withWatermark("created_at", delay).groupBy(session, key).agg(F.count("*").alias("events")).select(
        key, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "events")


def _velocity(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, characters, reset = state.get if state.exists else (None, 0, None)
    # Of each frame only numbers are held, whatever the texts' size.
    times, ids, sizes = ([] for _ in range(3))
    for pdf in frames:
        times.append(pdf["created_at"].astype("datetime64[us]").astype("int64").to_numpy())
        ids.append(pdf["change_id"].to_numpy())
        sizes.append(pdf["text"].str.len().to_numpy())
    times, ids, sizes = (np.concatenate(x) for x in (times, ids, sizes))
    order, flags = np.lexsort((ids, times)), []
    for now, size in zip((times[order] // 1000).tolist(), sizes[order].tolist(), strict=True):
        last, reset = (now if last is None else last), (now if reset is None else reset)
        characters += size
        flags.append(bool(now - last < SPEED_MILLISECONDS and characters > SPEED_CHARACTERS))
        last = now
        if now - reset > RESET_MILLISECONDS:
            characters, reset = 0, now
    state.update((last, characters, reset))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE_MILLISECONDS)
    yield pd.DataFrame({"document_id": key[0], "change_id": ids[order], "high_speed": flags})


def stream_typing_velocity(changes: DataFrame, delay: str = "1 minute") -> DataFrame:
    """High-speed flags per change, from state kept by document and dropped after an idle hour of event time.

    ``changes``: (document_id string, change_id long, created_at, text).
    """
    return changes.withWatermark("created_at", delay).groupBy("document_id").applyInPandasWithState(
        _velocity, "document_id string, change_id long, high_speed boolean", "last bigint, characters bigint, reset bigint",
        "append", GroupStateTimeout.EventTimeTimeout)


def stream_fresh(requests: DataFrame, keys: list[str], ttl: timedelta = timedelta(hours=1)) -> DataFrame:
    """Requests whose answer is not already fresh: the first of each key within the time to live."""
    return requests.withWatermark("created_at", f"{int(ttl.total_seconds())} seconds").dropDuplicatesWithinWatermark(keys)


class Answers(StatefulProcessor):
    """Answers a request of a key unless one was answered less than the time to live before; a timer forgets the answer.

    Times are those of the requests.  One that is earlier than the last answer is taken as answered by it.
    """

    def __init__(self, ttl: timedelta):
        self.ttl = int(ttl.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.answered = handle, handle.getValueState("answered", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Only the different times of a key are held: requests of one moment have one answer.
        times = sorted({int(t) for pdf in rows for t in pdf["created_at"].astype("datetime64[us]").astype("int64").unique()})
        last, new = self.answered.get()[0] if self.answered.exists() else None, []
        for t in times:
            if last is None or t >= last + self.ttl:
                last = t
                new.append(t)
        if new:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.answered.update((last,))
            self.handle.registerTimer(-(-(last + self.ttl) // 1000))
        yield pd.DataFrame({"key": [key[0]] * len(new), "answered_at": pd.to_datetime(new, unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.answered.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "answered_at": pd.Series([], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def stream_answers(requests: DataFrame, key: str, ttl: timedelta = timedelta(hours=1), delay: str = "0 seconds") -> DataFrame:
    """(key, answered_at): the requests that a cache with a time to live does not answer.  Needs the RocksDB state store.

    State holds one time per key and ends ``ttl`` after it, when the watermark passes.
    """
    keyed = requests.select(F.col(key).alias("key"), "created_at").withWatermark("created_at", delay)
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Answers(ttl), outputStructType="key string, answered_at timestamp", outputMode="Append", timeMode="EventTime")


def stream_unique(events: DataFrame, keys: list[str], delay: str = WATERMARK) -> DataFrame:
    """The first row of each key; rows behind the watermark are dropped one by one, so that :class:`LateRows` counts them exactly."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(keys)


class LateRows(StreamingQueryListener):
    """Adds up, for every query of the session, its batches, input rows and rows dropped behind the watermark, for as long as it runs."""

    def __init__(self):
        self.totals: dict[str, list[int]] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self.changed:
            total = self.totals.setdefault(str(progress.id), [0, 0, 0])
            total[0] += 1
            total[1] += progress.numInputRows
            total[2] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.id))
            self.changed.notify_all()

    def table(self, spark: SparkSession, query: StreamingQuery, seconds: float = 60) -> DataFrame:
        """(query_id, batches, input_rows, late_rows) of all queries so far, once ``query`` has ended and its last batch is counted."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(query.id) in self.ended, seconds):
                raise TimeoutError("the query has not ended")
            return spark.createDataFrame([(k, *v) for k, v in self.totals.items()], "query_id string, batches long, input_rows long, late_rows long")


def stream_alerts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Payloads of every event and matching subscription; a stream joined with a table."""
    return telemetry.alert_payloads(telemetry.match_subscriptions(events, subscriptions))


def stream_recheck(entries: DataFrame, registry: DataFrame, as_of: str = "current_timestamp()") -> DataFrame:
    """Entries due for a check that a registry snapshot now has."""
    return reports.claimed_packages(entries, registry, as_of)


def start_fold(stream: DataFrame, snapshots: Snapshots, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Fold reports into numbered snapshots; a repeated batch rewrites its own version."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        folded = reports.fold_reports(batch, with_order=True).withColumn("claimed", F.lit(False))
        snapshots.upsert(folded, batch_id, reports.merge_snapshots)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def start_consolidation(stream: DataFrame, packages: Snapshots, checkpoint: str, as_of: str = "current_timestamp()",
                        trigger: dict | None = None) -> StreamingQuery:
    """Add each batch's reports to the packages' sums, then confirm, decay and expire, every 15 minutes by default.

    Packages that a batch does not mention keep their counts; packages it is the first to mention are added as suspected.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        done = reports.consolidate_batch(packages.read(before=batch_id), batch, as_of)
        packages.write(reports.expire_stale(reports.decay(done, as_of), as_of), batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "15 minutes"})).start()


def start_append(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to parquet: findings, alerts in an outbox, score snapshots.

    The default trigger flushes once a minute.  Nothing is dropped when a source runs ahead.
    """
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        **(trigger or {"processingTime": "60 seconds"})).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they came after their watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def run_to_end(stream: DataFrame, checkpoint: str, path: str, mode: str = "append",
               each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process what is available and stop; used to compare a stream with its batch version."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)).start()
    query.awaitTermination()
    return query
