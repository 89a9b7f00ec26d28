"""Who wrote a line: change events, typing speed, regions, and findings by author."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftlake.operators.scan import quote, strip
from siftlake.operators.sequences import consecutive, running_total, time_bucket

# Thresholds of the change signals.
BURST_LINES, SPEED_CHARACTERS, SPEED_MILLISECONDS, RESET_MILLISECONDS = 3, 150, 200, 5000
# Weights of the change signals, and the score from which a change counts as generated.
SIGNAL_WEIGHTS = {"burst-insertion": 0.4, "multi-line-single-event": 0.2, "high-speed-typing": 0.3, "paste-detected": 0.35, "import-heavy": 0.25}
GENERATED = 0.5
# What an import line looks like, applied to the trimmed line.
IMPORT_LINE = r"^\s*import\s+|^\s*from\s+\S+\s+import\s+|(?<!\w)require\s*\(|^\s*using\s+|^\s*use\s+|^\s*#include\s+|^\s*package\s+"


def typing_sessions(changes: DataFrame) -> DataFrame:
    """Adds ``session``: changes of a document no more than five seconds apart share one.

    A longer pause always resets the typing counters, so sessions are independent.
    ``changes``: (document_id, ts, change_id, text).
    """
    order = ["ts", "change_id"]
    bucket = time_bucket("ts")
    gap = F.unix_micros(F.col("cur.ts").cast("timestamp")) - F.unix_micros(F.col("prev.ts").cast("timestamp"))
    starts = consecutive(changes.select("document_id", *order), ["document_id"], order, bucket).filter(
        gap > RESET_MILLISECONDS * 1000).select("document_id", F.col("cur.change_id").alias("change_id"), F.lit(1).alias("_start"))
    marked = changes.join(starts, ["document_id", "change_id"], "left").na.fill(0, ["_start"])
    return running_total(marked, ["document_id"], order, bucket, F.col("_start"), "session").drop("_start")


def _fast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """High-speed flags of sessions in order; the counters of one session are all that is held from row to row."""
    unit, characters, last, reset = None, 0, None, None
    for pdf in batches:
        flags = []
        for document, session, ts, n in zip(pdf["document_id"], pdf["session"], pdf["ts"], pdf["characters"]):
            if unit != (document, session):
                unit, characters, last, reset = (document, session), 0, ts, ts
            characters += n
            flags.append(bool((ts - last).total_seconds() * 1000 < SPEED_MILLISECONDS and characters > SPEED_CHARACTERS))
            last = ts
            if (ts - reset).total_seconds() * 1000 > RESET_MILLISECONDS:
                characters, reset = 0, ts
        yield pdf.assign(high_speed=flags)[["document_id", "change_id", "high_speed"]]


def _restart(df: DataFrame) -> DataFrame:
    """A session after the first starts with counters that its own first change has just reset."""
    first = F.row_number().over(W.partitionBy("document_id", "session").orderBy("ts", "change_id")) == 1
    return df.withColumn("characters", F.when(first & (F.col("session") > 0), 0).otherwise(F.col("characters")))


def typing_velocity(changes: DataFrame) -> DataFrame:
    """Adds ``high_speed``: more than 150 characters since the last reset, within 200 ms of the change before."""
    sessions = typing_sessions(changes.withColumn("characters", F.length("text")))
    counted = _restart(sessions.select("document_id", "session", "ts", "change_id", "characters"))
    # Sorted partitions are streamed, so a session may be of any length.
    ordered = counted.repartition("document_id", "session").sortWithinPartitions("document_id", "session", "ts", "change_id")
    flags = ordered.mapInPandas(
        _fast, f"document_id {changes.schema['document_id'].dataType.simpleString()}, "
        f"change_id {changes.schema['change_id'].dataType.simpleString()}, high_speed boolean")
    return changes.join(flags, ["document_id", "change_id"])


def change_signals(changes: DataFrame) -> DataFrame:
    """Signals, score and verdict of each change; ``high_speed`` counts when present."""
    lines = "split(text, '\\n')"
    imports = f"size(filter({lines}, l -> {strip('l')} <> '' AND {strip('l')} RLIKE {quote(IMPORT_LINE)}))"
    fast = "high_speed" if "high_speed" in changes.columns else "false"
    conditions = {
        "burst-insertion": f"size({lines}) >= {BURST_LINES}",
        "multi-line-single-event": f"size({lines}) >= 2 AND length(text) > 50",
        "high-speed-typing": fast,
        "paste-detected": f"length(text) > 100 AND size({lines}) >= 2 AND NOT text RLIKE '^\\\\s*$'",
        "import-heavy": f"{imports} >= 2",
    }
    listed = ", ".join(f"IF({c}, '{s}', NULL)" for s, c in conditions.items())
    total = " + ".join(f"IF(array_contains(signals, '{s}'), {w}D, 0D)" for s, w in SIGNAL_WEIGHTS.items())
    return changes.selectExpr("*", f"array_compact(array({listed})) AS signals", f"{imports} AS new_imports").selectExpr(
        "*", f"least(1D, round({total}, 10)) AS confidence").selectExpr("*", f"confidence >= {GENERATED} AS is_generated")


def _fold_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Current regions of each file, from its regions in order of time; only the live ones of one file are held."""
    columns = ["file_id", "start_line", "end_line", "source", "confidence", "signals"]
    file, starts, live = None, [], []

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(file, *r[:4], sorted(r[4])) for r in live], columns=columns)

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if live and row.file_id != file:
                yield rows()
                starts, live = [], []
            file, start, end = row.file_id, int(row.start_line), int(row.end_line)
            new = [start, end, row.source, row.confidence, set(row.signals if row.signals is not None else ())]
            # Live regions are disjoint and sorted: those that overlap the new one stand together.
            first = bisect_left(starts, start)
            first -= first > 0 and live[first - 1][1] >= start
            last = bisect_right(starts, end)
            # A neighbour of the same author joins the new region.
            if first > 0 and live[first - 1][2] == row.source and live[first - 1][1] >= start - 1:
                first -= 1
                near = live[first]
                new[0], new[3], new[4] = near[0], max(near[3], new[3]), near[4] | new[4]
            if last < len(live) and live[last][2] == row.source and end >= live[last][0] - 1:
                near = live[last]
                new[1], new[3], new[4] = near[1], max(near[3], new[3]), near[4] | new[4]
                last += 1
            live[first:last], starts[first:last] = [new], [new[0]]
    if live:
        yield rows()


def merge_regions(regions: DataFrame) -> DataFrame:
    """Current regions of each file: a later region replaces those it touches, neighbours of one author join at once.

    What an earlier region has become depends on all before, so a file's regions are folded in order; files are sorted
    streams, of which only the live regions are in memory.
    ``regions``: (file_id, region_id, start_line, end_line, source, confidence, signals, ts).
    """
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("file_id", "start_line", "end_line", "source", "confidence", "signals"))
    ordered = regions.select("file_id", "start_line", "end_line", "source", "confidence", "signals", "ts", "region_id").repartition("file_id").sortWithinPartitions("file_id", "ts", "region_id")
    return ordered.drop("ts", "region_id").mapInPandas(_fold_regions, schema)


def covering_blocks(start: str, end: str, levels: int) -> Column:
    """The fewest aligned blocks (level, block) that make up the lines ``start`` to ``end``: at most two for each level.

    Block b of level k holds the lines from b * 2**k on, 2**k of them.  SQL text in, an array out; empty where ``end`` is before ``start``.
    """
    first, past = f"shiftright({start} + shiftleft(1L, k) - 1, k)", f"shiftright({end} + 1L, k)"
    block = "named_struct('level', k, 'block', {0})"
    left = f"IF({first} < {past} AND {first} % 2 = 1, {block.format(first)}, NULL)"
    right = f"IF({first} < {past} AND {past} % 2 = 1, {block.format(past + ' - 1')}, NULL)"
    return F.expr(f"flatten(transform(sequence(0, {levels}), k -> array_compact(array({left}, {right}))))")


def attribute_findings(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """Author of each finding's line: the first region that covers it, else unknown.

    A region becomes its aligned blocks of lines, a line the blocks that hold it, one for each level: the interval join is an
    equality join, whose sides grow with the logarithm of a region's length.  Of the regions that share a block only the
    first can be a line's author.
    """
    longest = regions.agg(F.max(F.col("end_line") - F.col("start_line"))).first()[0]
    levels = max(0, longest or 0).bit_length() + 1
    blocks = regions.select("file_id", "start_line", "end_line", "source", "confidence", F.inline(covering_blocks("CAST(start_line AS BIGINT)", "CAST(end_line AS BIGINT)", levels)))
    order = F.struct("start_line", "end_line", "source")
    first = blocks.groupBy("file_id", "level", "block").agg(F.min(F.struct(order.alias("at"), F.struct("source", "confidence").alias("who"))).alias("_r"))
    lines = findings.select("file_id", "line_no").filter("line_no IS NOT NULL").distinct()
    holding = lines.select("file_id", "line_no", F.expr(f"inline(transform(sequence(0, {levels}), k -> named_struct('level', k, 'block', shiftright(CAST(line_no AS BIGINT), k))))"))
    author = holding.join(first, ["file_id", "level", "block"]).groupBy("file_id", "line_no").agg(F.min("_r").getField("who").alias("_a"))
    joined = findings.join(author, ["file_id", "line_no"], "left")
    return joined.select(*findings.columns, F.coalesce("_a.source", F.lit("unknown")).alias("source"),
                         F.coalesce("_a.confidence", F.lit(0.0)).alias("confidence"))


def attribution_stats(files: DataFrame, attributed: DataFrame) -> DataFrame:
    """Lines, shares and findings per thousand lines by author, over everything.

    ``files``: (file_id, total_lines, ai_lines, human_lines); ``attributed``: (source).
    """
    lines = files.agg(F.count("*").alias("files_tracked"), F.sum("total_lines").alias("total_lines"),
                      F.sum("ai_lines").alias("ai_lines"), F.sum("human_lines").alias("human_lines"))
    found = attributed.agg(F.count_if(F.col("source") == "ai").alias("ai_findings"), F.count_if(F.col("source") == "human").alias("human_findings"))
    # Two one-row aggregates put into one row without a join.
    names = [*lines.columns, *found.columns]
    both = lines.unionByName(found, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])
    return both.selectExpr(
        "*", "IF(total_lines > 0, round(ai_lines / total_lines, 6), 0D) AS ai_ratio",
        "IF(ai_lines > 0, round(ai_findings * 1000D / ai_lines, 2), 0D) AS ai_rate",
        "IF(human_lines > 0, round(human_findings * 1000D / human_lines, 2), 0D) AS human_rate")
