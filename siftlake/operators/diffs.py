"""Unified diffs: lines with their numbers, and the security regressions they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftlake.functions.versions import version_key
from siftlake.operators.scan import quote, scan
from siftlake.rules.regressions import ADDED, DEPENDENCY_LINE, HUNK, REMOVED
from siftlake.session import shuffled

NEARBY = 5


def read_unified_diff(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """Added and removed lines of each diff, numbered on the new side; one row of input per diff.

    A diff is cut at its hunk headers within its row, so the window that counts lines
    covers one hunk at a time.
    """
    keys = [c for c in diffs.columns if c != column]
    hunks = diffs.select(*keys, F.posexplode(F.split(column, r"(?m)^(?=@@ -)")).alias("_hunk", "_body"))
    headed = hunks.selectExpr(*keys, "_hunk", "_body", f"try_cast(regexp_extract(_body, {quote(HUNK)}, 1) AS INT) AS _start")
    lines = headed.filter("_start IS NOT NULL").selectExpr(*keys, "_hunk", "_start", "posexplode(split(_body, '\\n')) AS (_pos, _line)")
    marked = lines.filter("_pos > 0").withColumn("op", F.expr(
        "CASE WHEN startswith(_line, '+') AND NOT startswith(_line, '+++') THEN '+' "
        "WHEN startswith(_line, '-') AND NOT startswith(_line, '---') THEN '-' "
        "WHEN startswith(_line, '\\\\') THEN '' ELSE ' ' END"))
    before = W.partitionBy(*keys, "_hunk").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    numbered = marked.withColumn(
        "line_no", F.col("_start") + F.coalesce(F.count_if(F.col("op").isin("+", " ")).over(before), F.lit(0)).cast("int"))
    return numbered.filter(F.col("op").isin("+", "-")).select(*keys, "op", "line_no", F.substring("_line", 2, 2**31 - 1).alias("text"))


def _rule_changes(lines: DataFrame, keys: list[str], *families) -> DataFrame:
    """Hits of regression rules in one scan: removed safeguards that no added line nearby still has, and unsafe additions.

    An added line vouches for the lines around it: it is repeated for each of them, so that one aggregate by place
    settles which removals stand.
    """
    found = scan(lines.select(*keys, "op", F.col("line_no").alias("at"), "text"), *families)
    vouches = (F.col("family") == REMOVED.name) & (F.col("op") == "+")
    counts = F.when(F.col("family") == REMOVED.name, F.col("op") == "-").otherwise(F.col("op") == "+")
    around = F.sequence(F.col("at") - (NEARBY - 1), F.col("at") + (NEARBY - 1))
    places = found.filter(vouches | counts).select(
        *keys, F.explode(F.when(vouches, around).otherwise(F.array("at"))).alias("line_no"), "family", "rule_id", "severity", "category",
        F.when(vouches, 0).otherwise(1).alias("_hit"))
    settled = places.groupBy(*keys, "line_no", "family", "rule_id", "severity", "category").agg(F.sum("_hit").alias("_n"), F.min("_hit").alias("_alone"))
    return settled.filter("_alone = 1").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*keys, "line_no", "rule_id", "severity", "category")


def removed_safeguards(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Removed lines that matched a safeguard which no added line nearby still has."""
    return _rule_changes(lines, keys, REMOVED)


def dependency_downgrades(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Dependencies whose version in an added line is lower than in the last removed one."""
    pattern = quote(DEPENDENCY_LINE)
    parsed = lines.filter(f"text RLIKE {pattern}").selectExpr(
        *keys, "op", "line_no", f"regexp_extract(text, {pattern}, 1) AS name", f"regexp_extract(text, {pattern}, 2) AS version")
    old = parsed.filter("op = '-'").groupBy(*keys, "name").agg(F.max_by("version", F.struct("line_no", "version")).alias("previous"))
    new = parsed.filter("op = '+'").select(*keys, "name", "line_no", "version")
    return new.join(shuffled(old), [*keys, "name"]).filter(f"{version_key('version')} < {version_key('previous')}")


def regression_report(lines: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """All regressions of the diffs: safeguards removed, unsafe patterns added, dependencies downgraded."""
    downgraded = dependency_downgrades(lines.filter(F.col(path).endswith("package.json")), keys).select(
        *keys, "line_no", F.lit("REG_DEP_001").alias("rule_id"), F.lit("high").alias("severity"), F.lit("dependency-downgrade").alias("category"))
    return _rule_changes(lines, keys, REMOVED, ADDED).unionByName(downgraded)
