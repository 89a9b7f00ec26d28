"""Data-flow analysis: tainted variables, their spread through assignments, and flows to sinks.

Input ``corpus``: (file_id, project, path, lang, text).  A variable is used wherever its name
occurs in a text, even inside a longer word.  That containment is an equality join here: the
text is expanded to the distinct pieces of its words, and a variable meets its own name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.scan import _guard, _hits, may_match, quote, strip, to_lines
from siftlake.rules.flow import (
    ARROW_PARAMS, ASSIGNMENT, DESTRUCTURE, ES_IMPORT, FUNCTION_PARAMS, PYTHON_IMPORT, REQUIRE_IMPORT, SINKS, SOURCES,
)
from siftlake.session import checkpointed, shuffled

# Endings tried for an import path, in order.
IMPORT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".py", "", "/index.ts", "/index.js")


def _mentioned(lines: DataFrame, text: str, variables: DataFrame) -> DataFrame:
    """Lines with each tainted variable of their file that a word of ``text`` contains.

    Files are matched by equality and the name by a search in the line, so a long word costs no more rows.
    """
    named = variables.filter("var RLIKE '^\\\\w+$'").withColumnRenamed("file_id", "_file")
    return lines.join(shuffled(named), (F.col("file_id") == F.col("_file")) & F.contains(F.col(text), F.col("var"))).drop("_file")


def _code_lines(corpus: DataFrame, family) -> DataFrame:
    lines = to_lines(corpus.select("file_id", "lang", "text"))
    return lines.filter(_guard("line", family)).withColumn("trimmed", F.expr(strip("line")))


def sources(corpus: DataFrame) -> DataFrame:
    """Lines that bring in outside data; of several kinds on a line the last in catalogue order counts."""
    lines = _code_lines(corpus.filter(may_match("text", SOURCES)), SOURCES).withColumn("_low", F.lower("line"))
    kinds = "array(" + ", ".join(quote(r.category) for r in SOURCES.rules) + ")"
    hit = lines.selectExpr("file_id", "line_no", "trimmed", f"array_max({_hits('line', '_low', [SOURCES], ['lang'], True, False)}) AS _hit")
    return hit.filter("_hit IS NOT NULL").selectExpr("file_id", "line_no", "trimmed", f"element_at({kinds}, _hit) AS category")


def sinks(corpus: DataFrame) -> DataFrame:
    """Lines with a dangerous operation, one row per operation."""
    lines = _code_lines(corpus.filter(may_match("text", SINKS)), SINKS).withColumn("_low", F.lower("line"))
    kinds = "array(" + ", ".join(
        f"named_struct('operation', {quote(r.title)}, 'category', {quote(r.category)}, 'severity', {quote(r.severity)})" for r in SINKS.rules) + ")"
    hit = lines.selectExpr("file_id", "line_no", "line", f"explode({_hits('line', '_low', [SINKS], ['lang'], True, False)}) AS _hit")
    return hit.selectExpr("file_id", "line_no", "line", f"element_at({kinds}, _hit) AS _k").select("file_id", "line_no", "line", "_k.*")


def tainted_seeds(found: DataFrame) -> DataFrame:
    """Variables assigned on a source line; the last source of a variable wins."""
    assigned = f"filter(array(regexp_extract(trimmed, {quote(ASSIGNMENT)}, 1)), v -> v <> '')"
    unpacked = (f"filter(transform(split(regexp_extract(trimmed, {quote(DESTRUCTURE)}, 1), ','), "
                "v -> trim(split(trim(v), ':')[0])), v -> v <> '')")
    named = found.selectExpr("file_id", "line_no", "category", f"explode(array_distinct(concat({assigned}, {unpacked}))) AS var")
    return named.groupBy("file_id", "var").agg(
        F.max("line_no").alias("source_line"), F.max_by("category", "line_no").alias("category"))


def assignments(corpus: DataFrame) -> DataFrame:
    lines = _code_lines(corpus, SOURCES)
    return lines.filter(f"trimmed RLIKE {quote(ASSIGNMENT)}").selectExpr(
        "file_id", f"regexp_extract(trimmed, {quote(ASSIGNMENT)}, 1) AS target", f"regexp_extract(trimmed, {quote(ASSIGNMENT)}, 2) AS rhs").distinct()


def propagate(seeds: DataFrame, assigned: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Spread taint through assignments to a fixpoint; each round only follows the newly tainted variables.

    The lineage is cut after every round.  Rounds are as many as the longest chain of
    assignments; ``max_rounds`` stops earlier.
    """
    relevant = assigned.join(shuffled(seeds.select("file_id").distinct()), "file_id", "left_semi")
    uses = checkpointed(relevant)
    known = checkpointed(seeds)
    frontier, done = known, 0
    while max_rounds is None or done < max_rounds:
        reached = _mentioned(uses, "rhs", frontier).groupBy("file_id", "target").agg(
            F.min_by(F.struct("source_line", "category"), F.struct("source_line", "category")).alias("_s"))
        fresh = reached.select("file_id", F.col("target").alias("var"), "_s.source_line", "_s.category").join(
            shuffled(known.select("file_id", "var")), ["file_id", "var"], "left_anti")
        frontier = checkpointed(fresh)
        if frontier.isEmpty():
            break
        known, done = known.unionByName(frontier), done + 1
        if done % 8 == 0:
            known = checkpointed(known)
    return known


def local_flows(tainted: DataFrame, found_sinks: DataFrame) -> DataFrame:
    """Sink lines that mention a tainted variable of their file."""
    uses = found_sinks.select("file_id", "line_no", "line", "operation", "severity", F.col("category").alias("sink_category"))
    return _mentioned(uses, "line", tainted).select(
        F.lit("local").alias("kind"), F.col("file_id").alias("source_file"), "source_line", F.col("category").alias("source_category"),
        F.col("file_id").alias("sink_file"), F.col("line_no").alias("sink_line"), "operation", "sink_category", "severity", "var")


def functions_defined(corpus: DataFrame) -> DataFrame:
    """Functions with their parameters, declared or assigned as arrow functions."""
    lines = _code_lines(corpus.filter("text RLIKE 'function|=>'"), SOURCES)
    declared, arrow = quote(FUNCTION_PARAMS), quote(ARROW_PARAMS)
    shape = f"CASE WHEN trimmed RLIKE {declared} THEN {declared} ELSE {arrow} END"
    return lines.filter(f"trimmed RLIKE {declared} OR trimmed RLIKE {arrow}").selectExpr(
        "file_id", f"regexp_extract(trimmed, {shape}, 1) AS name",
        f"filter(transform(split(regexp_extract(trimmed, {shape}, 2), ','), p -> trim(split(split(trim(p), ':')[0], '=')[0])), p -> p <> '') AS params")


def _resolved(path: str) -> str:
    """SQL text of a path without ``.`` and ``..``."""
    return (f"array_join(aggregate(split({path}, '/'), CAST(array() AS ARRAY<STRING>), (done, part) -> "
            "CASE WHEN part IN ('', '.') THEN done WHEN part = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) "
            "ELSE concat(done, array(part)) END), '/')")


def import_edges(corpus: DataFrame) -> DataFrame:
    """Imported names by file and the file they come from, resolved against the whole project."""
    lines = to_lines(corpus.filter("text RLIKE 'import|require'").select("file_id", "project", "path", "text"))
    t = lines.filter(_guard("line", SOURCES)).withColumn("trimmed", F.expr(strip("line")))
    es, cjs, py = quote(ES_IMPORT), quote(REQUIRE_IMPORT), quote(PYTHON_IMPORT)

    def names(pattern: str, split_on: str) -> str:
        listed = f"regexp_extract(trimmed, {pattern}, 1)"
        many = f"transform(split({listed}, ','), n -> trim(split(trim(n), '{split_on}')[0]))"
        return f"IF({listed} <> '', {many}, array(regexp_extract(trimmed, {pattern}, 2)))"

    forms = (
        f"array_compact(array("
        f"IF(trimmed RLIKE {es}, named_struct('names', {names(es, ' as ')}, 'target', regexp_extract(trimmed, {es}, 3), 'exact', false), NULL), "
        f"IF(trimmed RLIKE {cjs}, named_struct('names', {names(cjs, ':')}, 'target', regexp_extract(trimmed, {cjs}, 3), 'exact', false), NULL), "
        f"IF(trimmed RLIKE {py}, named_struct('names', transform(split(regexp_extract(trimmed, {py}, 2), ','), n -> trim(n)), "
        f"'target', concat('./', regexp_extract(trimmed, {py}, 1), '.py'), 'exact', true), NULL)))"
    )
    imports = t.selectExpr("file_id", "project", "path", f"inline({forms})").filter("startswith(target, '.')")
    endings = "array(" + ", ".join(quote(e) for e in IMPORT_ENDINGS) + ")"
    folder = "regexp_replace(path, '[^/]*$', '')"
    tried = imports.selectExpr(
        "file_id", "project", "names", "target",
        f"posexplode(IF(exact, array(''), {endings})) AS (rank, ending)", f"{_resolved(f'concat({folder}, target)')} AS base",
    ).selectExpr("file_id", "project", "names", "target", "rank", "concat(base, ending) AS candidate")
    files = corpus.selectExpr("project", f"{_resolved('path')} AS candidate", "file_id AS to_file")
    found = tried.join(shuffled(files), ["project", "candidate"]).groupBy("file_id", "target", "names").agg(
        F.min_by("to_file", F.struct("rank", "to_file")).alias("to_file"))
    return found.select(F.col("file_id").alias("from_file"), "to_file", F.explode("names").alias("name")).filter("name <> ''").distinct()


def cross_file_flows(tainted: DataFrame, found_sinks: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Flows over an import: a tainted name reaches the importer's sinks, tainted data reaches the callee's sinks."""
    s = found_sinks.select(F.col("file_id").alias("sink_file"), F.col("line_no").alias("sink_line"), "operation",
                           F.col("category").alias("sink_category"), "severity")
    origin = tainted.select(F.col("file_id").alias("source_file"), "var", "source_line", F.col("category").alias("source_category"))
    inward = edges.join(shuffled(origin), (edges["to_file"] == origin["source_file"]) & (edges["name"] == origin["var"])).join(
        shuffled(s), F.col("sink_file") == F.col("from_file"))
    called = functions.select(F.col("file_id").alias("to_file"), "name").distinct()
    callable_edges = edges.join(shuffled(called), ["to_file", "name"]).select("from_file", "to_file").distinct()
    outward = callable_edges.join(shuffled(origin), F.col("from_file") == F.col("source_file")).join(shuffled(s), F.col("sink_file") == F.col("to_file"))
    columns = ["source_file", "source_line", "source_category", "sink_file", "sink_line", "operation", "sink_category", "severity", "var"]
    return inward.select(F.lit("cross").alias("kind"), *columns).unionByName(outward.select(F.lit("cross-call").alias("kind"), *columns))


def dedupe_flows(flows: DataFrame) -> DataFrame:
    """One row per flow; flows of imported names do not distinguish the variable."""
    identity = ["kind", "source_file", "source_line", "sink_file", "sink_line"]
    named = flows.withColumn("_var", F.when(F.col("kind") == "cross", "").otherwise(F.col("var")))
    rest = [c for c in flows.columns if c not in identity]
    # The first operation on the line stands for it.
    kept = named.groupBy(*identity, "_var").agg(F.min(F.struct(*rest)).alias("_r"))
    return kept.select(*identity, *[F.col(f"_r.{c}").alias(c) for c in rest])


def flows_by_severity(flows: DataFrame) -> DataFrame:
    return flows.groupBy("severity", "kind").agg(F.count("*").alias("flows"))


def analyze(corpus: DataFrame) -> DataFrame:
    """All flows of a corpus."""
    found_sources, found_sinks = sources(corpus), checkpointed(sinks(corpus))
    tainted = propagate(tainted_seeds(found_sources), assignments(corpus))
    flows = local_flows(tainted, found_sinks).unionByName(
        cross_file_flows(tainted, found_sinks, import_edges(corpus), functions_defined(corpus)))
    return dedupe_flows(flows)
