"""Rule scanning: every rule of one or more families against every line, in one pass.

Rules are compiled into one projection over the exploded lines, so the corpus is read
once however many families are asked for and nothing is joined or shuffled.  Two
filters, each implied by the rules, cut the regular-expression work:

* a line is only tried against the families with an anchor in it, which Arrow's expressions find for all
  anchors of a family at once, however many there are;
* a rule's expression only runs on lines that hold one of its own anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.files import infrastructure_framework
from siftlake.rules.infrastructure import IAC, NO_USER_RULE
from siftlake.rules.mining import CRYPTOJACK, RISKY_SCRIPTS
from siftlake.rules.model import Family, Rule
from siftlake.vocab import SEVERITY_RANK, severity_rank


def quote(value: str | None) -> str:
    """A SQL string literal; a dollar and a brace would otherwise start a variable."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$\\u007B")
    return f"'{escaped}'"


def strip(text: str) -> str:
    """SQL text without surrounding white space; Spark's own trim only knows the space."""
    return f"btrim({text}, ' \\t\\r\\n')"


def _or(conditions: Iterable[str]) -> str:
    joined = " OR ".join(conditions)
    return f"({joined})" if joined else "false"


def _holds(lowered: str, anchors: Iterable[str]) -> str:
    return _or(f"contains({lowered}, {quote(a)})" for a in anchors)


def _holds_once(lowered: str, anchors: Sequence[str]) -> str:
    """As :func:`_holds`, with the lower-cased text bound to a variable.

    A filter is moved below the projection that would have computed the lower-case text,
    which then is computed again for each anchor; the variable keeps it to once per row.
    """
    if len(anchors) < 2:
        return _holds(lowered, anchors)
    return f"exists(array({lowered}), t -> {_holds('t', anchors)})"


def _anchors(families: Sequence[Family]) -> list[str]:
    """Distinct anchors; one that contains another is implied by it."""
    anchors = sorted({a for f in families for r in f.rules for a in r.anchors})
    return [a for a in anchors if not any(b != a and b in a for b in anchors)]


def _candidates(text: str, lowered: str, families: Sequence[Family], multiline: bool) -> str:
    """Condition that holds wherever some rule of the families can match."""
    flag = "(?m)" if multiline else ""
    bare = [r for f in families for r in f.rules if not r.anchors]
    parts = [f"{text} RLIKE {quote(flag + r.jvm)}" for r in bare]
    anchors = _anchors(families)
    if anchors:
        parts.insert(0, _holds_once(lowered, anchors))
    return _or(parts)


def may_match(text: str, *families: Family) -> Column:
    """True for every text in which some rule of the families can match a line."""
    return F.expr(_candidates(f"`{text}`", f"lower(`{text}`)", families, True))


#: Where a line ends, for every rule family alike.
LINE_END = r"\r?\n"


def to_lines(corpus: DataFrame, split: str = LINE_END, text: str = "text") -> DataFrame:
    """One row per line, numbered from one."""
    rest = [c for c in corpus.columns if c != text]
    return corpus.select(*rest, F.posexplode(F.split(text, split)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no") + 1
    )


def _guard(line: str, family: Family) -> str:
    """Length and comment conditions of a family."""
    parts = []
    if family.skip_empty:
        parts.append(f"length({line}) > 0")
    if family.max_line is not None:
        parts.append(f"length({line}) <= {family.max_line}")
    if family.comment is not None:
        parts.append(f"NOT {line} RLIKE {quote(family.comment)}")
    return " AND ".join(parts) or "true"


def _gate(rule: Rule, family: Family, columns: Sequence[str]) -> list[str]:
    """Whether the rule applies to the row's language and framework."""
    parts = []
    unknown = "true" if family.unknown_language == "match" else "false"
    if rule.languages:
        listed = ", ".join(quote(x) for x in rule.languages)
        parts.append(f"coalesce(lang IN ({listed}), {unknown})" if "lang" in columns else unknown)
    if rule.frameworks and "framework" in columns:
        parts.append("coalesce(framework IN (" + ", ".join(quote(x) for x in rule.frameworks) + "), false)")
    return parts


def _describe(families: Sequence[Family]) -> str:
    """Literal array of rule descriptions; hits refer to it by position."""
    rows = []
    for f in families:
        for r in f.rules:
            rows.append(
                f"named_struct('rule_id', {quote(r.rule_id)}, 'type', {quote(f.finding_type)}, "
                f"'family', {quote(f.name)}, 'severity', {quote(r.severity)}, 'category', {quote(r.category)}, "
                f"'message', {quote(r.title)}, 'cwe', {quote(r.cwe)}, 'owasp', {quote(r.owasp)}, "
                f"'cis', {quote(r.cis)}, 'pattern', {quote(r.jvm)}, 'width', {f.evidence}, "
                f"'masked', {str(f.mask_evidence).lower()})"
            )
    return "array(" + ", ".join(rows) + ")"


def _hits(text: str, lowered: str, families: Sequence[Family], columns: Sequence[str], prefilter: bool,
          guarded: bool, flagged: bool = False) -> str:
    """Array of the positions of the rules that match; with ``flagged``, anchored rules only run where their family's flag is up."""
    arrays, position = [], 0
    for f in families:
        anchored, bare = [], []
        for r in f.rules:
            position += 1
            parts = _gate(r, f, columns)
            if prefilter and r.anchors:
                parts.append(_holds(lowered, r.anchors))
            if guarded:
                parts.append(_guard(text, f))
            parts.append(f"{text} RLIKE {quote(r.jvm)}")
            (anchored if _needed(r) else bare).append(f"CASE WHEN {' AND '.join(parts)} THEN {position} END")
        if anchored:
            hits = f"array({', '.join(anchored)})"
            arrays.append(f"IF(_may_{f.name}, {hits}, CAST(array() AS ARRAY<INT>))" if flagged else hits)
        if bare:
            arrays.append(f"array({', '.join(bare)})")
    return f"array_compact(concat({', '.join(arrays or ['CAST(array() AS ARRAY<INT>)'])}))"


#: Families whose flags are the bits of one number.
_FLAGS = 60


def _needed(rule: Rule) -> list[str]:
    """Expressions for Arrow of which every line that the rule matches holds one, in lower case; none if nothing is certain."""
    return [re.escape(a) for a in rule.anchors] or [rule.shape] * bool(rule.shape)


def _flags(lowered: str, families: Sequence[Family]) -> Column:
    """A number with a bit for each family: up where the lower-cased line holds one of the family's anchors or shapes.

    An alternation is one automaton for Arrow, so a line is read once for all of them together, and once more for each
    family where it holds any.
    """
    anchors = ["|".join(sorted({n for r in f.rules for n in _needed(r)})) for f in families]
    every = "|".join(sorted({n for f in families for r in f.rules for n in _needed(r)}))

    @F.arrow_udf("long")
    def bits(lines: pa.Array) -> pa.Array:
        out = np.zeros(len(lines), np.int64)
        if len(lines):
            at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(lines, every), False).to_numpy(zero_copy_only=False))
            some = lines.take(pa.array(at))
            for k, pattern in enumerate(anchors):
                if pattern:
                    out[at] |= pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False).astype(np.int64) << k
        return pa.array(out)

    return bits(F.col(lowered))


_RULE_COLUMNS = ("rule_id", "type", "family", "severity", "category", "message", "cwe", "owasp", "cis")


def scan(corpus: DataFrame, *families: Family, text: str = "text", prefilter: bool = True) -> DataFrame:
    """Findings of the families over a corpus: one per line and rule, at the first match.

    All columns of the corpus but the text are kept.  ``lang`` and ``framework``, where
    present, gate the rules bound to a language or framework.
    """
    if not families:
        raise ValueError("no rule family given")
    rest = [c for c in corpus.columns if c != text]
    kept = [f"`{c}`" for c in rest]
    lines = corpus.selectExpr(*kept, f"posexplode(split(`{text}`, {quote(LINE_END)})) AS (_pos, line)").selectExpr(
        *kept, "_pos + 1 AS line_no", "line", "lower(line) AS _low")
    flagged = prefilter and any(_needed(r) for f in families for r in f.rules)
    if flagged:
        groups = range(0, len(families), _FLAGS)
        lines = lines.select("*", *[_flags("_low", families[g:g + _FLAGS]).alias(f"_flags_{g // _FLAGS}") for g in groups])
        lines = lines.selectExpr(
            *kept, "line_no", "line", "_low", *[f"getbit(_flags_{k // _FLAGS}, {k % _FLAGS}) = 1 AS _may_{f.name}" for k, f in enumerate(families)])
    # The flags sit inside the generator: as a filter they would be computed a second time below it.
    matched = lines.selectExpr(
        *kept, "line_no", "line", f"explode({_hits('line', '_low', families, rest, prefilter, True, flagged)}) AS _hit",
    )
    described = matched.selectExpr("*", f"element_at({_describe(families)}, _hit) AS _rule")
    located = described.selectExpr(
        "*", "regexp_instr(line, _rule.pattern) AS col_start", "regexp_extract(line, _rule.pattern, 0) AS _found"
    )
    return located.selectExpr(
        *[f"`{c}`" for c in rest], "line_no", *[f"_rule.{c} AS {c}" for c in _RULE_COLUMNS],
        "col_start", "col_start + length(_found) AS col_end",
        "CASE WHEN _rule.masked THEN concat(substring(_found, 1, 4), '***') "
        "ELSE substring(_found, 1, _rule.width) END AS evidence",
    )


def scan_text_once(corpus: DataFrame, family: Family, text: str = "text") -> DataFrame:
    """File-level scan: one finding per text and rule, on the line of the first match."""
    rest = [c for c in corpus.columns if c != text]
    kept = ", ".join(f"`{c}`" for c in rest)
    source = corpus.filter(may_match(text, family)).selectExpr("*", f"lower(`{text}`) AS _low")
    matched = source.selectExpr(
        *rest, f"`{text}` AS _text",
        f"explode({_hits(f'`{text}`', '_low', [family], rest, True, False)}) AS _hit",
    )
    described = matched.selectExpr("*", f"element_at({_describe([family])}, _hit) AS _rule")
    located = described.selectExpr(
        "*", "substring(_text, 1, regexp_instr(_text, _rule.pattern) - 1) AS _before",
        "regexp_extract(_text, _rule.pattern, 0) AS evidence",
    )
    return located.selectExpr(
        *kept.split(", "), "length(_before) - length(replace(_before, '\n', '')) + 1 AS line_no",
        *[f"_rule.{c} AS {c}" for c in _RULE_COLUMNS], "evidence",
    )


def scan_infrastructure(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Infrastructure rules of each file's framework, and Dockerfiles that never leave root."""
    routed = corpus.withColumn("framework", infrastructure_framework(F.col(path), F.col(text)))
    routed = routed.filter(F.col("framework").isNotNull())
    rest = [c for c in routed.columns if c != text]
    found = scan(routed, IAC, text=text)
    rootless = routed.filter((F.col("framework") == "dockerfile") & ~F.col(text).rlike(NO_USER_RULE.jvm))
    without_user = rootless.selectExpr(
        *[f"`{c}`" for c in rest], "1 AS line_no",
        *[f"{quote(v)} AS {k}" for k, v in (
            ("rule_id", NO_USER_RULE.rule_id), ("type", "iac"), ("family", "iac"), ("severity", NO_USER_RULE.severity),
            ("category", NO_USER_RULE.category), ("message", NO_USER_RULE.title), ("cwe", None), ("owasp", None),
            ("cis", NO_USER_RULE.cis))],
        "1 AS col_start", "1 AS col_end", "'' AS evidence",
    )
    return found.unionByName(without_user)


def scan_patterns(corpus: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """User-supplied patterns, matched without regard to case; patterns that do not compile are left out."""
    jvm = corpus.sparkSession._jvm
    rules = []
    for i, p in enumerate(patterns):
        try:
            jvm.java.util.regex.Pattern.compile(p)
        except Exception:  # noqa: BLE001 - the pattern is not a valid expression
            continue
        rules.append(Rule(f"POLICY_PATTERN_{i + 1}", "high", "forbidden-pattern", "(?i)" + p, p))
    if not rules:
        empty = Rule("POLICY_PATTERN_0", "high", "forbidden-pattern", "(?!)", "")
        rules = [empty]
    return scan(corpus, Family("policy_pattern", tuple(rules), finding_type="policy"), text=text)


def severity_at_least(findings: DataFrame, threshold: str) -> DataFrame:
    """Keep findings at or above a severity; labels outside the vocabulary pass, and so do packages that do not exist."""
    rank = severity_rank(F.col("severity"))
    keep = rank.isNull() | (rank >= SEVERITY_RANK[threshold])
    if "type" in findings.columns:
        keep = keep | (F.col("type") == "hallucination")
    return findings.filter(keep)


def escalate(severity: Column) -> Column:
    """One level up, for findings inside install scripts."""
    return (
        F.when(severity == "low", "medium").when(severity == "medium", "high").when(severity == "high", "critical")
        .otherwise(severity)
    )


def scan_package_scripts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Mining indicators in the scripts of a package manifest that run unasked, each one level more severe."""
    rest = [c for c in corpus.columns if c != text]
    risky = ", ".join(quote(s) for s in RISKY_SCRIPTS)
    scripts = corpus.selectExpr(
        *[f"`{c}`" for c in rest], f"explode(from_json(`{text}`, 'scripts MAP<STRING, STRING>').scripts) AS (script, command)"
    ).filter(f"script IN ({risky})")
    return scan(scripts, CRYPTOJACK, text="command").withColumn("severity", escalate(F.col("severity")))


def merge_detectors(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    """Primary findings, plus the secondary ones that no primary finding on the same line already names.

    A secondary finding is covered when the name of a primary one contains its first word.
    """
    keys = list(keys)
    names = primary.select(*keys, F.lower("message").alias("_name")).distinct()
    word = F.lower(F.split("message", " ")[0])
    fresh = secondary.withColumn("_word", word)
    condition = [fresh[k] == names[k] for k in keys] + [names["_name"].contains(fresh["_word"])]
    return primary.unionByName(fresh.join(names, condition, "left_anti").drop("_word"), allowMissingColumns=True)


def summarize(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals by severity and by type in one pass."""
    counts = [F.count("*").alias("total_findings")]
    counts += [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    # Summary columns and the finding types they count.
    for name, kind in (
        ("hallucinated_packages", "hallucination"), ("vulnerable_packages", "vulnerability"),
        ("secrets_found", "secret"), ("sast_findings", "sast"), ("policy_violations", "policy"), ("mcp_issues", "mcp"),
    ):
        counts.append(F.count_if(F.col("type") == kind).alias(name))
    return findings.groupBy(*by).agg(*counts)


def gate(summary: DataFrame, mode: str = "scan") -> DataFrame:
    """Whether a run fails: on critical findings, and on high ones too before a commit."""
    failing = F.col("critical") > 0
    if mode == "pre-commit":
        failing = failing | (F.col("high") > 0)
    return summary.withColumn("failed", failing)


def severity_by_category(findings: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    return findings.groupBy(*by).pivot("severity", list(SEVERITY_RANK)).agg(F.count(F.lit(1))).na.fill(0)


def finding_density(findings: DataFrame, corpus: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Findings per thousand lines."""
    by = list(by)
    lines = corpus.groupBy(*by).agg(
        F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).alias("lines")
    )
    found = findings.groupBy(*by).agg(F.count("*").alias("findings"))
    return lines.join(found, by, "left").select(
        *by, "lines", F.coalesce("findings", F.lit(0)).alias("findings"),
        F.round(F.coalesce("findings", F.lit(0)) * 1000.0 / F.col("lines"), 4).alias("per_thousand_lines"),
    )


def security_context_score(summary: DataFrame) -> DataFrame:
    """Hundred, less fifteen per critical and five per other finding."""
    others = F.col("total_findings") - F.col("critical")
    return summary.withColumn("context_score", F.greatest(F.lit(0), 100 - 15 * F.col("critical") - 5 * others))
