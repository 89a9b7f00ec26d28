"""Checking SQL for the rule scans.

The checking database has no look-around, so a rule that needs it is checked as a plain
pattern over the line from which the excluded shapes were removed first.
"""

from __future__ import annotations

from siftlake.plans.tables import sql_text
from siftlake.rules.model import Family, Rule

# Rule id -> (shape to remove from the line, pattern without look-around).
_TAGGED = r"""\.innerHTML\s*=['"`]<(?:div|span|p|h[1-6]|br\s*/)>['"`]"""
_LOCAL = r"""((?:fetch|axios\.get|axios\.post|http\.get|request\.get)\s*\(\s*['"])http://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)"""
_HTTP = r"""(?:fetch|axios\.get|axios\.post|http\.get|request\.get)\s*\(\s*['"]http://"""
WITHOUT_LOOKAROUND: dict[str, tuple[str | None, str]] = {
    "CG_XSS_001": (_TAGGED, r"\.innerHTML\s*="),
    "XSS_001": (_TAGGED, r"\.innerHTML\s*="),
    "CG_HTTP_001": (_LOCAL, _HTTP),
    "HTTP_001": (_LOCAL, _HTTP),
    "CG_SESSION_001": (None, r"(?i)(?:cookie|setCookie|set-cookie).*httpOnly\s*[:=]\s*false"),
    "CG_DESER_002": (None, r"yaml\.load\s*\("),
    "DESER_002": (None, r"yaml\.load\s*\("),
    "SAST_DESERIALIZE": (None, r"(?:pickle\.loads?|yaml\.load\s*\()"),
    "SCRIPT_01": (r"(?i)https?://(?:registry\.npmjs\.org|pypi\.org|github\.com|api\.github\.com|nodejs\.org|npmjs\.com)", r"""(?i)https?://[^\s'")\]]+"""),
    "SCRIPT_22": (None, r"""(?i)require\s*\([^'")][^)]*\)"""),
    "SCRIPT_23": (None, r"""(?i)import\s*\([^'")][^)]*\)"""),
    "AICFG_11": (r"(?i)https?://(?:registry\.npmjs\.org|pypi\.org|api\.github\.com)", r"""(?i)(?:fetch|xhr|axios|http\.get|https\.get|request)\s*\(\s*['"]https?://"""),
    "INTENT_01": (r"(?i)https?://(?:cdn\.jsdelivr\.net|unpkg\.com|cdnjs\.cloudflare\.com|code\.jquery\.com)", r"""(?i)<script[^>]+src\s*=\s*["']https?://[^"']+["'][^>]*>"""),
    "INTENT_03": (r"(?i)https?://(?:api\.|localhost|127\.0\.0\.1)", r"""(?i)(?:fetch|axios|http\.get|https\.get|request|got)\s*\(\s*["'`]https?://[^"'`]+["'`]"""),
}


def matches(rule: Rule, line: str = "line") -> str:
    drop, pattern = WITHOUT_LOOKAROUND.get(rule.rule_id, (None, rule.pattern))
    if drop is not None:
        line = f"regexp_replace({line}, {sql_text(drop)}, '', 'g')"
    return f"regexp_matches({line}, {sql_text(pattern)})"


def evidence(rule: Rule, family: Family) -> str:
    """First match as shown on the finding; null where the check uses another pattern."""
    found = f"regexp_extract(line, {sql_text(rule.pattern)})"
    return f"left({found}, 4) || '***'" if family.mask_evidence else f"left({found}, {family.evidence})"


def guard(family: Family, line: str = "line") -> str:
    parts = ["true"]
    if family.skip_empty:
        parts.append(f"length({line}) > 0")
    if family.max_line is not None:
        parts.append(f"length({line}) <= {family.max_line}")
    if family.comment is not None:
        parts.append(f"NOT regexp_matches({line}, {sql_text(family.comment)})")
    return " AND ".join(parts)


def gate(rule: Rule, family: Family, with_language: bool, with_framework: bool) -> str:
    parts = ["true"]
    unknown = "true" if family.unknown_language == "match" else "false"
    if rule.languages:
        listed = ", ".join(sql_text(x) for x in rule.languages)
        parts.append(f"coalesce(lang IN ({listed}), {unknown})" if with_language else unknown)
    if rule.frameworks and with_framework:
        parts.append(f"coalesce(framework IN ({', '.join(sql_text(x) for x in rule.frameworks)}), false)")
    return " AND ".join(parts)


def lines_sql(corpus: str, columns: str = "file_id, lang") -> str:
    """The body of a CTE with the lines of another one."""
    cut = "string_split_regex(text, '\\r?\\n')"
    return (
        f"SELECT {columns}, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line "
        f"FROM (SELECT *, {cut} AS parts FROM {corpus})"
    )


def findings_sql(family: Family, columns: str = "file_id", with_language: bool = True,
                 with_framework: bool = False, with_evidence: bool = False, lines: str = "lines") -> str:
    """Union over the rules of a family of the lines each one matches."""
    selects = []
    for r in family.rules:
        shown = f", {evidence(r, family)} AS evidence" if with_evidence else ""
        selects.append(
            f"SELECT {columns}, line_no, {sql_text(r.rule_id)} AS rule_id, {sql_text(r.severity)} AS severity, "
            f"{sql_text(r.category)} AS category{shown} FROM {lines} "
            f"WHERE {guard(family)} AND {gate(r, family, with_language, with_framework)} AND {matches(r)}"
        )
    return "\nUNION ALL\n".join(selects)
