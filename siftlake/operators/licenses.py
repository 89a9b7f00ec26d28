"""License expressions: resolution, policy findings and compatibility with the project's license."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.scan import quote

# License identifiers by category.
CATEGORIES = {
    "permissive": ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Zlib", "WTFPL", "0BSD", "BSD-4-Clause",
                   "PostgreSQL", "OFL-1.1"),
    "public-domain": ("Unlicense", "CC0-1.0"),
    "weak-copyleft": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "EPL-2.0",
                      "CDDL-1.0", "LGPL", "Artistic-1.0", "Artistic-2.0"),
    "strong-copyleft": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL"),
    "network-copyleft": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "commercial-restricted": ("SSPL-1.0", "BUSL-1.1", "Elastic-2.0", "Commons-Clause"),
    "proprietary": ("UNLICENSED",),
    "unknown": ("SEE_LICENSE_IN_FILE",),
}
CATEGORY_OF = {i: c for c, ids in CATEGORIES.items() for i in ids}
# Other spellings.
ALIASES = {
    "Apache 2.0": "Apache-2.0", "Apache2": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "BSD-3": "BSD-3-Clause",
    "BSD 3-Clause": "BSD-3-Clause", "BSD-2": "BSD-2-Clause", "BSD 2-Clause": "BSD-2-Clause", "BSD License": "BSD-3-Clause",
    "GPL2": "GPL-2.0-only", "GPL 2": "GPL-2.0-only", "GPL-2.0": "GPL-2.0-only", "GPL 3": "GPL-3.0-only",
    "GPL-3.0": "GPL-3.0-only", "AGPL": "AGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-3.0": "LGPL-3.0-only", "Public Domain": "CC0-1.0",
}
# Project licenses and the dependency licenses they cannot take in.
INCOMPATIBLE = (
    (("Apache-2.0", "MIT", "BSD-3-Clause"), ("GPL-2.0-only", "GPL-2.0-or-later")),
    (("MIT", "BSD-3-Clause", "Apache-2.0", "UNLICENSED"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    (("MIT", "BSD-3-Clause", "Apache-2.0"), ("SSPL-1.0", "BUSL-1.1", "Elastic-2.0")),
)


@dataclass(frozen=True)
class LicensePolicy:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    deny_categories: tuple[str, ...] = ()
    project_license: str | None = None
    allow_unknown: bool = False
    # Judge every part of an AND, instead of treating AND and WITH like OR.
    strict_and: bool = False


def _map(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in values.items()) + ")"


def _listed(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(quote(v) for v in values)})" if values else "false"


def resolve(text: str) -> str:
    """SQL text of the identifier a license name stands for: itself, an alias, or the same in another case."""
    exact = _map({i: i for i in CATEGORY_OF})
    folded: dict[str, str] = {}
    for i in CATEGORY_OF:
        folded.setdefault(i.lower(), i)
    return (f"coalesce(try_element_at({exact}, {text}), try_element_at({_map(ALIASES)}, {text}), "
            f"try_element_at({_map(folded)}, lower({text})))")


def alternatives(expression: str) -> str:
    """SQL text of the resolved parts of a license expression; parts without meaning are dropped."""
    parts = f"split(trim(regexp_replace({expression}, '[()]', ' ')), '(?i)\\\\s+(?:OR|AND|WITH)\\\\s+')"
    return f"filter(transform({parts}, p -> {resolve('trim(p)')}), i -> i IS NOT NULL)"


def incompatible(project: str, dependency: str) -> str:
    """SQL condition: the project's license cannot take in the dependency's."""
    return "(" + " OR ".join(
        f"({_listed(project, p)} AND {_listed(dependency, d)})" for p, d in INCOMPATIBLE) + ")"


def _finding(rule: str, severity: str) -> str:
    return f"named_struct('rule_id', '{rule}', 'severity', '{severity}', 'license', id)"


def _judge(policy: LicensePolicy) -> str:
    """SQL text of the findings of one identifier ``id``."""
    category = f"try_element_at({_map(CATEGORY_OF)}, id)"
    found = []
    if not policy.deny and not policy.deny_categories:
        # Rules of the categories.
        for c, rule, severity in (
            ("strong-copyleft", "CG_LIC_020", "high"), ("network-copyleft", "CG_LIC_021", "high"),
            ("commercial-restricted", "CG_LIC_022", "critical"), ("proprietary", "CG_LIC_023", "high"),
            ("unknown", "CG_LIC_024", "medium"),
        ):
            found.append(f"IF({category} = '{c}', {_finding(rule, severity)}, NULL)")
        found.append(f"IF(id IN ('GPL', 'LGPL'), {_finding('CG_LIC_030', 'medium')}, NULL)")
    if policy.project_license is not None:
        found.append(f"IF({incompatible(resolve(quote(policy.project_license)), 'id')}, {_finding('CG_LIC_040', 'high')}, NULL)")
    none = "CAST(array() AS ARRAY<STRUCT<rule_id: STRING, severity: STRING, license: STRING>>)"
    rest = f"array_compact(array({', '.join(found)}))" if found else none
    return (
        f"CASE WHEN {_listed('id', policy.allow)} THEN {none} "
        f"WHEN {_listed('id', policy.deny)} THEN array({_finding('CG_LIC_010', 'critical')}) "
        f"WHEN {_listed(category, policy.deny_categories)} THEN array({_finding('CG_LIC_012', 'critical')}) "
        f"ELSE {rest} END"
    )


def license_findings(packages: DataFrame, policy: LicensePolicy = LicensePolicy(), column: str = "license") -> DataFrame:
    """Findings of each package's declared license, computed within its row.

    Of several alternatives one acceptable one is enough; otherwise the findings of the
    first are reported.
    """
    declared = f"`{column}`"
    listed = packages.selectExpr("*", f"{alternatives(declared)} AS _ids")
    judged = listed.selectExpr("*", f"transform(_ids, id -> {_judge(policy)}) AS _judged")
    none = "CAST(array() AS ARRAY<STRUCT<rule_id: STRING, severity: STRING, license: STRING>>)"
    missing = none if policy.allow_unknown else (
        "array(named_struct('rule_id', 'CG_LIC_001', 'severity', 'high', 'license', CAST(NULL AS STRING)))")
    failing = "forall(_judged, f -> size(f) > 0)"
    if policy.strict_and:
        joined = f"{declared} RLIKE '(?i)\\\\s(AND|WITH)\\\\s' AND NOT {declared} RLIKE '(?i)\\\\sOR\\\\s'"
        failing = f"IF({joined}, exists(_judged, f -> size(f) > 0), {failing})"
    chosen = "try_element_at(filter(_judged, f -> size(f) > 0), 1)"
    result = (
        f"CASE WHEN coalesce(trim({declared}), '') = '' THEN {missing} "
        "WHEN size(_ids) = 0 THEN array(named_struct('rule_id', 'CG_LIC_002', 'severity', 'medium', 'license', CAST(NULL AS STRING))) "
        f"WHEN {failing} THEN {chosen} ELSE {none} END"
    )
    return judged.selectExpr(*packages.columns, f"explode({result}) AS _f").select(*packages.columns, "_f.rule_id", "_f.severity", F.col("_f.license").alias("resolved"))
