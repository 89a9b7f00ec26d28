"""Version strings: cleaning, ordering keys and ranges.

Functions take and return SQL expression text, so that they nest without a round trip
through the driver's expression objects.
"""

from __future__ import annotations


def cleaned(spec: str) -> str:
    """A manifest's version without its range operators; null unless it starts like a version."""
    stripped = f"trim(regexp_replace({spec}, '^[\\\\^~>=<!\\\\s]*', ''))"
    return f"CASE WHEN {stripped} RLIKE '^[0-9]+[.][0-9]+' THEN {stripped} END"


def without_operators(spec: str) -> str:
    """A bill-of-materials version: range operators dropped, first alternative kept, never null."""
    return f"split(regexp_replace({spec}, '^[\\\\^~>=<]+', ''), ' ')[0]"


def version_key(version: str, parts: int = 4) -> str:
    """Array of numbers that orders versions; pre-release labels and non-numeric parts count as nothing."""
    core = f"split(regexp_replace({version}, '^[^0-9]*', ''), '-')[0]"
    padding = ", ".join(["'0'"] * parts)
    return (
        f"transform(slice(concat(split({core}, '[.]'), array({padding})), 1, {parts}), "
        "x -> coalesce(try_cast(regexp_extract(x, '^[0-9]+', 0) AS BIGINT), CAST(0 AS BIGINT)))"
    )


def major(version: str) -> str:
    return f"coalesce(try_cast(regexp_extract({version}, '^v?([0-9]+)', 1) AS BIGINT), CAST(0 AS BIGINT))"


def satisfies(version: str, bound: str) -> str:
    """Simple range such as ``<1.2.3``; a range of another shape is taken to hold, and so is an unknown version."""
    target = f"regexp_extract({bound}, '^(?:<=|<|>=|>|==|=)?\\\\s*([0-9]+[.][0-9]+[.][0-9]+)', 1)"
    operator = f"regexp_extract({bound}, '^(<=|<|>=|>|==|=)?', 1)"
    left, right = version_key(version), version_key(target)
    return (
        f"CASE WHEN {version} IS NULL OR {target} = '' THEN true "
        f"WHEN {operator} = '<' THEN {left} < {right} WHEN {operator} = '<=' THEN {left} <= {right} "
        f"WHEN {operator} = '>' THEN {left} > {right} WHEN {operator} = '>=' THEN {left} >= {right} "
        f"ELSE {left} = {right} END"
    )
