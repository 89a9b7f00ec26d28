"""What a scan rule is, and how one is written.

A rule carries one regular expression plus the metadata that ends up on its
findings.  ``anchors`` are lower-case literals of which every match of the
pattern must contain at least one; the scanner uses them to skip texts and lines
with a plain substring search before any regular expression runs.  A rule without
anchors is always evaluated, so anchors can only ever save work.  A rule that has none
may have a ``shape`` instead: an expression in Arrow's syntax that every match,
in lower case, contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ASCII word boundary.  The JVM's own ``\b`` counts accented letters as word
# characters, which would let rules behave differently on non-English text.
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


# A boundary that opens a pattern and is followed by a word character.
_OPENING = re.compile(r"^(\(\?[a-z]+\))?\\b(?=(?:\((?:\?:)?)?(?:\[[A-Za-z0-9_]|\\d|[A-Za-z0-9_]))")


def jvm_regex(pattern: str) -> str:
    """The pattern as Spark should run it."""
    pattern = _OPENING.sub(lambda m: (m.group(1) or "") + r"(?<!\w)", pattern)
    return pattern.replace(r"\b", _ASCII_BOUNDARY)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    pattern: str
    title: str
    anchors: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    cwe: str | None = None
    owasp: str | None = None
    cis: str | None = None
    shape: str | None = None

    @property
    def jvm(self) -> str:
        return jvm_regex(self.pattern)


@dataclass(frozen=True)
class Family:
    """A rule catalogue and the line guards it is scanned under."""

    name: str
    rules: tuple[Rule, ...]
    finding_type: str = "rule"
    max_line: int | None = None
    skip_empty: bool = False
    comment: str | None = None
    # What to do with a language-bound rule when the language is unknown.
    unknown_language: str = "skip"
    evidence: int = 120
    mask_evidence: bool = False
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def rule(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.rule_id == rule_id)


def check(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    ids = [r.rule_id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate rule ids")
    for r in rules:
        if any(a != a.lower() or not a for a in r.anchors):
            raise ValueError(f"anchors of {r.rule_id} must be lower case and not empty")
    return rules


SLASH_HASH_STAR = r"^\s*(?://|#|\*|/\*)"
SLASH_HASH_STAR_ONLY = r"^\s*(?://|#|\*)"
HASH_SLASH = r"^\s*(?:#|//)"
