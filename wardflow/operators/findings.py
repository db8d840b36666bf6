"""The one row shape of findings, and families of patterns that make them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.literals import may_match_sql, quoted

FINDING = "struct<type:string,detector:string,severity:string,risk_score:double,pattern:string,matched_text:string,label:string,channel:string>"
FINDINGS = f"array<{FINDING}>"
RESULT = f"struct<module_name:string,risk_level:string,risk_score:double,confidence:double,findings:{FINDINGS},details:string>"


def finding(kind, detector, severity, score, pattern=None, matched=None, label=None, channel=None) -> Column:
    def lit(x, t: str) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)

    return F.struct(
        lit(kind, "string").alias("type"),
        lit(detector, "string").alias("detector"),
        lit(severity, "string").alias("severity"),
        lit(score, "double").alias("risk_score"),
        lit(pattern, "string").alias("pattern"),
        lit(matched, "string").alias("matched_text"),
        lit(label, "string").alias("label"),
        lit(channel, "string").alias("channel"),
    )


def none() -> Column:
    return F.array().cast(FINDINGS)


@dataclass(frozen=True)
class Family:
    """Patterns that make findings of one type."""

    kind: str
    detector: str
    #: (pattern, score, label); a score of None is given by ``scored``.
    patterns: Sequence[tuple]
    severity: Callable[[float], str] | str = "high"
    #: Matches that count for each pattern; none for all.
    most: int | None = None
    flags: str = "(?i)"
    #: SQL of the score, and of the severity, of a match ``m``.
    scored: str | None = None
    graded: str | None = None
    shown: int = 1_000_000

    def find(self, text: str, channel: str | None = None, low: str | None = None) -> Column:
        """Findings in the column ``text``, in the order of the patterns, then of the text; empty for null text.

        ``low``: the column of the text in lower case, if ``text`` isn't. A pattern is only tried where one of its literals stands.
        """
        return F.expr(self.sql(text, text if low is None else low, channel))

    def sql(self, text: str, low: str, channel: str | None = None) -> str:
        """The same as text of Spark SQL: plans of hundreds of patterns are built some ten times as fast as by calls."""
        lit = lambda x: "CAST(NULL AS STRING)" if x is None else quoted(x)
        none = f"CAST(array() AS {FINDINGS})"
        parts = []
        for pattern, score, label in self.patterns:
            # In a text that is in lower case already, ignoring case would only cost time.
            plain = text == low and self.flags == "(?i)" and not re.search(r"(?<!\\)[A-Z]", pattern)
            found = f"regexp_extract_all({text}, {quoted(pattern if plain else self.flags + pattern)}, 0)"
            if self.most:
                found = f"slice({found}, 1, {self.most})"
            severity = self.graded or lit(self.severity if isinstance(self.severity, str) else self.severity(score))
            risk = self.scored or ("CAST(NULL AS DOUBLE)" if score is None else f"{score}D")
            row = f"named_struct('type', {lit(self.kind)}, 'detector', {lit(self.detector)}, 'severity', {severity}, 'risk_score', {risk}, 'pattern', {lit(pattern)}, 'matched_text', left(m, {self.shown}), 'label', {lit(label)}, 'channel', {lit(channel)})"
            parts.append(f"CASE WHEN {may_match_sql(low, [pattern])} THEN transform({found}, m -> {row}) ELSE {none} END")
        return f"CASE WHEN {text} IS NOT NULL AND {may_match_sql(low, [p for p, _, _ in self.patterns])} THEN flatten(array({', '.join(parts)})) ELSE {none} END"

    def find_each(self, elements: str, low: str, channel: str | None = None) -> Column:
        """Findings of all elements of an array column, one element behind the other; ``low`` is SQL of an element ``x``."""
        return F.expr(f"flatten(transform({elements}, x -> {self.sql('x', low, channel)}))")

    def count(self, text: str) -> Column:
        return F.size(self.find(text))


def plain(patterns: Sequence[str], score: float | None = None) -> tuple[tuple, ...]:
    return tuple((p, score, None) for p in patterns)


def literal(words: Sequence[str], score: float | None = None) -> tuple[tuple, ...]:
    """Words as patterns; they hold nothing but letters and blanks."""
    return tuple((w, score, w) for w in words)


def top(found: Column) -> Column:
    """The highest risk score of findings, 0 if there are none."""
    return F.coalesce(F.array_max(F.transform(found, lambda f: f["risk_score"])), F.lit(0.0))


def has(found: Column, *kinds: str) -> Column:
    return F.exists(found, lambda f: f["type"].isin(*kinds))


def number(found: Column, **where: str) -> Column:
    """How many findings have the given field values."""

    def ok(f: Column) -> Column:
        out = F.lit(True)
        for k, v in where.items():
            out = out & (f[k] == v)
        return out

    return F.size(F.filter(found, ok))


def result(module: str, level: Column | str, score: Column | float, confidence: Column | float, found: Column, details: Column | str) -> Column:
    def lit(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(module).alias("module_name"), lit(level).alias("risk_level"), lit(score).cast("double").alias("risk_score"), lit(confidence).cast("double").alias("confidence"), found.alias("findings"), lit(details).alias("details")
    )
