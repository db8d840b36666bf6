"""Pieces of DuckDB SQL for the oracles of the pattern detectors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from wardflow.plans.planted import quoted


def pattern(p: str, flags: str = "(?i)") -> str:
    return quoted(flags + re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", p))


def hits(col: str, p: str, most: int | None = None, flags: str = "(?i)") -> str:
    out = f"regexp_extract_all({col}, {pattern(p, flags)})"
    return f"({out})[1:{most}]" if most else out


def n(col: str, p: str, most: int | None = None, flags: str = "(?i)") -> str:
    return f"len({hits(col, p, most, flags)})"


def count(col: str, ps: Sequence[str], most: int | None = None, flags: str = "(?i)") -> str:
    return "(" + " + ".join(n(col, p, most, flags) for p in ps) + ")"


def found(col: str, ps: Sequence[str], flags: str = "(?i)") -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {pattern(p, flags)})" for p in ps) + ")"


def top(col: str, ps: Sequence[tuple[str, float]], flags: str = "(?i)") -> str:
    """The highest score of the patterns found, 0.0 if none."""
    return "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN regexp_matches({col}, {pattern(p, flags)}) THEN {s}::DOUBLE ELSE 0.0 END" for p, s in ps) + ")"


def joined(col: str, ps: Sequence[str]) -> str:
    return f"len(regexp_extract_all({col}, {quoted('|'.join(ps))}))"


def each_hidden(expression: str, hidden: str = "hidden") -> str:
    """The sum of an expression of ``x`` over the hidden elements."""
    return f"coalesce(list_sum(list_transform({hidden}, lambda x: {expression})), 0)"


def most_hidden(expression: str, hidden: str = "hidden") -> str:
    return f"coalesce(list_max(list_transform({hidden}, lambda x: {expression})), 0.0)"


def ladder(x: str, critical: float, high: float, medium: float, low: float) -> str:
    return f"CASE WHEN {x} >= {critical} THEN 'critical' WHEN {x} >= {high} THEN 'high' WHEN {x} >= {medium} THEN 'medium' WHEN {x} >= {low} THEN 'low' ELSE 'safe' END"


def d(x: float) -> str:
    return f"{x}::DOUBLE"
