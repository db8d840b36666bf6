"""Literals that every match of a pattern holds, so that most texts are settled by a substring search.

A regular expression reads a text at tens of MB a second, a substring search at many hundreds; and most texts
of a corpus hold none of the literals of a family of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals shorter than this settle too few texts.
_SHORTEST = 3
_P = re._parser
_C = re._constants


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest literal is longer; of equal ones the smaller set."""
    if a is None or b is None:
        return a or b
    rank = lambda s: (min(map(len, s)), -len(s))
    return max(a, b, key=rank)


def _of(items: Iterable[tuple]) -> frozenset[str] | None:
    best: frozenset[str] | None = None
    run = ""
    for op, value in items:
        if op is _C.LITERAL:
            run += chr(value)
            continue
        if op is _C.AT:
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        inner = None
        if op is _C.SUBPATTERN:
            inner = _of(value[3])
        elif op is _C.BRANCH:
            parts = [_of(x) for x in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT) and value[0] >= 1:
            alone = len(value[2]) == 1 and value[2][0][0] is _C.LITERAL
            inner = frozenset([chr(value[2][0][1]) * value[0]]) if alone else _of(value[2])
        best = _better(best, inner)
    return _better(best, frozenset([run])) if run else best


@lru_cache(maxsize=None)
def literals(pattern: str) -> frozenset[str] | None:
    """Lower-cased literals of which each match holds at least one; None if there is no useful set."""
    found = _of(_P.parse(pattern))
    if not found or min(map(len, found)) < _SHORTEST:
        return None
    found = {x.lower() for x in found}
    return frozenset(x for x in found if not any(y != x and y in x for y in found))


def quoted(text: str) -> str:
    """A literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def may_match_sql(low: str, patterns: Sequence[str]) -> str:
    """The condition of :func:`may_match` as text, "true" if there is none."""
    sets = [literals(p) for p in patterns]
    if not all(sets):
        return "true"
    union = set().union(*sets)
    return "(" + " OR ".join(f"contains({low}, {quoted(x)})" for x in sorted(union) if not any(y != x and y in x for y in union)) + ")"


def may_match(low: Column, patterns: Sequence[str]) -> Column | None:
    """A condition on a lower-cased text that holds wherever a pattern matches; None if there is none."""
    sets = [literals(p) for p in patterns]
    if not all(sets):
        return None
    name = low._jc.toString()
    if re.fullmatch(r"t_\w+", name):  # one call to the JVM instead of one for each literal
        return F.expr(may_match_sql(name, patterns))
    union = set().union(*sets)
    union = sorted(x for x in union if not any(y != x and y in x for y in union))
    out = F.contains(low, F.lit(union[0]))
    for x in union[1:]:
        out = out | F.contains(low, F.lit(x))
    return out
