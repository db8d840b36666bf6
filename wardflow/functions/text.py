"""Expressions on text: bounding, matches with positions, locations, levels and joined variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.literals import may_match



@dataclass(frozen=True)
class Limits:
    """The most characters (elements) that are scanned, kept or shown; None for no limit. The defaults."""

    regex: int | None = 200_000
    html: int | None = 2_000_000
    visible: int | None = 500_000
    element: int | None = 20_000
    chunk: int | None = 100_000
    elements: int | None = 500
    prompt: int | None = 20_000
    input: int | None = 50_000


_LIMITS = Limits()


def limits() -> Limits:
    return _LIMITS


def configure(**over: int | None) -> Limits:
    """Set some limits, and all others to their defaults, for plans that are built from here on; gives those that held before."""
    global _LIMITS
    before, _LIMITS = _LIMITS, Limits(**over)
    return before


def restore(before: Limits) -> None:
    global _LIMITS
    _LIMITS = before


#: Levels in rising order, and the score that stands for each.
LEVELS = ("safe", "low", "medium", "high", "critical")
LEVEL_SCORES = {"safe": 0.0, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}


def bounded(text: Column, limit: str = "regex") -> Column:
    """The characters within a limit; null for null."""
    cap = getattr(_LIMITS, limit)
    return text if cap is None else F.substring(text, 1, cap)


def hits(text: Column, pattern: str, cap: int | None = None, flags: str = "(?i)") -> Column:
    """All matches of ``pattern``, or the first ``cap``; null for null."""
    found = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    return F.slice(found, 1, cap) if cap else found


def any_of(text: Column, patterns: Sequence[str], flags: str = "(?i)", low: Column | None = None) -> Column:
    """Whether any pattern matches: one alternation, only read where the literals of a pattern stand in ``low``."""
    found = F.rlike(text, F.lit(flags + "|".join(f"(?:{p})" for p in patterns)))
    may = may_match(F.lower(text) if low is None else low, patterns)
    return found if may is None else may & found


def count_of(low: Column, patterns: Sequence[str]) -> Column:
    """Matches in a lower-cased text of the patterns joined to one alternation, leftmost first."""
    n = F.regexp_count(low, F.lit("|".join(patterns)))
    may = may_match(low, patterns)
    return n if may is None else F.when(may, n).otherwise(0)


def positions(text: Column, pattern: str, flags: str = "(?i)") -> Column:
    """array<struct<start, end, matched>> of all non-empty matches, offsets from 0, in one split and one extraction."""
    parts = F.split(text, flags + pattern, -1)
    found = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    spans = F.arrays_zip(F.slice(F.transform(parts, F.length), 1, F.size(found)).alias("gap"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,matched:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        one = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("matched"))
        return F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], one).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def location(text: Column, start: Column, end: Column, channel: str | Column, around: int = 50) -> Column:
    """Where a match stands: 1-based line, offset, and the stripped ends of the text before and behind, null at the edges."""
    before = F.substring(text, F.greatest(start - around, F.lit(0)) + 1, F.least(start, F.lit(around)))
    behind = F.substring(text, end + 1, F.lit(around))
    line = F.regexp_count(F.substring(text, F.lit(1), start), F.lit("\n")) + 1
    return F.struct(
        (channel if isinstance(channel, Column) else F.lit(channel)).alias("channel"),
        line.cast("int").alias("line_number"),
        start.cast("int").alias("char_offset"),
        F.when(start > 0, F.right(F.trim(before), F.lit(20))).alias("context_before"),
        F.when(end < F.length(text), F.left(F.trim(behind), F.lit(20))).alias("context_after"),
    )


def html_location(tag: Column, element_id: Column, classes: Column, attribute: Column, style: Column, preview: Column) -> Column:
    """Where a hidden element stands; classes are always an array."""
    return F.struct(F.lit("hidden").alias("channel"), tag.alias("tag_name"), element_id.alias("tag_id"), classes.cast("array<string>").alias("tag_class"), attribute.alias("attribute_name"), style.alias("css_style"), F.left(preview, F.lit(50)).alias("context_before"))


def pdf_location(page: Column, offset: Column) -> Column:
    return F.struct(F.lit("pdf").alias("channel"), page.cast("int").alias("page_number"), offset.cast("int").alias("char_offset"))


def ocr_location(box: Column) -> Column:
    """The box of a recognised word, as numbers by name; null without one."""
    names = ("left", "top", "width", "height", "conf")
    keys = ("x", "y", "width", "height", "confidence")
    pairs = [x for k, n in zip(keys, names) for x in (F.lit(k), box[n].cast("double"))]
    return F.struct(F.lit("ocr").alias("channel"), F.when(box.isNotNull(), F.create_map(*pairs)).alias("bounding_box"))


def encoded_location(encoding: Column, depth: Column, run: Column) -> Column:
    """Where decoded content comes from: the encoding, its depth, and the beginning of the run."""
    return F.struct(F.lit("decoded").alias("channel"), encoding.alias("encoding"), depth.cast("int").alias("depth"), F.left(run, F.lit(50)).alias("context_before"))


def find_locations(text: Column, pattern: str, channel: str, flags: str = "(?i)") -> Column:
    """array<struct<location fields, matched>> of all matches."""
    return F.transform(
        positions(text, pattern, flags),
        lambda p: F.struct(location(text, p["start"], p["end"], channel).alias("location"), p["matched"].alias("matched")),
    )


def snippet(text: Column, most: int = 100) -> Column:
    """The text, or its beginning with dots if it is longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def level(score: Column, critical: float, high: float, medium: float, low: float) -> Column:
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("safe")


def level_rank(name: Column) -> Column:
    """0 for safe to 4 for critical; -1 for anything else."""
    out = F.when(name == LEVELS[0], 0)
    for i, x in enumerate(LEVELS[1:], 1):
        out = out.when(name == x, i)
    return out.otherwise(-1)


def level_score(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for x, s in LEVEL_SCORES.items():
        out = F.when(name == x, s).otherwise(out)
    return out


def cap(score: Column, most: float = 1.0) -> Column:
    return F.least(score, F.lit(most))


def two(score: Column) -> Column:
    return F.format_string("%.2f", score)


def _beyond(size: Column, limit: str) -> Column:
    cap = getattr(_LIMITS, limit)
    return F.lit(False) if cap is None else size > cap


def with_texts(df: DataFrame, visible: str = "visible", hidden: str = "hidden") -> DataFrame:
    """Adds the joined variants that detectors scan, each made once: blanks, line ends and no separator between visible and hidden text.

    ``truncated`` says whether a limit keeps part of a row from being scanned.
    Null visible text counts as empty, null hidden elements as none, null elements as empty.
    """
    elements = F.transform(F.coalesce(F.col(hidden), F.array().cast("array<string>")), lambda h: F.coalesce(h, F.lit("")))
    df = df.withColumns({visible: F.coalesce(F.col(visible), F.lit("")), hidden: elements})
    joined = F.array_join(hidden, " ")
    spaced = F.concat_ws(" ", F.col(visible), joined)
    glued = F.concat(F.col(visible), joined)
    lines = F.concat_ws("\n", F.col(visible), F.array_join(hidden, "\n"))
    long = F.exists(hidden, lambda h: _beyond(F.length(h), "chunk")) | _beyond(F.length(visible), "chunk") | _beyond(F.size(hidden), "elements")
    df = df.withColumn("truncated", long | _beyond(F.length(visible) + F.length(joined) + 1, "regex"))
    return df.withColumns({"t_spaced": bounded(spaced), "t_glued": bounded(glued), "t_lines": bounded(lines)}).withColumns(
        {"t_spaced_lower": F.lower("t_spaced"), "t_glued_lower": F.lower("t_glued"), "t_lines_lower": F.lower("t_lines")}
    )


def guarded(condition: Column, found: Callable[[], Column], schema: str) -> Column:
    """``found`` where the condition holds, else an empty array."""
    return F.when(condition, found()).otherwise(F.array().cast(schema))
