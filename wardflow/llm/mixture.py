"""Mixing sources to target weights by Poisson replication (problem 6).

A record is taken as often as an inverted Poisson distribution says for a number between 0 and 1 made from
a seed and its id. A target's mean is first solved so that the truncated distribution has the wanted
repetition rate, then adjusted until the size really drawn is nearest to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.runtime import materialize
from wardflow.llm.overlap import TRAIN, source_name

#: More target rows than this are refused: the targets are a parameter, not data.
MAX_TARGETS = 10_000
_ROUNDS, _TRIED = 4, 9


def _cumulative(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k < cap. Terms are taken as logarithms, so that a mean of any size gives what it should."""
    if mean <= 0:
        return [1.0] * cap
    step, total, out = math.log(mean), 0.0, []
    for k in range(cap):
        total += math.exp(k * step - mean - math.lgamma(k + 1))
        out.append(min(1.0, total))
    return out


def _truncated(mean: float, cap: int) -> float:
    """The expected count when no record is taken more than ``cap`` times."""
    return sum(1 - c for c in _cumulative(mean, cap))


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose counts, cut at ``cap``, average ``rate``; for a rate below ``cap``, as no mean reaches it."""
    if not 0 <= rate < cap:
        raise ValueError("the rate must be below the cap")
    low, high = 0.0, 1.0
    while _truncated(high, cap) < rate:
        if high > 1e6 * cap:
            raise ValueError("the rate is too close to the cap")
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _truncated(middle, cap) < rate else (low, middle)
    return high


def _count(u: Column, cumulative: Column) -> Column:
    """Inversion: how many steps of the cumulative distribution lie at or below ``u``."""
    return F.size(F.filter(cumulative, lambda c: c <= u))


def _records(df: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    rows = df.filter(F.lower(F.trim("split_name")) == TRAIN)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11)).cast("double") / float(1 << 53)
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    return rows.select(F.col(id_col).alias("id"), source_name(F.col("source")).alias("source"), F.col("label").cast("int").alias("label"), size.alias("n_chars"), u.alias("u"))


def plan(records: DataFrame, targets: DataFrame) -> list[dict]:
    """The Poisson mean of each target, with the available and wanted sizes."""
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("label").cast("int").alias("label"), "target_share", "max_repeats")
    rows = [r.asDict() for r in t.limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError("too many targets")
    if len({(r["source"], r["label"]) for r in rows}) < len(rows):
        raise ValueError("a target occurs twice")
    spark = records.sparkSession
    keys = spark.createDataFrame([(r["source"], r["label"]) for r in rows], "source string, label int") if rows else t.select("source", "label")
    # One pass: grouped by target, all others being one group, so that only the targets' sums and one more come to the driver.
    named = records.join(F.broadcast(keys.withColumn("target", F.lit(True))), ["source", "label"], "left")
    target = F.when(F.col("target"), F.struct("source", "label")).alias("target")
    sums = {(x["target"]["source"], x["target"]["label"]) if x["target"] else None: x["n"] or 0 for x in named.groupBy(target).agg(F.sum("n_chars").alias("n")).collect()}
    whole, have = sum(sums.values()), sums
    for r in rows:
        r["available"] = have.get((r["source"], r["label"]), 0) or 0
        r["wanted"] = (r["target_share"] or 0.0) * whole
        r["max_repeats"] = max(0, r["max_repeats"] or 0)
        rate = r["wanted"] / r["available"] if r["available"] else 0.0
        # A rate that rounding can't tell from the cap takes each record as often as it may be.
        r["whole"], r["full"] = whole, rate >= r["max_repeats"] * (1 - 1e-9)
        r["mean"] = None if r["full"] else mean_for(rate, r["max_repeats"])
        r["spread"] = 0.5
    for _ in range(_ROUNDS):
        tried = {}
        for r in rows:
            if not r["full"] and r["mean"] > 0 and r["available"]:
                steps = [1 + r["spread"] * (2 * k / (_TRIED - 1) - 1) for k in range(_TRIED)]
                tried[r["source"], r["label"]] = [r["mean"] * s for s in steps]
        if not tried:
            break
        caps = {(r["source"], r["label"]): r["max_repeats"] for r in rows}
        table = [(*k, *[_cumulative(m, caps[k]) for m in means]) for k, means in tried.items()]
        names = [f"c{k}" for k in range(_TRIED)]
        grid = spark.createDataFrame(table, "source string, label int, " + ", ".join(f"{n} array<double>" for n in names))
        drawn = records.join(F.broadcast(grid), ["source", "label"]).groupBy("source", "label")
        drawn = drawn.agg(*[F.sum(F.col("n_chars") * _count(F.col("u"), F.col(n))).alias(n) for n in names]).collect()
        got = {(d["source"], d["label"]): [d[n] for n in names] for d in drawn}
        for r in rows:
            if sizes := got.get((r["source"], r["label"])):
                best = min(range(_TRIED), key=lambda k: abs(sizes[k] - r["wanted"]))
                r["mean"] = tried[r["source"], r["label"]][best]
                r["spread"] = r["spread"] * 2.2 / (_TRIED - 1)
    return rows


def draw(df: DataFrame, targets: DataFrame, id_col: str = "sample_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id_col, source, label, n_chars, n_times): how often each train record of a target is taken.

    Records whose source and label are no target (a null label is none), and of other splits, are not in the result. A null
    text has no characters. A target without records, or whose share exceeds what ``max_repeats`` of each
    record give, stays short of its share; the others are not enlarged for it. No targets give no rows.
    """
    records = materialize(_records(df, id_col, text_col, seed), "records")
    return _drawn(records, plan(records, targets)).withColumnRenamed("id", id_col)


def _drawn(records: DataFrame, rows: list[dict]) -> DataFrame:
    means = [(r["source"], r["label"], [-1.0] * r["max_repeats"] if r["full"] else _cumulative(r["mean"], r["max_repeats"])) for r in rows]
    grid = records.sparkSession.createDataFrame(means, "source string, label int, c array<double>")
    out = records.join(F.broadcast(grid), ["source", "label"])
    return out.select("id", "source", "label", "n_chars", _count(F.col("u"), F.col("c")).alias("n_times"))


def shares(df: DataFrame, targets: DataFrame, id_col: str = "sample_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row for each target with its wanted and actual size.

    actual_share is of the mix's set size (the characters of all train texts), share_of_drawn of what was
    really drawn; they differ if some target can't be filled.
    """
    records = materialize(_records(df, id_col, text_col, seed), "records")
    rows = plan(records, targets)
    taken = _drawn(records, rows).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("n_times").alias("n_taken"), F.max("n_times").alias("most_repeats"), F.max("n_chars").alias("longest"), F.sum(F.col("n_chars") * F.col("n_times")).alias("chars_taken")
    )
    names = "source string, label int, target_share double, max_repeats int, chars_available long, mix_chars long"
    wanted = records.sparkSession.createDataFrame([(r["source"], r["label"], r["target_share"], r["max_repeats"], r["available"], r["whole"]) for r in rows], names)
    out = wanted.join(taken, ["source", "label"], "left").fillna(0, ["n_records", "n_taken", "most_repeats", "longest", "chars_taken"])
    out = materialize(out, "shares")  # a row for each target
    every = out.agg(F.sum("chars_taken")).first()[0] or 0
    out = out.withColumn("all_taken", F.lit(every))
    share = F.coalesce(F.try_divide(F.col("chars_taken").cast("double"), F.col("mix_chars")), F.lit(0.0))
    drawn = F.coalesce(F.try_divide(F.col("chars_taken").cast("double"), F.col("all_taken")), F.lit(0.0))
    return out.select("source", "label", "target_share", "max_repeats", "n_records", "n_taken", "most_repeats", "longest", "chars_available", "mix_chars", "chars_taken", share.alias("actual_share"), drawn.alias("share_of_drawn"))


def mix(df: DataFrame, targets: DataFrame, id_col: str = "sample_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id_col, copy_no, place): the mix itself, each record once for each time it is taken, in a global random order.

    ``place`` is a hash of seed, id and copy; rows are range-partitioned and sorted by it.
    """
    taken = draw(df, targets, id_col, text_col, seed).filter("n_times > 0")
    rows = taken.select(id_col, F.explode(F.sequence(F.lit(1), F.col("n_times"))).alias("copy_no"))
    return rows.withColumn("place", F.xxhash64(F.lit(seed + 1), id_col, "copy_no")).orderBy("place", id_col, "copy_no")
