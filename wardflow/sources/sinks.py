"""Audit events, responses and splits as written tables."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.policy import present


def audit_events(df: DataFrame) -> DataFrame:
    """One event for each assessed row: findings summarised by module, and metadata as a map of texts."""
    modules = F.array(*[F.struct(F.lit(m).alias("module"), F.col(m)["risk_level"].alias("risk_level"), F.col(m)["risk_score"].alias("risk_score"), F.size(F.col(m)["findings"]).alias("findings_count")) for m in present(df)])
    score = lambda c: F.round(c, 3).cast("string")
    metadata = F.create_map(
        F.lit("risk_score"), score(F.col("risk_score")),
        F.lit("primary_intent"), F.col("primary_intent"),
        F.lit("intent_confidence"), score(F.col("intent_confidence")),
        F.lit("visible_length"), F.length("visible").cast("string"),
        F.lit("hidden_elements"), F.size("hidden").cast("string"),
        F.lit("restrictions_mode"), F.col("restrictions.mode"),
        F.lit("restricted_capabilities"), F.array_join("restricted_capabilities", ","),
        F.lit("requested_actions"), F.array_join("requested_actions", ","),
    )
    return df.select(
        F.sha2(F.concat_ws("\x1f", F.col("input_id").cast("string"), "visible"), 256).alias("event_id"),
        F.current_timestamp().alias("timestamp"),
        F.lit("security_assessment").alias("event_type"),
        F.col("overall_risk").alias("severity"),
        F.col("input_id").cast("string").alias("input_source"),
        F.col("overall_risk").alias("risk_level"),
        "decision",
        modules.alias("findings"),
        metadata.alias("metadata"),
    )


def log_to_console(level: int = logging.INFO) -> logging.Logger:
    """The library's logger, writing time, name, level and message; set up once."""
    log = logging.getLogger("wardflow")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


def append_events(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines; concurrent appends add files and never rewrite any."""
    events.write.mode("append").json(folder)
    logging.getLogger("wardflow").info("security events logged: %s", folder)


def response(df: DataFrame) -> DataFrame:
    """What a caller is told: scores to three places, findings as counts."""

    def module(m: str) -> Column:
        r = F.col(m)
        return F.struct(F.lit(m).alias("module"), r["risk_level"].alias("risk_level"), F.round(r["confidence"], 3).alias("confidence"), F.round(r["risk_score"], 3).alias("risk_score"), F.size(r["findings"]).alias("findings_count"), r["details"].alias("details"))

    return df.select(
        "input_id", "decision", "overall_risk", F.round("risk_score", 3).alias("risk_score"), "primary_intent", F.round("intent_confidence", 3).alias("intent_confidence"),
        "requested_actions", "restricted_capabilities", "sanitized_content", "reasoning", F.array(*[module(m) for m in present(df)]).alias("analysis"),
    )


def write_splits(df: DataFrame, folder: str, split_col: str = "split_name") -> None:
    """train_set, val_set and test_set as CSV folders with header."""
    for name in ("train", "val", "test"):
        df.filter(F.col(split_col) == name).drop(split_col).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}_set")


def report(df: DataFrame, rows: int = 20) -> str:
    """A short table for the console."""
    return df.select("input_id", "decision", "overall_risk", F.round("risk_score", 3).alias("risk_score"), "primary_intent")._show_string(rows, 80, False)
