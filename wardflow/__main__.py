"""python -m wardflow [--policy NAME] [--config FILE] [PATH | TEXT ...]: assess files, texts, standard input or input.txt.

Without any of them, on a terminal, inputs are asked for until quit, exit or q. A file that can't be read is reported with its
error, never assessed as an empty text, and the exit code is 2.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.config import Config
from wardflow.operators import html
from wardflow.plans import pipeline
from wardflow.sources import files, sinks

log = logging.getLogger("wardflow")
LEAVE = ("quit", "exit", "q")


def load(spark: SparkSession, given: list[str]) -> DataFrame:
    """(input_id, raw, error) of texts and of the files among them."""
    rows = spark.createDataFrame([(x, x, None) for x in given if not os.path.exists(x)], "input_id string, raw string, error string")
    empty = [x for x in given if os.path.isfile(x) and not os.path.getsize(x)]  # no reader gives a row for them
    rows = rows.unionByName(spark.createDataFrame([(x, None, "the file is empty") for x in empty], rows.schema))
    for path in (x for x in given if os.path.exists(x) and x not in empty):
        loaded = files.load_files(spark, os.path.abspath(path))
        blank = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "the file is empty")
        rows = rows.unionByName(loaded.select(F.col("path").alias("input_id"), F.col("text").alias("raw"), F.coalesce("error", blank).alias("error")))
    return rows


def assess(spark: SparkSession, given: list[str], policy: str, config: Config, prompt: str | None, events: str | None = None) -> tuple[str, list[str]]:
    """The report of what could be read, and the errors of what couldn't."""
    rows = load(spark, given)
    errors = [f"{r['input_id']}: {r['error']}" for r in rows.filter("error IS NOT NULL").select("input_id", "error").limit(1000).collect()]
    for e in errors:
        log.error("not assessed: %s", e)
    read = html.extract(rows.filter("error IS NULL")).withColumn("system_prompt", F.lit(prompt).cast("string"))
    assessed = pipeline.assess(read.select("input_id", "visible", "hidden", "system_prompt"), policy, config)
    if events:
        sinks.append_events(sinks.audit_events(assessed), events)
        log.info("security events appended to %s", events)
    return sinks.report(assessed), errors


def main() -> int:
    parser = argparse.ArgumentParser(prog="wardflow", description=__doc__)
    parser.add_argument("inputs", nargs="*")
    parser.add_argument("--policy", default="effective", choices=("effective", "multi_signal"))
    parser.add_argument("--config")
    parser.add_argument("--prompt", help="the system prompt of the agent that will read the inputs; else agent_system_prompt.txt or WARDFLOW_AGENT_SYSTEM_PROMPT")
    parser.add_argument("--events", help="a folder to which security events are appended")
    args = parser.parse_args()
    sinks.log_to_console()
    given = args.inputs
    if not given and not sys.stdin.isatty() and (said := sys.stdin.read()).strip():
        given = [said]
    if not given and os.path.exists("input.txt"):
        given = ["input.txt"]
    if not given and not sys.stdin.isatty():
        parser.error("nothing to assess")
    spark = SparkSession.builder.appName("wardflow").getOrCreate()
    config, prompt = Config.load(args.config), files.find_prompt(args.prompt)
    failed = False
    try:
        if given:
            report, errors = assess(spark, given, args.policy, config, prompt, args.events)
            print(report)
            failed = bool(errors)
        while not given:
            try:
                said = input("> ").strip()
            except (EOFError, KeyboardInterrupt):
                break
            if said.lower() in LEAVE:
                break
            if said:
                report, errors = assess(spark, [said], args.policy, config, prompt, args.events)
                print("\n".join(errors) or report)
    finally:
        spark.stop()
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
