"""Restrictions of agent sessions, and whether actions are allowed under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines that an agent's system prompt gets, by mode and by capability that is off.
DISABLED = """ALL AUTONOMOUS ACTIONS ARE DISABLED.
You are in READ-ONLY mode. You can only:
- Read and analyze information
- Answer questions
- Provide explanations

You CANNOT:
- Execute code
- Make web requests
- Write files
- Use tools or call APIs
- Send emails or messages
- Perform any side-effecting actions"""
APPROVAL = ("HUMAN APPROVAL REQUIRED FOR ACTIONS.\nReason: ", "\n\nYou must inform the user that any action requires their explicit approval.")
READ_ONLY = "READ-ONLY MODE ACTIVE.\nYou cannot perform write operations or side-effecting actions."
OFF_LINES = (
    ("allow_web_access", "- Web access is DISABLED. Do not attempt to make HTTP requests or access external URLs."),
    ("allow_file_write", "- File write operations are DISABLED. Do not attempt to save, create, or modify files."),
    ("allow_code_execution", "- Code execution is DISABLED. Do not generate or execute code snippets."),
    ("allow_tool_use", "- Tool usage is DISABLED. Only respond with direct text answers."),
)
FIELDS = ("restriction_mode", "allow_web_access", "allow_file_write", "allow_code_execution", "allow_tool_use", "max_output_length", "allowed_domains", "blocked_patterns", "requires_approval", "approval_reason")


def latest_restrictions(history: DataFrame) -> DataFrame:
    """One row for each session: its latest restrictions; of equal times the larger restriction_id.

    A map-side combined maximum, so that a session with a long history is one row a task. Rows without
    session are dropped, as no action can name them; a null time is older than any other.
    """
    order = F.struct("applied_at", "restriction_id")
    by = history.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.max_by(F.struct("restriction_id", "applied_at", *FIELDS), order).alias("r"))
    status = F.when(F.col("r.restriction_mode") != "NORMAL", "ENFORCED").otherwise("STANDARD")
    return by.select("session_id", "r.*", status.alias("enforcement_status"))


def clear_restrictions(latest: DataFrame, sessions: DataFrame) -> DataFrame:
    """``latest`` without the given sessions."""
    return latest.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def _domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def check_actions(actions: DataFrame, latest: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """``actions`` (action_id, session_id, action_type, params<url, length>) with allowed and reason.

    The first rule that forbids decides: the mode, then the capability, domain, blocked pattern or length of
    the action's kind. ``kinds`` maps spellings of action types to the known ones; letter case is ignored.
    Actions without session, or of sessions without restrictions, are allowed. A left join on session_id: the side
    of the restrictions has one row a session, so a hot session is split by the skew join, not collected.
    """
    known = {"web_access": "web_request", "output": "generate_output"} | (kinds or {})
    kind = F.lower(F.trim("action_type"))
    for a, b in known.items():
        kind = F.when(kind == a, b).otherwise(kind)
    extra = [c for c in latest.columns if c != "session_id"]
    renamed = latest.select("session_id", F.struct(*extra).alias("limits"))
    df = actions.withColumn("kind", kind).join(renamed, "session_id", "left")
    r, k = F.col("limits"), F.col("kind")
    url, length = F.coalesce("params.url", F.lit("")), F.coalesce("params.length", F.lit(0))
    mode = r["restriction_mode"]
    acting = k.isin("file_write", "code_execution", "tool_use", "web_request")
    domain = _domain(url)
    hit = F.filter(r["blocked_patterns"], lambda p: F.coalesce(F.rlike(url, F.concat(F.lit("(?i)"), p)), F.lit(False)))
    reason = (
        F.when(r.isNull(), F.lit(None))
        .when((mode == "ACTION_DISABLED") & ~k.isin("read", "query", "generate_output"), F.concat(F.lit("ACTION_DISABLED mode: "), k, F.lit(" is not allowed")))
        .when((mode == "READ_ONLY") & acting, F.concat(F.lit("READ_ONLY mode: "), k, F.lit(" is not allowed")))
        .when((mode == "APPROVAL_REQUIRED") & (acting | (k == "send_email")), F.concat(F.lit("APPROVAL_REQUIRED mode: "), k, F.lit(" requires human approval - "), F.coalesce(r["approval_reason"], F.lit("None"))))
        .when((k == "web_request") & ~r["allow_web_access"], "Web access is restricted for this session")
        .when((k == "web_request") & (F.size(r["allowed_domains"]) > 0) & ~F.array_contains(r["allowed_domains"], domain), F.concat(F.lit("Domain "), domain, F.lit(" is not in allowed list")))
        .when((k == "web_request") & (F.size(hit) > 0), F.concat(F.lit("URL matches blocked pattern: "), F.get(hit, 0)))
        .when((k == "file_write") & ~r["allow_file_write"], "File write operations are restricted")
        .when((k == "code_execution") & ~r["allow_code_execution"], "Code execution is restricted")
        .when((k == "tool_use") & ~r["allow_tool_use"], "Tool usage is restricted")
        .when((k == "generate_output") & (r["max_output_length"] > 0) & (length > r["max_output_length"]), F.format_string("Output length exceeds limit of %d", r["max_output_length"]))
    )
    df = df.withColumn("denied", reason)
    open_ = F.when(r.isNull(), "No restrictions active").otherwise("Action allowed")
    return df.select(*actions.columns, F.col("denied").isNull().alias("allowed"), F.coalesce("denied", open_).alias("reason"))


def prompt_addition(df: DataFrame) -> DataFrame:
    """Adds ``prompt_addition`` to rows of latest restrictions: the lines an agent's system prompt gets."""
    rule = F.lit("=" * 60)
    mode = F.col("restriction_mode")
    off = F.concat_ws("\n", *[F.when(~F.col(c), text) for c, text in OFF_LINES])
    body = (
        F.when(mode == "ACTION_DISABLED", DISABLED)
        .when(mode == "APPROVAL_REQUIRED", F.concat(F.lit(APPROVAL[0]), F.coalesce("approval_reason", F.lit("None")), F.lit(APPROVAL[1])))
        .when(mode == "READ_ONLY", READ_ONLY)
        .otherwise(F.when(off != "", off))
    )
    lines = F.concat_ws(
        "\n",
        rule, F.lit("SECURITY RESTRICTIONS ACTIVE"), rule,
        F.when(mode != "NORMAL", F.concat(F.lit("MODE: "), mode, F.lit("\n"))),
        body,
        F.when(F.col("max_output_length") > 0, F.format_string("- Output length is LIMITED to %d characters.", F.col("max_output_length"))),
        F.when(F.size("blocked_patterns") > 0, F.concat(F.lit("- Blocked patterns: "), F.array_join(F.slice("blocked_patterns", 1, 3), ", "))),
        F.lit(""), F.lit("Any attempt to bypass these restrictions will be logged and blocked."), rule,
    )
    return df.withColumn("prompt_addition", lines)


def serialise(df: DataFrame) -> DataFrame:
    """Adds ``policy``: the restrictions as one JSON text."""
    return df.withColumn("policy", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}))
