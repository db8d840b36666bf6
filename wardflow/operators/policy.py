"""From module results to a risk score, a decision, restrictions, sanitised text and reasoning.

Two policies: ``effective`` (weights, intent floors, overrides) and ``multi_signal`` (aligned signals).
All of it is a projection of a row's result columns: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.functions.config import Config
from wardflow.operators import findings as R

#: The order in which results are summed and findings are read.
MODULES = (
    "intent_classifier",
    "hidden_content_analyzer",
    "prompt_injection_detector",
    "exfiltration_detector",
    "agentic_intent_detector",
    "houyi_pattern_detector",
    "semantic_threat_detector",
    "content_deobfuscator",
    "ocr_content_analyzer",
)
RESTRICTIONS = "struct<mode:string,allow_web_access:boolean,allow_file_write:boolean,allow_code_execution:boolean,allow_tool_use:boolean,max_output_length:int,allowed_domains:array<string>,blocked_patterns:array<string>,requires_approval:boolean,approval_reason:string>"
#: What a session may not send where data could leave, and words that are sanitised.
BLOCKED = (r"https?://", r"send\s+to", r"post\s+to", "upload", r"append\s+to", "transmit")
SANITISED_WORDS = ("ignore previous", "disregard", "forget instructions", "new instructions", "override", "bypass")
#: The floors of intents in the multi-signal policy, before they are capped.
CALIBRATED = {"malicious": 0.90, "conditional_instructional": 0.50, "instructional": 0.30, "ambiguous": 0.15, "descriptive": 0.0}


def present(df: DataFrame) -> list[str]:
    return [m for m in MODULES if m in df.columns]


def effective_score(r: Column) -> Column:
    """A result's score, or that of its level if it has none."""
    return F.when(r["risk_score"] > 0, r["risk_score"]).otherwise(T.level_score(r["risk_level"]))


def weighted_risk(results: Sequence[tuple[str, Column]], config: Config) -> Column:
    """The mean of score * confidence by the modules' weights, over the modules that have a result."""
    sums = lambda f: reduce(lambda a, b: a + b, [F.when(r.isNotNull(), f(m, r)).otherwise(0.0) for m, r in results])
    total = sums(lambda m, r: F.lit(config.weight(m)))
    return F.coalesce(F.try_divide(sums(lambda m, r: effective_score(r) * r["confidence"] * F.lit(config.weight(m))), total), F.lit(0.0))


def intent_floor(intent: Column, floors: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for name, floor in floors.items():
        out = F.when(intent == name, floor).otherwise(out)
    return out


def overall_level(score: Column) -> Column:
    return T.level(score, 0.8, 0.6, 0.4, 0.15)


def _serious(r: Column, *levels: str) -> Column:
    return F.coalesce(r["risk_level"].isin(*levels), F.lit(False))


def _suspicious_decoded(r: Column) -> Column:
    return F.exists(r["findings"], lambda f: (f["type"] == "decoded_content") & (f["label"] != ""))


class Rows:
    """Access to a table's result columns, where missing modules are null."""

    def __init__(self, df: DataFrame) -> None:
        self.have = set(present(df))

    def __getitem__(self, module: str) -> Column:
        return F.col(module) if module in self.have else F.lit(None).cast(R.RESULT)

    def score(self, module: str) -> Column:
        return F.coalesce(self[module]["risk_score"], F.lit(0.0))

    def has(self, module: str, *kinds: str) -> Column:
        return F.coalesce(R.has(self[module]["findings"], *kinds), F.lit(False))

    def serious(self, module: str, *levels: str) -> Column:
        return _serious(self[module], *(levels or ("medium", "high", "critical")))

    def suspicious(self) -> Column:
        return F.coalesce(_suspicious_decoded(self["content_deobfuscator"]), F.lit(False))


# ---- effective policy ---------------------------------------------------------------------------


def score_effective(df: DataFrame, config: Config = Config(), ml_score: str | None = None) -> DataFrame:
    """Adds ``risk_score``, ``overall_risk``, ``decision_source`` and ``override_reason``.

    ``ml_score``: a column with a model's probability, which replaces the rule score where it isn't null.
    ``context`` and ``primary_intent`` are used if they are there.
    """
    rows = Rows(df)
    intent = F.col("primary_intent") if "primary_intent" in df.columns else F.lit("ambiguous")
    rule = T.cap(F.greatest(weighted_risk([(m, rows[m]) for m in present(df)], config), intent_floor(intent, config.values["intent_risk_floors"])))
    df = df.withColumn("rule_score", rule)
    base = F.coalesce(F.col(ml_score), F.col("rule_score")) if ml_score else F.col("rule_score")
    source = F.when(F.col(ml_score).isNotNull(), "ml_model").otherwise("rule_based") if ml_score else F.lit("rule_based")
    script = rows.has("hidden_content_analyzer", "dangerous_script")
    decoded = rows.serious("content_deobfuscator", "high", "critical") & rows.suspicious()
    bypass = rows.has("agentic_intent_detector", "permission_bypass", "link_action")
    score = F.greatest(base, F.when(script, 0.90).otherwise(0.0), F.when(decoded, 0.75).otherwise(0.0), F.when(bypass, 0.85).otherwise(0.0))
    reason = F.when(bypass, "permission_bypass_attempt").when(decoded, "obfuscated_suspicious_content").when(script, "dangerous_script_detected")
    df = df.withColumns({"base_score": score, "override_reason": reason, "decision_source": source})
    return _adjusted(df, intent)


def _adjusted(df: DataFrame, intent: Column) -> DataFrame:
    adjust = F.col("context.risk_adjustment") if "context" in df.columns else F.lit(0.0)
    floor = F.when(intent == "malicious", 0.90).otherwise(0.0)
    score = F.greatest(floor, T.cap(F.col("base_score") + adjust))
    df = df.withColumn("risk_score", T.cap(score)).drop("base_score")
    return df.withColumn("overall_risk", overall_level(F.col("risk_score")))


def signals_effective(rows: Rows) -> Column:
    """How many of hidden content, injection and encoded content score above 0.4."""
    return reduce(lambda a, b: a + b, [(rows.score(m) > 0.4).cast("int") for m in ("hidden_content_analyzer", "prompt_injection_detector", "content_deobfuscator")])


def decision_effective(intent: Column, score: Column, signals: Column, config: Config = Config()) -> Column:
    return (
        F.when((intent == "malicious") | (score >= config.threshold("block")), "block")
        .when((score >= config.threshold("require_approval")) & (signals >= 2), "require_approval")
        .when(score >= config.threshold("sanitize"), "sanitize")
        .when((intent == "descriptive") & (score < config.threshold("allow")), "allow")
        .otherwise("sanitize")
    )


def restriction(mode: str, web, file, code, tool, most, approval=False, reason=None, blocked=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(mode).alias("mode"), lit(web).alias("allow_web_access"), lit(file).alias("allow_file_write"), lit(code).alias("allow_code_execution"), lit(tool).alias("allow_tool_use"),
        lit(most).cast("int").alias("max_output_length"), none.alias("allowed_domains"), (none if blocked is None else blocked).alias("blocked_patterns"), lit(approval).alias("requires_approval"), lit(reason).cast("string").alias("approval_reason"),
    ).cast(RESTRICTIONS)


def restrictions_effective(level: Column) -> Column:
    return (
        F.when(level == "critical", restriction("ACTION_DISABLED", False, False, False, False, 500))
        .when(level == "high", restriction("APPROVAL_REQUIRED", False, False, False, False, None, True, "High-risk content detected"))
        .when(level == "medium", restriction("READ_ONLY", False, False, False, True, None))
        .otherwise(restriction("NORMAL", True, True, True, True, None))
    )


# ---- multi-signal policy ------------------------------------------------------------------------

_SEPARATORS = ("framework_component", "separator", "closure_separator")
_DISRUPTORS = ("task_redefinition", "prompt_leak", "output_shaping")


def score_multi_signal(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds ``risk_score`` and ``overall_risk``. Intents count as weak, so that their floor is at most 0.10."""
    rows = Rows(df)
    intent = F.col("primary_intent")
    floor = T.cap(intent_floor(intent, CALIBRATED, 0.15), 0.10)
    score = F.greatest(weighted_risk([(m, rows[m]) for m in present(df)], config), floor)
    decoded = rows.serious("content_deobfuscator") & rows.suspicious()
    score = F.greatest(score, F.when(decoded, config.baseline("decoded_content")).otherwise(0.0))
    h = "houyi_pattern_detector"
    both = rows.has(h, *_SEPARATORS, "language_switch") & rows.has(h, *_DISRUPTORS)
    boosted = F.greatest(score, rows.score(h))
    boosted = F.when(rows.has(h, "prompt_leak"), T.cap(boosted + 0.2)).otherwise(boosted)
    boosted = F.when(rows.has(h, "data_to_question_retasking"), T.cap(boosted + 0.15)).otherwise(boosted)
    calm = ~rows.serious(h, "low", "medium", "high", "critical")
    df = df.withColumn("base_score", F.when(calm, score).when(both, boosted).otherwise(F.greatest(score, rows.score(h) * 0.6)))
    agentic = rows.serious("agentic_intent_detector") & F.coalesce(F.exists(rows["agentic_intent_detector"]["findings"], lambda f: f["severity"].isin("high", "critical")), F.lit(False))
    threat = rows.serious("content_deobfuscator", "high", "critical") & rows.suspicious()
    least = F.greatest(F.when(agentic, 0.5).otherwise(0.0), F.when(threat, 0.6).otherwise(0.0), F.when(~intent.isin("descriptive", "ambiguous"), 0.2).otherwise(0.0))
    return _adjusted(df.withColumn("base_score", F.greatest("base_score", least)), intent)


def signals_multi(rows: Rows) -> Column:
    """How many of five signals are at least of medium level, each with a condition of its own."""
    on = [
        rows.serious("hidden_content_analyzer") & rows.has("hidden_content_analyzer", "instruction_keyword", "dangerous_script", "obfuscation"),
        rows.serious("prompt_injection_detector") & (rows.score("prompt_injection_detector") > 0.4),
        rows.serious("content_deobfuscator") & rows.suspicious(),
        rows.serious("agentic_intent_detector") & (rows.score("agentic_intent_detector") > 0.4),
        rows.serious("houyi_pattern_detector") & (rows.score("houyi_pattern_detector") > 0.5),
    ]
    return reduce(lambda a, b: a + b, [c.cast("int") for c in on])


def decision_multi_signal(rows: Rows, intent: Column, score: Column, config: Config = Config()) -> Column:
    h, a = "houyi_pattern_detector", "agentic_intent_detector"
    leak = rows.has(h, "prompt_leak")
    full = rows.has(h, *_SEPARATORS) & rows.has(h, *_DISRUPTORS)
    severe = rows.serious(h, "high", "critical")
    aligned = signals_multi(rows) >= 2

    def rising(block: float, approve: float) -> Column:
        return F.when(score >= block, "block").when((score >= approve) & aligned, "require_approval").otherwise("sanitize")

    bypass = rows.has(a, "permission_bypass", "link_action")
    return (
        F.when(intent == "malicious", "block")
        .when(severe & (leak | (full & (rows.score(h) >= 0.75))), "block")
        .when(severe & full, "require_approval")
        .when(intent == "conditional_instructional", rising(0.8, 0.6))
        .when(intent == "instructional", rising(0.8, 0.55))
        .when(intent == "ambiguous", rising(0.75, 0.55))
        .when(rows.serious(a), F.when(bypass | (score >= 0.75), "block").when(score >= 0.5, "require_approval").otherwise("sanitize"))
        .when(score >= config.threshold("block"), "block")
        .when((score >= config.threshold("require_approval")) & aligned, "require_approval")
        .when(score >= config.threshold("sanitize"), "sanitize")
        .when((intent == "descriptive") & (score < config.threshold("allow")), "allow")
        .otherwise("sanitize")
    )


def restrictions_multi_signal(rows: Rows, intent: Column, level: Column) -> Column:
    off = (False, False, False, False)
    exfil = rows.serious("exfiltration_detector", "high", "critical")
    inject = rows.serious("prompt_injection_detector", "high", "critical")
    bypass, link = rows.has("agentic_intent_detector", "permission_bypass"), rows.has("agentic_intent_detector", "link_action")
    blocked = F.when(exfil | link, F.array(*[F.lit(x) for x in BLOCKED])).otherwise(F.array().cast("array<string>"))
    return (
        F.when(intent.isin("malicious", "conditional_instructional"), restriction("ACTION_DISABLED", *off, 500, True, F.concat(F.lit("Content classified as "), intent)))
        .when(intent == "instructional", restriction("APPROVAL_REQUIRED", *off, 1000, True, "Instructional content requires approval"))
        .when(intent == "ambiguous", restriction("READ_ONLY", *off, 1500))
        .when(bypass | link, restriction("ACTION_DISABLED", *off, 500, True, "Permission bypass or link action detected", blocked))
        .when(level == "critical", restriction("ACTION_DISABLED", *off, 500, blocked=blocked))
        .when(rows.serious("agentic_intent_detector"), restriction("APPROVAL_REQUIRED", *off, 1000, True, "Agentic action request requires human approval", blocked))
        .when(level == "high", restriction("RESTRICTED", ~exfil, False, False, ~inject, 1000, blocked=blocked))
        .when(level == "medium", restriction("READ_ONLY", ~exfil, False, False, True, 2000, blocked=blocked))
        .otherwise(restriction("NORMAL", True, True, True, True, None, blocked=blocked))
    )


# ---- shared -------------------------------------------------------------------------------------


def restricted_capabilities(r: Column, extended: bool = False) -> Column:
    parts = [
        F.when(r["mode"] != "NORMAL", F.concat(F.lit("mode:"), r["mode"])),
        F.when(~r["allow_web_access"], "web_access"),
        F.when(~r["allow_file_write"], "file_write"),
        F.when(~r["allow_code_execution"], "code_execution"),
        F.when(~r["allow_tool_use"], "tool_use"),
    ]
    if extended:
        parts += [F.when(r["max_output_length"].isNotNull(), F.format_string("output_limited:%d", r["max_output_length"])), F.when(r["requires_approval"], "requires_approval")]
    return F.array_compact(F.array(*parts))


def sanitise(text: Column, matched: Column, words: bool = False) -> Column:
    """``text`` with each matched phrase (in order, as written) and every address replaced; null phrases are skipped."""
    phrases = F.filter(matched, lambda m: m.isNotNull() & (m != ""))
    out = F.aggregate(phrases, text, lambda acc, m: F.replace(acc, m, F.lit("[REDACTED]")))
    out = F.regexp_replace(out, P.URL, "[URL_REMOVED]")
    if words:
        for w in SANITISED_WORDS:
            out = F.regexp_replace(out, f"(?i){w}", "[SANITIZED]")
    return out


def all_findings(df: DataFrame) -> Column:
    return F.flatten(F.array(*[F.coalesce(F.col(m)["findings"], R.none()) for m in present(df)]))


#: The sections of the multi-signal policy's reasoning, by module, in order, and its last line by decision.
SECTIONS = (
    ("houyi_pattern_detector", "HOUYI Pattern Analysis:"),
    ("semantic_threat_detector", "Semantic Analysis:"),
    ("content_deobfuscator", "De-obfuscation Analysis:"),
    ("ocr_content_analyzer", "OCR Analysis:"),
    ("agentic_intent_detector", "AGENTIC INTENT DETECTED:"),
)
OUTCOMES = (
    ("block", "Action: Content BLOCKED due to critical security threats or malicious/instructional intent."),
    ("require_approval", "Action: HUMAN APPROVAL REQUIRED - instructional, agentic, or ambiguous content detected."),
    ("sanitize", "Action: Content sanitized - suspicious elements removed before processing."),
    ("allow", "Action: Content allowed - classified as purely descriptive with minimal risk."),
)


def _context_section(df: DataFrame) -> Column:
    if "context" not in df.columns:
        return F.lit(None).cast("string")
    c = F.col("context")
    return F.when(c["risk_adjustment"] != 0, F.format_string("System-Prompt Context Analysis:\n- %s (adjustment: %+.2f)\n", c["explanation"], c["risk_adjustment"]))


def _module_section(module: str, title: str) -> Column:
    r = F.col(module)
    lines = [F.concat(F.lit(f"{title}\n- "), r["details"])]
    if module == "houyi_pattern_detector":
        severe = R.number(r["findings"], severity="critical")
        lines.append(F.when(severe > 0, F.format_string("- %d critical HOUYI indicator(s)", severe)))
    if module == "agentic_intent_detector":
        actions = F.array_sort(F.array_distinct(F.transform(F.filter(r["findings"], lambda f: f["type"] == "action_request"), lambda f: f["label"])))
        lines.append(F.when(F.size(actions) > 0, F.concat(F.lit("- Requested actions: "), F.array_join(actions, ", "))))
        lines.append(F.when(R.has(r["findings"], "permission_bypass"), F.lit("- CRITICAL: Attempts to bypass user permission/approval")))
        lines.append(F.when(R.has(r["findings"], "link_action"), F.lit("- CRITICAL: Link-based action or data exfiltration detected")))
    return F.when(r["risk_level"] != "safe", F.concat(F.concat_ws("\n", *lines), F.lit("\n")))


def reasoning_multi_signal(df: DataFrame) -> Column:
    """The decision in sections: intent, context, each module that isn't safe, other critical and high results, and what is done. Actions are sorted."""
    have = present(df)
    own = {m for m, _ in SECTIONS} | {"intent_classifier"}

    def results(level: str, title: str) -> Column:
        found = F.array_compact(F.array(*[F.when(F.col(m)["risk_level"] == level, F.concat(F.lit(f"- {m}: "), F.col(m)["details"])) for m in have if m not in own]))
        return F.when(F.size(found) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(found, "\n"), F.lit("\n")))

    last = F.lit(None).cast("string")
    for decision, text in OUTCOMES:
        last = F.when(F.col("decision") == decision, text).otherwise(last)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("PRIMARY INTENT: "), F.upper("primary_intent")),
        F.format_string("Risk Assessment: %s (score: %.2f)", F.upper("overall_risk"), F.col("risk_score")),
        F.concat(F.lit("Decision: "), F.upper("decision"), F.lit("\n")),
        F.concat(F.lit("Intent Analysis:\n- "), F.col("intent_classifier.details"), F.lit("\n")) if "intent_classifier" in have else F.lit(None).cast("string"),
        _context_section(df),
        *[_module_section(m, title) for m, title in SECTIONS if m in have],
        results("critical", "Critical Threats:"),
        results("high", "High-Risk Findings:"),
        last,
    )


def reasoning(df: DataFrame) -> Column:
    """The effective policy's decision in ordered lines: source, intent, risk, decision, override, context, modules of high risk."""
    severe = F.array_compact(F.array(*[F.when(F.col(m)["risk_level"].isin("high", "critical"), F.concat(F.lit(f"  - {m}: "), F.col(m)["details"])) for m in present(df)]))
    lines = [
        F.concat(F.lit("DECISION SOURCE: "), F.upper(F.col("decision_source") if "decision_source" in df.columns else F.lit("rule_based"))),
        F.concat(F.lit("PRIMARY INTENT: "), F.upper("primary_intent")),
        F.format_string("Risk Level: %s (score: %.2f)", F.upper("overall_risk"), F.col("risk_score")),
        F.concat(F.lit("Decision: "), F.upper("decision")),
        F.lit(""),
    ]
    if "override_reason" in df.columns:
        lines.append(F.when(F.col("override_reason").isNotNull(), F.concat(F.lit("CRITICAL OVERRIDE APPLIED: "), F.col("override_reason"), F.lit("\n"))))
    lines.append(_context_section(df))
    lines.append(F.when(F.size(severe) > 0, F.concat(F.lit("Critical Findings:\n"), F.array_join(F.slice(severe, 1, 5), "\n"), F.lit("\n"))))
    return F.concat_ws("\n", *lines)


def decide(df: DataFrame, policy: str = "effective", config: Config = Config(), ml_score: str | None = None) -> DataFrame:
    """Adds score, level, decision, restrictions, restricted capabilities, sanitised text and reasoning."""
    intent = F.col("primary_intent")
    if policy == "effective":
        df = score_effective(df, config, ml_score)
        rows = Rows(df)
        decision = decision_effective(intent, F.col("risk_score"), signals_effective(rows), config)
        restrict = restrictions_effective(F.col("overall_risk"))
    elif policy == "multi_signal":
        df = score_multi_signal(df, config)
        rows = Rows(df)
        decision = decision_multi_signal(rows, intent, F.col("risk_score"), config)
        restrict = restrictions_multi_signal(rows, intent, F.col("overall_risk"))
    else:
        raise ValueError("policy is effective or multi_signal")
    df = df.withColumns({"decision": decision, "restrictions": restrict})
    matched = F.transform(all_findings(df), lambda f: f["matched_text"])
    clean = F.when(F.col("decision") == "sanitize", sanitise(F.col("visible"), matched, policy == "multi_signal"))
    df = df.withColumns({"restricted_capabilities": restricted_capabilities(F.col("restrictions"), policy == "multi_signal"), "sanitized_content": clean, "intent_confidence": F.col("intent_classifier.confidence")})
    return df.withColumn("reasoning", reasoning(df) if policy == "effective" else reasoning_multi_signal(df))
