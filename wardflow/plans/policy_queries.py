"""Queries of policies, context and the session guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.functions.config import Config
from wardflow.functions.runtime import scratch
from wardflow.operators import context as C
from wardflow.operators import detectors as D
from wardflow.operators import guard as G
from wardflow.operators import learn as L
from wardflow.operators import policy as POL
from wardflow.plans import detector_queries as Q0
from wardflow.plans import pipeline
from wardflow.plans import sql as Q
from wardflow.plans.catalog import query
from wardflow.plans.planted import chain_sql, content_inputs, content_sql, document_inputs, document_sql, sample_inputs, sample_sql
from wardflow.sources import sinks

r6 = Q0.r6
_W = Config().values["risk_weights"]
_F = Config().values["intent_risk_floors"]


def _six(spark: SparkSession, sf: str) -> DataFrame:
    """The results of the six modules that SQL can express."""
    return _six_of(content_inputs(spark, sf))


def _six_of(rows: DataFrame) -> DataFrame:
    df = D.classify_intent(T.with_texts(rows))
    return D.detect_hijack(D.detect_agentic(D.detect_exfiltration(D.detect_injection(D.analyze_hidden(df)))))


_MODULES = (("int_r", "intent_classifier"), ("hid_r", "hidden_content_analyzer"), ("inj_r", "prompt_injection_detector"), ("exf_r", "exfiltration_detector"), ("agt_r", "agentic_intent_detector"), ("hou_r", "houyi_pattern_detector"))
_EFF = lambda a: f"CASE WHEN {a}.score > 0 THEN {a}.score ELSE CASE {a}.level WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.0 END END"
_SUM = " + ".join(f"({_EFF(a)}) * {a}.conf * {_W[m]}::DOUBLE" for a, m in _MODULES)
_FLOOR = "CASE int_r.intent " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _F.items()) + " ELSE 0.0 END"
_JOIN = "int_r" + "".join(f" JOIN {a} USING (input_id)" for a, _ in _MODULES[1:])
_SIX = f"""{Q0.INTENT_SQL}, {Q0.HIDDEN_SQL}, {Q0.INJ_SQL}, {Q0.EXF_SQL}, {Q0.AGT_SQL}, {Q0.HOU_SQL}"""
_EFFECTIVE = f"""pol0 AS (SELECT input_id, int_r.intent, ({_SUM}) / ({' + '.join(f'{_W[m]}::DOUBLE' for _, m in _MODULES)}) AS weighted, {_FLOOR} AS floor, hid.sc > 0 AS script, agt_r.bypass, hid_r.score AS hs, inj_r.score AS js FROM {_JOIN} JOIN hid USING (input_id)),
pol AS (SELECT *, least(1.0, greatest(least(1.0, greatest(weighted, floor)), CASE WHEN script THEN 0.9 ELSE 0.0 END, CASE WHEN bypass THEN 0.85 ELSE 0.0 END, CASE WHEN intent = 'malicious' THEN 0.9 ELSE 0.0 END)) AS risk FROM pol0),
pol2 AS (SELECT *, {Q.ladder('risk', 0.8, 0.6, 0.4, 0.15)} AS level, CASE WHEN intent = 'malicious' OR risk >= 0.75 THEN 'block' WHEN risk >= 0.4 AND (CASE WHEN hs > 0.4 THEN 1 ELSE 0 END + CASE WHEN js > 0.4 THEN 1 ELSE 0 END) >= 2 THEN 'require_approval'
 WHEN risk >= 0.2 THEN 'sanitize' WHEN intent = 'descriptive' AND risk < 0.15 THEN 'allow' ELSE 'sanitize' END AS decision FROM pol)"""
POLICY_SQL = f"{content_sql()}, {_SIX}, {_EFFECTIVE}"

_CAL = "CASE int_r.intent " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in POL.CALIBRATED.items()) + " ELSE 0.15 END"
_SERIOUS = "IN ('medium', 'high', 'critical')"
_RISING = lambda block, approve: f"CASE WHEN risk >= {block} THEN 'block' WHEN risk >= {approve} AND aligned THEN 'require_approval' ELSE 'sanitize' END"
def _mean(decoded: bool) -> str:
    """The weighted mean of the modules; the semantic one, which has no vectors, counts with its weight alone."""
    weights = [_W[m] for _, m in _MODULES] + ([_W["semantic_threat_detector"], _W["content_deobfuscator"]] if decoded else [])
    more = f" + ({_EFF('deo_r')}) * deo_r.conf * {_W['content_deobfuscator']}::DOUBLE" if decoded else ""
    return f"({_SUM}{more}) / ({' + '.join(f'{w}::DOUBLE' for w in weights)})"


def _multi(decoded: bool) -> str:
    """CTEs up to m5: the multi-signal policy; with ``decoded`` of the whole chain (deo_r and c2 must be there), else of six modules."""
    medium, high = (f"(deo_r.sus AND deo_r.level {_SERIOUS})", "(deo_r.sus AND deo_r.level IN ('high', 'critical'))") if decoded else ("false", "false")
    adjust, more = ("c2.adjust", " JOIN deo_r USING (input_id) JOIN c2 USING (input_id)") if decoded else ("0.0", "")
    return f"""m0 AS (SELECT input_id, int_r.intent, greatest({_mean(decoded)}, least(0.1, {_CAL}), CASE WHEN {medium} THEN 0.2 ELSE 0.0 END)::DOUBLE AS base, {high} AS threat, {adjust} AS adjust, hou_r.score AS hs, hou_r.level AS hl, agt_r.score AS gs, agt_r.level AS gl, agt_r.bypass, rc > 0 AS by_permission, n9 > 0 AS leak, nr > 0 AS retask,
 f > 0 OR ns > 0 AS seps, n7 + n9 + n6 > 0 AS disrupts, ra > 0 OR rb >= 0.7 OR rc > 0 OR rd > 0 AS strong, exf_r.level IN ('high', 'critical') AS exfil, inj_r.level IN ('high', 'critical') AS inject,
 (CASE WHEN hid_r.level {_SERIOUS} AND kw + ob + sc > 0 THEN 1 ELSE 0 END + CASE WHEN inj_r.level {_SERIOUS} AND inj_r.score > 0.4 THEN 1 ELSE 0 END + CASE WHEN agt_r.level {_SERIOUS} AND agt_r.score > 0.4 THEN 1 ELSE 0 END + CASE WHEN hou_r.level {_SERIOUS} AND hou_r.score > 0.5 THEN 1 ELSE 0 END + CASE WHEN {medium} THEN 1 ELSE 0 END) >= 2 AS aligned
 FROM {_JOIN} JOIN hid USING (input_id) JOIN ag USING (input_id) JOIN ho USING (input_id){more}),
m1 AS (SELECT *, CASE WHEN leak THEN least(1.0, greatest(base, hs) + 0.2::DOUBLE) ELSE greatest(base, hs) END AS b1 FROM m0),
m2 AS (SELECT *, CASE WHEN hl = 'safe' THEN base WHEN seps AND disrupts THEN CASE WHEN retask THEN least(1.0, b1 + 0.15::DOUBLE) ELSE b1 END ELSE greatest(base, hs * 0.6::DOUBLE) END AS b2 FROM m1),
m3 AS (SELECT *, greatest(CASE WHEN intent = 'malicious' THEN 0.9 ELSE 0.0 END, least(1.0, adjust + greatest(b2, CASE WHEN threat THEN 0.6 ELSE 0.0 END, CASE WHEN gl {_SERIOUS} AND strong THEN 0.5 ELSE 0.0 END, CASE WHEN intent NOT IN ('descriptive', 'ambiguous') THEN 0.2 ELSE 0.0 END))) AS risk FROM m2),
m4 AS (SELECT *, {Q.ladder('risk', 0.8, 0.6, 0.4, 0.15)} AS level, CASE WHEN intent = 'malicious' THEN 'block' WHEN hl IN ('high', 'critical') AND (leak OR (seps AND disrupts AND hs >= 0.75)) THEN 'block' WHEN hl IN ('high', 'critical') AND seps AND disrupts THEN 'require_approval'
 WHEN intent = 'conditional_instructional' THEN {_RISING(0.8, 0.6)} WHEN intent = 'instructional' THEN {_RISING(0.8, 0.55)} WHEN intent = 'ambiguous' THEN {_RISING(0.75, 0.55)}
 WHEN gl {_SERIOUS} THEN CASE WHEN bypass OR risk >= 0.75 THEN 'block' WHEN risk >= 0.5 THEN 'require_approval' ELSE 'sanitize' END WHEN risk >= 0.75 THEN 'block' WHEN risk >= 0.4 AND aligned THEN 'require_approval'
 WHEN risk >= 0.2 THEN 'sanitize' WHEN intent = 'descriptive' AND risk < 0.15 THEN 'allow' ELSE 'sanitize' END AS decision FROM m3),
m5 AS (SELECT *, CASE WHEN intent IN ('malicious', 'conditional_instructional') THEN 1 WHEN intent = 'instructional' THEN 2 WHEN intent = 'ambiguous' THEN 3 WHEN bypass THEN 4 WHEN level = 'critical' THEN 5 WHEN gl {_SERIOUS} THEN 6 WHEN level = 'high' THEN 7 WHEN level = 'medium' THEN 8 ELSE 9 END AS c FROM m4)"""


MULTI_SQL = f"{content_sql()}, {_SIX}, {_multi(False)}"



@query(f"{POLICY_SQL} SELECT input_id, round(weighted, 6) AS weighted_risk, round(floor, 6) AS intent_floor FROM pol0")
def policy_weighted_risk(spark: SparkSession, sf: str) -> DataFrame:
    df = _six(spark, sf)
    rows = POL.Rows(df)
    return df.select("input_id", r6(POL.weighted_risk([(m, rows[m]) for m in POL.present(df)], Config())).alias("weighted_risk"), POL.intent_floor(F.col("primary_intent"), _F).alias("intent_floor"))


@query(f"{POLICY_SQL} SELECT input_id, intent AS primary_intent, round(risk, 6) AS risk_score, level AS overall_risk, decision, CASE WHEN bypass THEN 'permission_bypass_attempt' WHEN script THEN 'dangerous_script_detected' END AS override_reason FROM pol2")
def policy_decision_effective(spark: SparkSession, sf: str) -> DataFrame:
    df = POL.decide(_six(spark, sf))
    return df.select("input_id", "primary_intent", r6(F.col("risk_score")).alias("risk_score"), "overall_risk", "decision", "override_reason")


@query(
    f"""{POLICY_SQL} SELECT input_id, CASE level WHEN 'critical' THEN 'ACTION_DISABLED' WHEN 'high' THEN 'APPROVAL_REQUIRED' WHEN 'medium' THEN 'READ_ONLY' ELSE 'NORMAL' END AS mode, CASE WHEN level = 'critical' THEN 500 END::INTEGER AS max_output_length,
 CASE WHEN level IN ('critical', 'high') THEN 'mode:' || CASE level WHEN 'critical' THEN 'ACTION_DISABLED' ELSE 'APPROVAL_REQUIRED' END || ',web_access,file_write,code_execution,tool_use' WHEN level = 'medium' THEN 'mode:READ_ONLY,web_access,file_write,code_execution' ELSE '' END AS capabilities FROM pol2"""
)
def policy_restrictions(spark: SparkSession, sf: str) -> DataFrame:
    df = POL.decide(_six(spark, sf))
    return df.select("input_id", "restrictions.mode", "restrictions.max_output_length", F.array_join("restricted_capabilities", ",").alias("capabilities"))


@query(f"{MULTI_SQL} SELECT input_id, intent AS primary_intent, round(risk, 6) AS risk_score, level AS overall_risk, decision FROM m5")
def policy_decision_multi_signal(spark: SparkSession, sf: str) -> DataFrame:
    df = POL.decide(_six(spark, sf), "multi_signal")
    return df.select("input_id", "primary_intent", r6(F.col("risk_score")).alias("risk_score"), "overall_risk", "decision")


@query(
    f"""{MULTI_SQL} SELECT input_id, CASE c WHEN 1 THEN 'ACTION_DISABLED' WHEN 2 THEN 'APPROVAL_REQUIRED' WHEN 3 THEN 'READ_ONLY' WHEN 4 THEN 'ACTION_DISABLED' WHEN 5 THEN 'ACTION_DISABLED' WHEN 6 THEN 'APPROVAL_REQUIRED' WHEN 7 THEN 'RESTRICTED' WHEN 8 THEN 'READ_ONLY' ELSE 'NORMAL' END AS mode,
 CASE WHEN c IN (1, 4, 5) THEN 500 WHEN c IN (2, 6, 7) THEN 1000 WHEN c = 3 THEN 1500 WHEN c = 8 THEN 2000 END::INTEGER AS max_output_length, c IN (1, 2, 4, 6) AS requires_approval,
 CASE c WHEN 1 THEN 'Content classified as ' || intent WHEN 2 THEN 'Instructional content requires approval' WHEN 4 THEN 'Permission bypass or link action detected' WHEN 6 THEN 'Agentic action request requires human approval' END AS approval_reason,
 c = 9 OR (c IN (7, 8) AND NOT exfil) AS allow_web_access, c = 9 OR c = 8 OR (c = 7 AND NOT inject) AS allow_tool_use, c = 9 AS allow_file_write, CASE WHEN c >= 4 AND (exfil OR (bypass AND NOT by_permission) OR rd_link) THEN 6 ELSE 0 END::INTEGER AS n_blocked FROM (SELECT m5.*, ag.rd > 0 AS rd_link FROM m5 JOIN ag USING (input_id))"""
)
def policy_restrictions_multi_signal(spark: SparkSession, sf: str) -> DataFrame:
    df = POL.decide(_six(spark, sf), "multi_signal")
    names = ("mode", "max_output_length", "requires_approval", "approval_reason", "allow_web_access", "allow_tool_use", "allow_file_write")
    return df.select("input_id", *[f"restrictions.{n}" for n in names], F.size("restrictions.blocked_patterns").alias("n_blocked"))


_INJ_HITS = "list_concat(" + ", ".join(Q.hits("visible", p) for p, _ in P.INJECTIONS) + ")"


@query(
    f"""{document_sql()} SELECT input_id, regexp_replace(list_reduce(list_concat([visible], list_filter({_INJ_HITS}, lambda m: m <> '')), lambda acc, m: replace(acc, m, '[REDACTED]')), {Q.quoted(P.URL)}, '[URL_REMOVED]', 'g') AS sanitized FROM t"""
)
def policy_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    df = document_inputs(spark, sf)
    matched = F.flatten(F.array(*[T.hits(F.col("visible"), p) for p, _ in P.INJECTIONS]))
    return df.select("input_id", POL.sanitise(F.col("visible"), matched).alias("sanitized"))


_TOK = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), {Q.quoted(chr(91) + 'a-zA-Z0-9' + chr(39) + chr(93) + '+')}), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in P.STOPWORDS)}], w)))"
_BOUNDS = "list_concat(" + ", ".join(f"regexp_extract_all(lower(system_prompt), {Q.quoted(p)}, 1)" for p in P.BOUNDARIES) + ")"
_CONTEXT = f"""c0 AS (SELECT input_id, system_prompt, substr(visible, 1, 50000) AS v, {_TOK('system_prompt')} AS p, {_TOK('substr(visible, 1, 50000)')} AS w,
 list_filter(list_transform({_BOUNDS}, lambda b: rtrim(regexp_replace(trim(b), '[.,;:]+$', ''))), lambda b: len(regexp_extract_all(b, '\\S+')) BETWEEN 3 AND 12) AS bs FROM t),
c1 AS (SELECT *, CASE WHEN len(p) > 0 AND len(w) > 0 THEN len(list_intersect(p, w))::DOUBLE / len(list_distinct(list_concat(p, w))) ELSE 0.0 END AS al, CASE WHEN {Q.found('lower(v)', P.OVERRIDE_SIGNALS, '')} THEN len(list_filter(bs, lambda b: list_has_any({_TOK('b')}, w))) ELSE 0 END AS nb FROM c0)"""
_ADJUST = "CASE WHEN trim(system_prompt) = '' THEN 0.0 WHEN nb > 0 THEN least(0.25, 0.12 * nb) WHEN al >= 0.08 THEN -least(0.15, al * 0.3) ELSE 0.0 END::DOUBLE"
_CTX = f"{content_sql()}, {_CONTEXT}"
_WHOLE = f"{chain_sql(Q0.deob_sql('t0'))}, {_SIX}, {_CONTEXT}, c2 AS (SELECT input_id, {_ADJUST} AS adjust FROM c1)"


@query(f"{_CTX} SELECT input_id, round(CASE WHEN trim(system_prompt) = '' THEN 0.0 ELSE al END, 6) AS topic_alignment, (CASE WHEN trim(system_prompt) = '' THEN 0 ELSE nb END)::BIGINT AS n_violations, round(CASE WHEN trim(system_prompt) = '' THEN 0.0 WHEN nb > 0 THEN least(0.25, 0.12 * nb) WHEN al >= 0.08 THEN -least(0.15, al * 0.3) ELSE 0.0 END::DOUBLE, 6) AS risk_adjustment FROM c1")
def context_adjustment(spark: SparkSession, sf: str) -> DataFrame:
    df = C.weigh_context(content_inputs(spark, sf))
    c = F.col("context")
    return df.select("input_id", r6(c["topic_alignment"]).alias("topic_alignment"), F.size(c["boundary_violations"]).cast("long").alias("n_violations"), r6(c["risk_adjustment"]).alias("risk_adjustment"))


# ---- guard --------------------------------------------------------------------------------------

_LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY applied_at DESC NULLS LAST, restriction_id DESC) AS k FROM agent_restrictions WHERE session_id IS NOT NULL) WHERE k = 1)"""


@query(f"WITH {_LATEST} SELECT session_id, restriction_id, restriction_mode, CASE WHEN restriction_mode <> 'NORMAL' THEN 'ENFORCED' ELSE 'STANDARD' END AS enforcement_status FROM latest")
def guard_latest(spark: SparkSession, sf: str) -> DataFrame:
    return G.latest_restrictions(spark.read.parquet(f"{sf}/agent_restrictions.parquet")).select("session_id", "restriction_id", "restriction_mode", "enforcement_status")


@query(
    f"""WITH {_LATEST}, a AS (SELECT a.action_id, a.received_at, CASE lower(trim(a.action_type)) WHEN 'web_access' THEN 'web_request' WHEN 'output' THEN 'generate_output' ELSE lower(trim(a.action_type)) END AS k, coalesce(a.params.url, '') AS url, coalesce(a.params.length, 0) AS len, l.* FROM agent_actions a LEFT JOIN latest l ON a.session_id = l.session_id),
d AS (SELECT action_id, received_at, CASE WHEN restriction_id IS NULL THEN 'no limits' WHEN restriction_mode = 'ACTION_DISABLED' AND k NOT IN ('read', 'query', 'generate_output') THEN 'mode'
 WHEN restriction_mode = 'READ_ONLY' AND k IN ('file_write', 'code_execution', 'tool_use', 'web_request') THEN 'mode' WHEN restriction_mode = 'APPROVAL_REQUIRED' AND k IN ('file_write', 'code_execution', 'tool_use', 'web_request', 'send_email') THEN 'mode'
 WHEN k = 'web_request' AND NOT allow_web_access THEN 'capability' WHEN k = 'web_request' AND len(allowed_domains) > 0 AND NOT list_contains(allowed_domains, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) THEN 'domain'
 WHEN k = 'web_request' AND len(list_filter(blocked_patterns, lambda p: CASE p WHEN 'https?://' THEN regexp_matches(url, '(?i)https?://') WHEN 'upload' THEN regexp_matches(url, '(?i)upload') WHEN 'send\\s+to' THEN regexp_matches(url, '(?i)send\\s+to') WHEN 'post\\s+to' THEN regexp_matches(url, '(?i)post\\s+to') WHEN 'append\\s+to' THEN regexp_matches(url, '(?i)append\\s+to') WHEN 'transmit' THEN regexp_matches(url, '(?i)transmit') ELSE contains(lower(url), lower(p)) END)) > 0 THEN 'pattern'
 WHEN k = 'file_write' AND NOT allow_file_write THEN 'capability' WHEN k = 'code_execution' AND NOT allow_code_execution THEN 'capability' WHEN k = 'tool_use' AND NOT allow_tool_use THEN 'capability' WHEN k = 'generate_output' AND max_output_length > 0 AND len > max_output_length THEN 'length' ELSE 'allowed' END AS verdict FROM a)
 SELECT action_id, received_at, verdict IN ('no limits', 'allowed') AS allowed, verdict FROM d"""
)
def guard_action_check(spark: SparkSession, sf: str) -> DataFrame:
    latest = G.latest_restrictions(spark.read.parquet(f"{sf}/agent_restrictions.parquet"))
    df = G.check_actions(spark.read.parquet(f"{sf}/agent_actions.parquet"), latest)
    reason = F.col("reason")
    verdict = (
        F.when(reason == "No restrictions active", "no limits").when(reason == "Action allowed", "allowed").when(reason.contains(" mode: "), "mode").when(reason.startswith("Domain "), "domain")
        .when(reason.startswith("URL matches"), "pattern").when(reason.startswith("Output length"), "length").otherwise("capability")
    )
    return df.select("action_id", "received_at", "allowed", verdict.alias("verdict"))


_RULE = "=" * 60
_OFF = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN NOT {c} THEN {Q.quoted(text)} END" for c, text in G.OFF_LINES) + ")"
_BODY = f"""CASE restriction_mode WHEN 'ACTION_DISABLED' THEN {Q.quoted(G.DISABLED)} WHEN 'APPROVAL_REQUIRED' THEN {Q.quoted(G.APPROVAL[0])} || coalesce(approval_reason, 'None') || {Q.quoted(G.APPROVAL[1])}
 WHEN 'READ_ONLY' THEN {Q.quoted(G.READ_ONLY)} ELSE nullif({_OFF}, '') END"""


@query(
    f"""WITH {_LATEST} SELECT session_id, concat_ws(chr(10), '{_RULE}', 'SECURITY RESTRICTIONS ACTIVE', '{_RULE}', CASE WHEN restriction_mode <> 'NORMAL' THEN 'MODE: ' || restriction_mode || chr(10) END, {_BODY},
 CASE WHEN max_output_length > 0 THEN '- Output length is LIMITED to ' || max_output_length || ' characters.' END, CASE WHEN len(blocked_patterns) > 0 THEN '- Blocked patterns: ' || array_to_string(blocked_patterns[1:3], ', ') END,
 '', 'Any attempt to bypass these restrictions will be logged and blocked.', '{_RULE}') AS prompt_addition, to_json({{{', '.join(f"'{c}': {c}" for c in G.FIELDS)}}})::VARCHAR AS policy FROM latest"""
)
def guard_prompt_additions(spark: SparkSession, sf: str) -> DataFrame:
    latest = G.latest_restrictions(spark.read.parquet(f"{sf}/agent_restrictions.parquet"))
    return G.serialise(G.prompt_addition(latest)).select("session_id", "prompt_addition", "policy")


@query(f"WITH {_LATEST} SELECT l.session_id, l.restriction_mode FROM latest l WHERE l.session_id NOT IN (SELECT session_id FROM agent_actions WHERE session_id IS NOT NULL)")
def guard_clear(spark: SparkSession, sf: str) -> DataFrame:
    """Restrictions of the sessions that never acted: those that did are cleared."""
    latest = G.latest_restrictions(spark.read.parquet(f"{sf}/agent_restrictions.parquet"))
    return G.clear_restrictions(latest, spark.read.parquet(f"{sf}/agent_actions.parquet").filter("session_id IS NOT NULL")).select("session_id", "restriction_mode")


# ---- whole assessments --------------------------------------------------------------------------


_WHOLE_EFFECTIVE = f"""w0 AS (SELECT input_id, int_r.intent, greatest(least(1.0, greatest({_mean(True)}, {_FLOOR})), CASE WHEN hid.sc > 0 THEN 0.9 ELSE 0.0 END, CASE WHEN deo_r.sus AND deo_r.level IN ('high', 'critical') THEN 0.75 ELSE 0.0 END, CASE WHEN agt_r.bypass THEN 0.85 ELSE 0.0 END) AS base,
 c2.adjust, (CASE WHEN hid_r.score > 0.4 THEN 1 ELSE 0 END + CASE WHEN inj_r.score > 0.4 THEN 1 ELSE 0 END + CASE WHEN deo_r.score > 0.4 THEN 1 ELSE 0 END) AS signals, CASE WHEN agt_r.level {_SERIOUS} THEN ag.actions ELSE [] END AS actions FROM {_JOIN} JOIN hid USING (input_id) JOIN ag USING (input_id) JOIN deo_r USING (input_id) JOIN c2 USING (input_id)),
w1 AS (SELECT *, greatest(CASE WHEN intent = 'malicious' THEN 0.9 ELSE 0.0 END, least(1.0, base + adjust)) AS risk FROM w0),
w2 AS (SELECT *, {Q.ladder('risk', 0.8, 0.6, 0.4, 0.15)} AS level, CASE WHEN intent = 'malicious' OR risk >= 0.75 THEN 'block' WHEN risk >= 0.4 AND signals >= 2 THEN 'require_approval' WHEN risk >= 0.2 THEN 'sanitize' WHEN intent = 'descriptive' AND risk < 0.15 THEN 'allow' ELSE 'sanitize' END AS decision FROM w1)"""


@query(f"{_WHOLE}, {_WHOLE_EFFECTIVE} SELECT input_id, intent AS primary_intent, round(risk, 6) AS risk_score, level AS overall_risk, decision, CASE level WHEN 'critical' THEN 'ACTION_DISABLED' WHEN 'high' THEN 'APPROVAL_REQUIRED' WHEN 'medium' THEN 'READ_ONLY' ELSE 'NORMAL' END AS mode, array_to_string(actions, ',') AS actions FROM w2")
def assess_effective(spark: SparkSession, sf: str) -> DataFrame:
    df = pipeline.assess(content_inputs(spark, sf))
    return df.select("input_id", "primary_intent", r6(F.col("risk_score")).alias("risk_score"), "overall_risk", "decision", "restrictions.mode", F.array_join("requested_actions", ",").alias("actions"))


@query(
    f"""{_WHOLE}, {_multi(True)} SELECT input_id, intent AS primary_intent, round(risk, 6) AS risk_score, level AS overall_risk, decision, CASE c WHEN 1 THEN 'ACTION_DISABLED' WHEN 2 THEN 'APPROVAL_REQUIRED' WHEN 3 THEN 'READ_ONLY' WHEN 4 THEN 'ACTION_DISABLED' WHEN 5 THEN 'ACTION_DISABLED' WHEN 6 THEN 'APPROVAL_REQUIRED' WHEN 7 THEN 'RESTRICTED' WHEN 8 THEN 'READ_ONLY' ELSE 'NORMAL' END AS mode,
 CASE c WHEN 1 THEN 'Content classified as ' || intent WHEN 2 THEN 'Instructional content requires approval' WHEN 4 THEN 'Permission bypass or link action detected' WHEN 6 THEN 'Agentic action request requires human approval' END AS approval_reason FROM m5"""
)
def assess_multi_signal(spark: SparkSession, sf: str) -> DataFrame:
    df = pipeline.assess(content_inputs(spark, sf), "multi_signal")
    return df.select("input_id", "primary_intent", r6(F.col("risk_score")).alias("risk_score"), "overall_risk", "decision", "restrictions.mode", "restrictions.approval_reason")


@query()
def assess_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a caller reads: sanitised text and reasoning."""
    return pipeline.assess(content_inputs(spark, sf)).select("input_id", "decision", "sanitized_content", "reasoning")


@query()
def assess_findings(spark: SparkSession, sf: str) -> DataFrame:
    df = pipeline.analyze(content_inputs(spark, sf))
    return pipeline.findings_table(df).groupBy("module_name", "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("input_id").alias("n_inputs"))


_RESULTS = " UNION ALL ".join(f"SELECT input_id, '{m}' AS module_name, level AS risk_level, round(score, 6) AS risk_score, round(conf, 6) AS confidence FROM {a}" for a, m in _MODULES)


@query(f"{content_sql()}, {_SIX} {_RESULTS}")
def assess_module_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = pipeline.module_results(_six(spark, sf))
    return rows.select("input_id", "module_name", "risk_level", r6(F.col("risk_score")).alias("risk_score"), r6(F.col("confidence")).alias("confidence"))


@query(
    f"""{POLICY_SQL} SELECT sha256(input_id::VARCHAR || chr(31) || visible) AS event_id, 'security_assessment' AS event_type, level AS severity, input_id::VARCHAR AS input_source, decision, 6 AS n_modules, intent AS primary_intent,
 length(visible)::VARCHAR AS visible_length, len(hidden)::VARCHAR AS hidden_elements FROM pol2 JOIN t USING (input_id)"""
)
def assess_audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as they are read back from the files that they were appended to."""
    events = sinks.audit_events(POL.decide(_six(spark, sf)))
    folder = scratch(spark, "events")
    sinks.append_events(events, folder)
    e, m = spark.read.schema(events.schema).json(folder), F.col("metadata")
    return e.select("event_id", "event_type", "severity", "input_source", "decision", F.size("findings").alias("n_modules"), *[m[k].alias(k) for k in ("primary_intent", "visible_length", "hidden_elements")])


@query(
    f"""{sample_sql()}, {_SIX}, {_EFFECTIVE} SELECT label, CASE WHEN decision IN ('block', 'require_approval') THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM pol2 JOIN training_samples s ON s.sample_id = pol2.input_id GROUP BY 1, 2"""
)
def labels_vs_decision_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against the effective policy's decision; what is stopped counts as an attack."""
    df = POL.decide(_six_of(sample_inputs(spark, sf)))
    return L.confusion(df.withColumn("prediction", F.col("decision").isin("block", "require_approval").cast("int")))


_FIRST_INJ = " UNION ALL ".join(f"SELECT input_id, visible, unnest({Q.hits(Q0._CHUNK, p)}) AS m, {i} AS p FROM t" for i, (p, _) in enumerate(P.INJECTIONS))


@query(
    f"""{document_sql()}, h AS (SELECT *, row_number() OVER () AS o FROM ({_FIRST_INJ})), k AS (SELECT *, row_number() OVER (PARTITION BY input_id, p, m ORDER BY o) AS nth FROM h),
l AS (SELECT *, (list_sum(list_transform(string_split(lower(visible), m)[1:nth], lambda x: length(x))) + (nth - 1) * length(m))::BIGINT AS char_offset FROM k)
SELECT input_id, m AS matched_text, char_offset, (length(substr(visible, 1, char_offset)) - length(replace(substr(visible, 1, char_offset), chr(10), '')) + 1)::INTEGER AS line_number, CASE WHEN char_offset > 0 THEN right(trim(substr(visible, greatest(char_offset - 50, 0) + 1, least(char_offset, 50))), 20) END AS context_before FROM l"""
)
def finding_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Where the injection patterns stand in the visible text of every document."""
    rows = pipeline.located_findings(D.detect_injection(T.with_texts(document_inputs(spark, sf))))
    rows = rows.filter("type = 'injection_pattern' AND channel = 'visible'")
    return rows.select("input_id", "matched_text", F.col("location.char_offset").cast("long").alias("char_offset"), "location.line_number", "location.context_before")
