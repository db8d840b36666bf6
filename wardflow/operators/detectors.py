"""The detectors as DataFrame operators: each adds one result column to a table with visible and hidden text.

They read the columns made by ``functions.text.with_texts`` and never shuffle; a text without a match of a
family is read once for that family. Null texts count as empty, so that every row gets a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.operators import findings as R
from wardflow.operators.findings import Family, literal, plain


def _contains(m: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | m.contains(w)
    return out


# ---- intent -------------------------------------------------------------------------------------


def _one_of(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(m), '{w}')" for w in words)


_COMMANDS, _DUTIES, _SECRETLY = ("ignore", "disregard", "forget"), ("must", "shall", "need to"), ("without", "silently")
_IMPERATIVE = lambda strong, middle, weak: f"CASE WHEN {_one_of(_COMMANDS)} THEN {strong} WHEN {_one_of(_DUTIES)} THEN {middle} ELSE {weak} END"
_OUTCOME = lambda strong, weak: f"CASE WHEN {_one_of(_SECRETLY)} THEN {strong} ELSE {weak} END"

INTENT_FAMILIES = {
    "conditional_ai": Family("conditional_ai_context", "intent_classifier", plain(P.CONDITIONAL_AI, 0.9), "critical", 3, shown=80),
    "imperative": Family("imperative_instruction", "intent_classifier", plain(P.IMPERATIVES), most=3, scored=_IMPERATIVE("0.85D", "0.7D", "0.5D"), graded=_IMPERATIVE("'critical'", "'high'", "'medium'"), shown=80),
    "capability": Family("capability_reference", "intent_classifier", plain(P.CAPABILITIES, 0.6), "medium", 3, shown=80),
    "outcome": Family("outcome_oriented", "intent_classifier", plain(P.OUTCOMES), most=3, scored=_OUTCOME("0.75D", "0.55D"), graded=_OUTCOME("'high'", "'medium'"), shown=80),
    "link_action": Family("link_action", "intent_classifier", plain(P.INTENT_LINKS, 0.9), "critical", 3, shown=80),
}


def intent_signals(df: DataFrame) -> DataFrame:
    """Adds ``signals``: the findings of each family and how many descriptive markers stand in the text."""
    parts = {k: f.find("t_spaced" if k == "link_action" else "t_spaced_lower", None, "t_spaced_lower") for k, f in INTENT_FAMILIES.items()}
    markers = sum((T.any_of(F.col("t_spaced_lower"), [p], low=F.col("t_spaced_lower")).cast("int") for p in P.DESCRIPTIVE), F.lit(0))
    df = df.withColumn("signals", F.struct(*[v.alias(k) for k, v in parts.items()], markers.alias("descriptive")))
    s = F.col("signals")
    scores = F.struct(*[R.top(s[k]).alias(k) for k in parts], (s["descriptive"] * F.lit(0.2)).alias("descriptive"))
    return df.withColumn("signal_scores", scores)


def intent_tree(s: Column) -> Column:
    """struct<intent, confidence, risk> of the signal scores; the first rule that holds decides."""

    def leaf(intent: str, confidence, risk) -> Column:
        lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
        return F.struct(F.lit(intent).alias("intent"), lit(confidence).alias("confidence"), lit(risk).alias("risk"))

    most = F.greatest(s["imperative"], s["capability"], s["outcome"])
    strength = s["imperative"] + s["capability"] * 0.7 + s["outcome"] * 0.8
    conditional = s["conditional_ai"] > 0.5
    return (
        F.when(s["link_action"] > 0.5, leaf("malicious", 0.95, 0.95))
        .when(conditional & (most > 0.3), leaf("conditional_instructional", T.cap(0.8 + s["conditional_ai"] * 0.15, 0.95), T.cap(0.7 + s["conditional_ai"] * 0.2 + most * 0.15)))
        .when(conditional, leaf("ambiguous", 0.65, 0.45))
        .when(strength > 0.8, leaf("instructional", T.cap(0.75 + strength * 0.1, 0.9), T.cap(0.5 + strength * 0.3)))
        .when((strength > 0.4) & (s["descriptive"] > strength * 1.5), leaf("descriptive", 0.7, 0.1))
        .when((strength > 0.4) & (s["descriptive"] > strength), leaf("ambiguous", 0.6, 0.35))
        .when(strength > 0.4, leaf("instructional", 0.7, 0.45 + strength * 0.2))
        .when((s["descriptive"] > 0.2) | (strength < 0.1), leaf("descriptive", 0.8, 0.05))
        .otherwise(leaf("ambiguous", 0.6, 0.3))
    )


def _intent_details(s: Column, scores: Column, tree: Column) -> Column:
    names = {"conditional_ai": "conditional AI-targeting", "imperative": "imperative instructions", "capability": "capability references", "outcome": "outcome-oriented language", "link_action": "link-based actions"}
    fired = F.array_compact(F.array(*[F.when(F.size(s[k]) > 0, F.format_string(f"{n} (score: %.2f)", scores[k])) for k, n in names.items()]))
    head = F.format_string("Intent: %s (confidence: %.2f)", F.upper(tree["intent"]), tree["confidence"])
    signals = F.when(F.size(fired) > 0, F.concat(F.lit("Signals: "), F.array_join(fired, ", "))).otherwise("No instructional signals detected")
    marks = F.when(s["descriptive"] > 0, F.format_string("Descriptive markers present (score: %.2f)", scores["descriptive"]))
    return F.concat(F.concat_ws(". ", head, signals, marks), F.lit("."))


def classify_intent(df: DataFrame) -> DataFrame:
    """Adds ``intent_classifier`` and ``primary_intent``."""
    df = intent_signals(df).withColumn("tree", intent_tree(F.col("signal_scores")))
    s, t = F.col("signals"), F.col("tree")
    found = F.concat(*[s[k] for k in INTENT_FAMILIES])
    out = R.result("intent_classifier", T.level(t["risk"], 0.8, 0.6, 0.4, 0.15), t["risk"], t["confidence"], found, _intent_details(s, F.col("signal_scores"), t))
    return df.withColumns({"intent_classifier": out, "primary_intent": t["intent"]})


def intent_strength(text: Column, intent: Column) -> Column:
    """struct<strength, confidence, signal>: weak, medium or strong; weak with no confidence for intents that instruct nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    weak, middle, strong = (T.count_of(low, p) for p in (P.WEAK_CONDITIONALS, P.MEDIUM_CONDITIONALS, P.STRONG_IMPERATIVES))
    able, out = T.count_of(low, P.STRENGTH_CAPABILITIES), T.count_of(low, P.STRENGTH_OUTCOMES)
    mild, urgent = T.count_of(low, P.WEAK_MARKERS), T.count_of(low, P.STRONG_MARKERS)
    both = (able > 1) & (out > 0)
    signal = T.cap(strong * F.lit(0.4)) + F.when(both, 0.4).when(able > 1, 0.2).otherwise(0.0) + middle * F.lit(0.15) + weak * F.lit(0.05)
    signal = F.greatest(signal + (urgent * F.lit(0.1) + mild * F.lit(-0.1)), F.lit(0.0))
    total = strong + F.when(both, 2).when(able > 1, 1).otherwise(0) + middle + weak
    name = F.when(total == 0, "weak").when(signal >= 0.7, "strong").when(signal >= 0.35, "medium").otherwise("weak")
    sure = (
        F.when(total == 0, 0.5).when(signal >= 0.7, T.cap(0.6 + (signal - 0.7) * 2, 0.95)).when(signal >= 0.35, T.cap(0.5 + signal, 0.9)).otherwise(T.cap(signal + 0.3, 0.85))
    )
    instructs = F.coalesce(intent.isin("instructional", "conditional_instructional", "ambiguous"), F.lit(False))
    return F.struct(F.when(instructs, name).otherwise("weak").alias("strength"), F.when(instructs, sure).otherwise(0.0).alias("confidence"), F.when(instructs, signal).otherwise(0.0).alias("signal"))


def strength_floor(strength: Column) -> Column:
    return F.when(strength == "medium", 0.40).when(strength == "strong", 0.60).otherwise(0.15)


def needs_more_signals(strength: Column) -> Column:
    return strength == "weak"


def is_benign_hidden(text: Column) -> Column:
    """Metadata, comments, or short noise of recognised text."""
    low = F.lower(text)
    return T.any_of(low, P.BENIGN_METADATA, "") | T.any_of(F.trim(text), P.BENIGN_COMMENTS, "") | ((F.length(text) < 50) & T.any_of(low, P.BENIGN_NOISE, ""))


def hidden_text_risk(text: Column, strength: Column, executable: Column) -> Column:
    base = F.when(executable, 0.3).otherwise(0.0)
    base = F.when(is_benign_hidden(text), T.cap(base + 0.05, 0.15)).otherwise(base)
    return T.cap(base * F.when(strength == "strong", 1.2).when(strength == "medium", 0.7).otherwise(0.3))


# ---- hidden content -----------------------------------------------------------------------------

OBFUSCATIONS = Family("obfuscation", "obfuscation_detector", plain(P.OBFUSCATION, 0.65), "medium")
SCRIPTS = Family("dangerous_script", "script_analyzer", plain(P.DANGEROUS_SCRIPTS, 0.9), "critical")


def hidden_findings(strength: Column, hidden: str = "hidden", visible: str = "visible") -> Column:
    """All findings of the columns' hidden elements, benign ones too: keywords by element, obfuscation, size, scripts."""
    risk = F.when(strength == "weak", 0.4).when(strength == "medium", 0.65).otherwise(0.85)
    words = F.array(*[F.lit(w) for w in P.HIDDEN_KEYWORDS])

    def by_keyword(h: Column) -> Column:
        low = F.lower(h)
        return F.transform(F.filter(words, lambda w: F.contains(low, w)), lambda w: R.finding("instruction_keyword", "keyword_detector", F.when(risk > 0.7, "high").otherwise("medium"), risk, None, w, None, "hidden"))

    size = F.expr(f"aggregate({hidden}, 0, (n, h) -> n + length(h))")
    anomaly = F.when((F.length(visible) > 0) & (size > F.length(visible) * 5), F.array(R.finding("size_anomaly", "size_anomaly_detector", "low", 0.25))).otherwise(R.none())
    scripts = f"filter({hidden}, h -> contains(lower(h), '<script'))"
    return F.concat(F.flatten(F.transform(hidden, by_keyword)), OBFUSCATIONS.find_each(hidden, "lower(x)", "hidden"), anomaly, SCRIPTS.find_each(scripts, "lower(x)", "script"))


def _is_threat(f: Column) -> Column:
    always = f["type"].isin("obfuscation", "dangerous_script")
    low = F.lower(F.coalesce(f["matched_text"], F.lit("")))
    terms = ("metadata", "generator", "charset", "viewport", "comment", *P.BENIGN_TERMS)
    return always | ((f["type"] != "size_anomaly") & ~_contains(low, *terms))


def analyze_hidden(df: DataFrame, strength: Column | None = None) -> DataFrame:
    """Adds ``hidden_content_analyzer``: the mean risk of the threats in hidden elements."""
    strength = F.lit(None).cast("string") if strength is None else strength
    df = df.withColumn("hidden_all", hidden_findings(strength))
    df = df.withColumn("threats", F.filter("hidden_all", _is_threat))
    n = F.size("threats")
    mean = F.aggregate("threats", F.lit(0.0), lambda a, f: a + f["risk_score"]) / n
    mean = F.when((strength == "weak") & (mean < 0.5), F.greatest(mean, F.lit(0.1))).otherwise(mean)
    empty = R.result("hidden_content_analyzer", "safe", 0.0, 0.95, R.none(), "No hidden content detected.")
    benign = R.result("hidden_content_analyzer", "safe", 0.0, 0.85, R.none(), F.format_string("Hidden content present (%d elements) but no threats detected.", F.size("hidden")))
    found = R.result("hidden_content_analyzer", T.level(mean, 0.8, 0.6, 0.4, 0.2), mean, T.cap(mean + 0.2, 0.95), F.col("threats"), F.format_string("Detected %d threat patterns in hidden content.", n))
    return df.withColumn("hidden_content_analyzer", F.when(F.size("hidden") == 0, empty).when(n == 0, benign).otherwise(found))


# ---- prompt injection ---------------------------------------------------------------------------

INJECTION = Family("injection_pattern", "pattern_matcher", tuple((p, s, None) for p, s in P.INJECTIONS), lambda s: "critical" if s >= 0.9 else "high")
SWITCH = Family("context_switch", "context_switch_detector", plain(P.CONTEXT_SWITCHES, 0.85), "high")
ROLE = Family("role_manipulation", "role_detector", literal(P.ROLES, 0.8), "high")
QUOTE = Family("structural_attack", "structure_detector", tuple((p, 0.7, label) for p, label in P.QUOTES), "medium", flags="(?is)", shown=50)
REPETITION = r"(ignore|disregard|forget|override)"


def injection_parts(df: DataFrame) -> DataFrame:
    """Adds ``inj``: findings of each family; visible text and every hidden element are scanned apart."""
    visible = T.bounded(F.col("visible"), "chunk")
    most = T.limits().elements
    hidden = F.transform(F.slice("hidden", 1, most) if most else F.col("hidden"), lambda h: T.bounded(h, "chunk"))
    df = df.withColumn("chunks", F.struct(visible.alias("v"), hidden.alias("h")))
    both = T.bounded(F.concat(F.col("chunks.v"), F.array_join("chunks.h", " ")))
    df = df.withColumn("t_chunks", both).withColumn("t_chunks_lower", F.lower("t_chunks")).withColumn("chunks_low", F.struct(F.lower("chunks.v").alias("v"), F.transform("chunks.h", F.lower).alias("h")))

    def each(family: Family) -> Column:
        return F.concat(F.expr(family.sql("chunks_low.v", "chunks_low.v", "visible")), family.find_each("chunks_low.h", "x", "hidden"))

    repeated = T.count_of(F.col("t_chunks_lower"), [REPETITION])
    repetition = F.when(repeated >= 3, F.array(R.finding("repetition_attack", "repetition_detector", "medium", 0.65, None, None, repeated.cast("string")))).otherwise(R.none())
    parts = {"patterns": each(INJECTION), "switches": SWITCH.find("t_chunks", None, "t_chunks_lower"), "roles": each(ROLE), "structure": F.concat(QUOTE.find("t_chunks", None, "t_chunks_lower"), repetition)}
    return df.withColumn("inj", F.struct(*[c.alias(k) for k, c in parts.items()]))


def detect_injection(df: DataFrame) -> DataFrame:
    """Adds ``prompt_injection_detector``: the highest risk of the families that fired."""
    df = injection_parts(df)
    p = F.col("inj")
    fired = lambda k, s: F.when(F.size(p[k]) > 0, s).otherwise(0.0)
    df = df.withColumn("inj_found", F.concat(p["patterns"], p["switches"], p["roles"], p["structure"]))
    risk = F.greatest(R.top(p["patterns"]), fired("switches", 0.85), fired("roles", 0.8), fired("structure", 0.7))
    n = F.size("inj_found")
    safe = R.result("prompt_injection_detector", "safe", 0.0, 0.9, R.none(), "No prompt injection patterns detected.")
    found = R.result("prompt_injection_detector", T.level(risk, 0.85, 0.7, 0.5, 0.3), risk, T.cap(risk + 0.1, 0.95), F.col("inj_found"), F.format_string("Detected %d injection pattern(s). Max risk: %.2f", n, risk))
    return df.withColumn("prompt_injection_detector", F.when(n == 0, safe).otherwise(found))


# ---- exfiltration -------------------------------------------------------------------------------

SENDING = Family("exfiltration_with_context", "exfiltration_detector", plain(P.EXFILTRATION, 0.9), "critical", shown=100)
COLLECTING = Family("data_collection_with_action", "exfiltration_detector", plain(P.COLLECTION, 0.85), "high", shown=100)
CALLING = Family("callback_pattern", "exfiltration_detector", plain(P.CALLBACKS, 0.8), "high", shown=100)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.URL), F.lit(0))


def url_authority(url: Column) -> Column:
    """Host with user and port, as written; made by pattern, since parsing fails on half-finished addresses."""
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def url_parameters(url: Column) -> Column:
    """Decoded names of the query's parameters that have a value."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.")))
    return F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))


def suspicious_parameters(url: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*P.CALLBACK_PARAMETERS, *P.DATA_PARAMETERS)])
    return F.array_intersect(names, url_parameters(url))


def url_findings(found: Column) -> Column:
    def of(u: Column) -> Column:
        odd, host = suspicious_parameters(u), url_authority(u)
        parameter = F.when(F.size(odd) > 0, R.finding("suspicious_url_param", "exfiltration_detector", "medium", 0.7, None, F.left(u, F.lit(100)), F.array_join(odd, ",")))
        sink = F.when(_contains(host, *P.DATA_SINKS), R.finding("known_data_sink", "exfiltration_detector", "high", 0.7, None, F.left(u, F.lit(100)), host))
        return F.array_compact(F.array(parameter, sink))

    return F.flatten(F.transform(found, of))


def exfiltration_parts(df: DataFrame) -> DataFrame:
    """Adds ``exf``. Addresses in hidden text count twice, as they stand in the joined text and are added again."""
    twice = T.bounded(F.concat(F.col("t_glued"), F.array_join("hidden", " ")))
    low = "t_glued_lower"
    parts = {"sending": SENDING.find(low), "collecting": COLLECTING.find(low), "calling": CALLING.find(low), "addresses": url_findings(urls(twice))}
    return df.withColumn("exf", F.struct(*[c.alias(k) for k, c in parts.items()]))


def detect_exfiltration(df: DataFrame) -> DataFrame:
    """Adds ``exfiltration_detector``: the mean of the constants of the categories that fired."""
    df = exfiltration_parts(df)
    p = F.col("exf")
    df = df.withColumn("exf_found", F.concat(p["sending"], p["collecting"], p["calling"], p["addresses"]))
    constants = F.array_compact(F.array(*[F.when(F.size(p[k]) > 0, s) for k, s in (("sending", 0.9), ("collecting", 0.85), ("calling", 0.8), ("addresses", 0.7))]))
    mean = F.aggregate(constants, F.lit(0.0), lambda a, x: a + x) / F.size(constants)
    n = F.size("exf_found")
    safe = R.result("exfiltration_detector", "safe", 0.0, 0.85, R.none(), "No data exfiltration patterns detected.")
    found = R.result("exfiltration_detector", T.level(mean, 0.85, 0.7, 0.5, 0.3), mean, T.cap(mean + 0.15, 0.95), F.col("exf_found"), F.format_string("Detected %d exfiltration/callback indicators.", n))
    return df.withColumn("exfiltration_detector", F.when(n == 0, safe).otherwise(found))


# ---- agentic intent -----------------------------------------------------------------------------

ACTION = Family("action_request", "agentic_intent_detector", tuple((p, s, a) for p, a, s in P.ACTIONS), lambda s: "critical" if s >= 0.85 else "high", 2)
AUTONOMOUS = Family("autonomy_request", "agentic_intent_detector", tuple((p, s, None) for p, s in P.AUTONOMY), lambda s: "high" if s >= 0.7 else "medium", 2)
BYPASS = Family("permission_bypass", "agentic_intent_detector", tuple((p, s, None) for p, s in P.BYPASSES), "critical", 2)
AGENT_LINK = Family("link_action", "agentic_intent_detector", tuple((p, s, None) for p, s in P.AGENT_LINKS), "critical", 2)


def agentic_risk(p: Column) -> Column:
    on = {k: F.size(p[k]) > 0 for k in ("actions", "autonomy", "bypass", "links")}
    base = F.greatest(*[R.top(p[k]) for k in on])
    n = sum((c.cast("int") for c in on.values()), F.lit(0))
    risk = F.when(n >= 3, T.cap(base * 1.4)).when(n == 2, T.cap(base * 1.2)).otherwise(base)
    risk = F.when(on["bypass"] | on["links"], F.greatest(risk, F.lit(0.85))).otherwise(risk)
    return T.cap(F.when(on["actions"] & on["autonomy"], T.cap(risk + 0.15)).otherwise(risk))


def agentic_parts(df: DataFrame) -> DataFrame:
    low = "t_spaced_lower"
    parts = {"actions": ACTION.find(low), "autonomy": AUTONOMOUS.find(low), "bypass": BYPASS.find(low), "links": AGENT_LINK.find(low)}
    return df.withColumn("agt", F.struct(*[c.alias(k) for k, c in parts.items()]))


def detect_agentic(df: DataFrame) -> DataFrame:
    """Adds ``agentic_intent_detector`` and ``requested_actions`` (distinct, sorted; empty below medium)."""
    df = agentic_parts(df)
    p = F.col("agt")
    df = df.withColumns({"agt_found": F.concat(p["actions"], p["autonomy"], p["bypass"], p["links"]), "agt_risk": agentic_risk(p)})
    risk, found = F.col("agt_risk"), F.col("agt_found")
    actions = F.array_sort(F.array_distinct(F.transform(p["actions"], lambda f: f["label"])))
    critical, high = R.number(found, severity="critical"), R.number(found, severity="high")
    severe = F.concat_ws(", ", F.when(critical > 0, F.format_string("%d critical", critical)), F.when(high > 0, F.format_string("%d high-risk", high)))
    details = F.concat(
        F.concat_ws(". ", F.format_string("Agentic intent: %d indicator(s)", F.size(found)), F.when(F.size(actions) > 0, F.concat(F.lit("Actions: "), F.array_join(F.slice(actions, 1, 5), ", "))), F.when(severe != "", severe)), F.lit(".")
    )
    level = T.level(risk, 0.85, 0.65, 0.4, 0.15)
    safe = R.result("agentic_intent_detector", "safe", 0.0, 0.9, R.none(), "No agentic intent detected.")
    out = F.when(F.size(found) == 0, safe).otherwise(R.result("agentic_intent_detector", level, risk, T.cap(risk + 0.15, 0.95), found, details))
    df = df.withColumn("agentic_intent_detector", out)
    serious = F.col("agentic_intent_detector.risk_level").isin("medium", "high", "critical")
    return df.withColumn("requested_actions", F.when(serious, actions).otherwise(F.array().cast("array<string>")))


# ---- context hijacking --------------------------------------------------------------------------

SEPARATOR = Family("separator", "houyi_pattern_detector", plain(P.SEPARATORS), "medium", shown=50)
CLOSURE = Family("closure_separator", "houyi_pattern_detector", plain(P.CLOSURES), "medium", shown=50)
REDEFINING = Family("task_redefinition", "houyi_pattern_detector", plain(P.REDEFINITIONS, 0.7), "high", 3, shown=80)
LEAKING = Family("prompt_leak", "houyi_pattern_detector", plain(P.LEAKS, 0.9), "critical", 3, shown=80)
SHAPING = Family("output_shaping", "houyi_pattern_detector", plain(P.SHAPING, 0.6), "medium", 3, shown=80)
RETASK = Family("data_to_question_retasking", "houyi_pattern_detector", plain(P.RETASKING), "high", flags="(?is)", shown=100)


def split_sentences(text: Column) -> Column:
    return F.split(text, "[.!?]+", -1)


def language_switch(text: Column) -> Column:
    """One finding if one of the scripts first stands behind more than 20 characters."""
    rows = [
        F.when((F.regexp_instr(text, F.lit(p)) > 0) & (F.length(F.trim(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(p)) - 1))) > 20), R.finding("language_switch", "houyi_pattern_detector", "medium", None))
        for p in P.LANGUAGES
    ]
    foreign = F.rlike(text, F.lit("[" + "".join(p[1:-2] for p in P.LANGUAGES) + "]"))
    return F.when(foreign, F.slice(F.array_compact(F.array(*rows)), 1, 1)).otherwise(R.none())


def topic_drift(parts: Column) -> Column:
    """1 less the share of the first half's topic words that the last quarter has too, of sentences; 0 if one has none or there are under 4."""
    n = F.size(parts)
    first = F.lower(F.array_join(F.slice(parts, F.lit(1), F.floor(n / 2).cast("int")), " "))
    skip = F.floor(n * 3 / 4).cast("int")
    last = F.lower(F.array_join(F.slice(parts, skip + 1, n - skip), " "))
    topics = F.array(*[F.lit(t) for t in P.TOPICS])
    a, b = F.filter(topics, lambda t: F.contains(first, t)), F.filter(topics, lambda t: F.contains(last, t))
    drift = 1.0 - F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when((n >= 4) & (F.size(a) > 0) & (F.size(b) > 0), drift).otherwise(0.0)


def hijack_parts(df: DataFrame) -> DataFrame:
    """Adds ``hou``: findings of each component and the drift (0 unless it is above 0.6 and there is a separator)."""
    text, low = F.col("t_lines"), F.col("t_lines_lower")
    df = df.withColumn("hou_parts", split_sentences(text))
    parts = F.col("hou_parts")
    half = F.array_join(F.slice(parts, F.lit(1), F.floor(F.size(parts) / 2).cast("int")), " ")
    framework = F.when((F.size(parts) >= 3) & T.any_of(half, P.FRAMEWORK, low=low), F.array(R.finding("framework_component", "houyi_pattern_detector", "low", None))).otherwise(R.none())
    separators = F.concat(SEPARATOR.find("t_lines", None, "t_lines_lower"), CLOSURE.find("t_lines", None, "t_lines_lower"), language_switch(text))
    disruptors = F.concat(*[f.find("t_lines", None, "t_lines_lower") for f in (REDEFINING, LEAKING, SHAPING)])
    df = df.withColumn("hou", F.struct(framework.alias("framework"), separators.alias("separators"), disruptors.alias("disruptors")))
    some = F.size("hou.separators") > 0
    drift = F.when(some, topic_drift(parts)).otherwise(0.0)
    retasking = F.when(some, RETASK.find("t_lines", None, "t_lines_lower")).otherwise(R.none())
    return df.withColumn("hou_more", F.struct(drift.alias("drift"), retasking.alias("retasking")))


def detect_hijack(df: DataFrame) -> DataFrame:
    """Adds ``houyi_pattern_detector``, by which of framework, separator and disruptor are present."""
    df = hijack_parts(df)
    h, more = F.col("hou"), F.col("hou_more")
    drifts = more["drift"] > 0.6
    drift = F.when(drifts, more["drift"]).otherwise(0.0)
    framework = F.when(F.size(h["framework"]) > 0, 0.3).otherwise(0.0)
    separators = F.size(h["separators"]) * F.lit(0.25)
    disruptor = F.greatest(R.top(h["disruptors"]), drift, F.when(F.size(more["retasking"]) > 0, 0.75).otherwise(0.0))
    df = df.withColumn("hou_score", F.struct(framework.alias("f"), separators.alias("s_all"), T.cap(separators).alias("s"), disruptor.alias("d")))
    s = F.col("hou_score")
    n = (s["f"] > 0).cast("int") + (s["s"] > 0).cast("int") + (s["d"] > 0).cast("int")
    whole = s["f"] * 0.2 + s["s"] * 0.3 + s["d"] * 0.5
    whole = F.when(R.has(h["disruptors"], "prompt_leak"), T.cap(whole + 0.25)).otherwise(whole)
    whole = F.when(drifts, T.cap(whole + 0.15)).otherwise(whole)
    whole = T.cap(F.when(F.size(more["retasking"]) > 0, T.cap(whole + 0.2)).otherwise(whole))
    risk = F.when(n == 0, 0.0).when(n == 1, F.greatest(s["f"], s["s"], s["d"]) * 0.3).when(n == 2, T.cap((s["f"] + s["s"] + s["d"]) * 0.4, 0.65)).otherwise(whole)
    drifted = F.when(drifts, F.array(R.finding("semantic_drift", "houyi_pattern_detector", "high", more["drift"]))).otherwise(R.none())
    df = df.withColumns({"hou_risk": risk, "hou_n": n, "hou_found": F.concat(h["framework"], h["separators"], h["disruptors"], drifted, more["retasking"])})
    critical, high = R.number(F.col("hou_found"), severity="critical"), R.number(F.col("hou_found"), severity="high")
    sure = F.when(F.col("hou_n") == 0, 0.9).when(F.col("hou_n") == 1, 0.6).when(F.col("hou_n") == 2, 0.75).when(critical > 0, 0.95).otherwise(0.85)
    names = F.concat_ws(", ", F.when(s["f"] > 0, F.lit("framework")), F.when(s["s_all"] > 0, F.format_string("separator (%.2f)", s["s_all"])), F.when(s["d"] > 0, F.format_string("disruptor (%.2f)", s["d"])))
    details = F.when(F.col("hou_n") == 0, "No HOUYI-style pattern components detected.").otherwise(
        F.concat(
            F.concat_ws(
                ". ",
                F.format_string("HOUYI pattern analysis: %d/3 components present", F.col("hou_n")),
                F.concat(F.lit("Components: "), names),
                F.format_string("Overall risk: %.2f", F.col("hou_risk")),
                F.when(critical > 0, F.format_string("%d critical indicator(s)", critical)),
                F.when(high > 0, F.format_string("%d high-risk indicator(s)", high)),
            ),
            F.lit("."),
        )
    )
    return df.withColumn("houyi_pattern_detector", R.result("houyi_pattern_detector", T.level(F.col("hou_risk"), 0.85, 0.65, 0.4, 0.2), F.col("hou_risk"), sure, F.col("hou_found"), details))


# ---- recognised text of images ------------------------------------------------------------------

OCR_INSTRUCTION = Family("ocr_instruction", "ocr_instruction_detector", tuple((p, s, label) for p, label, s in P.OCR_INSTRUCTIONS), "high")
OCR_KEYWORD = Family("ocr_suspicious_keyword", "keyword_detector", literal(P.OCR_KEYWORDS, 0.65), "high")
OCR_BASELINE = 0.25
OCR_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp")


def can_recognise(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*OCR_SUFFIXES)


def analyze_ocr(df: DataFrame, text_col: str = "ocr_text", baseline: float = OCR_BASELINE) -> DataFrame:
    """Adds ``ocr_content_analyzer`` for text recognised in an image; low with the baseline risk where there is none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    hexes = F.regexp_extract_all(text, F.lit(r"(?:0x|\\x)?[0-9a-fA-F]{16,}"), F.lit(0))
    encoded = F.array_compact(
        F.array(
            F.when(F.size(runs) > 2, R.finding("ocr_encoding", "encoding_detector", "medium", 0.6, None, F.get(runs, 0), "base64")),
            F.when(F.size(hexes) > 1, R.finding("ocr_encoding", "encoding_detector", "medium", 0.55, None, F.get(hexes, 0), "hexadecimal")),
        )
    )
    links = F.transform(F.slice(urls(text), 1, 3), lambda u: R.finding("ocr_url", "url_detector", "medium", 0.5, None, u))
    df = df.withColumn("t_ocr_lower", low).withColumn("ocr_found", F.concat(OCR_INSTRUCTION.find("t_ocr_lower", "ocr"), encoded, links, OCR_KEYWORD.find("t_ocr_lower", "ocr")))
    risk = F.greatest(R.top(F.col("ocr_found")), F.lit(baseline))
    empty = R.result("ocr_content_analyzer", "low", baseline, 0.8, F.array(R.finding("empty_ocr", "ocr_content_analyzer", "low", None)), "Image processed but no text extracted.")
    details = F.format_string("Analyzed %d characters: %d finding(s), maximum risk %.2f.", F.length(text), F.size("ocr_found"), risk)
    return df.withColumn("ocr_content_analyzer", F.when(text == "", empty).otherwise(R.result("ocr_content_analyzer", T.level(risk, 0.8, 0.6, 0.4, 0.2), risk, 0.85, F.col("ocr_found"), details)))


def word_box(words: Column, offset: Column) -> Column:
    """The box of the recognised word at a character offset: each word covers its length and one blank; null if none.

    ``words``: array<struct<text, left, top, width, height, conf>>; null elements never cover anything.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("i"), F.lit(-1).alias("hit"))

    def step(acc: Column, w: Column) -> Column:
        end = acc["at"] + F.coalesce(F.length(w["text"]), F.lit(0)) + 1
        here = (acc["at"] <= offset) & (offset < end) & (acc["hit"] < 0)
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(here, acc["i"] + 1).otherwise(acc["hit"]).alias("hit"))

    hit = F.aggregate(words, start, step, lambda a: a["hit"])
    return F.when(hit >= 0, F.get(words, hit))
