"""Queries of ingestion and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.operators import detectors as D
from wardflow.operators import encoded as E
from wardflow.operators import findings as R
from wardflow.operators import html as H
from wardflow.operators import semantic as S
from wardflow.plans import sql as Q
from wardflow.plans.catalog import query
from wardflow.plans.planted import content_inputs, content_sql, document_inputs, document_sql


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_texts(content_inputs(spark, sf))


def r6(c) -> F.Column:
    return F.round(c, 6)


CONTENT = content_sql()
LEVELS_INJ = (0.85, 0.7, 0.5, 0.3)


# ---- flagship -----------------------------------------------------------------------------------

_INJ_TOP = Q.top("lower(substr(visible, 1, 100000))", P.INJECTIONS)


@query(f"{document_sql()}, s AS (SELECT greatest({_INJ_TOP}, {Q.most_hidden(Q.top('lower(x)', P.INJECTIONS))}) AS risk FROM t) SELECT {Q.ladder('risk', *LEVELS_INJ)} AS risk_level, count(*) AS n_documents, round(avg(risk), 6) AS mean_risk FROM s GROUP BY 1")
def risk_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = D.injection_parts(T.with_texts(document_inputs(spark, sf)))
    risk = df.select(R.top(F.col("inj.patterns")).alias("risk"))
    return risk.groupBy(T.level(F.col("risk"), *LEVELS_INJ).alias("risk_level")).agg(F.count(F.lit(1)).alias("n_documents"), r6(F.avg("risk")).alias("mean_risk"))


# ---- ingestion ----------------------------------------------------------------------------------


@query(
    """SELECT kind, is_html, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(trim(raw), '^https?://') THEN 'url' ELSE 'text' END AS kind, coalesce(regexp_matches(raw, '<[^>]+>'), false) AS is_html
 FROM (SELECT CASE WHEN content_id % 3 = 0 THEN ' ' || coalesce(element_at(metadata, 'url')[1], 'none') WHEN content_id % 3 = 1 THEN raw_html ELSE visible_text END AS raw FROM extracted_content)) GROUP BY 1, 2"""
)
def scan_type_sniff(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/extracted_content.parquet")
    kind = F.col("content_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit(" "), F.coalesce(F.col("metadata")["url"], F.lit("none")))).when(kind == 1, F.col("raw_html")).otherwise(F.col("visible_text"))
    df = df.select(raw.alias("raw"))
    return df.groupBy(H.input_kind(F.col("raw")).alias("kind"), F.coalesce(H.contains_html(F.col("raw")), F.lit(False)).alias("is_html")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT content_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS visible
 FROM extracted_content WHERE raw_html IS NOT NULL AND raw_html <> ''"""
)
def scan_visible_text_native(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/extracted_content.parquet").filter("raw_html IS NOT NULL AND raw_html <> ''")
    return df.select("content_id", H.visible_text_by_pattern(F.col("raw_html")).alias("visible"))


_SPANS = " UNION ALL ".join(f"SELECT '{c}' AS channel, unnest(regexp_extract_all(raw_html, {Q.pattern(p, '(?is)')})) AS txt FROM extracted_content" for c, p in H.HIDDEN_SPANS)


@query(f"SELECT channel, count(*) AS n, sum(length(txt))::BIGINT AS n_chars FROM ({_SPANS}) GROUP BY channel")
def scan_hidden_spans(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/extracted_content.parquet").select(F.explode(H.hidden_spans(F.col("raw_html"))).alias("s"))
    return df.groupBy("s.channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s.text")).alias("n_chars"))


@query(
    """SELECT coalesce(nullif(lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)), ''), 'none') AS scheme, count(DISTINCT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS n_domains, count(*) AS n
 FROM (SELECT element_at(metadata, 'url')[1] AS url, coalesce(raw_html, visible_text) AS raw FROM extracted_content) WHERE url IS NOT NULL AND raw IS NOT NULL GROUP BY 1"""
)
def scan_page_domains(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/extracted_content.parquet").select(F.coalesce("raw_html", "visible_text").alias("raw"), F.col("metadata")["url"].alias("url"))
    m = F.col("metadata")
    pages = H.extract(df.filter("url IS NOT NULL AND raw IS NOT NULL"), url_col="url")
    return pages.groupBy(F.coalesce(F.nullif(m["scheme"], F.lit("")), F.lit("none")).alias("scheme")).agg(F.countDistinct(m["domain"]).alias("n_domains"), F.count(F.lit(1)).alias("n"))


_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_entity}', {Q.quoted(_sign)})"
_IN_ORDER = ", ".join([f"list_transform(regexp_extract_all(raw_html, {Q.pattern(p, '(?is)')}), lambda x: '{c}')" for c, p in H.HIDDEN_SPANS] + [
    "list_transform(regexp_extract_all(raw_html, '<[a-z]+ style=.(?:display:none|visibility: hidden|opacity:0).>'), lambda x: 'css_hidden')", "list_transform(regexp_extract_all(raw_html, '(?s)<!--.*?-->'), lambda x: 'html_comment')"])


@query(
    f"""SELECT input_id, CASE WHEN html THEN length({_VISIBLE}) ELSE length(coalesce(raw_html, '')) END::INTEGER AS n_visible, CASE WHEN html THEN len(channels) ELSE 0 END::INTEGER AS n_hidden, CASE WHEN html THEN array_to_string(channels, ',') END AS channels
 FROM (SELECT content_id AS input_id, raw_html, coalesce(regexp_matches(raw_html, '<[^>]+>'), false) AS html, list_concat({_IN_ORDER}) AS channels FROM extracted_content)"""
)
def scan_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The parser's result of every page, with its hidden elements by channel. The SQL knows the hiding styles that the pages have."""
    df = spark.read.parquet(f"{sf}/extracted_content.parquet").select(F.col("content_id").alias("input_id"), F.col("raw_html").alias("raw"))
    out = H.extract(df)
    return out.select("input_id", F.length("visible").alias("n_visible"), F.size("hidden").alias("n_hidden"), F.array_join(F.transform("locations", lambda x: x["channel"]), ",").alias("channels"))


# ---- injection ----------------------------------------------------------------------------------

_CHUNK = "lower(substr(visible, 1, 100000))"
_PATTERN_COUNT = f"({Q.count(_CHUNK, [p for p, _ in P.INJECTIONS])} + {Q.each_hidden(Q.count('lower(x)', [p for p, _ in P.INJECTIONS]))})"
_ROLE_COUNT = f"({Q.count(_CHUNK, P.ROLES)} + {Q.each_hidden(Q.count('lower(x)', P.ROLES))})"
_SWITCH_COUNT = Q.count("glued", P.CONTEXT_SWITCHES)
_QUOTE_COUNT = Q.count("glued", [p for p, _ in P.QUOTES], None, "(?is)")
_REPEATED = f"len(regexp_extract_all(lower(glued), {Q.quoted(D.REPETITION)}))"
_INJ_RISK = f"greatest(CASE WHEN n_patterns > 0 THEN pattern_risk ELSE 0.0 END, CASE WHEN n_switches > 0 THEN 0.85 ELSE 0.0 END, CASE WHEN n_roles > 0 THEN 0.8 ELSE 0.0 END, CASE WHEN n_structure > 0 THEN 0.7 ELSE 0.0 END)::DOUBLE"
INJ_SQL = f"""inj0 AS (SELECT input_id, {_PATTERN_COUNT}::BIGINT AS n_patterns, greatest({_INJ_TOP}, {Q.most_hidden(Q.top('lower(x)', P.INJECTIONS))}) AS pattern_risk, {_SWITCH_COUNT}::BIGINT AS n_switches,
 {_ROLE_COUNT}::BIGINT AS n_roles, {_REPEATED}::BIGINT AS n_repeated, ({_QUOTE_COUNT} + CASE WHEN {_REPEATED} >= 3 THEN 1 ELSE 0 END)::BIGINT AS n_structure FROM t),
inj AS (SELECT *, {_INJ_RISK} AS score FROM inj0),
inj_r AS (SELECT input_id, score, {Q.ladder('score', *LEVELS_INJ)} AS level, CASE WHEN n_patterns + n_switches + n_roles + n_structure = 0 THEN 0.9 ELSE least(score + 0.1, 0.95) END::DOUBLE AS conf FROM inj)"""


@query(f"{CONTENT}, {INJ_SQL} SELECT input_id, n_patterns, pattern_risk FROM inj")
def inj_patterns(spark: SparkSession, sf: str) -> DataFrame:
    df = D.injection_parts(_content(spark, sf))
    return df.select("input_id", F.size("inj.patterns").cast("long").alias("n_patterns"), R.top(F.col("inj.patterns")).alias("pattern_risk"))


@query(f"{CONTENT}, {INJ_SQL} SELECT input_id, n_switches, n_roles FROM inj")
def inj_switches_roles(spark: SparkSession, sf: str) -> DataFrame:
    df = D.injection_parts(_content(spark, sf))
    return df.select("input_id", F.size("inj.switches").cast("long").alias("n_switches"), F.size("inj.roles").cast("long").alias("n_roles"))


@query(f"{CONTENT}, {INJ_SQL} SELECT input_id, CASE WHEN n_repeated >= 3 THEN n_repeated END AS n_repeated, n_structure FROM inj")
def inj_repetition(spark: SparkSession, sf: str) -> DataFrame:
    df = D.injection_parts(_content(spark, sf))
    repeated = F.get(F.filter("inj.structure", lambda f: f["type"] == "repetition_attack"), 0)["label"]
    return df.select("input_id", repeated.cast("long").alias("n_repeated"), F.size("inj.structure").cast("long").alias("n_structure"))


@query(f"{CONTENT}, {INJ_SQL} SELECT input_id, round(score, 6) AS risk_score, level AS risk_level, round(conf, 6) AS confidence FROM inj_r")
def inj_result(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("prompt_injection_detector")
    return D.detect_injection(_content(spark, sf)).select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), r6(m["confidence"]).alias("confidence"))


_LOC = r"\b(ignore|disregard)\s+[a-z]+"


@query(f"{document_sql()}, m AS (SELECT input_id, visible, regexp_extract_all(visible, {Q.pattern(_LOC)}) AS ms FROM t), f AS (SELECT input_id, visible, ms[1] AS m1, strpos(visible, ms[1]) - 1 AS pos, len(ms) AS n_found FROM m WHERE len(ms) > 0) SELECT input_id, n_found::BIGINT AS n_found, m1 AS matched, pos::BIGINT AS char_offset, (length(substr(visible, 1, pos)) - length(replace(substr(visible, 1, pos), chr(10), '')) + 1)::BIGINT AS line_number FROM f")
def text_locations(spark: SparkSession, sf: str) -> DataFrame:
    df = document_inputs(spark, sf).withColumn("at", T.find_locations(F.col("visible"), _LOC, "visible")).filter(F.size("at") > 0)
    first = F.get("at", 0)
    return df.select("input_id", F.size("at").cast("long").alias("n_found"), first["matched"].alias("matched"), first["location"]["char_offset"].cast("long").alias("char_offset"), first["location"]["line_number"].cast("long").alias("line_number"))


# ---- intent -------------------------------------------------------------------------------------


def _imperative_sql(col: str) -> str:
    score = "CASE WHEN contains(m, 'ignore') OR contains(m, 'disregard') OR contains(m, 'forget') THEN 0.85 WHEN contains(m, 'must') OR contains(m, 'shall') OR contains(m, 'need to') THEN 0.7 ELSE 0.5 END"
    every = "list_concat(" + ", ".join(Q.hits(col, p, 3) for p in P.IMPERATIVES) + ")"
    return f"coalesce(list_max(list_transform({every}, lambda m: {score})), 0.0)::DOUBLE"


def _outcome_sql(col: str) -> str:
    every = "list_concat(" + ", ".join(Q.hits(col, p, 3) for p in P.OUTCOMES) + ")"
    return f"coalesce(list_max(list_transform({every}, lambda m: CASE WHEN contains(m, 'without') OR contains(m, 'silently') THEN 0.75 ELSE 0.55 END)), 0.0)::DOUBLE"


INTENT_SQL = f"""sig AS (SELECT input_id, {Q.top('low', [(p, 0.9) for p in P.CONDITIONAL_AI])} AS conditional_ai, {_imperative_sql('low')} AS imperative, {Q.top('low', [(p, 0.6) for p in P.CAPABILITIES])} AS capability,
 {_outcome_sql('low')} AS outcome, {Q.top('spaced', [(p, 0.9) for p in P.INTENT_LINKS])} AS link_action, ({' + '.join(f"CASE WHEN regexp_matches(low, {Q.pattern(p)}) THEN 1 ELSE 0 END" for p in P.DESCRIPTIVE)}) * 0.2::DOUBLE AS descriptive FROM t),
sig2 AS (SELECT *, imperative + capability * 0.7::DOUBLE + outcome * 0.8::DOUBLE AS strength, greatest(imperative, capability, outcome) AS most FROM sig),
tree AS (SELECT *, CASE WHEN link_action > 0.5 THEN 'malicious' WHEN conditional_ai > 0.5 AND most > 0.3 THEN 'conditional_instructional' WHEN conditional_ai > 0.5 THEN 'ambiguous' WHEN strength > 0.8 THEN 'instructional'
 WHEN strength > 0.4 AND descriptive > strength * 1.5 THEN 'descriptive' WHEN strength > 0.4 AND descriptive > strength THEN 'ambiguous' WHEN strength > 0.4 THEN 'instructional' WHEN descriptive > 0.2 OR strength < 0.1 THEN 'descriptive' ELSE 'ambiguous' END AS intent,
 CASE WHEN link_action > 0.5 THEN 0.95 WHEN conditional_ai > 0.5 AND most > 0.3 THEN least(0.95, 0.8 + conditional_ai * 0.15) WHEN conditional_ai > 0.5 THEN 0.65 WHEN strength > 0.8 THEN least(0.9, 0.75 + strength * 0.1)
 WHEN strength > 0.4 AND descriptive > strength * 1.5 THEN 0.7 WHEN strength > 0.4 AND descriptive > strength THEN 0.6 WHEN strength > 0.4 THEN 0.7 WHEN descriptive > 0.2 OR strength < 0.1 THEN 0.8 ELSE 0.6 END::DOUBLE AS conf,
 CASE WHEN link_action > 0.5 THEN 0.95 WHEN conditional_ai > 0.5 AND most > 0.3 THEN least(1.0, 0.7 + conditional_ai * 0.2 + most * 0.15) WHEN conditional_ai > 0.5 THEN 0.45 WHEN strength > 0.8 THEN least(1.0, 0.5 + strength * 0.3)
 WHEN strength > 0.4 AND descriptive > strength * 1.5 THEN 0.1 WHEN strength > 0.4 AND descriptive > strength THEN 0.35 WHEN strength > 0.4 THEN 0.45 + strength * 0.2 WHEN descriptive > 0.2 OR strength < 0.1 THEN 0.05 ELSE 0.3 END::DOUBLE AS score FROM sig2),
int_r AS (SELECT input_id, intent, score, {Q.ladder('score', 0.8, 0.6, 0.4, 0.15)} AS level, conf FROM tree)"""
_SIGNALS = ("conditional_ai", "imperative", "capability", "outcome", "link_action", "descriptive")


@query(f"{CONTENT}, {INTENT_SQL} SELECT input_id, {', '.join(f'round({s}, 6) AS {s}' for s in _SIGNALS)} FROM sig")
def intent_signals(spark: SparkSession, sf: str) -> DataFrame:
    df = D.intent_signals(_content(spark, sf))
    return df.select("input_id", *[r6(F.col("signal_scores")[s]).alias(s) for s in _SIGNALS])


@query(f"{CONTENT}, {INTENT_SQL} SELECT input_id, intent, level AS risk_level, round(score, 6) AS risk_score, round(conf, 6) AS confidence FROM int_r")
def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("intent_classifier")
    return D.classify_intent(_content(spark, sf)).select("input_id", F.col("primary_intent").alias("intent"), m["risk_level"].alias("risk_level"), r6(m["risk_score"]).alias("risk_score"), r6(m["confidence"]).alias("confidence"))


STRENGTH_SQL = f"""st0 AS (SELECT t.input_id, intent, {Q.joined('low', P.WEAK_CONDITIONALS)} AS w, {Q.joined('low', P.MEDIUM_CONDITIONALS)} AS m, {Q.joined('low', P.STRONG_IMPERATIVES)} AS s, {Q.joined('low', P.STRENGTH_CAPABILITIES)} AS c,
 {Q.joined('low', P.STRENGTH_OUTCOMES)} AS o, {Q.joined('low', P.WEAK_MARKERS)} AS wm, {Q.joined('low', P.STRONG_MARKERS)} AS sm FROM t JOIN int_r USING (input_id)),
st1 AS (SELECT *, greatest(0.0::DOUBLE, least(s * 0.4::DOUBLE, 1.0) + CASE WHEN c > 1 AND o > 0 THEN 0.4::DOUBLE WHEN c > 1 THEN 0.2::DOUBLE ELSE 0.0 END + m * 0.15::DOUBLE + w * 0.05::DOUBLE + (sm * 0.1::DOUBLE + wm * (-0.1::DOUBLE))) AS signal,
 s + CASE WHEN c > 1 AND o > 0 THEN 2 WHEN c > 1 THEN 1 ELSE 0 END + m + w AS total FROM st0)"""


@query(
    f"""{CONTENT}, {INTENT_SQL}, {STRENGTH_SQL} SELECT input_id, CASE WHEN intent NOT IN ('instructional', 'conditional_instructional', 'ambiguous') THEN 'weak' WHEN total = 0 THEN 'weak' WHEN signal >= 0.7 THEN 'strong' WHEN signal >= 0.35 THEN 'medium' ELSE 'weak' END AS strength,
 round(CASE WHEN intent NOT IN ('instructional', 'conditional_instructional', 'ambiguous') THEN 0.0 ELSE signal END, 6) AS signal FROM st1"""
)
def intent_strength(spark: SparkSession, sf: str) -> DataFrame:
    df = D.classify_intent(_content(spark, sf)).withColumn("s", D.intent_strength(F.col("t_spaced"), F.col("primary_intent")))
    return df.select("input_id", "s.strength", r6(F.col("s.signal")).alias("signal"))


@query(
    f"""SELECT content_id, i::BIGINT AS element, ({Q.found('lower(h)', P.BENIGN_METADATA, '')} OR {Q.found('trim(h)', P.BENIGN_COMMENTS, '')} OR (length(h) < 50 AND {Q.found('lower(h)', P.BENIGN_NOISE, '')})) AS benign
 FROM (SELECT content_id, unnest(range(len(hidden_elements))) AS i, unnest(hidden_elements) AS h FROM extracted_content)"""
)
def hidden_benign(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/extracted_content.parquet").select("content_id", F.posexplode("hidden_elements").alias("element", "h"))
    return df.select("content_id", F.col("element").cast("long").alias("element"), D.is_benign_hidden(F.col("h")).alias("benign"))


# ---- hidden content -----------------------------------------------------------------------------

_KW = "(" + " + ".join(f"CASE WHEN contains(lower(x), {Q.quoted(k)}) THEN 1 ELSE 0 END" for k in P.HIDDEN_KEYWORDS) + ")"
HIDDEN_SQL = f"""hid0 AS (SELECT input_id, len(hidden) AS n_hidden, {Q.each_hidden(_KW)} AS kw, {Q.each_hidden(Q.count('x', P.OBFUSCATION))} AS ob,
 {Q.each_hidden("CASE WHEN contains(lower(x), '<script') THEN " + Q.count('x', P.DANGEROUS_SCRIPTS) + " ELSE 0 END")} AS sc, coalesce(list_sum(list_transform(hidden, lambda x: length(x))), 0) AS hlen, length(visible) AS vlen FROM t),
hid AS (SELECT *, CASE WHEN kw + ob + sc = 0 THEN 0.0 ELSE (kw * 0.85::DOUBLE + ob * 0.65::DOUBLE + sc * 0.9::DOUBLE) / (kw + ob + sc) END AS score FROM hid0),
hid_r AS (SELECT input_id, score, {Q.ladder('score', 0.8, 0.6, 0.4, 0.2)} AS level, CASE WHEN n_hidden = 0 THEN 0.95 WHEN kw + ob + sc = 0 THEN 0.85 ELSE least(score + 0.2, 0.95) END::DOUBLE AS conf FROM hid)"""


@query(f"{CONTENT}, {HIDDEN_SQL} SELECT input_id, kw::BIGINT AS n_keywords, ob::BIGINT AS n_obfuscations, sc::BIGINT AS n_scripts, (vlen > 0 AND hlen > vlen * 5) AS size_anomaly FROM hid")
def hidden_findings(spark: SparkSession, sf: str) -> DataFrame:
    df = D.analyze_hidden(_content(spark, sf))
    kind = lambda k: R.number(F.col("hidden_all"), type=k)
    return df.select("input_id", kind("instruction_keyword").cast("long").alias("n_keywords"), kind("obfuscation").cast("long").alias("n_obfuscations"), kind("dangerous_script").cast("long").alias("n_scripts"), (kind("size_anomaly") > 0).alias("size_anomaly"))


@query(f"{CONTENT}, {HIDDEN_SQL} SELECT input_id, round(score, 6) AS risk_score, level AS risk_level, round(conf, 6) AS confidence FROM hid_r")
def hidden_result(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("hidden_content_analyzer")
    return D.analyze_hidden(_content(spark, sf)).select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), r6(m["confidence"]).alias("confidence"))


# ---- exfiltration -------------------------------------------------------------------------------

_NAMES = (*P.CALLBACK_PARAMETERS, *P.DATA_PARAMETERS)
_QUERY = r"regexp_extract(u, '^[^?#]*\?([^#]*)', 1)"
_ODD = "(" + " + ".join(f"CASE WHEN list_contains(list_transform(list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(p, '^[^=]+=.')), lambda p: split_part(p, '=', 1)), '{x}') THEN 1 ELSE 0 END" for x in _NAMES) + ")"
_HOST = "regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)"
_SINK = "(" + " OR ".join(f"contains({_HOST}, '{x}')" for x in P.DATA_SINKS) + ")"
EXF_SQL = f"""ex0 AS (SELECT input_id, {Q.count('glow', P.EXFILTRATION)} AS n_sending, {Q.count('glow', P.COLLECTION)} AS n_collecting, {Q.count('glow', P.CALLBACKS)} AS n_calling,
 regexp_extract_all(substr(glued || hj, 1, 200000), {Q.quoted(P.URL)}) AS us FROM t),
ex1 AS (SELECT *, len(us) AS n_urls, coalesce(list_sum(list_transform(us, lambda u: CASE WHEN {_ODD} > 0 THEN 1 ELSE 0 END)), 0) AS n_odd, coalesce(list_sum(list_transform(us, lambda u: CASE WHEN {_SINK} THEN 1 ELSE 0 END)), 0) AS n_sinks FROM ex0),
ex AS (SELECT *, CASE WHEN n_sending > 0 THEN 1 ELSE 0 END AS a, CASE WHEN n_collecting > 0 THEN 1 ELSE 0 END AS b, CASE WHEN n_calling > 0 THEN 1 ELSE 0 END AS c, CASE WHEN n_odd + n_sinks > 0 THEN 1 ELSE 0 END AS d FROM ex1),
exf_r AS (SELECT input_id, score, {Q.ladder('score', *LEVELS_INJ)} AS level, CASE WHEN cats = 0 THEN 0.85 ELSE least(score + 0.15, 0.95) END::DOUBLE AS conf FROM (SELECT input_id, a + b + c + d AS cats, CASE WHEN a + b + c + d = 0 THEN 0.0 ELSE (a * 0.9::DOUBLE + b * 0.85::DOUBLE + c * 0.8::DOUBLE + d * 0.7::DOUBLE) / (a + b + c + d) END AS score FROM ex))"""


@query(f"{CONTENT}, {EXF_SQL} SELECT input_id, n_sending::BIGINT AS n_sending, n_collecting::BIGINT AS n_collecting, n_calling::BIGINT AS n_calling, n_urls::BIGINT AS n_urls, n_odd::BIGINT AS n_odd, n_sinks::BIGINT AS n_sinks FROM ex")
def exfil_categories(spark: SparkSession, sf: str) -> DataFrame:
    df = D.exfiltration_parts(_content(spark, sf))
    size = lambda k: F.size(F.col("exf")[k]).cast("long")
    urls = F.size(D.urls(T.bounded(F.concat(F.col("t_glued"), F.array_join("hidden", " "))))).cast("long")
    kind = lambda k: R.number(F.col("exf.addresses"), type=k).cast("long")
    return df.select("input_id", size("sending").alias("n_sending"), size("collecting").alias("n_collecting"), size("calling").alias("n_calling"), urls.alias("n_urls"), kind("suspicious_url_param").alias("n_odd"), kind("known_data_sink").alias("n_sinks"))


@query(f"{CONTENT}, {EXF_SQL} SELECT input_id, round(score, 6) AS risk_score, level AS risk_level, round(conf, 6) AS confidence FROM exf_r")
def exfil_result(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("exfiltration_detector")
    return D.detect_exfiltration(_content(spark, sf)).select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), r6(m["confidence"]).alias("confidence"))


@query(f"{CONTENT}, us AS (SELECT input_id, unnest(regexp_extract_all(spaced, {Q.quoted(P.URL)})) AS u FROM t) SELECT {_HOST} AS domain, count(*) AS n, count(DISTINCT input_id) AS n_inputs, max({_ODD})::BIGINT AS most_parameters FROM us GROUP BY 1")
def exfil_domains(spark: SparkSession, sf: str) -> DataFrame:
    df = _content(spark, sf).select("input_id", F.explode(D.urls(F.col("t_spaced"))).alias("u"))
    return df.groupBy(D.url_authority(F.col("u")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("input_id").alias("n_inputs"), F.max(F.size(D.suspicious_parameters(F.col("u")))).cast("long").alias("most_parameters"))


# ---- agentic ------------------------------------------------------------------------------------

_ACTIONS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {Q.pattern(p)}) THEN '{a}' END" for p, a, _ in P.ACTIONS) + "], lambda x: x IS NOT NULL)))"
AGT_SQL = f"""ag0 AS (SELECT input_id, {_ACTIONS} AS actions, {Q.top('low', [(p, s) for p, _, s in P.ACTIONS])} AS ra, {Q.top('low', P.AUTONOMY)} AS rb, {Q.top('low', P.BYPASSES)} AS rc, {Q.top('low', P.AGENT_LINKS)} AS rd FROM t),
ag1 AS (SELECT *, greatest(ra, rb, rc, rd) AS base, CASE WHEN ra > 0 THEN 1 ELSE 0 END + CASE WHEN rb > 0 THEN 1 ELSE 0 END + CASE WHEN rc > 0 THEN 1 ELSE 0 END + CASE WHEN rd > 0 THEN 1 ELSE 0 END AS n FROM ag0),
ag2 AS (SELECT *, greatest(CASE WHEN n >= 3 THEN least(1.0, base * 1.4::DOUBLE) WHEN n = 2 THEN least(1.0, base * 1.2::DOUBLE) ELSE base END, CASE WHEN rc > 0 OR rd > 0 THEN 0.85 ELSE 0.0 END) AS lifted FROM ag1),
ag AS (SELECT *, least(1.0, CASE WHEN ra > 0 AND rb > 0 THEN lifted + 0.15::DOUBLE ELSE lifted END) AS score FROM ag2),
agt_r AS (SELECT input_id, score, {Q.ladder('score', 0.85, 0.65, 0.4, 0.15)} AS level, CASE WHEN n = 0 THEN 0.9 ELSE least(score + 0.15, 0.95) END::DOUBLE AS conf, rc > 0 OR rd > 0 AS bypass FROM ag)"""


@query(f"{CONTENT}, {AGT_SQL} SELECT a.action, count(*) AS n FROM (SELECT unnest(actions) AS action FROM ag JOIN agt_r USING (input_id) WHERE level IN ('medium', 'high', 'critical')) a GROUP BY 1")
def agentic_actions(spark: SparkSession, sf: str) -> DataFrame:
    # The outer form keeps the optimizer from deriving a filter that would evaluate every pattern a second time.
    actions = D.detect_agentic(_content(spark, sf)).select(F.explode_outer("requested_actions").alias("action"))
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).filter("action IS NOT NULL")


@query(f"{CONTENT}, {AGT_SQL} SELECT input_id, round(score, 6) AS risk_score, level AS risk_level, round(conf, 6) AS confidence FROM agt_r")
def agentic_combined(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("agentic_intent_detector")
    return D.detect_agentic(_content(spark, sf)).select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), r6(m["confidence"]).alias("confidence"))


# ---- context hijacking --------------------------------------------------------------------------

_FIRST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lines, {Q.pattern(p, '')}) AND length(trim(substr(lines, 1, strpos(lines, regexp_extract(lines, {Q.pattern(p, '')})) - 1))) > 20 THEN 1 END" for p in P.LANGUAGES) + "], lambda x: x IS NOT NULL)"
_TOPICS = "[" + ", ".join(f"'{w}'" for w in P.TOPICS) + "]"
HOU_SQL = f"""ho0 AS (SELECT *, string_split_regex(lines, '[.!?]+') AS parts FROM t),
ho1 AS (SELECT *, len(parts) AS np, array_to_string(parts[1:(len(parts) // 2)], ' ') AS half, {Q.count('lines', P.SEPARATORS)} + {Q.count('lines', P.CLOSURES)} + CASE WHEN len({_FIRST}) > 0 THEN 1 ELSE 0 END AS ns,
 {Q.count('lines', P.REDEFINITIONS, 3)} AS n7, {Q.count('lines', P.LEAKS, 3)} AS n9, {Q.count('lines', P.SHAPING, 3)} AS n6, {Q.count('lines', P.RETASKING, None, '(?is)')} AS nr0 FROM ho0),
ho2 AS (SELECT *, CASE WHEN ns > 0 THEN nr0 ELSE 0 END AS nr, CASE WHEN np >= 3 AND {Q.found("coalesce(half, '')", P.FRAMEWORK)} THEN 0.3::DOUBLE ELSE 0.0 END AS f,
 list_filter({_TOPICS}, lambda w: contains(lower(coalesce(half, '')), w)) AS ta, list_filter({_TOPICS}, lambda w: contains(lower(coalesce(array_to_string(parts[(np * 3 // 4 + 1):], ' '), '')), w)) AS tb FROM ho1),
ho3 AS (SELECT *, CASE WHEN ns > 0 AND np >= 4 AND len(ta) > 0 AND len(tb) > 0 THEN 1.0::DOUBLE - len(list_intersect(ta, tb))::DOUBLE / len(ta) ELSE 0.0 END AS drift FROM ho2),
ho4 AS (SELECT *, least(1.0, ns * 0.25::DOUBLE) AS s, greatest(CASE WHEN n9 > 0 THEN 0.9 WHEN n7 > 0 THEN 0.7 WHEN n6 > 0 THEN 0.6 ELSE 0.0 END::DOUBLE, CASE WHEN drift > 0.6 THEN drift ELSE 0.0 END, CASE WHEN nr > 0 THEN 0.75 ELSE 0.0 END) AS dis FROM ho3),
ho5 AS (SELECT *, CASE WHEN f > 0 THEN 1 ELSE 0 END + CASE WHEN s > 0 THEN 1 ELSE 0 END + CASE WHEN dis > 0 THEN 1 ELSE 0 END AS nc, f * 0.2::DOUBLE + s * 0.3::DOUBLE + dis * 0.5::DOUBLE AS w0 FROM ho4),
ho6 AS (SELECT *, CASE WHEN n9 > 0 THEN least(1.0, w0 + 0.25::DOUBLE) ELSE w0 END AS w1 FROM ho5), ho7 AS (SELECT *, CASE WHEN drift > 0.6 THEN least(1.0, w1 + 0.15::DOUBLE) ELSE w1 END AS w2 FROM ho6),
ho AS (SELECT *, CASE WHEN nc = 0 THEN 0.0 WHEN nc = 1 THEN greatest(f, s, dis) * 0.3::DOUBLE WHEN nc = 2 THEN least(0.65, (f + s + dis) * 0.4::DOUBLE) ELSE least(1.0, CASE WHEN nr > 0 THEN w2 + 0.2::DOUBLE ELSE w2 END) END AS score FROM ho7),
hou_r AS (SELECT input_id, score, {Q.ladder('score', 0.85, 0.65, 0.4, 0.2)} AS level, CASE WHEN nc = 0 THEN 0.9 WHEN nc = 1 THEN 0.6 WHEN nc = 2 THEN 0.75 WHEN n9 > 0 THEN 0.95 ELSE 0.85 END::DOUBLE AS conf FROM ho)"""


@query(f"{CONTENT}, {HOU_SQL} SELECT input_id, (f > 0) AS framework, ns::BIGINT AS n_separators, (n7 + n9 + n6)::BIGINT AS n_disruptors, nr::BIGINT AS n_retasking, round(drift, 6) AS drift FROM ho")
def houyi_components(spark: SparkSession, sf: str) -> DataFrame:
    df = D.hijack_parts(_content(spark, sf))
    size = lambda c: F.size(c).cast("long")
    return df.select("input_id", (F.size("hou.framework") > 0).alias("framework"), size("hou.separators").alias("n_separators"), size("hou.disruptors").alias("n_disruptors"), size("hou_more.retasking").alias("n_retasking"), r6(F.col("hou_more.drift")).alias("drift"))


@query(f"{CONTENT}, {HOU_SQL} SELECT input_id, round(score, 6) AS risk_score, level AS risk_level, round(conf, 6) AS confidence FROM hou_r")
def houyi_risk(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("houyi_pattern_detector")
    return D.detect_hijack(_content(spark, sf)).select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), r6(m["confidence"]).alias("confidence"))


# ---- encoded content ----------------------------------------------------------------------------


_RUNS = ", ".join(f"len(list_filter({Q.hits('spaced', p, None, '')}, lambda m: length(m) >= 20))::BIGINT AS n_{n}" for n, p, _ in P.ENCODINGS)


@query(f"{CONTENT} SELECT input_id, {_RUNS} FROM t")
def deob_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _content(spark, sf).select("input_id", *[F.size(E.runs(F.col("t_spaced"), n)).cast("long").alias(f"n_{n}") for n, _, _ in P.ENCODINGS])


#: UTF-8 in hexadecimal: what is no part of a sequence is dropped.
_UTF8 = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|(?:E0[AB].|E[1-9A-CEF][89AB].|ED[89].)[89AB].|(?:F0[9AB].|F[1-3][89AB].|F48.)[89AB].[89AB]."
_TEXT_OF = lambda h: f"decode(unhex(array_to_string(list_filter(regexp_extract_all({h}, '{_UTF8}|..'), lambda x: regexp_full_match(x, '{_UTF8}')), '')))"
_BARE_HEX = "upper(replace(replace(run, '0x', ''), '\\x', ''))"
_URL_ONCE = "url_decode(replace(run, '+', ' '))"


def deob_sql(table: str) -> str:
    """dr: the runs of each encoding (e) of ``table``; dd: those that decode, with labels. One level: no run of the tables holds another."""
    runs = " UNION ALL ".join(f"SELECT input_id, {e} AS e, '{n}' AS encoding, unnest(l) AS run, unnest(range(1, len(l) + 1)) AS place FROM (SELECT input_id, list_filter({Q.hits('spaced', p, None, '')}, lambda m: length(m) >= 20) AS l FROM {table})" for e, (n, p, _) in enumerate(P.ENCODINGS))
    labels = ", ".join(f"CASE WHEN regexp_matches(lower(decoded), {Q.quoted(p)}) THEN '{label}' END" for p, label in P.SUSPICIOUS_DECODED)
    bases = " ".join(f"WHEN {e} THEN {r}" for e, (_, _, r) in enumerate(P.ENCODINGS))
    return f"""dr AS ({runs}), du AS (SELECT *, CASE e WHEN 0 THEN {_TEXT_OF('hex(from_base64(run))')} WHEN 1 THEN CASE WHEN length({_BARE_HEX}) % 2 = 0 THEN {_TEXT_OF(_BARE_HEX)} END
 ELSE CASE WHEN contains({_URL_ONCE}, '%') THEN url_decode(replace({_URL_ONCE}, '+', ' ')) ELSE {_URL_ONCE} END END AS decoded FROM dr),
dd AS (SELECT *, list_filter([{labels}], lambda x: x IS NOT NULL) AS labels, CASE e {bases} END::DOUBLE AS ground FROM du WHERE decoded <> ''),
deo0 AS (SELECT input_id, count(*) AS n, max(least(1.0, ground + CASE WHEN len(labels) > 0 THEN 0.4::DOUBLE + len(labels) * 0.1::DOUBLE ELSE 0.0 END)) AS risk, bool_or(len(labels) > 0) AS sus FROM dd WHERE place <= 5 GROUP BY 1),
deo1 AS (SELECT input_id, count(DISTINCT e) AS kinds FROM dr GROUP BY 1),
deo2 AS (SELECT {table}.input_id, coalesce(kinds, 0) AS kinds, coalesce(n, 0) + CASE WHEN kinds > 1 THEN 1 ELSE 0 END AS n, CASE WHEN kinds > 1 THEN least(1.0, coalesce(risk, 0.0) + 0.15::DOUBLE) ELSE coalesce(risk, 0.0) END AS score, coalesce(sus, false) AS sus FROM {table} LEFT JOIN deo1 USING (input_id) LEFT JOIN deo0 USING (input_id)),
deo_r AS (SELECT input_id, n, score, sus, {Q.ladder('score', 0.8, 0.6, 0.4, 0.2)} AS level, CASE WHEN kinds = 0 THEN 0.9 ELSE least(0.95, 0.75::DOUBLE + n * 0.05::DOUBLE) END::DOUBLE AS conf FROM deo2)"""


@query(f"{CONTENT}, {deob_sql('t')} SELECT input_id, (row_number() OVER (PARTITION BY input_id ORDER BY e, place) - 1)::INTEGER AS i, encoding, 0 AS depth, decoded, array_to_string(labels, ',') AS labels FROM dd")
def deob_decode(spark: SparkSession, sf: str) -> DataFrame:
    df = E.with_decoded(_content(spark, sf)).select("input_id", F.posexplode("decoded").alias("i", "d"))
    return df.select("input_id", "i", "d.encoding", "d.depth", "d.decoded", F.array_join(E.suspicious_labels(F.col("d.decoded")), ",").alias("labels"))


@query(f"{CONTENT}, {deob_sql('t')} SELECT input_id, round(score, 6) AS risk_score, level AS risk_level, round(conf, 6) AS confidence, n::INTEGER AS n_findings FROM deo_r")
def deob_result(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("content_deobfuscator")
    return E.analyze_encoded(E.with_decoded(_content(spark, sf))).select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), r6(m["confidence"]).alias("confidence"), F.size(m["findings"]).alias("n_findings"))


# ---- recognised text, vectors -------------------------------------------------------------------

_OCR = f"greatest(0.25::DOUBLE, {Q.top('lower(visible)', [(p, s) for p, _, s in P.OCR_INSTRUCTIONS])}, CASE WHEN len(regexp_extract_all(visible, '[A-Za-z0-9+/]{{20,}}={{0,2}}')) > 2 THEN 0.6 ELSE 0.0 END, CASE WHEN len(regexp_extract_all(visible, '(?:0x|\\\\x)?[0-9a-fA-F]{{16,}}')) > 1 THEN 0.55 ELSE 0.0 END, CASE WHEN regexp_matches(visible, {Q.quoted(P.URL)}) THEN 0.5 ELSE 0.0 END, {Q.top('lower(visible)', [(p, 0.65) for p in P.OCR_KEYWORDS])})"


@query(f"{CONTENT}, o AS (SELECT input_id, {_OCR} AS score, {Q.count('lower(visible)', P.OCR_KEYWORDS)}::BIGINT AS n_keywords FROM t) SELECT input_id, round(score, 6) AS risk_score, {Q.ladder('score', 0.8, 0.6, 0.4, 0.2)} AS risk_level, n_keywords FROM o")
def ocr_result(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("ocr_content_analyzer")
    df = D.analyze_ocr(content_inputs(spark, sf), "visible")
    return df.select("input_id", r6(m["risk_score"]).alias("risk_score"), m["risk_level"].alias("risk_level"), R.number(m["findings"], type="ocr_suspicious_keyword").cast("long").alias("n_keywords"))


#: The vectors of the smallest ids of each label stand for concepts; all vectors are compared with them.
_BANK = "bank AS (SELECT vec_id AS concept_id, 'c' || label AS category, embedding FROM embeddings WHERE vec_id < 25)"
_COS = "list_sum(list_transform(list_zip(e.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z::DOUBLE))))"


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    bank = e.filter("vec_id < 25").select(F.col("vec_id").alias("concept_id"), F.concat(F.lit("c"), "label").alias("category"), "embedding")
    return S.nearest_concepts(e, bank, "vec_id", "embedding")


@query(f"WITH {_BANK}, s AS (SELECT e.vec_id, b.concept_id, b.category, {_COS} AS sim FROM embeddings e CROSS JOIN bank b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, concept_id) AS k FROM s WHERE sim IS NOT NULL) SELECT vec_id, concept_id, category, round(sim, 6) AS similarity FROM r WHERE k = 1")
def semantic_cosine_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select("vec_id", "concept_id", "category", r6(F.col("similarity")).alias("similarity"))


@query(f"WITH {_BANK}, s AS (SELECT e.vec_id, b.concept_id, b.category, {_COS} AS sim FROM embeddings e CROSS JOIN bank b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, concept_id) AS k FROM s WHERE sim IS NOT NULL) SELECT category, count(*) AS n, round(max(sim), 6) AS most FROM r WHERE k = 1 AND sim > 0.2 GROUP BY category")
def semantic_category_max(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.category_maxima(_nearest(spark, sf), "vec_id", 0.2)
    return hits.groupBy("category").agg(F.count(F.lit(1)).alias("n"), r6(F.max("similarity")).alias("most"))


@query(
    f"WITH {_BANK}, s AS (SELECT e.vec_id, b.concept_id, b.category, {_COS} AS sim FROM embeddings e CROSS JOIN bank b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, concept_id) AS k FROM s WHERE sim IS NOT NULL), "
    "x AS (SELECT r.vec_id, e.label, r.category, r.sim FROM r JOIN embeddings e USING (vec_id) WHERE k = 1 AND sim > 0.2), c AS (SELECT label, category, max(sim) AS m FROM x GROUP BY 1, 2), "
    "g AS (SELECT label, max(m) AS most, count(*) AS n FROM c GROUP BY 1) SELECT label, n AS n_categories, round(most, 6) AS most, round(least(1.0, most * 0.7 * least(1.3, 1.0 + n * 0.1)), 6)::DOUBLE AS risk FROM g"
)
def semantic_risk_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """The semantic risk of all vectors of a label, as if they were the sentences of one text."""
    near = _nearest(spark, sf).join(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "vec_id")
    risk = S.semantic_risk(S.category_maxima(near, "label", 0.2), "label")
    return risk.select("label", "n_categories", r6(F.col("most")).alias("most"), r6(F.col("risk")).alias("risk"))
