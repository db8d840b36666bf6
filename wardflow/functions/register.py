"""The operators that make sense on one value, as functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wardflow.functions import patterns as P

FUNCTIONS = ("risk_level", "injection_risk", "url_domain", "visible_text", "is_html")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions, inlined by the optimizer, and the table function ``hidden_elements(html)``.

    risk_level(score), injection_risk(text), url_domain(url), visible_text(html), is_html(text). All give null for
    null but injection_risk, which gives 0.
    """
    cases = ", ".join(f"CASE WHEN rlike(t, {_quoted('(?i)' + p)}) THEN {s}D ELSE 0D END" for p, s in P.INJECTIONS)
    bodies = {
        "risk_level(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.15 THEN 'low' WHEN score IS NOT NULL THEN 'safe' END",
        "injection_risk(text STRING) RETURNS DOUBLE": f"(SELECT greatest({cases}) FROM (SELECT lower(coalesce(text, '')) AS t))",
        "url_domain(url STRING) RETURNS STRING": f"regexp_extract(url, {_quoted('^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)')}, 1)",
        "visible_text(html STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)[ ]*>', ' '), '(?s)<!--.*?-->', ' '), '<[^>]+>', ' '), '[ \\\\n\\\\r\\\\t]+', ' '))",
        "is_html(text STRING) RETURNS BOOLEAN": "rlike(text, '<[^>]+>')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.udtf(returnType="idx int, channel string, text string")
    class HiddenElements:
        def eval(self, html: str):
            from wardflow.operators.html import read_html

            for i, h in enumerate(read_html(html)["hidden"] if html else []):
                yield i, h["location"]["channel"], h["text"]

    spark.udtf.register("hidden_elements", HiddenElements)
