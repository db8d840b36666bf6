"""An input weighed against the system prompt of the agent that will read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T


def tokens(text: Column) -> Column:
    """Distinct words of more than two characters that carry a topic, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9']+"), F.lit(0))
    topic = F.filter(F.array_distinct(words), lambda w: F.length(w) > 2)
    return F.array_except(topic, F.array(*[F.lit(w) for w in P.STOPWORDS]))


def boundaries(prompt: Column) -> Column:
    """Phrases of 3 to 12 words that follow words which set a boundary, by trigger, then by place."""
    low = F.lower(prompt)
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in P.BOUNDARIES]))
    bare = F.transform(found, lambda b: F.rtrim(F.regexp_replace(F.trim(b), r"[.,;:]+$", "")))
    return F.filter(bare, lambda b: F.size(F.regexp_extract_all(b, F.lit(r"\S+"), F.lit(0))).between(3, 12))


def topic_alignment(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def weigh_context(df: DataFrame, text_col: str = "visible", prompt_col: str = "system_prompt") -> DataFrame:
    """Adds ``context``: struct<risk_adjustment, topic_alignment, boundary_violations, explanation>.

    A null or blank prompt gives no adjustment; a null text counts as empty.
    """
    prompt = T.bounded(F.col(prompt_col), "prompt")
    text = T.bounded(F.coalesce(F.col(text_col), F.lit("")), "input")
    given = F.coalesce(F.trim(prompt) != "", F.lit(False))
    parts = F.when(given, F.struct(tokens(prompt).alias("p"), tokens(text).alias("t"), boundaries(prompt).alias("b"), T.any_of(F.lower(text), P.OVERRIDE_SIGNALS, "").alias("signal")))
    df = df.withColumn("ctx", parts)
    c = F.col("ctx")
    broken = F.when(c["signal"], F.filter(c["b"], lambda b: F.arrays_overlap(tokens(b), F.col("ctx.t")))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"ctx_align": topic_alignment(c["p"], c["t"]), "ctx_broken": broken})
    n, align = F.size("ctx_broken"), F.col("ctx_align")
    adjust = F.when(n > 0, T.cap(F.lit(0.12) * n, 0.25)).when(align >= 0.08, -T.cap(align * 0.3, 0.15)).otherwise(0.0)
    why = (
        F.when(n > 0, F.format_string("Input overrides %d boundaries of the system prompt: %s", n, F.array_join(F.slice("ctx_broken", 1, 3), ", ")))
        .when(align >= 0.08, F.format_string("Input is on the topic of the system prompt (overlap=%.2f).", align))
        .otherwise(F.format_string("Input is off the topic of the system prompt (overlap=%.2f).", align))
    )
    none = F.struct(F.lit(0.0).alias("risk_adjustment"), F.lit(0.0).alias("topic_alignment"), F.array().cast("array<string>").alias("boundary_violations"), F.lit("No system prompt; judged in isolation.").alias("explanation"))
    out = F.when(given, F.struct(adjust.alias("risk_adjustment"), align.alias("topic_alignment"), F.col("ctx_broken").alias("boundary_violations"), why.alias("explanation"))).otherwise(none)
    return df.withColumn("context", out).drop("ctx", "ctx_align", "ctx_broken")
