"""The whole chain from inputs to assessments: one lazy projection, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardflow.functions.config import Config
from wardflow.functions.text import location, with_texts
from wardflow.operators import context, detectors, encoded, findings, html, learn, policy, semantic


def analyze(df: DataFrame, config: Config = Config(), nearest: DataFrame | None = None, decode: str = "strict", parity: bool = True) -> DataFrame:
    """Adds the result column of every module to rows of input_id, visible and hidden.

    Decoded content joins the hidden elements before the detectors read them. ``nearest``: see analyze_semantic.
    ``ocr_text``, if it is there, is analyzed too where it isn't empty. With ``parity`` the strength of the intent isn't given
    to the analysis of hidden content.
    """
    df = encoded.with_decoded(with_texts(df), mode=decode, settings=config.get("deobfuscation"))
    if config.enabled("active_deobfuscation"):
        df = with_texts(encoded.append_decoded(df))
    df = detectors.classify_intent(df)
    df = df.withColumn("strength", detectors.intent_strength(F.col("t_spaced"), F.col("primary_intent"))["strength"])
    df = detectors.analyze_hidden(df, None if parity else F.col("strength"))
    df = detectors.detect_exfiltration(detectors.detect_injection(df))
    df = detectors.detect_agentic(df)
    if config.enabled("houyi_detection"):
        df = detectors.detect_hijack(df)
    if config.enabled("semantic_detection"):
        df = semantic.analyze_semantic(df, nearest if config.get("semantic_analysis", "enabled", default=True) else None, threshold=config.get("semantic_analysis", "similarity_threshold", default=semantic.THRESHOLD))
    df = encoded.analyze_encoded(df)
    if "ocr_text" in df.columns and config.enabled("ocr_analysis") and config.get("ocr_analysis", "enabled", default=True):
        df = detectors.analyze_ocr(df, baseline=config.get("ocr_analysis", "baseline_risk", default=detectors.OCR_BASELINE))
        df = df.withColumn("ocr_content_analyzer", F.when(F.trim("ocr_text") != "", F.col("ocr_content_analyzer")))
    return df


def assess(df: DataFrame, name: str = "effective", config: Config = Config(), nearest: DataFrame | None = None, decode: str = "strict") -> DataFrame:
    """Adds module results, score, level, decision, restrictions, sanitised text and reasoning to rows of inputs.

    ``ocr_text``, the recognised text of an image, is a module's input; to have all detectors read it, give it to ``html.extract``.
    ``system_prompt``, if it is there, is weighed against the visible text. Columns of the input keep their names;
    they must not be called like an added one.
    """
    df = analyze(df, config, nearest, decode)
    if "system_prompt" in df.columns:
        df = context.weigh_context(df)
    return policy.decide(df, name, config)


def sample_features(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of samples with the module results and the feature columns of their texts, read as HTML where they hold tags."""
    read = html.extract(rows.withColumn("input_id", F.monotonically_increasing_id()), text_col)
    return learn.with_features(analyze(read), text_col, "metadata")


def findings_type() -> StructType:
    return StructType.fromDDL(findings.FINDING)


def findings_table(df: DataFrame) -> DataFrame:
    """One row for each finding of analyzed rows: input_id, module_name and the finding's fields."""
    modules = F.array(*[F.struct(F.lit(m).alias("module_name"), F.coalesce(F.col(m)["findings"], findings.none()).alias("findings")) for m in policy.present(df)])
    # Outer forms, as the optimizer would derive filters from the others that evaluate all detectors again.
    rows = df.select("input_id", F.explode_outer(modules).alias("m"))
    return rows.select("input_id", "m.module_name", F.explode_outer("m.findings").alias("f")).filter("f IS NOT NULL").select("input_id", "module_name", "f.*")


def located_findings(df: DataFrame) -> DataFrame:
    """Rows of ``findings_table`` with ``location``: where each finding's text stands in the input.

    channel (visible or hidden), element (of the hidden ones, from 0), 1-based line_number and 0-based char_offset in the visible text or in that
    element, what stands around it, and html, the element's own location, where ``df`` has the ``locations`` of ``html.extract``. Of equal
    findings of one pattern the first stands at the first place, and so on. Findings without text, or whose text was decoded or
    isn't there as written (letter case aside), have a null location. Nothing is shuffled.
    """
    nth = lambda fs: F.transform(
        fs, lambda f, i: F.struct(f.alias("f"), (F.size(F.filter(F.slice(fs, 1, i), lambda g: g["pattern"].eqNullSafe(f["pattern"]) & g["channel"].eqNullSafe(f["channel"]) & (F.lower(g["matched_text"]) == F.lower(f["matched_text"])))) + 1).alias("nth"))
    )
    modules = F.array(*[F.struct(F.lit(m).alias("module_name"), nth(F.coalesce(F.col(m)["findings"], findings.none())).alias("findings")) for m in policy.present(df)])
    extra = ["locations"] if "locations" in df.columns else []
    rows = df.select("input_id", "visible", "hidden", *extra, F.explode_outer(modules).alias("m"))
    rows = rows.select("input_id", "visible", "hidden", *extra, "m.module_name", F.explode_outer("m.findings").alias("x")).filter("x IS NOT NULL")
    rows = rows.select("input_id", "visible", "hidden", *extra, "module_name", "x.nth", "x.f.*")
    # Elements are joined by a sign that is in none, so that what stands before a match tells the element.
    mark = "\x01"
    unseen = F.array_join(F.transform("hidden", lambda h: F.replace(h, F.lit(mark), F.lit(" "))), mark)
    what = F.nullif(F.lower("matched_text"), F.lit(""))
    before = lambda text, n: F.call_function("substring_index", F.lower(text), what, n)
    rows = rows.withColumns({"_hid": unseen, "_n": F.col("nth").cast("int")})
    n_seen = F.when(F.coalesce(F.col("channel") == "visible", F.col("channel").isNull()), F.regexp_count(F.lower("visible"), F.concat(F.lit("\\Q"), what, F.lit("\\E")))).otherwise(0)
    rows = rows.withColumn("_seen", n_seen)
    in_visible = F.col("_n") <= F.col("_seen")
    rows = rows.withColumn("_before", F.when(in_visible, before(F.col("visible"), F.col("_n"))).when(F.coalesce(F.col("channel") != "visible", F.lit(True)), before(F.col("_hid"), F.col("_n") - F.col("_seen"))))
    there = F.when(in_visible, F.lit(True)).otherwise(F.length("_before") < F.length("_hid"))
    element = F.when(~in_visible, F.length("_before") - F.length(F.replace("_before", F.lit(mark), F.lit(""))))
    start = F.length(F.when(in_visible, F.col("_before")).otherwise(F.substring_index("_before", mark, -1)))
    text = F.when(in_visible, F.col("visible")).otherwise(F.get("hidden", element))
    place = location(text, start, start + F.length("matched_text"), F.when(in_visible, "visible").otherwise("hidden"))
    html = F.get("locations", element) if extra else F.lit(None).cast("struct<tag_name:string>")
    whole = F.struct(*[place[c].alias(c) for c in ("channel", "line_number", "char_offset", "context_before", "context_after")], element.alias("element"), html.alias("html"))
    rows = rows.withColumn("location", F.when(there & what.isNotNull(), whole))
    return rows.select("input_id", "module_name", *[f.name for f in findings_type().fields], "location")


def module_results(df: DataFrame) -> DataFrame:
    """One row for each input and module: level, score, confidence, number of findings, details."""
    modules = F.array(*[F.col(m) for m in policy.present(df)])
    rows = df.select("input_id", F.explode_outer(modules).alias("m")).filter("m IS NOT NULL")
    return rows.select("input_id", "m.module_name", "m.risk_level", "m.risk_score", "m.confidence", F.size("m.findings").alias("n_findings"), "m.details")
