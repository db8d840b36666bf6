"""Features, balanced and split samples, and classifiers whose probability may replace the rule score."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions.ranks import hash_ranked
from wardflow.functions.runtime import materialize
from wardflow.operators import findings as R

#: The features, in the order that a model expects.
FEATURES = (
    "has_active_content", "hidden_text_ratio", "metadata_risk", "agentic_score", "agentic_has_bypass", "hidden_risk_score", "has_dangerous_script", "houyi_score", "houyi_has_separator",
    "contains_obfuscation", "obfuscation_score", "injection_score", "has_role_manipulation", "exfiltration_score", "intent_score", "intent_numeric", "semantic_score", "visible_ratio", "hidden_ratio",
    "hidden_to_visible_ratio", "has_html", "hidden_element_count", "url_count", "has_url", "suspicious_keyword_count",
)
#: Suspicious words, what metadata is searched for, and the numbers of intents.
KEYWORDS = ("ignore", "disregard", "override", "bypass", "jailbreak", "admin", "system", "execute", "send to", "transmit")
METADATA_SIGNS = (r"ignore\s+(previous|prior|above)", r"override\s+", r"bypass\s+", "jailbreak", r"system\s+prompt", r"execute\s+", r"admin\s+mode")
INTENT_NUMBERS = {"descriptive": 0.0, "ambiguous": 0.25, "instructional": 0.5, "conditional_instructional": 0.75, "malicious": 1.0}


def metadata_features(metadata: Column) -> dict[str, Column]:
    """has_active_content, hidden_text_ratio and metadata_risk of a map<string,string>; zeros for null."""
    number = lambda k, other: F.coalesce(metadata[k].try_cast("double"), F.lit(float(other)))
    sheets = number("sheet_count", 1)
    ratio = F.when(sheets > 0, number("hidden_sheet_count", 0) / sheets).otherwise(0.0)
    ratio = F.when(number("comment_count", 0) > 0, F.greatest(ratio, F.lit(0.5))).otherwise(ratio)
    ratio = F.when(F.lower(metadata["ocr_extracted"]) == "true", 0.3).otherwise(ratio)
    told = F.concat_ws(" ", *[F.nullif(metadata[k], F.lit("")) for k in ("author", "title", "subject", "creator")])
    signs = sum((F.rlike(told, F.lit("(?i)" + p)).cast("int") for p in METADATA_SIGNS), F.lit(0))
    active = F.coalesce((F.lower(metadata["has_active_content"]) == "true").cast("double"), F.lit(0.0))
    return {"has_active_content": active, "hidden_text_ratio": F.coalesce(ratio, F.lit(0.0)), "metadata_risk": F.least(F.lit(1.0), signs * F.lit(0.2))}


def metadata_map(text: Column) -> Column:
    """Metadata given as JSON text, as a map of texts; null if it can't be read."""
    return F.from_json(text, "map<string,string>")


def text_features(text: Column, visible: Column, hidden: Column) -> dict[str, Column]:
    seen, unseen = F.length(visible), F.aggregate(hidden, F.lit(0), lambda n, h: n + F.length(h))
    urls = F.regexp_count(text, F.lit(P.URL))
    words = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in KEYWORDS), F.lit(0))
    every = F.greatest(seen + unseen, F.lit(1))
    return {
        "visible_ratio": seen / every,
        "hidden_ratio": unseen / every,
        "hidden_to_visible_ratio": F.when(seen > 0, unseen / F.greatest(seen, F.lit(1))).otherwise(0.0),
        "has_html": (F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))).cast("double"),
        "hidden_element_count": F.size(hidden).cast("double"),
        "url_count": urls.cast("double"),
        "has_url": (urls > 0).cast("double"),
        "suspicious_keyword_count": words.cast("double"),
    }


def with_features(df: DataFrame, text_col: str = "visible", metadata_col: str | None = None) -> DataFrame:
    """Adds the feature columns to rows that have module results; nothing is detected again."""
    none = F.lit(None).cast("map<string,string>")
    on = lambda m, *kinds: R.has(F.col(m)["findings"], *kinds).cast("double")
    score = lambda m: F.col(m)["risk_score"]
    intent = F.lit(0.25)
    for name, n in INTENT_NUMBERS.items():
        intent = F.when(F.col("primary_intent") == name, n).otherwise(intent)
    columns = {
        **metadata_features(F.col(metadata_col) if metadata_col else none),
        "agentic_score": score("agentic_intent_detector"),
        "agentic_has_bypass": on("agentic_intent_detector", "permission_bypass"),
        "hidden_risk_score": score("hidden_content_analyzer"),
        "has_dangerous_script": on("hidden_content_analyzer", "dangerous_script"),
        "houyi_score": score("houyi_pattern_detector"),
        "houyi_has_separator": on("houyi_pattern_detector", "separator", "closure_separator"),
        "contains_obfuscation": (score("content_deobfuscator") > 0.3).cast("double"),
        "obfuscation_score": score("content_deobfuscator"),
        "injection_score": score("prompt_injection_detector"),
        "has_role_manipulation": on("prompt_injection_detector", "role_manipulation"),
        "exfiltration_score": score("exfiltration_detector"),
        "intent_score": score("intent_classifier"),
        "intent_numeric": intent,
        "semantic_score": score("semantic_threat_detector"),
        **text_features(F.col(text_col), F.col("visible"), F.col("hidden")),
    }
    return df.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def balanced(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """As many rows of each label as the rarest has, chosen by the order of the hash of ``key``.

    Rows of null label are dropped. The sizes compared are one row a label.
    """
    ranked = hash_ranked(df.filter(F.col(label).isNotNull()), label, key)
    least = ranked.groupBy(label).agg(F.first("group_size").alias("s")).agg(F.min("s").alias("least"))
    return ranked.join(F.broadcast(least), F.col("rank") <= F.col("least")).drop("rank", "group_size", "least")  # one row


def stratified(df: DataFrame, key: str, label: str = "label", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Adds ``split_name``: the first ``train`` of each label by the order of the hash of ``key``, then ``val``, then test."""
    ranked = hash_ranked(df, label, key)
    place = (F.col("rank") - 1) / F.col("group_size")
    return ranked.withColumn("split_name", F.when(place < train, "train").when(place < train + val, "val").otherwise("test")).drop("rank", "group_size")


def classifier(kind: str = "random_forest", trees: int = 200, depth: int = 15, seed: int = 42):
    """random_forest, gradient_boosting, or xgboost, which falls back to the forest where it isn't installed."""
    if kind == "gradient_boosting":
        return GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=150 if trees == 200 else trees, maxDepth=min(depth, 10), stepSize=0.1, subsamplingRate=0.8, seed=seed)
    if kind == "xgboost":
        try:
            from xgboost.spark import SparkXGBClassifier

            return SparkXGBClassifier(label_col="label", features_col="features", weight_col="weight", n_estimators=trees, max_depth=depth)
        except ImportError:
            pass
    elif kind != "random_forest":
        raise ValueError("unknown kind of classifier")
    return RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed)


def train(df: DataFrame, kind: str = "random_forest", trees: int = 200, depth: int = 15, seed: int = 42) -> PipelineModel:
    """Fit on rows with the feature columns and a label of 0 or 1; labels are weighted to equal sums."""
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not {0, 1} <= set(counts):
        raise ValueError("both labels are needed")
    total = counts[0] + counts[1]
    weight = F.when(F.col("label") == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    rows = df.withColumns({"weight": weight, "label": F.col("label").cast("double")})
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), classifier(kind, trees, depth, seed)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``ml_score``, the probability of label 1, and ``prediction``."""
    out = model.transform(df)
    return out.withColumn("ml_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def confusion(df: DataFrame, label: str = "label", said: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(said).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def metrics(df: DataFrame, label: str = "label", said: str = "prediction") -> DataFrame:
    """One row with precision, recall, f1 and accuracy; 0 where a ratio has no denominator."""
    n = lambda a, b: F.sum(F.when((F.col(label) == a) & (F.col(said) == b), 1).otherwise(0))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def area_under_curve(df: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="ml_score", labelCol="label").evaluate(df.withColumn("label", F.col("label").cast("double")))


def importances(model: PipelineModel, most: int = 10) -> list[tuple[str, float]]:
    """The features that matter most, the greatest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURES, map(float, values)), key=lambda x: -x[1])[:most]


def assign_splits(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of (text, label, source, type) with a key by content, balanced and split 80 / 10 / 10; equal rows are one."""
    keyed = rows.filter("text IS NOT NULL AND label IS NOT NULL").withColumn(key, F.md5(F.concat_ws("\x1f", "source", "type", F.col("label").cast("string"), "text"))).dropDuplicates([key])
    return stratified(balanced(keyed, key), key)


def train_pipeline(rows: DataFrame, featured: Callable[[DataFrame], DataFrame], folder: str | None = None, kind: str = "random_forest", trees: int = 200, depth: int = 15) -> tuple[PipelineModel, dict]:
    """Loaded samples (text, label, source, type) to a model, with its metrics on the validation and test rows.

    Samples are balanced and split, ``featured`` adds the feature columns (``pipeline.sample_features``), the model is fitted on the train
    rows, and saved in ``folder`` if one is given.
    """
    table = materialize(featured(assign_splits(rows)).select("split_name", "label", *FEATURES), "features")
    model = train(table.filter("split_name = 'train'"), kind, trees, depth)
    about: dict = {"kind": kind, "train_samples": table.filter("split_name = 'train'").count()}
    for split in ("val", "test"):
        said = predict(model, table.filter(F.col("split_name") == split))
        about |= {f"{split}_{k}": v for k, v in metrics(said).first().asDict().items()} | {f"{split}_auc": area_under_curve(said)}
    about["importances"] = importances(model)
    if folder:
        save(model, folder, about)
    return model, about


def save(model: PipelineModel, folder: str, about: dict | None = None) -> None:
    """The model with its feature names and ``about`` in a JSON file beside it."""
    model.write().overwrite().save(f"{folder}/model")
    session = SparkSession.active()
    session.createDataFrame([(json.dumps({"features": list(FEATURES), **(about or {})}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load(folder: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/model")
