"""Relational reports over events, samples and documents, sampling, learning and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.functions.config import Config
from wardflow.functions.runtime import materialize, scratch
from wardflow.operators import detectors as D
from wardflow.operators import findings as R
from wardflow.operators import learn as L
from wardflow.plans import pipeline
from wardflow.plans import sql as Q
from wardflow.plans.catalog import query
from wardflow.plans.planted import PAYLOADS, document_inputs, document_sql, sample_inputs
from wardflow.sources import datasets, files, sinks
from wardflow.streaming import streams

LEVELS = (0.85, 0.7, 0.5, 0.3)


def _once(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events, repeated rows once: of each event the row received first."""
    df = spark.read.parquet(f"{sf}/audit_events.parquet")
    return df.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in df.columns if c != "event_id"]), F.struct("received_at", "logged_at")).alias("e")).select("event_id", "e.*")


_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at, logged_at) AS k FROM audit_events) WHERE k = 1)"


@query(f"WITH {_EV}, f AS (SELECT event_id, unnest(findings) AS f FROM ev) SELECT f.detector AS detector, f.kind AS kind, lower(f.severity) AS severity, count(*) AS n, count(DISTINCT event_id) AS n_events, round(max(f.risk_score), 6) AS most FROM f GROUP BY 1, 2, 3")
def findings_by_module(spark: SparkSession, sf: str) -> DataFrame:
    df = _once(spark, sf).select("event_id", F.explode("findings").alias("f"))
    return df.groupBy(F.col("f.detector").alias("detector"), F.col("f.kind").alias("kind"), F.lower("f.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"), F.round(F.max("f.risk_score"), 6).alias("most"))


_W = Config().values["risk_weights"]
_WCASE = "CASE f.detector " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in _W.items()) + " ELSE 0.05 END"


@query(f"WITH {_EV}, f AS (SELECT event_id, unnest(findings) AS f FROM ev), m AS (SELECT event_id, f.detector AS detector, max(f.risk_score) AS s, max({_WCASE})::DOUBLE AS w FROM f GROUP BY 1, 2) SELECT event_id, round(sum(s * w) / sum(w), 6) AS weighted_risk, count(*) AS n_modules FROM m GROUP BY 1")
def weighted_risk_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted mean of each event's best score by detector: weights come by a join of a table of fixed size."""
    f = _once(spark, sf).select("event_id", F.explode("findings").alias("f")).groupBy("event_id", F.col("f.detector").alias("detector")).agg(F.max("f.risk_score").alias("s"))
    weights = spark.createDataFrame(list(_W.items()), "detector string, w double")
    f = f.join(F.broadcast(weights), "detector", "left").withColumn("w", F.coalesce("w", F.lit(0.05)))
    return f.groupBy("event_id").agg(F.round(F.sum(F.col("s") * F.col("w")) / F.sum("w"), 6).alias("weighted_risk"), F.count(F.lit(1)).alias("n_modules"))


@query(f"WITH {_EV} SELECT time_bucket(INTERVAL '5 minutes', logged_at) AS window_start, time_bucket(INTERVAL '5 minutes', logged_at) + INTERVAL '5 minutes' AS window_end, decision, count(*) AS n_events FROM (SELECT DISTINCT event_id, logged_at, decision FROM audit_events WHERE logged_at IS NOT NULL) GROUP BY 1, 2, 3")
def event_rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.event_rates(spark.read.parquet(f"{sf}/audit_events.parquet"))


@query(f"WITH {_EV} SELECT coalesce(element_at(metadata, 'session_id')[1], 'none') AS session_id, count(*) AS n_events, sum(CASE WHEN decision = 'block' THEN 1 ELSE 0 END)::BIGINT AS n_blocked, max(len(findings))::BIGINT AS most_findings FROM ev GROUP BY 1")
def events_by_session(spark: SparkSession, sf: str) -> DataFrame:
    df = _once(spark, sf).withColumn("session_id", F.coalesce(F.col("metadata")["session_id"], F.lit("none")))
    size = F.when(F.col("findings").isNotNull(), F.size("findings"))
    return df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.when(F.col("decision") == "block", 1).otherwise(0)).alias("n_blocked"), F.max(size).cast("long").alias("most_findings"))


# ---- documents ----------------------------------------------------------------------------------

_TOP = Q.top("lower(substr(visible, 1, 100000))", P.INJECTIONS)
_DOCS = f"{document_sql()}, s AS (SELECT input_id, {_TOP} AS risk FROM t)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    df = T.with_texts(document_inputs(spark, sf).withColumn("hidden", F.array().cast("array<string>")))
    return D.injection_parts(df).select("input_id", R.top(F.col("inj.patterns")).alias("risk"))


@query(f"{_DOCS} SELECT input_id, risk FROM s ORDER BY risk DESC, input_id LIMIT 20")
def top_risky_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).orderBy(F.desc("risk"), "input_id").limit(20)


@query(f"{_DOCS} SELECT coalesce(lower(d.lang), 'none') AS lang, d.source, count(*) AS n, round(avg(risk), 6) AS mean_risk, grouping(coalesce(lower(d.lang), 'none'), d.source)::BIGINT AS level FROM s JOIN documents d ON d.doc_id = s.input_id GROUP BY ROLLUP (coalesce(lower(d.lang), 'none'), d.source)")
def risk_rollup_by_lang_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("input_id"), F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), "source")
    df = _scored(spark, sf).join(docs, "input_id")
    return df.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.grouping_id().alias("level"))


@query(f"{_DOCS} SELECT d.thread_id, max(risk) AS most, arg_min(input_id, (-risk, input_id)) AS riskiest, count(*) AS n_posts FROM s JOIN documents d ON d.doc_id = s.input_id GROUP BY 1")
def thread_max_risk(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("input_id"), "thread_id")
    df = _scored(spark, sf).join(docs, "input_id")
    return df.groupBy("thread_id").agg(F.max("risk").alias("most"), F.min_by("input_id", F.struct(-F.col("risk"), "input_id")).alias("riskiest"), F.count(F.lit(1)).alias("n_posts"))


# ---- samples ------------------------------------------------------------------------------------

_SRC = "replace(lower(trim(source)), '-', '_')"
_RANK = "SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id::VARCHAR), sample_id::VARCHAR) AS r, count(*) OVER (PARTITION BY label) AS n FROM training_samples"


@query(f"WITH k AS ({_RANK} WHERE label IS NOT NULL), m AS (SELECT min(n) AS least FROM k) SELECT sample_id, label FROM k, m WHERE r <= least")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/training_samples.parquet").select("sample_id", "label")
    return L.balanced(df, "sample_id")


@query(f"WITH k AS ({_RANK}) SELECT sample_id, label, CASE WHEN (r - 1)::DOUBLE / n < 0.8 THEN 'train' WHEN (r - 1)::DOUBLE / n < 0.9 THEN 'val' ELSE 'test' END AS split_name FROM k")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/training_samples.parquet").select("sample_id", "label")
    return L.stratified(df, "sample_id", train=0.8, val=0.1).select("sample_id", "label", "split_name")


_KEYWORDS = "(" + " + ".join(f"CASE WHEN contains(lower(raw), '{w}') THEN 1 ELSE 0 END" for w in L.KEYWORDS) + ")"


@query(
    f"""SELECT content_id, round(v::DOUBLE / greatest(v + h, 1), 6) AS visible_ratio, round(h::DOUBLE / greatest(v + h, 1), 6) AS hidden_ratio, CASE WHEN contains(raw, '<') AND contains(raw, '>') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_html,
 len(regexp_extract_all(raw, {Q.quoted(P.URL)}))::DOUBLE AS url_count, {_KEYWORDS}::DOUBLE AS suspicious_keyword_count FROM (SELECT content_id, coalesce(raw_html, visible_text, '') AS raw, length(coalesce(visible_text, '')) AS v,
 coalesce(list_sum(list_transform(hidden_elements, lambda x: length(x))), 0) AS h FROM extracted_content)"""
)
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/extracted_content.parquet")
    f = L.text_features(F.coalesce("raw_html", "visible_text", F.lit("")), F.coalesce("visible_text", F.lit("")), F.coalesce("hidden_elements", F.array().cast("array<string>")))
    out = {k: c.cast("double") for k, c in f.items()}
    return df.select("content_id", F.round(out["visible_ratio"], 6).alias("visible_ratio"), F.round(out["hidden_ratio"], 6).alias("hidden_ratio"), out["has_html"].alias("has_html"), out["url_count"].alias("url_count"), out["suspicious_keyword_count"].alias("suspicious_keyword_count"))


@query(f"SELECT {_SRC} AS source, label, split_name, count(*) AS n, count(DISTINCT text) AS n_texts, sum(length(text))::BIGINT AS n_chars FROM training_samples GROUP BY CUBE ({_SRC}, label, split_name) HAVING count(*) > 0")
def sample_cube(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/training_samples.parquet").withColumn("source", F.regexp_replace(F.lower(F.trim("source")), "-", "_"))
    # Hashes instead of texts go through the grouping sets.
    text = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("h")
    df = df.select("source", "label", "split_name", text, F.length("text").alias("size"))
    return df.cube("source", "label", "split_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("n_texts"), F.sum("size").alias("n_chars"))


@query()
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all labelled samples, a forest fitted on the train rows, and its metrics on the others.

    A payload is planted by a hash of the id, the label having no part in it, so that the metrics say what the texts give.
    """
    rows = sample_inputs(spark, sf)
    extra = F.element_at(F.array(*[F.lit(v) for v, _ in PAYLOADS]), (F.pmod(F.xxhash64("input_id"), F.lit(len(PAYLOADS))) + 1).cast("int"))
    rows = rows.withColumn("visible", F.concat_ws(" ", "visible", extra))
    featured = L.with_features(pipeline.analyze(rows)).select("input_id", "label", "split_name", *L.FEATURES)
    featured = materialize(featured, "features")
    model = L.train(featured.filter("split_name = 'train'"), trees=20, depth=6)
    return L.metrics(L.predict(model, featured.filter("split_name <> 'train'")))


@query(
    """SELECT source, type, label, count(*) AS n, sum(length(txt))::BIGINT AS n_chars FROM (SELECT 'tapir' AS source, 'instruction_following' AS type, 0 AS label, text || chr(10) || coalesce(lang, '') AS txt FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT 'puffin', 'conversation', 0, text FROM documents WHERE post_kind = 'question' AND text <> ''
 UNION ALL SELECT 'deepset_jailbreaks', 'jailbreak', CASE WHEN label = 0 THEN 0 ELSE 1 END, text FROM training_samples WHERE text <> '') GROUP BY 1, 2, 3"""
)
def dataset_union(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written as three of the public datasets and read by their readers, found by their names in one folder."""
    folder = scratch(spark, "datasets")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")
    docs.select(F.col("text").alias("instruction"), F.col("lang").alias("input")).write.parquet(f"{folder}/tapir.parquet")
    kind = F.when(F.col("post_kind") == "question", "human").otherwise("gpt")
    docs.select(kind.alias("Source"), F.col("text").alias("value")).write.parquet(f"{folder}/puffin.parquet")
    spark.read.parquet(f"{sf}/training_samples.parquet").select(F.col("text").alias("prompt"), "label").write.json(f"{folder}/jailbreaks.json")
    rows = datasets.load_raw(spark, folder)
    return rows.groupBy("source", "type", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT type, label, source, count(*) AS n FROM (SELECT 'benign_query' AS type, 0 AS label, 'synthetic_benign' AS source FROM range(5000)) GROUP BY ALL")
def synthetic_samples(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.synthetic_benign(spark).groupBy("type", "label", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN split_name = 'train' THEN 'train_set' WHEN split_name = 'val' THEN 'val_set' ELSE 'test_set' END AS name, count(*) AS n, sum(sample_id)::BIGINT AS ids FROM training_samples WHERE split_name IN ('train', 'val', 'test') AND label IS NOT NULL GROUP BY 1")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Splits written as CSV files and read back."""
    folder = scratch(spark, "splits")
    sinks.write_splits(spark.read.parquet(f"{sf}/training_samples.parquet").filter("label IS NOT NULL").select("sample_id", "label", "text", "split_name"), folder)
    schema = "sample_id long, label int, text string"
    parts = [spark.read.csv(f"{folder}/{n}_set", header=True, schema=schema, multiLine=True, escape='"').withColumn("name", F.lit(f"{n}_set")) for n in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query("SELECT 'json' AS suffix, count(*) AS n_rows, sum(length(trim(text)))::BIGINT AS n_chars, 0 AS n_errors FROM documents WHERE lower(trim(text)) IS NOT NULL AND regexp_matches(text, '^\\s*\\{')")
def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Record texts written as files of lines and read by the file reader; their lines are counted again."""
    folder = scratch(spark, "loaded")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.rlike("text", F.lit(r"^\s*\{")))
    docs.select(F.to_json(F.struct(F.trim("text").alias("t"))).alias("value")).write.option("maxRecordsPerFile", 1000).text(folder, lineSep="\n")
    loaded = files.load_files(spark, folder, "part-*")
    lines = loaded.select("suffix", "error", F.explode(F.split("text", "\n")).alias("line"))
    t = F.from_json("line", "t string")["t"]
    return lines.filter("line <> ''").groupBy(F.lit("json").alias("suffix")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(t)).alias("n_chars"), F.sum(F.col("error").isNotNull().cast("int")).cast("int").alias("n_errors"))
