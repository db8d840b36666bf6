"""Similarity of sentences to malicious concepts, by vectors that the caller supplies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.operators import findings as R

#: The similarity that counts, and the categories that add risk of their own.
THRESHOLD = 0.65
CRITICAL = ("prompt_override", "autonomous_action", "conditional_targeting")
#: A concept table of more rows than this is refused, as it is held in every task.
MAX_CONCEPTS = 10_000


def concept_bank(spark) -> DataFrame:
    """(concept_id, category, phrase): the phrases whose vectors a model has to give."""
    return spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(P.CONCEPTS)], "concept_id int, category string, phrase string")


def threat_sentences(text: Column) -> Column:
    """Stripped sentences of more than 10 characters."""
    return F.filter(F.transform(F.split(text, "[.!?]+", -1), F.trim), lambda s: F.length(s) > 10)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays, summed in their order; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def _nearest(bank: Broadcast):
    """For mapInArrow over (id, vector): the nearest concept of each vector, all of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, categories, matrix = bank.value
        length = np.sqrt((matrix * matrix).sum(axis=1))
        some = np.flatnonzero(length > 0)
        for batch in batches:
            v = batch.column(1)
            sizes = np.array([len(x) if x is not None else -1 for x in v.to_pylist()]) if v.null_count else np.diff(v.offsets.to_numpy())
            rows = np.flatnonzero(sizes == matrix.shape[1]) if len(some) else np.array([], np.int64)
            x = np.array(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, matrix.shape[1]))
            norm = np.sqrt((x * x).sum(axis=1))
            keep = np.flatnonzero(norm > 0)
            rows, x, norm = rows[keep], x[keep], norm[keep]
            # The bank is in the order of its ids, and argmax takes the first of equal ones.
            sims = np.round(x @ matrix[some].T / (norm[:, None] * length[some]), 12)
            best = sims.argmax(axis=1) if len(rows) else np.array([], np.int64)
            at = some[best] if len(rows) else best
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(ids[at]), pa.array([categories[i] for i in at], pa.string()), pa.array(sims[np.arange(len(rows)), best])], names=["id", "concept_id", "category", "similarity"]
            )

    return run


def nearest_concepts(vectors: DataFrame, concepts: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, concept_id, category, similarity): the nearest concept of each vector; ties go to the smallest concept id.

    ``concepts``: concept_id, category, embedding. The table is checked to be small and broadcast; a batch of vectors meets it in
    one matrix product. Vectors that are null, of no length or of another dimension have no nearest concept, nor has any if there are
    no concepts. Concepts of another dimension than the first one's raise. Similarities are rounded to 12 places, so that ties are told alike everywhere.
    """
    rows = concepts.select(F.col("concept_id").cast("long"), "category", "embedding").filter("embedding IS NOT NULL").limit(MAX_CONCEPTS + 1).collect()
    if len(rows) > MAX_CONCEPTS:
        raise ValueError("too many concepts")
    rows = sorted(rows, key=lambda r: r[0])
    if len({len(r["embedding"]) for r in rows}) > 1:
        raise ValueError("concepts of several dimensions")
    bank = (np.array([r["concept_id"] for r in rows], np.int64), [r["category"] for r in rows], np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1))
    given = vectors.sparkSession.sparkContext.broadcast(bank)
    typed = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = typed.mapInArrow(_nearest(given), f"id {vectors.schema[id_col].dataType.simpleString()}, concept_id long, category string, similarity double")
    return out.withColumnRenamed("id", id_col)


def category_maxima(nearest: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, category, similarity): the best similarity of each category above the threshold."""
    return nearest.filter(F.col("similarity") > threshold).groupBy(key, "category").agg(F.max("similarity").alias("similarity"))


def semantic_risk(maxima: DataFrame, key: str) -> DataFrame:
    """(key, risk, n_categories, most) of category maxima."""
    critical = F.sum(F.when(F.col("category").isin(*CRITICAL), F.col("similarity") * 0.15).otherwise(0.0))
    by = maxima.groupBy(key).agg(F.max("similarity").alias("most"), F.count(F.lit(1)).alias("n_categories"), critical.alias("extra"))
    risk = T.cap(F.col("most") * 0.7 * T.cap(1.0 + F.col("n_categories") * F.lit(0.1), 1.3) + F.col("extra"))
    return by.select(key, risk.alias("risk"), "n_categories", "most")


def severity(similarity: Column) -> Column:
    return F.when(similarity >= 0.85, "critical").when(similarity >= 0.75, "high").when(similarity >= 0.65, "medium").otherwise("low")


def unavailable() -> Column:
    """The result where no vectors are supplied: no risk and no confidence, but the module's weight still counts."""
    note = F.array(R.finding("embeddings_unavailable", "semantic_threat_detector", "info", None))
    return R.result("semantic_threat_detector", "safe", 0.0, 0.0, note, "Semantic detection skipped - embeddings not available.")


def analyze_semantic(df: DataFrame, nearest: DataFrame | None = None, key: str = "input_id", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``semantic_threat_detector``. ``nearest``: (key, category, similarity), a row for each sentence with a vector."""
    if nearest is None:
        return df.withColumn("semantic_threat_detector", unavailable())
    hits = nearest.filter(F.col("similarity") > threshold)
    found = hits.groupBy(key).agg(F.collect_list(R.finding("semantic_similarity", "semantic_threat_detector", severity(F.col("similarity")), F.col("similarity"), None, None, F.col("category"))).alias("sem_found"))
    joined = df.join(found, key, "left").join(semantic_risk(category_maxima(nearest, key, threshold), key), key, "left")
    risk, most, n = F.coalesce("risk", F.lit(0.0)), F.coalesce("most", F.lit(0.0)), F.size(F.coalesce("sem_found", R.none()))
    sure = T.cap(F.lit(0.6) + n * F.lit(0.05) + most * F.lit(0.2), 0.85)
    details = F.when(n == 0, "No semantic threats detected.").otherwise(F.format_string("Detected %d semantically similar threat pattern(s). Maximum similarity score: %.2f.", n, most))
    out = R.result("semantic_threat_detector", T.level(risk, 0.8, 0.6, 0.4, 0.2), risk, sure, F.coalesce("sem_found", R.none()), details)
    return joined.withColumn("semantic_threat_detector", out).drop("sem_found", "risk", "n_categories", "most")
