"""The queries of the training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import copies, encode, lookalike, mixture, near, overlap, packing, pieces, subjects
from wardflow.llm.sql import SQL  # noqa: F401
from wardflow.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copies_found(read(spark, sf, "documents", "doc_id", "text"))


@_query
def p1_copy_counts(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copy_counts(read(spark, sf, "documents", "doc_id", "text"))


@_query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(read(spark, sf, "documents", "doc_id", "text"))


@_query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.cut_found(read(spark, sf, "extracted_content", "content_id", "visible_text"))


@_query
def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_oversized(read(spark, sf, "extracted_content", "content_id", "visible_text"))


@_query
def p3_cover(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each text make when they are put together again, and whether each keeps to the rules."""
    p = pieces.split_oversized(read(spark, sf, "extracted_content", "content_id", "visible_text"))
    in_order = F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "n_chars", "piece")))
    whole = p.groupBy("content_id").agg(in_order.alias("p"), F.max(F.length("piece")).alias("longest"))
    last = lambda x: F.get("p", x["piece_no"] - 2)
    rest = F.transform("p", lambda x: F.when(x["piece_no"] == 1, x["piece"]).otherwise(F.substring(x["piece"], F.lit(201), F.length(x["piece"]))))
    overlaps = F.forall("p", lambda x: (x["piece_no"] == 1) | (F.left(x["piece"], F.lit(200)) == F.right(last(x)["piece"], F.lit(200))))
    ordered = F.forall("p", lambda x: (x["n_chars"] == F.length(x["piece"])) & ((x["piece_no"] == 1) | (x["start_char"] == last(x)["start_char"] + last(x)["n_chars"] - 200)))
    return whole.select("content_id", F.md5(F.array_join(rest, "")).alias("whole"), (F.col("longest") <= 4000).alias("within"), overlaps.alias("overlapping"), ordered.alias("ordered"))


@_query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    content = lookalike.lookalike_pairs(read(spark, sf, "extracted_content", "content_id", "visible_text"), "content_id", "visible_text")
    samples = lookalike.lookalike_pairs(read(spark, sf, "training_samples", "sample_id", "text"), "sample_id", "text")
    return content.withColumn("tbl", F.lit("extracted_content")).unionByName(samples.withColumn("tbl", F.lit("training_samples"))).select("tbl", "id_a", "id_b")


@_query
def p4_content_form(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalized(read(spark, sf, "extracted_content", "content_id", "visible_text"), "content_id", "visible_text")


@_query
def p4_sample_form(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalized(read(spark, sf, "training_samples", "sample_id", "text"), "sample_id", "text")


@_query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.split_overlaps(read(spark, sf, "training_samples", "sample_id", "text", "split_name"))


@_query
def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(read(spark, sf, "training_samples", "sample_id", "text", "split_name", "source"))


@_query
def p6_taken(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.draw(read(spark, sf, "training_samples"), read(spark, sf, "mix_targets"))


@_query
def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.shares(read(spark, sf, "training_samples"), read(spark, sf, "mix_targets"))


@_query
def p6_met(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each target gets the size that it asks for, but for one record's, or, where its records don't give that, all that they give."""
    s = mixture.shares(read(spark, sf, "training_samples"), read(spark, sf, "mix_targets"))
    most, wanted = F.col("chars_available") * F.col("max_repeats"), F.col("target_share") * F.col("mix_chars")
    met = F.when(most >= wanted, F.abs(F.col("chars_taken") - wanted) <= F.col("longest")).otherwise(F.col("chars_taken") == most)
    names = ("source", "label", "target_share", "n_records", "chars_available", "mix_chars")
    return s.select(*names, (most >= wanted).alias("fillable"), met.alias("met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


@_query
def p6_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(read(spark, sf, "training_samples"), read(spark, sf, "mix_targets"))


@_query
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(read(spark, sf, "documents", "doc_id", "text"))


@_query
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(encode.token_counts(read(spark, sf, "documents", "doc_id", "text")))


@_query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    of = subjects.document_subjects(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "subject_examples"))
    return of.select("doc_id", F.explode("subjects").alias("subject"))


@_query
def p9_corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by number of subjects and subject; a document of two counts for both."""
    of = subjects.document_subjects(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "subject_examples"))
    rows = of.select(F.size("subjects").alias("n_subjects"), F.explode_outer("subjects").alias("subject"))
    return rows.groupBy("n_subjects", "subject").agg(F.count(F.lit(1)).alias("n_documents"))
