"""Same or near-same records across splits (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.runtime import materialize, partitions
from wardflow.llm.copies import bare, members
from wardflow.llm.near import _SKETCH, _likely, _side, hot_keys, in_blocks, signatures, verify

TRAIN = "train"


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, no blanks at the ends, "_" for "-"."""
    return F.regexp_replace(F.lower(F.trim(source)), "-", "_")


def _sides(df: DataFrame, id_col: str, text_col: str, split_col: str) -> DataFrame:
    split = F.lower(F.trim(F.col(split_col)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), split.alias("split"))
    return rows.filter("text IS NOT NULL AND split IS NOT NULL").withColumn("train", F.col("split") == TRAIN)


def _keyed(rows: DataFrame) -> DataFrame:
    """(id, train, k1, k2), written, of rows with a letter or digit: a key of what is left without white space, letter case and punctuation.

    Keys of one side only are dropped by counts that are partial before the shuffle.
    """
    keys = rows.withColumn("c", bare(F.col("text"))).filter(F.rlike("c", F.lit(r"[\p{L}\p{N}]")))
    keys = materialize(keys.select("id", "train", F.xxhash64("c").alias("k1"), F.xxhash64(F.lit(1), "c").alias("k2")), "keys")
    both = keys.groupBy("k1", "k2").agg(F.min("train").alias("low"), F.max("train").alias("high")).filter("high AND NOT low")
    return materialize(keys.join(both.select("k1", "k2"), ["k1", "k2"], "left_semi"), "same-keys")


def _similar(rows: DataFrame, min_words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, train, class), (x, y)), both written: classes of rows of the same words, and the classes of train rows (x) and of evaluation rows (y) that share ``threshold`` of their words.

    Only classes meet in the bands, on one side those that hold train rows and on the other those that hold evaluation
    rows; hot bands meet in blocks.
    """
    signed = signatures(rows.select("id", "text"), min_words)
    same = members(signed.select("id", F.col("m1").alias("k1"), F.col("m2").alias("k2")))
    same = materialize(same.select("first_id", "id"), "same-words")
    class_of = signed.select("id").join(same, "id", "left").select("id", F.coalesce("first_id", "id").alias("class"))
    class_of = materialize(class_of.join(rows.select("id", "train"), "id"), "classes")
    kinds = class_of.groupBy("class").agg(F.max("train").alias("t"), F.min("train").alias("only_t"))
    kinds = materialize(kinds.select("class", "t", (~F.col("only_t")).alias("e")), "kinds")
    reps = signed.join(kinds.withColumnRenamed("class", "id"), "id")
    bands = reps.select(F.explode("keys").alias("key"), "id", "n", "t", "e", *_SKETCH)
    hot = hot_keys(bands.select("key"))

    def met(part: DataFrame, blocks: int) -> DataFrame:
        x, y = _side(part.filter("t").drop("t", "e"), "x"), _side(part.filter("e").drop("t", "e"), "y")
        pairs = in_blocks(x, y, blocks) if blocks > 1 else x.join(y, "key")
        pairs = pairs.filter((F.col("x_id") != F.col("y_id")) & _likely(threshold))
        return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    pairs = met(bands.join(F.broadcast(hot), "key", "left_anti") if hot else bands, 1)
    if hot:
        pairs = pairs.unionByName(met(bands.join(F.broadcast(hot), "key", "left_semi"), partitions(rows.sparkSession)))
    linked = verify(materialize(pairs.distinct(), "pairs"), rows.select("id", "text"), threshold)
    ways = linked.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.x", "p.y")
    itself = kinds.filter("t AND e").select(F.col("class").alias("x"), F.col("class").alias("y"))
    with_t, with_e = kinds.filter("t").select(F.col("class").alias("x")), kinds.filter("e").select(F.col("class").alias("y"))
    ways = ways.join(with_t, "x", "left_semi").join(with_e, "y", "left_semi")
    return class_of, materialize(ways.unionByName(itself), "class-links")


def split_overlaps(df: DataFrame, id_col: str = "sample_id", text_col: str = "text", split_col: str = "split_name", min_words: int = 20, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of a train and a non-train row of the same or nearly the same text.

    Texts are the same if equal after ignoring white space, letter case and punctuation, with a letter or
    digit left; nearly the same if both have ``min_words`` words and share ``threshold`` of them. Rows of
    null text or split are in no pair. Ids must be unique; other columns are ignored. The result is all pairs; only it is
    as large, since equal texts meet by key and near ones by class, and a hot key's join is split by the skew join.
    """
    rows = _sides(df, id_col, text_col, split_col)
    keys = _keyed(rows)
    t, e = (keys.filter(on).select("k1", "k2", F.col("id").alias(name)) for on, name in (("train", "id_t"), ("NOT train", "id_e")))
    same = t.join(e, ["k1", "k2"]).select("id_t", "id_e")
    class_of, linked = _similar(rows, min_words, threshold)
    t = class_of.filter("train").select(F.col("class").alias("x"), F.col("id").alias("id_t"))
    e = class_of.filter("NOT train").select(F.col("class").alias("y"), F.col("id").alias("id_e"))
    pairs = same.unionByName(linked.join(t, "x").join(e, "y").select("id_t", "id_e"))
    return pairs.select(F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b")).distinct()


def overlap_report(
    df: DataFrame, id_col: str = "sample_id", text_col: str = "text", split_col: str = "split_name", source_col: str = "source", min_words: int = 20, threshold: float = 0.8
) -> DataFrame:
    """(split_name, source, n_pairs, n_records): pairs, and evaluation records in any, by the evaluation record's split and source.

    Pairs are those of ``split_overlaps``, but are counted by the sizes of keys and classes and never made: those of the same key, and
    those of linked classes, less those that are both.
    """
    rows = _sides(df, id_col, text_col, split_col)
    keys, (class_of, linked) = _keyed(rows), _similar(rows, min_words, threshold)
    n = F.count(F.lit(1)).alias("n")
    by_key = keys.filter("train").groupBy("k1", "k2").agg(n).withColumnRenamed("n", "n_same")
    by_class = class_of.filter("train").groupBy(F.col("class").alias("x")).agg(n)
    near = linked.join(by_class, "x").groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("n_near"))
    named = keys.join(class_of.select("id", "class"), "id")
    both_t = named.filter("train").groupBy("k1", "k2", F.col("class").alias("x")).agg(n)
    both_e = named.filter("NOT train").select("k1", "k2", F.col("class").alias("y")).distinct()
    both = both_e.join(linked, "y").join(both_t, ["k1", "k2", "x"]).groupBy("k1", "k2", F.col("y").alias("class")).agg(F.sum("n").alias("n_both"))
    e = df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(F.col(split_col))).alias("split_name"), source_name(F.col(source_col)).alias("source"), F.col(text_col).isNotNull().alias("has"))
    e = e.filter((F.col("split_name") != TRAIN) & F.col("has")).drop("has")
    e = e.join(keys.filter("NOT train").drop("train"), "id", "left").join(class_of.filter("NOT train").select("id", "class"), "id", "left")
    e = e.join(by_key, ["k1", "k2"], "left").join(near, "class", "left").join(both, ["k1", "k2", "class"], "left")
    pairs = F.coalesce("n_same", F.lit(0)) + F.coalesce("n_near", F.lit(0)) - F.coalesce("n_both", F.lit(0))
    e = e.withColumn("n", pairs).filter("n > 0")
    return e.groupBy("split_name", "source").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_records"))
