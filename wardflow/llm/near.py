"""Near-duplicate records with small edits (problem 2).

Texts are linked if the words common to both, counted with repetition, are at least ``threshold`` of all
words of both. Links come from banded MinHash candidates, pruned by the XOR population count of their parity
bitmaps, and an exact check of the words of every candidate left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.functions.runtime import discard, materialize, partitions
from wardflow.llm import sketch
from wardflow.llm.components import components
from wardflow.llm.copies import members
from wardflow.llm.words import shared, words

_SKETCH = [f"s{i}" for i in range(sketch.LONGS)]
#: Pairs of ids that are broadcast at most; 16 MB.
MAX_PAIRS = 1_000_000
#: Pairs for each shuffle partition that take their texts along at once; 10 MB or so.
PAIRS_A_PARTITION = 20_000
#: A band key of fewer rows is never hot.
HOT_ROWS = 1000
#: Bands are met in up to so many passes, one for each PASS_TEXTS, so that only this part of the band rows is on disk at once.
PASSES, PASS_TEXTS = 4, 250_000
#: Rows of a large bucket that meet as many others in one task.
BLOCK_ROWS = 1 << 14


def signatures(texts: DataFrame, min_words: int) -> DataFrame:
    """The signatures (sketch.SCHEMA) of ``texts`` (id, text), written."""
    enough = texts.filter(F.length("text") >= 2 * min_words - 1)  # a word and a gap each
    return materialize(enough.mapInArrow(sketch.sign(min_words), sketch.SCHEMA), "signatures")


def _exactly(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in batches:
            known: dict[str, Counter] = {}

            def count(text: str) -> Counter:
                found = known.get(text)
                if found is None:
                    found = known[text] = Counter(words(text))
                return found

            keep = [shared(count(x), count(y)) >= threshold for x, y in zip(pairs.column(2).to_pylist(), pairs.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([pairs.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return check


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The candidate ``pairs`` (a, b), written, whose words of ``texts`` (id, text) really share ``threshold``.

    Up to MAX_PAIRS pairs are broadcast, and only texts of candidates travel; above, all texts are shuffled once for both joins. As a
    pair takes a text along, more than PAIRS_A_PARTITION for each shuffle partition are checked in parts, one after the other.
    """
    if (total := pairs.count()) <= MAX_PAIRS:
        x = texts.withColumnRenamed("id", "a").join(F.broadcast(pairs), "a")
        y = texts.join(F.broadcast(pairs.select(F.col("b").alias("id")).distinct()), "id", "left_semi")
        return _checked(x, y, threshold)
    n = partitions(pairs.sparkSession)
    y = texts.repartition(n, "id")
    parts = -(-total // (n * PAIRS_A_PARTITION))
    if parts == 1:
        return _checked(pairs.join(y.withColumnRenamed("id", "a"), "a"), y, threshold)
    of_part = (pairs.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == k).join(y.withColumnRenamed("id", "a"), "a") for k in range(parts))
    return _all([materialize(_checked(x, y, threshold), "checked") for x in of_part])


def _checked(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    both = x.withColumnRenamed("text", "text_a").join(y.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_exactly(threshold), "a long, b long")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _likely(threshold: float):
    """A condition on rows x and y: their lengths and sketches allow the similarity."""
    low = F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n")
    return low & (sketch.differing("x_", "y_") <= sketch.limit(threshold))


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "key"))


def hot_keys(bands: DataFrame, share: float = 0.001, slots: int = 1 << 14) -> DataFrame | None:
    """(key), written, of every band key that holds more than ``share`` of all rows of ``bands`` (and HOT_ROWS), at most 1 / share; none if there is none.

    Rows are first counted by slots of keys, which is a small table by partial aggregation; only keys of slots that are so large are
    counted themselves. So finding them is exact and shuffles no row.
    """
    slot = F.pmod("key", F.lit(slots)).alias("slot")
    sizes = {r["slot"]: r["n"] for r in bands.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``slots`` rows
    least = max(HOT_ROWS, sum(sizes.values()) * share)
    large = [x for x, n in sizes.items() if n > least]
    if not large:
        return None
    keys = bands.filter(F.pmod("key", F.lit(slots)).isin(large)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = materialize(keys.filter(F.col("n") > least).select("key"), "hot-keys")
    return None if keys.isEmpty() else keys


def in_blocks(left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
    """The join of ``left`` and ``right`` on key, for keys of very many rows: each key's left rows are dealt to ``blocks`` blocks, and its right rows go to all."""
    dealt = left.withColumn("block", F.pmod(F.xxhash64("x_id"), F.lit(blocks)))
    copied = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.join(copied, ["key", "block"]).drop("block")


def _pass(reps: DataFrame, k: int, passes: int, *more: str) -> DataFrame:
    """The band rows of pass ``k`` of ``passes``: key, id, n, sketch and the columns ``more``."""
    size = -(-sketch.BANDS // passes)
    return reps.select(F.explode(F.slice("keys", 1 + k * size, size)).alias("key"), "id", "n", *_SKETCH, *more)


def _met(rows: DataFrame, threshold: float, whole_bucket: int, passes: int) -> DataFrame:
    """Candidates (a, b) of the band rows ``rows``: all pairs of a bucket of up to ``whole_bucket`` rows, those with its smallest id of a larger one.

    A larger bucket also gives one row (a, a, key, c) of its smallest id and its number of rows. key and c are null of a candidate.
    """
    spark = rows.sparkSession
    parts = max(partitions(spark) // passes, min(partitions(spark), spark.sparkContext.defaultParallelism))
    of_key = Window.partitionBy("key")
    sized = rows.repartition(parts, "key").withColumns({"c": F.count(F.lit(1)).over(of_key), "least": F.min("id").over(of_key)}).filter("c > 1")
    x = _side(sized.filter((F.col("c") <= whole_bucket) | (F.col("id") == F.col("least"))).drop("least"), "x")
    y = _side(sized.drop("least", "c"), "y")
    mark = (F.col("x_c") > whole_bucket) & (F.col("x_id") == F.col("y_id"))
    met = x.join(y, "key").filter(mark | ((F.col("x_id") < F.col("y_id")) & _likely(threshold)))
    return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.when(mark, F.col("key")).alias("key"), F.when(mark, F.col("x_c")).alias("c")).distinct()


def _met_hot(reps: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """As :func:`_met` of the keys ``hot``, all large, whose rows are not shuffled."""
    bands = reps.select(F.explode("keys").alias("key"), "id", "n", *_SKETCH).join(F.broadcast(hot), "key")
    centre = bands.groupBy("key").agg(F.min_by(F.struct("id", "n", *_SKETCH), "id").alias("r"), F.count(F.lit(1)).alias("c"))
    centre = materialize(centre.select("key", "c", "r.*"), "centres")
    star = _side(bands, "y").join(F.broadcast(_side(centre, "x")), "key").filter("x_id < y_id").filter(_likely(threshold))
    star = star.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("c")).distinct()
    return star.unionByName(centre.select(F.col("id").alias("a"), F.col("id").alias("b"), "key", "c"))


def _grid(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
    """One side of a join in a grid: a bucket of c rows has ceil(c / BLOCK_ROWS) blocks, a row is in one of them and goes to each of the other side."""
    blocks = F.ceil(F.col("c") / BLOCK_ROWS)
    placed = rows.withColumns({own: F.pmod(F.xxhash64("id"), blocks), other: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))}).drop("c")
    return placed.select("key", "i", "j", *(F.col(x).alias(f"{name}_{x}") for x in placed.columns if x not in ("key", "i", "j")))


def _left_out(rows: DataFrame, large: DataFrame, few: bool, threshold: float) -> DataFrame:
    """Candidates (a, b) of the band rows ``rows`` in the buckets ``large`` (key, c, heart): rows of another root than the heart, with all rows of another root than their own."""
    rows = rows.join(F.broadcast(large) if few else large, "key")
    outside = F.col("root") != F.col("heart")
    still = materialize(rows.filter(outside).select("key").distinct(), "open-keys")  # a bucket that its smallest id connects is done
    rows = rows.join(F.broadcast(still) if few else still, "key", "left_semi").withColumn("outside", outside).drop("heart")
    met = _grid(rows.filter("outside"), "x", "i", "j").join(_grid(rows, "y", "j", "i"), ["key", "i", "j"])
    met = met.filter("x_root <> y_root AND (x_id < y_id OR NOT y_outside)").filter(_likely(threshold))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def links(reps: DataFrame, texts: DataFrame, threshold: float, whole_bucket: int = 64) -> DataFrame:
    """Verified links (a, b) that connect all similar texts among ``reps`` (signatures of distinct texts), written.

    Within a bucket of up to ``whole_bucket`` rows each pair is a candidate. In a larger one every row is
    first compared with the row of smallest id; what this connects needs no more links among itself, so
    that only rows it left out meet all others, in a grid of blocks as fine as the bucket is large. This is exact, and a bucket of
    near-copies, however large, costs one comparison a row. Hot buckets are told apart before the others are counted, so that none is
    brought into one task. Band rows are made and met in passes, of which only candidates stay.
    """
    hot = hot_keys(reps.select(F.explode("keys").alias("key")))
    passes, met = min(PASSES, -(-reps.count() // PASS_TEXTS) or 1), []
    for k in range(passes):
        rows = _pass(reps, k, passes)
        met.append(materialize(_met(rows.join(F.broadcast(hot), "key", "left_anti") if hot else rows, threshold, whole_bucket, passes), "met"))
    if hot:
        met.append(materialize(_met_hot(reps, hot, threshold), "met"))
    pairs = materialize(_all(met).filter("a < b").select("a", "b").distinct(), "pairs")
    large = materialize(_all(met).filter("a = b").select("key", "c", F.col("a").alias("id")), "large-buckets")
    discard(*met)
    found = materialize(verify(pairs, texts, threshold), "links")
    n_large = large.count()
    if not n_large:
        return found
    roots = components(found)
    named = materialize(reps.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    large = materialize(large.join(roots, "id", "left").select("key", "c", F.coalesce("root", "id").alias("heart")), "hearts")
    left_out = [materialize(_left_out(_pass(named, k, passes, "root"), large, n_large <= MAX_PAIRS, threshold), "left-out") for k in range(passes)]
    discard(named)
    more = materialize(_all(left_out).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    discard(*left_out, pairs)
    return materialize(found.unionByName(verify(more, texts, threshold)), "links")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, threshold: float = 0.8) -> DataFrame:
    """(first_id, member_id) of each member of a group but the smallest id; groups are linked directly or through others.

    Null and empty texts, and texts of fewer than ``min_words`` words, are in no group. Texts of the same
    words with the same repetition are collapsed first, hot ones salted, so that copies cost no pairs.
    Other columns of ``df`` are ignored; ids must be unique.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    signed = signatures(texts, min_words)
    same = materialize(members(signed.select("id", F.col("m1").alias("k1"), F.col("m2").alias("k2"))), "same-words")
    reps = materialize(signed.join(same, "id", "left_anti").drop("m1", "m2"), "distinct")
    discard(signed)
    roots = components(links(reps, texts, threshold))
    discard(reps)
    # A representative is the smallest id of its copies, so a component's smallest one is its group's.
    through = same.join(roots.select(F.col("id").alias("first_id"), "root"), "first_id", "left")
    copies = through.select(F.coalesce("root", "first_id").alias("first_id"), F.col("id").alias("member_id"))
    return copies.unionByName(roots.select(F.col("root").alias("first_id"), F.col("id").alias("member_id")))
