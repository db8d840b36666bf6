"""Exact ranks within groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_ranked(df: DataFrame, group: str, key: str) -> DataFrame:
    """Adds ``rank`` (from 1) and ``group_size`` by the order of md5(key), then key, within ``group``.

    Rows are ranked within (group, first three digits of the hash), 4,096 parts a group, and moved by how many rows
    the group's earlier parts hold; only these counts, at most 4,096 a group, are summed over a whole group.
    Null groups are a group; null keys hash as empty text.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    df = df.withColumn("_h", F.md5(text)).withColumn("_p", F.substring("_h", 1, 3))
    parts = df.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy("_g")
    starts = parts.withColumns({"_start": F.sum("_n").over(by_group.orderBy("_q")) - F.col("_n"), "group_size": F.sum("_n").over(by_group)}).drop("_n")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy("_h", text)))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("rank", F.col("_start") + F.col("_r")).drop("_h", "_p", "_r", "_start", "_g", "_q")
