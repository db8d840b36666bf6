"""Duplicates hidden by formatting differences (problem 1).

Records whose texts differ only by white space, letter case, punctuation or, in records of named
fields, by order and notation of the fields form one set. A set is counted with its hot keys salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.runtime import materialize

#: The fields that a record text must hold, each exactly once.
RECORD_FIELDS = ("title", "tags", "body")
#: White space, separators, controls, punctuation and zero-width characters (Java syntax).
IGNORED = r"[\s\p{Z}\p{Cc}\p{P}\u00AD\u180E\u200B-\u200F\u2060\uFEFF]+"
_NAMES = "|".join(RECORD_FIELDS)
_IS_RECORD = rf"(?is)^\s*(?:\{{\s*\"(?:{_NAMES})\"|(?:{_NAMES})\s*:)"
_FIELD_START = rf"(?i)(?:^\s*|\s*[\r\n|]\s*)(?=(?:{_NAMES})\s*:)"
_FIELD = rf"(?is)^\s*({_NAMES})\s*:(.*)$"


def bare(text: Column) -> Column:
    """``text`` without ignored characters, in one letter case (full mappings, so that ß equals SS)."""
    # The replacement between the two also keeps the optimizer from simplifying lower(upper(x)) to lower(x).
    large = F.replace(F.upper(F.regexp_replace(text, IGNORED, "")), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(large), "ς", "σ")


def canonical(text: Column) -> Column:
    """The form in which copies are equal; null for null.

    A record of the three fields, as a JSON object or as ``name: value`` parts parted by line ends or
    bars, gives its fields in the order of their names, whatever their order and notation. A text that
    only resembles a record (a field missing, repeated or unreadable) is compared as plain text.
    """
    parsed = F.from_json(text, "map<string,string>", {"allowUnquotedControlChars": "true"})
    json_fields = F.transform(
        F.map_entries(parsed), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), bare(e["value"]).alias("value"))
    )
    plain_fields = F.transform(
        F.filter(F.split(text, _FIELD_START), lambda p: F.trim(p) != ""),
        lambda p: F.struct(F.lower(F.regexp_extract(p, _FIELD, 1)).alias("name"), bare(F.regexp_extract(p, _FIELD, 2)).alias("value")),
    )
    fields = F.array_sort(F.when(F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("{"), json_fields).otherwise(plain_fields))
    wanted = F.array(*[F.lit(x) for x in sorted(RECORD_FIELDS)])
    whole = F.transform(fields, lambda f: f["name"]) == wanted
    joined = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit("\x02"), F.coalesce(f["value"], F.lit("")))), "\x01")
    return F.when(F.rlike(text, F.lit(_IS_RECORD)) & whole, joined).otherwise(bare(text))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2): a 128-bit key of the canonical form.

    Texts without any letter or digit count as equal only if they are the same characters, and null
    texts are one set of their own; both kinds are marked by ``content = false``.
    """
    c = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("c", canonical(F.col("text")))
    c = c.withColumn("content", F.coalesce(F.rlike("c", F.lit(r"[\p{L}\p{N}]")), F.lit(False)))
    c = c.withColumn("c", F.when(F.col("content"), F.col("c")).otherwise(F.concat(F.lit("\x03"), F.col("text"))))
    return c.select("id", "content", F.xxhash64("c").alias("k1"), F.xxhash64(F.lit(1), F.col("c")).alias("k2"))


def copy_sets(keys: DataFrame, hot_share: float = 0.001, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """(sets, hot): sets has k1, k2, first_id, n_copies of every set; hot has the sets above ``hot_share`` of all rows.

    ``keys``: id, k1, k2, written (it is read several times). Hot keys are found exactly, from counts
    that are partial on each input partition; there are at most ``1 / hot_share`` of them, so that
    table is small whatever the input. Their rows are salted and aggregated in two levels, the others in one.
    The representative is the smallest id.
    """
    total = keys.count()
    least = max(2.0, total * hot_share)
    hot_keys = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    hot_keys = materialize(hot_keys.select("k1", "k2"), "hot")  # at most 1 / hot_share rows
    hot = keys.join(F.broadcast(hot_keys), ["k1", "k2"], "left_semi")
    rest = keys.join(F.broadcast(hot_keys), ["k1", "k2"], "left_anti")
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    level1 = salted.groupBy("k1", "k2", "salt").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    hot_sets = level1.groupBy("k1", "k2").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n_copies"))
    hot_sets = materialize(hot_sets, "hot-sets")
    rest_sets = rest.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return hot_sets.unionByName(rest_sets), hot_sets


def members(keys: DataFrame, hot_share: float = 0.001, salts: int = 32) -> DataFrame:
    """(first_id, id) of each row that is not the first of its set.

    Rows of hot keys meet their representatives by a broadcast of at most ``1 / hot_share`` rows and are
    never shuffled; the others are joined on their key.
    """
    sets, hot = copy_sets(keys, hot_share, salts)
    rest_sets = sets.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").filter("n_copies > 1")
    rest = keys.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti")
    a = keys.join(F.broadcast(hot), ["k1", "k2"]).select("first_id", "id")
    b = rest.join(rest_sets, ["k1", "k2"]).select("first_id", "id")
    return a.unionByName(b).filter("first_id <> id")


def copy_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001) -> DataFrame:
    """One row (first_id, n_copies) for each distinct record; an empty table gives no rows.

    Other columns of ``df`` are ignored. Equal ids would count as separate copies.
    """
    keys = materialize(keyed(df, id_col, text_col), "keys")
    return copy_sets(keys, hot_share)[0].select("first_id", "n_copies")


def copies_found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001) -> DataFrame:
    """(first_id, copy_id) of every copy but the first, among texts with a letter or digit."""
    keys = materialize(keyed(df.filter(F.col(text_col).isNotNull()), id_col, text_col).filter("content"), "keys")
    return members(keys, hot_share).select("first_id", F.col("id").alias("copy_id"))
