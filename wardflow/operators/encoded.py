"""Encoded content: detection, guarded decoding to three levels, and its risk.

``strict`` decoding (the default) accepts an inner result only if it is printable; ``compat`` follows every
inner decoding that gives anything, also where plain words happen to be readable as base64.
"""

from __future__ import annotations

import base64
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from wardflow.functions import patterns as P
from wardflow.functions import text as T
from wardflow.operators import findings as R

#: Levels of decoding, characters decoded at once, and the shortest run that counts.
MAX_DEPTH, MAX_SIZE, MIN_RUN = 3, 1_000_000, 20
#: What each text with a run of at least MIN_RUN holds: with its padding, a base64 run has 18 or 19 characters of the alphabet.
MAYBE = r"[A-Za-z0-9+/]{18}(?:[A-Za-z0-9+/]{2}|[A-Za-z0-9+/]?=)|[0-9a-fA-F]{16}|(?:%[0-9a-fA-F]{2}){2}"


def runs(text: Column, encoding: str, least: int = MIN_RUN) -> Column:
    """The runs of an encoding that are long enough, in the order of the text."""
    pattern = next(p for n, p, _ in P.ENCODINGS if n == encoding)
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m) >= least)


def decode_once(run: Column, encoding: str) -> Column:
    """One level of decoding in the JVM; null if the run isn't valid, bytes that are no UTF-8 dropped."""
    if encoding == "base64":
        bare = F.regexp_replace(run, r"\s", "")
        raw = F.try_to_binary(F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    elif encoding == "hex":
        bare = F.replace(F.replace(run, F.lit("0x"), F.lit("")), F.lit("\\x"), F.lit(""))
        raw = F.when(F.length(bare) % 2 == 0, F.unhex(bare))
    else:
        once = F.try_url_decode(run)
        return F.when(F.contains(once, F.lit("%")), F.coalesce(F.try_url_decode(once), once)).otherwise(once)
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def _decode(text: str, encoding: str) -> str:
    try:
        if encoding == "base64":
            bare = re.sub(r"\s", "", text)
            bare += "=" * (-len(bare) % 4)
            return base64.b64decode(bare, validate=True).decode("utf-8", "ignore")
        if encoding == "hex":
            bare = text.replace("0x", "").replace("\\x", "")
            return bytes.fromhex(bare).decode("utf-8", "ignore") if len(bare) % 2 == 0 else ""
        once = unquote_plus(text)
        return unquote_plus(once) if "%" in once else once
    except ValueError:
        return ""


_PATTERNS = [(n, re.compile(p)) for n, p, _ in P.ENCODINGS]


def decode(text: str, encoding: str, strict: bool = True, level: int = 0, trace: list[dict] | None = None, most: tuple[int, int] = (MAX_DEPTH, MAX_SIZE)) -> tuple[str, int]:
    """(decoded, depth), ("", level) if nothing comes out. The depth grows by two for each level found inside.

    ``trace`` gets each step that was taken: encoding, input and output, 100 characters at most. ``most``: levels and characters.
    """
    if level >= most[0] or len(text) > most[1]:
        return "", level
    out = _decode(text, encoding)
    if not out or (strict and level and not out.isprintable()):
        return "", level
    for name, pattern in _PATTERNS:
        found = pattern.fullmatch(out.strip()) if strict else pattern.search(out)
        if found and (not strict or len(out.strip()) >= MIN_RUN):
            steps: list[dict] = []
            inner, depth = decode(out, name, strict, level + 1, steps, most)
            if inner:
                if trace is not None:
                    trace += [_step(encoding, text, out), *steps]
                return inner, depth + 1
    if trace is not None:
        trace.append(_step(encoding, text, out))
    return out, level


def _step(encoding: str, before: str, behind: str) -> dict:
    return {"encoding": encoding, "input": before[:100], "output": behind[:100]}


_TRACE = "array<struct<encoding:string,input:string,output:string>>"
_DECODED = f"array<struct<encoding:string,run:string,decoded:string,depth:int,place:int,trace:{_TRACE}>>"


def _decoder(strict: bool, most: tuple[int, int]):
    """Of an array of runs, those that decode, with their depth and the steps that were taken: one Arrow function."""
    arrow = to_arrow_type(DataType.fromDDL(_DECODED))

    def one(run: dict) -> dict | None:
        trace: list[dict] = []
        decoded, depth = decode(run["run"], run["encoding"], strict, 0, trace, most)
        return {**run, "decoded": decoded, "depth": depth, "trace": trace} if decoded else None

    @F.arrow_udf(_DECODED)
    def read(found: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [d for x in r if (d := one(x))] for r in found.to_pylist()], arrow)

    return read


def with_decoded(df: DataFrame, text_col: str = "t_spaced", mode: str = "strict", settings: dict | None = None) -> DataFrame:
    """Adds ``decoded``: array<struct<encoding, run, decoded, depth, place, trace>> of the runs that decode, by encoding then place.

    ``place`` counts the runs of an encoding from 1, those that don't decode too; ``trace`` has the steps of decoding.
    ``settings``: max_recursion_depth, max_decode_size, min_pattern_length. Rows without a run of any encoding never leave the JVM.
    """
    if mode not in ("strict", "compat"):
        raise ValueError("mode is strict or compat")
    settings = settings or {}
    least = settings.get("min_pattern_length", MIN_RUN)
    most = settings.get("max_recursion_depth", MAX_DEPTH), settings.get("max_decode_size", MAX_SIZE)
    text = F.col(text_col)

    def named(encoding: str) -> Column:
        return F.transform(runs(text, encoding, least), lambda m, i: F.struct(F.lit(encoding).alias("encoding"), m.alias("run"), (i + 1).alias("place")))

    found = F.concat(*[named(n) for n, _, _ in P.ENCODINGS])
    df = df.withColumn("runs", F.when(F.rlike(text, F.lit(MAYBE)), found) if least >= MIN_RUN else found)
    some = _decoder(mode == "strict", most)(F.when(F.size("runs") > 0, F.col("runs")))
    return df.withColumn("decoded", F.coalesce(some, F.array().cast(_DECODED)))


def decoded_text(decoded: Column) -> Column:
    """All decoded content, one run a line."""
    return F.array_join(F.transform(decoded, lambda d: d["decoded"]), "\n")


def append_decoded(df: DataFrame, hidden: str = "hidden") -> DataFrame:
    """Adds decoded content to the hidden elements as one more of them, before detectors read them."""
    text = decoded_text(F.col("decoded"))
    return df.withColumn(hidden, F.when(text != "", F.array_append(hidden, F.concat(F.lit("[DECODED_CONTENT]: "), text))).otherwise(F.col(hidden)))


def suspicious_labels(content: Column) -> Column:
    low = F.lower(content)
    return F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(p)), F.lit(label)) for p, label in P.SUSPICIOUS_DECODED]))


def encoding_risk(encoding: Column, depth: Column, labels: Column) -> Column:
    base = F.lit(0.3)
    for name, _, risk in P.ENCODINGS:
        base = F.when(encoding == name, risk).otherwise(base)
    return T.cap(base + depth * F.lit(0.2) + F.when(F.size(labels) > 0, F.lit(0.4) + F.size(labels) * F.lit(0.1)).otherwise(0.0))


def severity(risk: Column) -> Column:
    return F.when(risk >= 0.8, "critical").when(risk >= 0.6, "high").when(risk >= 0.4, "medium").otherwise("low")


def analyze_encoded(df: DataFrame, most: int = 5) -> DataFrame:
    """Adds ``content_deobfuscator`` from ``runs`` and ``decoded``: the first ``most`` runs of each encoding are judged, so far as they decode."""

    def first(encoding: str) -> Column:
        return F.filter("decoded", lambda d: (d["encoding"] == encoding) & (d["place"] <= most))

    per = [first(n) for n, _, _ in P.ENCODINGS]

    def of(d: Column) -> Column:
        labels = suspicious_labels(d["decoded"])
        risk = encoding_risk(d["encoding"], d["depth"], labels)
        return R.finding("decoded_content", "content_deobfuscator", severity(risk), risk, d["encoding"], F.left(d["run"], F.lit(50)), F.array_join(labels, ","))

    kinds = F.array_distinct(F.transform(F.coalesce("runs", F.array().cast("array<struct<encoding:string,run:string,place:int>>")), lambda r: r["encoding"]))
    df = df.withColumns({"enc_found": F.transform(F.concat(*per), of), "enc_kinds": kinds})
    several = F.size("enc_kinds") > 1
    risk = R.top(F.col("enc_found"))
    risk = F.when(several, T.cap(risk + 0.15)).otherwise(risk)
    found = F.concat("enc_found", F.when(several, F.array(R.finding("multiple_encodings", "content_deobfuscator", "high", None, None, None, F.array_join("enc_kinds", ",")))).otherwise(R.none()))
    odd = F.size(F.filter("enc_found", lambda f: f["label"] != ""))
    details = F.concat(
        F.concat_ws(
            ". ",
            F.format_string("Detected %d encoding type(s): %s", F.size("enc_kinds"), F.array_join("enc_kinds", ", ")),
            F.format_string("Decoded %d encoded segment(s)", F.size(found)),
            F.format_string("Maximum risk score: %.2f", risk),
            F.when(odd > 0, F.format_string("%d decoded segment(s) contain suspicious patterns", odd)),
        ),
        F.lit("."),
    )
    safe = R.result("content_deobfuscator", "safe", 0.0, 0.9, R.none(), "No encoded content detected.")
    out = R.result("content_deobfuscator", T.level(risk, 0.8, 0.6, 0.4, 0.2), risk, T.cap(F.lit(0.75) + F.size(found) * F.lit(0.05), 0.95), found, details)
    return df.withColumn("content_deobfuscator", F.when(F.size("enc_kinds") == 0, safe).otherwise(out))
