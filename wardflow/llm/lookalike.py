"""Visually identical text with different characters (problem 4).

Every text gets one form: canonically composed, letters and punctuation of full or half width in their
usual width, ligatures as their letters, all blanks as one, line ends as \\n, invisible characters gone and
look-alike letters of other scripts as the Latin letter they look like. Accents, letter case, digits of
other kinds (½, ², ①) and styled letters stay, because they are seen. Characters are tested for stability
and only unstable segments, with the characters around that they may combine with, are normalized; the
results are spliced into the unchanged text.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardflow.functions.runtime import materialize

#: Letters of other scripts and the Latin letters they look like, by script. Letters that show a difference in any
#: usual face (the dotless ı, ι, σ, Ь) are none.
LOOKALIKES = {
    letter: latin
    for letters, latins in (
        ("ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "JABEZHIKMNOPTYXC"),  # Greek
        ("αορνϲϳ", "aopvcj"),
        ("ЅІЈАВЕКМНОРСТУХѴҮӀԌԚԜ", "SIJABEKMHOPCTYXVYIGQW"),  # Cyrillic
        ("аеорсухѕіјѵһүӏԁԛԝ", "aeopcyxsijvhyldqw"),
        ("ԼՍՏՕ", "LUSO"),  # Armenian
        ("զհյոսցօ", "qhjnugo"),
        ("ᎠᎪᎫᎬᎱᎳᎷᎻᎢᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DAJERWMHTGZVSLCPKB"),  # Cherokee
        ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
        ("ɡᴄᴏᴜᴠᴡᴢꜱ", "gcouvwzs"),  # Latin letters drawn like others, among them small capitals
    )
    for letter, latin in zip(letters, latins, strict=True)
}
#: Hyphens and minus signs drawn alike, and the ellipsis that is three dots.
_SIGNS = {"\u02d7": "-", "\u2010": "-", "\u2011": "-", "\u2212": "-", "\u2026": "..."}
#: Ranges of common characters that are all stable: ASCII without carriage return, the Latin letters of
#: Europe with their accents, Kana, and the usual Kanji.
STABLE = r"\x00-\x0C\x0E-\x7F\u00A1-\u00AC\u00AE-\u017F\u3001\u3002\u3041-\u3096\u30A1-\u30FA\u30FC\u4E00-\u9FFF"
#: The same in Java, for a whole text: one greedy loop over it, which tells printable ASCII by its first comparison.
_ALL_STABLE = rf"\A[ -~[{STABLE}]]*\z"
#: Scripts in which joiners change how letters are drawn.
_JOINING = re.compile(r"[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18af]")
_EMOJI = re.compile(r"[\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f000-\U0001faff]")


def _invisible(c: str) -> bool:
    """Default-ignorable formatting characters and variation selectors."""
    shown = "\u0600" <= c <= "\u070f" or c == "\u08e2"  # signs that enclose digits
    selector = "\ufe00" <= c <= "\ufe0f" or "\U000e0000" <= c <= "\U000e0fff"
    return (ud.category(c) == "Cf" and not shown) or c == "\u034f" or selector


def _fold(c: str) -> str | None:
    """What one character looks like, where that is not the character itself; canonical forms aside."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _SIGNS:
        return _SIGNS[c]
    if c != " " and ud.category(c) == "Zs":
        return " "
    if c in "\x85\u2028\u2029":
        return "\n"
    kind, _, to = ud.decomposition(c).partition(" ")
    ligature = "LIGATURE" in ud.name(c, "") and ("\ufb00" <= c <= "\ufb17")
    radical = kind == "<compat>" and "\u2e80" <= c <= "\u2fdf"
    roman = kind == "<compat>" and "\u2160" <= c <= "\u217f"
    if kind in ("<wide>", "<narrow>") or ligature or radical or roman:
        folded = ud.normalize("NFKC", c)
        return "".join(LOOKALIKES.get(x, x) for x in folded)
    return None


@lru_cache(maxsize=1)
def _tables() -> tuple[re.Pattern, dict[int, str]]:
    """The pattern of an unstable segment, and the folds of single characters.

    A character is unstable if NFC may change or compose it (its quick check isn't Yes, or it combines),
    if it folds, or if its canonical decomposition holds a letter that folds.
    """
    unstable, folds = [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3 or ud.category(c) == "Cn":
            continue
        fold = _fold(c)
        if fold is not None:
            folds[code] = fold
        if fold is not None or _invisible(c) or ud.combining(c) or not ud.is_normalized("NFC", c):
            unstable.append(code)
        elif any(x in LOOKALIKES for x in ud.normalize("NFD", c)):
            unstable.append(code)
        elif 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2 or ud.category(c) == "Mc":
            unstable.append(code)  # composes with what stands before it
    ranges, start = [], unstable[0]
    for a, b in zip(unstable, [*unstable[1:], -1]):
        if b != a + 1:
            ranges.append(f"\\U{start:08x}-\\U{a:08x}")
            start = b
    return re.compile("[" + "".join(ranges) + "]+"), folds


def _shown_joiner(s: str, i: int) -> bool:
    """Whether the invisible character at ``i`` changes how its neighbours are drawn."""
    before = s[i - 1] if i else ""
    behind = s[i + 1] if i + 1 < len(s) else ""
    if s[i] == "\u200d" and _EMOJI.match(before) and _EMOJI.match(behind):
        return True
    if s[i] == "\ufe0f":
        return bool(_EMOJI.match(before)) or before in "#*0123456789\u00a9\u00ae\u203c\u2049\u2122"
    return s[i] in "\u200c\u200d" and bool(_JOINING.match(before)) and bool(_JOINING.match(behind))


def _normal(s: str, behind: str) -> str:
    """The form of a segment; ``behind``: the character after it, which decides whether a joiner shows."""
    if any(_invisible(c) for c in s):
        wide = s + behind
        s = "".join(c for i, c in enumerate(s) if not _invisible(c) or _shown_joiner(wide, i))
    folds = _tables()[1]
    return ud.normalize("NFC", ud.normalize("NFD", s.translate(folds)).translate(folds))


class _Segments(dict):
    """Forms of segments that end in no joiner, kept in a worker; bounded."""

    def __missing__(self, s: str) -> str:
        form = _normal(s, "")
        if len(s) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[s] = form
        return form


_KNOWN = _Segments()


def visible_form(text: str) -> str:
    """The one form of ``text``; texts of the same form look the same."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, at = [], 0
    for m in _tables()[0].finditer(text):
        first, end = m.span()
        if first > at:
            first -= 1  # what follows may combine with the stable character before
        segment = text[first:end]
        if segment[-1] in "\u200c\u200d\ufe0f":
            form = _normal(segment, text[end : end + 1])
        else:
            form = _KNOWN[segment]
        out += (text[at:first], form)
        at = end
    if not at:
        return text
    out.append(text[at:])
    return "".join(out)


@F.pandas_udf(StringType())
def _forms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else visible_form(t), na_action="ignore")


def with_form(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``form``, the one form of a text column; null for null, empty for empty.

    Texts of characters in STABLE are stable as they are and never leave the JVM. Most are ASCII, which shows by
    their lengths; only the others are searched for a character that isn't stable.
    """
    text = F.col(text_col)
    wide = F.octet_length(text) > F.length(text)
    unstable = F.contains(text, F.lit("\r")) | (wide & ~F.rlike(text, F.lit(_ALL_STABLE)))
    df = df.withColumn("_unstable", F.coalesce(unstable, F.lit(False)))
    form = F.when(F.col("_unstable"), _forms(F.when(F.col("_unstable"), text))).otherwise(text)
    return df.withColumn("form", form).drop("_unstable")


def normalized(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, form, changed) of every row; a null text has a null form and isn't changed."""
    out = with_form(df.select(id_col, F.col(text_col).alias("text")))
    return out.select(id_col, "form", F.coalesce(F.col("form") != F.col("text"), F.lit(False)).alias("changed"))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of rows whose texts are different characters of the same form.

    Texts without a visible character, and null ones, are in no pair. Pairs are made of variants, the different texts of one
    form, and ids are attached to them last: equal rows never meet, however many there are, and a hot text without another
    variant is in no join. Each join has one row a variant on the side that doesn't hold rows, so the skew join splits a hot one.
    """
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    out = with_form(out).filter(F.rlike("form", F.lit(r"[^\s\p{Z}\p{C}]")))
    keys = out.select("id", F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(1), "form").alias("k2"), F.xxhash64("text").alias("v1"), F.xxhash64(F.lit(1), "text").alias("v2"))
    keys = materialize(keys, "forms")
    ends = [f(v).alias(f"{f.__name__}_{v}") for f in (F.min, F.max) for v in ("v1", "v2")]
    several = keys.groupBy("k1", "k2").agg(*ends).filter("min_v1 <> max_v1 OR min_v2 <> max_v2").select("k1", "k2")
    rows = materialize(keys.join(several, ["k1", "k2"], "left_semi"), "variants")
    variants = rows.select("k1", "k2", "v1", "v2").distinct()
    a = variants.select("k1", "k2", F.struct("v1", "v2").alias("a"))
    b = variants.select("k1", "k2", F.struct("v1", "v2").alias("b"))
    pairs = a.join(b, ["k1", "k2"]).filter("a < b").select("a.v1", "a.v2", F.col("b.v1").alias("b1"), F.col("b.v2").alias("b2"))
    first = pairs.join(rows.select("id", "v1", "v2"), ["v1", "v2"]).select("id", "b1", "b2")
    second = rows.select(F.col("id").alias("id_2"), F.col("v1").alias("b1"), F.col("v2").alias("b2"))
    return first.join(second, ["b1", "b2"]).select(F.least("id", "id_2").alias("id_a"), F.greatest("id", "id_2").alias("id_b"))
