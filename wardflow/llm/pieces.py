"""Splitting oversized items at natural boundaries (problem 3).

Cuts are chosen by dynamic programming over boundary positions: the sum of cut penalties and of the
pieces' squared distance from an even size is least, no piece being longer than the limit and each
starting with the last ``overlap`` characters of the one before.

Words are only offered in stretches of over a quarter of the limit without a better boundary. Elsewhere no best plan cuts at
one: such a cut costs 8, and it could be moved to the better boundary before it and, should the next piece be too long then, one more
made at a better boundary (there is one, as the places that keep both parts within the limit span a quarter of it), which costs two
cuts of 2 at most and at most 1 for the size of each of three pieces. Only next to such a stretch can the plan be dearer than the
least, by one word's cost. In stretches without white space cuts are offered at each 40th character: an approximation of evenness, not of
the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What ends before a cut, and its penalty. Evenness costs at most about one a piece, so
#: that a better kind of boundary is worth a less even size and a cut inside a word is the last resort.
PENALTIES = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "word": 8.0, "character": 100.0}
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n\s*)+|\r\n[^\S\n]*(?:\r\n\s*)+")
_LINE = re.compile(r"\r\n|[\n\r\u2028\u2029]\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？｡]+[」』）”’]*\s*")
_WORD = re.compile(r"\s+")
#: A cut between two characters may not part what is drawn as one.
_JOINED = re.compile(r"[\u0300-\u036f\u200c\u200d\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff]")
#: Stretches without a better boundary that are this share of the limit, or longer, offer their words,
#: and so many characters apart, if they have none, their characters.
_STRETCH, _GRID = 0.25, 40

SCHEMA = "id {id}, piece_no int, start_char int, n_chars int, cut string, piece string"


def _boundaries(text: str, limit: int) -> dict[int, str]:
    """Positions where a cut is considered, each with its kind; a cut is behind the white space."""
    found: dict[int, str] = {}
    for kind, pattern in (("sentence", _SENTENCE), ("line", _LINE), ("paragraph", _PARAGRAPH)):
        for m in pattern.finditer(text):
            found[m.end()] = kind
    stretch = int(limit * _STRETCH)

    def gaps() -> list[tuple[int, int]]:
        edges = [0, *sorted(p for p in found if 0 < p < len(text)), len(text)]
        return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > stretch]

    for a, b in gaps():
        for m in _WORD.finditer(text, a, b):
            found.setdefault(m.end(), "word")
    for a, b in gaps():
        for p in range(a + _GRID, b, _GRID):
            grid = p
            while p < b and p - grid < stretch and (_JOINED.match(text, p) or text[p - 1] == "\u200d"):
                p += 1
            # Where all that is in reach is joined, it is parted after all.
            joined = p >= b or _JOINED.match(text, p) or text[p - 1] == "\u200d"
            found.setdefault(grid if joined else p, "character")
    return {p: k for p, k in found.items() if 0 < p < len(text)}


def cuts(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, str]]:
    """The best (position, kind) cuts of ``text``; none if it is within ``limit``."""
    size = len(text)
    if size <= limit:
        return []
    kinds = _boundaries(text, limit)
    at = [0, *sorted(kinds), size]
    step = limit - overlap
    even = size / -(-(size - overlap) // step)
    best, back = [0.0] + [float("inf")] * (len(at) - 1), [0] * len(at)
    for j in range(1, len(at)):
        end = at[j]
        cost = PENALTIES[kinds[end]] if end < size else 0.0
        if end < size and end < overlap:
            continue  # the next piece could not start with that many characters
        if end <= limit:
            best[j] = cost + ((end - even) / even) ** 2
        for i in range(bisect_left(at, end - step, 1), j):
            value = best[i] + cost + ((end - at[i] - even) / even) ** 2
            if value < best[j]:
                best[j], back[j] = value, i
    if best[-1] == float("inf"):
        return [(p, "character") for p in range(limit, size, step)]  # only below limits of some 200, where the grid is too wide
    j, chosen = back[len(at) - 1], []
    while j:
        chosen.append((at[j], kinds[at[j]]))
        j = back[j]
    return chosen[::-1]


def _split(limit: int, overlap: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "start_char", "n_chars", "cut", "piece"]
        types = [id_type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows: list[tuple] = []
                for i, value in zip(part.column(0).to_pylist(), part.column(1)):
                    text = value.as_py()
                    start = 0
                    for n, (end, kind) in enumerate([*cuts(text, limit, overlap), (len(text), "end")], 1):
                        rows.append((i, n, start, end - start, kind, text[start:end]))
                        start = end - overlap
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def split_oversized(df: DataFrame, id_col: str = "content_id", text_col: str = "visible_text", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(id_col, piece_no, start_char, n_chars, cut, piece): the pieces of every text of more than ``limit`` characters.

    ``cut`` is what ends the piece: paragraph, line, sentence, word, character (no natural place in
    reach) or end. Dropping the first ``overlap`` characters of all pieces but the first and joining them gives the
    text again. Null, empty and short texts need no cutting and give no row; other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of limit")
    id_type = df.schema[id_col].dataType
    if id_type.typeName() not in ("long", "string"):
        raise ValueError("ids must be long or string")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > limit)
    arrow = pa.int64() if id_type.typeName() == "long" else pa.string()
    pieces = texts.mapInArrow(_split(limit, overlap, arrow), SCHEMA.format(id=id_type.simpleString()))
    return pieces.withColumnRenamed("id", id_col)


def cut_found(df: DataFrame, id_col: str = "content_id", text_col: str = "visible_text", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(id_col) of each text that had to be cut."""
    return split_oversized(df, id_col, text_col, limit, overlap).filter("piece_no = 2").select(id_col)
