"""Files as rows of text: plain text, tables, office documents, and what can't be read.

Binary formats go through one Arrow function on ``binaryFile`` rows; a file that can't be read gives a row
with an error instead of failing the job. PDF pages need a library that may be absent: without it such files
are errors.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardflow.functions import text as T

#: Suffixes by how they are read.
TEXT = (".txt", ".md", ".log", ".json", ".xml", ".html", ".htm", ".csv", ".py", ".js", ".yaml", ".yml")
OFFICE = (".docx", ".xlsx", ".pptx", ".pdf")
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp")
REJECTED = (".zip", ".tar", ".gz", ".bin")
LOADED = "struct<text:string,metadata:map<string,string>,error:string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("docProps/core.xml"))
    return {k: e.text for k, tag in (("author", "creator"), ("title", "title"), ("subject", "subject")) if (e := root.find(_DC + tag)) is not None and e.text}


def _docx(data: bytes) -> tuple[str, dict]:
    """Paragraphs that aren't blank, then table rows, then comments."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    said = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
    lines = [t for p in body.findall(_W + "p") if (t := said(p)).strip()]
    lines += [" | ".join(said(c) for c in row.findall(_W + "tc")) for table in body.findall(_W + "tbl") for row in table.findall(_W + "tr")]
    comments = []
    if "word/comments.xml" in z.namelist():
        comments = [said(c) for c in ElementTree.fromstring(z.read("word/comments.xml")).findall(_W + "comment")]
    lines += [f"[COMMENT: {c}]" for c in comments]
    return "\n".join(lines), {**_core(z), "comment_count": str(len(comments)), "has_active_content": str("word/vbaProject.bin" in z.namelist()).lower()}


def _xlsx(data: bytes) -> tuple[str, dict]:
    """A header for each sheet and a line for each row that holds anything; hidden sheets are marked."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    lines, hidden = [], 0
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(_S + "sheets")
    for sheet in sheets:
        unseen = sheet.get("state", "visible") != "visible"
        hidden += unseen
        lines.append(f"[HIDDEN_SHEET: {sheet.get('name')}]" if unseen else f"Sheet: {sheet.get('name')}")
        target = targets[sheet.get(_R + "id")].lstrip("/")
        rows = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target)).iter(_S + "row")
        for i, row in enumerate(rows, 1):
            cells = []
            for c in row.findall(_S + "c"):
                v = c.find(_S + "v")
                inline = "".join(t.text or "" for t in c.iter(_S + "t"))
                cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None and v.text else ""))
            if any(x.strip() for x in cells):
                lines.append(f"Row {row.get('r', i)}: " + " | ".join(cells))
    if len(lines) == len(sheets):
        raise ValueError("no cell holds anything")
    return "\n".join(lines), {**_core(z), "sheet_count": str(len(sheets)), "hidden_sheet_count": str(hidden), "has_active_content": str("xl/vbaProject.bin" in names).lower()}


def _pptx(data: bytes) -> tuple[str, dict]:
    """A header for each slide and its paragraphs, indented."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    lines = []
    for i, name in enumerate(slides, 1):
        lines.append(f"Slide {i}:")
        for p in ElementTree.fromstring(z.read(name)).iter(_A + "p"):
            if (t := "".join(x.text or "" for x in p.iter(_A + "t"))).strip():
                lines.append("  " + t)
    return "\n".join(lines), {**_core(z), "slide_count": str(len(slides))}


def _pdf(data: bytes) -> tuple[str, dict]:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no library for PDF files") from None
    reader = PdfReader(io.BytesIO(data))
    text = "\n".join(p.extract_text() or "" for p in reader.pages)
    if not text.strip():
        raise ValueError("no text in the PDF")
    info = reader.metadata or {}
    active = any(k in reader.trailer["/Root"] for k in ("/OpenAction", "/AA", "/JavaScript"))
    return text, {"page_count": str(len(reader.pages)), "author": str(info.get("/Author", "")), "title": str(info.get("/Title", "")), "has_active_content": str(active).lower()}


#: How each kind of image begins.
_MAGIC = ((b"\x89PNG", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"GIF8", "GIF"), (b"BM", "BMP"), (b"RIFF", "WEBP"), (b"II*\x00", "TIFF"), (b"MM\x00*", "TIFF"))


def _image(data: bytes) -> tuple[str, dict]:
    """No text, but the image's format, and its size where the header says it plainly (PNG, GIF, BMP, JPEG)."""
    kind = next((k for m, k in _MAGIC if data.startswith(m)), None)
    size = None
    if kind == "PNG" and len(data) >= 24:
        size = struct.unpack(">II", data[16:24])
    elif kind == "GIF" and len(data) >= 10:
        size = struct.unpack("<HH", data[6:10])
    elif kind == "BMP" and len(data) >= 26:
        size = tuple(map(abs, struct.unpack("<ii", data[18:26])))
    elif kind == "JPEG":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                size = struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
                break
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return "", {"image_format": kind or "", "image_size": "x".join(map(str, size)) if size else "", "has_active_content": "false"}


_READERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {".docx": _docx, ".xlsx": _xlsx, ".pptx": _pptx, ".pdf": _pdf} | dict.fromkeys(IMAGES, _image)


def read_office(kind: str, data: bytes) -> dict:
    try:
        text, metadata = _READERS[kind](data)
        return {"text": text, "metadata": {k: v for k, v in metadata.items() if v}}
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(StringType())
def _office(kind: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else json.dumps(read_office(k, b)) for k, b in zip(kind, data)], dtype=object)


def load_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, suffix, text, metadata, error) of every file under ``path``.

    Text is UTF-8, else Latin-1, stripped. Images give a placeholder, as their text is recognised elsewhere.
    Archives and binaries are errors. Unknown suffixes are read if they are UTF-8.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", suffix(F.col("path")).alias("suffix"), "content")
    kind = F.col("suffix")
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.trim(F.coalesce(utf8, F.decode(F.col("content"), "ISO-8859-1")))
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    files = files.withColumn("loaded", F.from_json(_office(kind, F.when(kind.isin(*OFFICE, *IMAGES), F.col("content"))), LOADED))
    error = F.when(kind.isin(*REJECTED), F.concat(F.lit("binary files are not read: "), kind)).when(kind.isin(*OFFICE), F.col("loaded.error")).when(~kind.isin(*TEXT, *IMAGES) & utf8.isNull(), "not readable as text")
    out = F.when(kind.isin(*OFFICE), F.col("loaded.text")).when(kind.isin(*IMAGES), F.concat(F.lit("[IMAGE FILE: "), name, F.lit("]"))).when(kind.isin(*TEXT), text).otherwise(F.trim(utf8))
    none = F.create_map().cast("map<string,string>")
    return files.select("path", "suffix", F.when(error.isNull(), out).alias("text"), F.coalesce("loaded.metadata", none).alias("metadata"), error.alias("error"))


def table_text(df: DataFrame) -> Column:
    """A row of a table as one text, its values joined by bars; nulls are left out."""
    return F.concat_ws(" | ", *[F.col(c).cast("string") for c in df.columns])


def find_prompt(given: str | None = None, file: str = "agent_system_prompt.txt", variable: str = "WARDFLOW_AGENT_SYSTEM_PROMPT") -> str | None:
    """The system prompt given, else that of a file, else that of an environment variable, within its limit; None if there is none."""
    if not given:
        try:
            with open(file, encoding="utf-8") as f:
                given = f.read().strip()
        except (OSError, UnicodeDecodeError):
            pass
    given = given or os.environ.get(variable)
    return given[: T.limits().prompt] if given else None


def resolve_prompt(given: Column, default: str | None) -> Column:
    """The system prompt of a row, else the default, within its limit."""
    return T.bounded(F.coalesce(F.when(F.trim(given) != "", given), F.lit(default)), "prompt")
