"""Visible and hidden parts of HTML.

The document tree needs a parser: one Arrow function with the standard library's, fed only rows that hold a
tag. Everything that patterns can find is also here as column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from wardflow.functions import text as T

#: Spans of raw HTML that hide content, by channel; a dot matches line ends.
HIDDEN_SPANS = (
    ("script", r"<\s*script[^>]*>.*?</\s*script\s*>"),
    ("iframe", r"<\s*iframe[^>]*>.*?</\s*iframe\s*>"),
    ("css_hidden_style", r"style\s*=\s*[\"'].*?display\s*:\s*none"),
    ("css_hidden_visibility", r"style\s*=\s*[\"'].*?visibility\s*:\s*hidden"),
    ("html_comment", r"<!--.*?-->"),
    ("noscript", r"<\s*noscript[^>]*>.*?</\s*noscript\s*>"),
)
#: Styles that hide an element, searched in the lower-cased style without blanks.
HIDING_STYLES = (
    r"opacity\s*:\s*0",
    r"display\s*:\s*none",
    r"visibility\s*:\s*hidden",
    r"height\s*:\s*0",
    r"width\s*:\s*0",
    r"font-size\s*:\s*0",
    r"text-indent\s*:\s*-?[0-9]+",
    r"clip\s*:\s*rect\(0",
    r"position\s*:\s*absolute.*?(left|right|top|bottom)\s*:\s*-",
    r"color\s*:\s*transparent",
    r"background-color\s*:\s*transparent",
)
_LOCATION = "struct<channel:string,tag_name:string,tag_id:string,tag_class:array<string>,css_style:string,hiding_technique:string,line_number:int,offset:int,length:int,text_preview:string>"
EXTRACTED = f"struct<visible:string,hidden:array<struct<text:string,location:{_LOCATION}>>,metadata:map<string,string>>"
#: Characters of an element's text that its location shows.
PREVIEW = 100
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "noscript"}


class _Element:
    def __init__(self, tag: str, attributes: dict[str, str], begin: int, unseen: bool) -> None:
        self.tag, self.attributes, self.begin, self.end, self.unseen = tag, attributes, begin, begin, unseen
        self.preview = ""


class _Reader(HTMLParser):
    """Elements in document order with their spans, and the text nodes that are seen."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html = html
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.open: list[_Element] = []
        self.open_tags: Counter = Counter()
        self.elements: list[_Element] = []
        self.seen: list[str] = []
        self.title: str | None = None
        self.feed(html)
        self.close()
        for e in self.open:
            e.end = len(html)

    def line_of(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        begin = self._at()
        unseen = tag in _UNSEEN or any(e.unseen for e in self.open[-1:])
        e = _Element(tag, {k: v or "" for k, v in reversed(attrs)}, begin, unseen)
        e.end = begin + len(self.get_starttag_text() or "")
        self.elements.append(e)
        if tag not in _VOID:
            self.open.append(e)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open_tags[self.open.pop().tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        at = self._at()
        close = self.html.find(">", at) + 1 or len(self.html)
        while self.open:
            e = self.open.pop()
            self.open_tags[e.tag] -= 1
            e.end = close if e.tag == tag else at
            if e.tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].tag == "title" and self.title is None:
            self.title = data
        # An element holds no less text than those inside, so that above a full preview all are full.
        for e in reversed(self.open):
            if len(e.preview) >= PREVIEW:
                break
            e.preview = (e.preview + data[:PREVIEW])[:PREVIEW]
        if not (self.open and self.open[-1].unseen) and data.strip():
            self.seen.append(data.strip())


def read_html(html: str, url: str | None = None, limits: T.Limits = T.Limits()) -> dict:
    """Visible text, hidden elements with locations, and metadata, as in EXTRACTED. Linear in the page, but for spans that never end."""
    html = html[: limits.html]
    page = _Reader(html)
    hidden: list[dict] = []

    def add(text: str, channel: str, **where) -> None:
        hidden.append({"text": text[: limits.element], "location": {"channel": channel, **where}})

    def span(m: re.Match, channel: str) -> None:
        add(m.group(), channel, line_number=page.line_of(m.start()), offset=m.start(), length=len(m.group()))

    scanned = html[: limits.regex]
    for channel, pattern in HIDDEN_SPANS:
        for m in re.finditer(pattern, scanned, re.DOTALL | re.IGNORECASE):
            span(m, channel)
    shown = [e for e in page.elements if not e.unseen]
    for e in shown:
        style = e.attributes.get("style")
        bare = (style or "").replace(" ", "").lower()
        technique = next((p for p in HIDING_STYLES if re.search(p, bare, re.IGNORECASE)), None) if style is not None else None
        if technique:
            text = html[e.begin : e.end]
            add(text, "css_hidden", tag_name=e.tag, tag_id=e.attributes.get("id"), tag_class=e.attributes.get("class", "").split() or None, css_style=style, hiding_technique=technique, text_preview=e.preview)
    for e in shown:
        classes = e.attributes.get("class", "").split()
        if any("hidden" in c.lower() for c in classes):
            add(html[e.begin : e.end], "css_class_hidden", tag_name=e.tag, tag_id=e.attributes.get("id"), tag_class=classes, text_preview=e.preview)
    for m in re.finditer(r"<!--.*?-->", scanned, re.DOTALL):
        span(m, "html_comment")  # a second time: every comment counts twice
    known = {h["text"] for h in hidden}
    for e in shown:
        style = e.attributes.get("style", "")
        bare = style.replace(" ", "").lower()
        if re.search(r"position:absolute", bare) and re.search(r"(left|right|top|bottom):-\d+", bare):
            text = html[e.begin : e.end][: limits.element]
            if text not in known:
                known.add(text)
                add(text, "absolute_position_hidden", tag_name=e.tag, css_style=style, text_preview=e.preview)
    metadata = {"input_type": "html_text"} if url is None else {"source_url": url}
    if url is not None:
        if page.title is not None:
            metadata["title"] = page.title
        for e in page.elements:
            if e.tag == "meta":
                name, content = e.attributes.get("name") or e.attributes.get("property"), e.attributes.get("content")
                if name and content:
                    metadata[name] = content
        m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/?#]*))?", url)
        metadata["scheme"], metadata["domain"] = (m.group(1).lower(), m.group(2) or "") if m else ("", "")
    visible = re.sub(r"\s+", " ", " ".join(page.seen)).strip()
    return {"visible": visible[: limits.visible], "hidden": hidden, "metadata": metadata}


def _read(limits: T.Limits):
    arrow = to_arrow_type(DataType.fromDDL(EXTRACTED))

    @F.arrow_udf(EXTRACTED)
    def read(html: pa.Array, url: pa.Array) -> pa.Array:
        found = [None if h is None else read_html(h, u, limits) for h, u in zip(html.to_pylist(), url.to_pylist())]
        for page in found:
            if page:
                page["metadata"] = list(page["metadata"].items())
        return pa.array(found, arrow)

    return read


def contains_html(text: Column) -> Column:
    return F.rlike(text, F.lit("<[^>]+>"))


def input_kind(raw: Column) -> Column:
    """url or text; addresses are told by their beginning in lower case."""
    return F.when(F.rlike(F.trim(raw), F.lit("^https?://")), "url").otherwise("text")


def extract(df: DataFrame, raw_col: str = "raw", url_col: str | None = None, ocr_col: str | None = None) -> DataFrame:
    """Adds visible, hidden (array<string>), locations (of the hidden elements, in their order), metadata and raw_html.

    ``ocr_col``: text recognised in the input's image, which is added behind its text, so that all detectors read it.
    Rows without a tag are plain text and never leave the JVM. Null input is empty text. With ``url_col`` the raw
    column holds the page fetched from it; a missing page gives an empty text and an error in the metadata.
    """
    raw = F.col(raw_col)
    if ocr_col:
        raw = append_ocr(T.bounded(F.coalesce(raw, F.lit(""))), F.col(ocr_col))
    raw = T.bounded(raw, "html")
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    is_html = F.coalesce(contains_html(raw), F.lit(False)) | (url.isNotNull() & raw.isNotNull())
    df = df.withColumn("_page", _read(T.limits())(F.when(is_html, raw), url))
    p = F.col("_page")
    error = F.create_map(F.lit("error"), F.lit("no page"), F.lit("source"), url)
    plain = F.create_map(F.lit("input_type"), F.lit("plain_text"))
    metadata = F.when(p.isNotNull(), p["metadata"]).when(url.isNotNull() & raw.isNull(), error).otherwise(plain)
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "visible": F.coalesce(p["visible"], T.bounded(raw, "visible"), F.lit("")),
            "hidden": F.coalesce(F.transform(p["hidden"], lambda h: h["text"]), none),
            "locations": F.transform(p["hidden"], lambda h: h["location"]),
            "metadata": metadata,
            "raw_html": F.when(p.isNotNull(), raw),
        }
    ).drop("_page")


def resolve_pages(inputs: DataFrame, pages: DataFrame) -> DataFrame:
    """``inputs`` (input_id, raw) with the crawled page of each address: ``pages`` has url and html, one row a url.

    Nothing is fetched: addresses without page keep a null html. A left join on the address.
    """
    kinds = inputs.withColumn("input_kind", input_kind(F.col("raw"))).withColumn("url", F.when(F.col("input_kind") == "url", F.trim("raw")))
    return kinds.join(pages.select("url", "html"), "url", "left")


# ---- what patterns alone can tell ---------------------------------------------------------------


def visible_text_by_pattern(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed: near the parser's result, all in the JVM."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def hidden_spans(html: Column) -> Column:
    """array<struct<channel, text>> of the raw spans that hide content, by channel, then by place."""

    def one(channel: str, pattern: str) -> Column:
        return F.transform(T.hits(T.bounded(html), pattern, None, "(?is)"), lambda m: F.struct(F.lit(channel).alias("channel"), T.bounded(m, "element").alias("text")))

    return F.flatten(F.array(*[one(c, p) for c, p in HIDDEN_SPANS]))


def append_ocr(raw: Column, ocr: Column) -> Column:
    """Raw input with the text recognised in its image behind it."""
    return F.when(F.coalesce(F.trim(ocr) != "", F.lit(False)), F.concat_ws("\n\n[OCR_EXTRACTED_TEXT]\n", raw, ocr)).otherwise(raw)
