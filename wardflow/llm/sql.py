"""DuckDB SQL of the problems that SQL can state, over whole tables and by plain pairwise definitions."""

from __future__ import annotations

import re
import unicodedata

from wardflow.llm import lookalike
from wardflow.plans.planted import quoted

#: Letter case with the full mappings that lower() alone doesn't make, and everything that doesn't count taken out.
_BARE = "replace(replace(replace(replace(replace(replace(replace(lower(regexp_replace({0}, '[\\s\\p{{Z}}\\p{{C}}\\p{{P}}]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬆ', 'st'), 'ﬃ', 'ffi')"


def bare(text: str) -> str:
    return _BARE.format(text)


def _field(name: str) -> str:
    others = "|".join(x for x in ("title", "tags", "body") if x != name)
    plain = f"regexp_extract(text, '(?is)(?:^|[\\r\\n|])\\s*{name}\\s*:(.*?)(?:[\\r\\n|]\\s*(?:{others})\\s*:|\\z)', 1)"
    return f"CASE WHEN json_valid(text) THEN json_extract_string(text, '$.{name}') ELSE {plain} END"


_RECORD = "regexp_matches(text, '(?is)^\\s*(?:\\{\\s*\"(?:title|tags|body)\"|(?:title|tags|body)\\s*:)') AND length(coalesce(ft, '')) > 0 AND length(coalesce(fg, '')) > 0 AND length(coalesce(fb, '')) > 0"
P1_FOUND = f"""WITH d AS (SELECT doc_id, text, {_field('title')} AS ft, {_field('tags')} AS fg, {_field('body')} AS fb FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
k AS (SELECT doc_id, CASE WHEN {_RECORD} THEN 'r' || {bare('ft')} || '|' || {bare('fg')} || '|' || {bare('fb')} ELSE 'p' || {bare('text')} END AS key FROM d),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k)
SELECT first_id, doc_id AS copy_id FROM m WHERE doc_id <> first_id"""


def _similar(table: str, key: str) -> str:
    """CTEs up to links(x, y), x < y: rows of 20 words or more that share 0.8 of them, by all pairs that have a word in common."""
    return f"""w AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {table} WHERE text IS NOT NULL),
c AS (SELECT id, word, count(*) AS n FROM w GROUP BY id, word), t AS (SELECT id, sum(n) AS total FROM c GROUP BY id HAVING sum(n) >= 20),
s AS (SELECT a.id AS x, b.id AS y, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.word = b.word AND a.id < b.id WHERE a.id IN (SELECT id FROM t) AND b.id IN (SELECT id FROM t) GROUP BY 1, 2),
links AS (SELECT x, y FROM s JOIN t tx ON tx.id = x JOIN t ty ON ty.id = y WHERE common >= 0.8 * (tx.total + ty.total - common))"""


P2_FOUND = f"""WITH RECURSIVE {_similar('documents', 'doc_id')},
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, other) AS (SELECT x, y FROM ways UNION SELECT reach.id, ways.y FROM reach JOIN ways ON ways.x = reach.other)
SELECT min(other) AS first_id, id AS member_id FROM reach GROUP BY id HAVING min(other) < id"""

P3_FOUND = "SELECT content_id FROM extracted_content WHERE length(visible_text) > 4000"

P5_FOUND = f"""WITH {_similar('training_samples', 'sample_id')},
k AS (SELECT sample_id AS id, {bare('text')} AS key FROM training_samples WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
every AS (SELECT a.id AS x, b.id AS y FROM k a JOIN k b ON a.key = b.key AND a.id < b.id UNION SELECT x, y FROM links)
SELECT x AS id_a, y AS id_b FROM every JOIN training_samples a ON a.sample_id = x JOIN training_samples b ON b.sample_id = y WHERE (lower(trim(a.split_name)) = 'train') <> (lower(trim(b.split_name)) = 'train')"""

P1_COPY_COUNTS = f"""WITH d AS (SELECT doc_id, text, {_field('title')} AS ft, {_field('tags')} AS fg, {_field('body')} AS fb, coalesce(regexp_matches(text, '[\\p{{L}}\\p{{N}}]'), false) AS content FROM documents),
k AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN NOT content THEN 'x' || text WHEN {_RECORD} THEN 'r' || {bare('ft')} || '|' || {bare('fg')} || '|' || {bare('fb')} ELSE 'p' || {bare('text')} END AS key FROM d)
SELECT min(doc_id) AS first_id, count(*) AS n_copies FROM k GROUP BY key"""

P3_COVER = "SELECT content_id, md5(visible_text) AS whole, true AS within, true AS overlapping, true AS ordered FROM extracted_content WHERE length(visible_text) > 4000"

P5_REPORT = f"""WITH p AS ({P5_FOUND}), ends AS (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p)
SELECT lower(trim(split_name)) AS split_name, replace(lower(trim(source)), '-', '_') AS source, count(*) AS n_pairs, count(DISTINCT id) AS n_records FROM ends JOIN training_samples ON sample_id = id WHERE lower(trim(split_name)) <> 'train' GROUP BY 1, 2"""

#: What each target can be given: all it asks for, or all that its records give when each is taken as often as it may be.
P6_MET = """WITH r AS (SELECT replace(lower(trim(source)), '-', '_') AS source, label, coalesce(length(text), 0) AS n FROM training_samples WHERE lower(trim(split_name)) = 'train'),
h AS (SELECT source, label, sum(n) AS have, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT sum(n) AS whole FROM r)
SELECT replace(lower(trim(t.source)), '-', '_') AS source, t.label, t.target_share, coalesce(h.n, 0) AS n_records, coalesce(have, 0)::BIGINT AS chars_available, whole::BIGINT AS mix_chars, coalesce(have, 0) * max_repeats >= target_share * whole AS fillable, true AS met, true AS within_repeats
FROM mix_targets t CROSS JOIN w LEFT JOIN h ON h.source = replace(lower(trim(t.source)), '-', '_') AND h.label = t.label"""


def _form(text: str) -> str:
    """The one form of a text by whole-text steps: line ends, invisible characters, folds, composition. Joiners that show are put by while these go."""
    ones: dict[str, str] = {}
    many: dict[str, str] = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x3000A), *range(0xE0000, 0xE01F0)):
        c = chr(code)
        if unicodedata.category(c) == "Cn" or 0xAC00 <= code <= 0xD7A3:
            continue
        form = lookalike.visible_form(c)
        if len(form) == 1 != (c == form):
            ones[c] = form
        elif form != c and form:
            many[c] = form
    gone = "".join(f"\\x{{{code:X}}}" for code in (*range(0xAD, 0x3000), *range(0xFE00, 0xFF00)) if lookalike._invisible(chr(code)))
    class_of = lambda pattern: re.sub(r"\\u([0-9a-f]{4})|\\U([0-9a-f]{8})", lambda m: f"\\x{{{m[1] or m[2]}}}", pattern.pattern)
    picture, letter = class_of(lookalike._EMOJI), class_of(lookalike._JOINING)
    kept = text
    for before, sign, behind, place in ((picture, "200D", picture, 0xE000), (letter, "200D", letter, 0xE000), (letter, "200C", letter, 0xE001), (f"(?:{picture}|[#*0-9©®‼⁉])", "FE0F", "", 0xE002)):
        for _ in range(2):  # neighbours overlap
            kept = f"regexp_replace({kept}, '({before})\\x{{{sign}}}({behind})', '\\1' || chr({place}) || '\\2', 'g')"
    out = f"replace(replace(regexp_replace({kept}, '[{gone}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    # Combining marks may follow a folded letter, so that it is composed before and after.
    out = f"nfc_normalize(translate(nfc_normalize({out}), {quoted(''.join(ones))}, {quoted(''.join(ones.values()))}))"
    for c in sorted(many, key=many.get):
        if lookalike._fold(c):
            out = f"replace({out}, {quoted(c)}, {quoted(many[c])})"
    return f"translate({out}, chr({0xE000}) || chr({0xE001}) || chr({0xE002}), chr({0x200D}) || chr({0x200C}) || chr({0xFE0F}))"


def _form_of(table: str, key: str, text: str) -> str:
    return f"SELECT {key}, form, coalesce(form <> text, false) AS changed FROM (SELECT {key}, {text} AS text, {_form(text)} AS form FROM {table})"


def _pairs_of(table: str, key: str, text: str) -> str:
    return f"SELECT '{table}' AS tbl, a.{key} AS id_a, b.{key} AS id_b FROM f_{table} a JOIN f_{table} b ON a.form = b.form AND a.text <> b.text AND a.{key} < b.{key}"


def _forms_cte(table: str, key: str, text: str) -> str:
    return f"f_{table} AS (SELECT * FROM (SELECT {key}, {text} AS text, {_form(text)} AS form FROM {table} WHERE {text} IS NOT NULL) WHERE regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]'))"


_TEXTS = (("extracted_content", "content_id", "visible_text"), ("training_samples", "sample_id", "text"))
P4_FOUND = f"WITH {', '.join(_forms_cte(*t) for t in _TEXTS)} {' UNION ALL '.join(_pairs_of(*t) for t in _TEXTS)}"

SQL = {
    "p1_found": P1_FOUND, "p1_copy_counts": P1_COPY_COUNTS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_cover": P3_COVER, "p4_found": P4_FOUND,
    "p4_content_form": _form_of(*_TEXTS[0]), "p4_sample_form": _form_of(*_TEXTS[1]), "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p6_met": P6_MET,
}
