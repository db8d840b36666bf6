"""Problems 3, 4 and 7: pieces, forms and ids, against their definitions and brute force."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.llm import encode, lookalike, pieces

tokenizers = pytest.importorskip("tokenizers")
FILE = f"{encode.FOLDER}/{encode.VOCABULARY}"


# ---- pieces -------------------------------------------------------------------------------------


def parts(text, limit=60, overlap=10):
    out, start = [], 0
    for end, kind in [*pieces.cuts(text, limit, overlap), (len(text), "end")]:
        out.append((start, text[start:end], kind))
        start = end - overlap
    return out


def least_cost(text, limit, overlap):
    """The cost of the best cuts by trying every boundary at every place, without bounds on the search."""
    kinds = pieces._boundaries(text, limit)
    step, size = limit - overlap, len(text)
    even = size / -(-(size - overlap) // step)
    best = {0: 0.0}
    for end in [*sorted(kinds), size]:
        if end < size and end < overlap:
            continue
        own = pieces.PENALTIES[kinds[end]] if end < size else 0.0
        found = [c + own + ((end - p - even) / even) ** 2 for p, c in best.items() if end - p <= (limit if p == 0 else step)]
        if found:
            best[end] = min(found)
    return best[size]


@given(st.text(alphabet="ab .!?\n。あé​", min_size=61, max_size=400))
@settings(max_examples=200, deadline=None)
def test_pieces_fit_overlap_and_give_the_text_again(text):
    got = parts(text)
    assert all(0 < len(p) <= 60 for _, p, _ in got)
    assert "".join(p if i == 0 else p[10:] for i, (_, p, _) in enumerate(got)) == text
    for (_, a, _), (_, b, _) in zip(got, got[1:]):
        assert b.startswith(a[-10:])


@given(st.text(alphabet="ab .\n", min_size=61, max_size=250))
@settings(max_examples=100, deadline=None)
def test_cuts_cost_the_least(text):
    kinds = pieces._boundaries(text, 60)
    even = len(text) / -(-(len(text) - 10) // 50)
    cost, at = 0.0, 0
    for end, kind in [*pieces.cuts(text, 60, 10), (len(text), "end")]:
        cost += (pieces.PENALTIES[kinds[end]] if kind != "end" else 0) + ((end - at - even) / even) ** 2
        at = end
    assert cost == pytest.approx(least_cost(text, 60, 10))


def test_cut_kinds():
    para = ("word " * 8 + "end.\n\n") * 6
    assert {k for _, _, k in parts(para)[:-1]} == {"paragraph"}
    assert {k for _, _, k in parts("x" * 300)[:-1]} == {"character"}
    assert pieces.cuts("short") == [] and pieces.cuts("y" * 4000) == []
    family = "\U0001f469‍\U0001f52c"
    for _, p, _ in parts(family * 60):
        assert not p.startswith("‍")


@pytest.mark.parametrize("text", ["\u200d" * 5000, "a" + "\u0301" * 9000, "word " * 300 + "\u200d" * 5000 + " end" * 300, "x" * 2000 + "\u0301" * 4500 + "x" * 3000])
def test_long_joined_stretches_are_cut(text):
    got = parts(text, 4000, 200)
    assert all(0 < len(p) <= 4000 for _, p, _ in got)
    assert "".join(p if i == 0 else p[200:] for i, (_, p, _) in enumerate(got)) == text


@given(st.text(alphabet="a\u200d\u0301 ", min_size=61, max_size=400))
@settings(max_examples=200, deadline=None)
def test_joined_pieces_fit_and_give_the_text_again(text):
    got = parts(text)
    assert all(0 < len(p) <= 60 for _, p, _ in got)
    assert "".join(p if i == 0 else p[10:] for i, (_, p, _) in enumerate(got)) == text


def test_cuts_where_the_grid_is_too_wide():
    text = "x" * 100
    got = parts(text, 20, 5)
    assert all(0 < len(p) <= 20 for _, p, _ in got)
    assert "".join(p if i == 0 else p[5:] for i, (_, p, _) in enumerate(got)) == text


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a b " * 2000, "x"), (2, None, "x"), (3, "", "x"), (4, "z" * 4000, "x"), (5, "日本" * 2001, None)], "content_id long, visible_text string, piece string")
    got = pieces.split_oversized(df).collect()
    assert {r["content_id"] for r in got} == {1, 5} and all(r["n_chars"] == len(r["piece"]) <= 4000 for r in got)
    assert {r[0] for r in pieces.cut_found(df).collect()} == {1, 5}
    assert pieces.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, overlap=3000)


# ---- one form -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"), ("été", "été"), ("ze​ro﻿ ⁠wi­dth", "zero width"), ("no break space ", "no break space "),
        ("Раsѕwоrd", "Password"), ("ΑΒΕ αο", "ABE ao"), ("ﬁve oﬀ ﬆop", "five off stop"), ("write‐up ‑ so…", "write-up - so..."), ("ｶﾞ", "ガ"), ("a\r\nb\rc", "a\nb\nc"), ("ё", "ë"), ("c​̧", "ç"), ("한", "한"),
        ("ᎪᎳ", "AW"), ("ӏӀѵ", "lIv"), ("ոՕ", "nO"), ("ᴄᴏꜱ", "cos"), ("ꓧꓮꓔ", "HAT"), ("3−2", "3-2"),
    ],
)
def test_alike(a, b):
    assert lookalike.visible_form(a) == lookalike.visible_form(b)


@pytest.mark.parametrize(("a", "b"), [("naive", "naïve"), ("A", "a"), ("½", "1/2"), ("x²", "x2"), ("①", "1"), ("が", "か"), ("й", "и"), ("0", "O"), ("\U0001f469‍\U0001f52c", "\U0001f469\U0001f52c"), ("❤️", "❤"), ("𝐀", "A"), ("kış", "kis"), ("a–b", "a-b")])
def test_not_alike(a, b):
    assert lookalike.visible_form(a) != lookalike.visible_form(b)


@given(st.text(max_size=60))
@settings(max_examples=500, deadline=None)
def test_form_is_stable_composed_and_the_same_for_equal_texts(text):
    form = lookalike.visible_form(text)
    assert lookalike.visible_form(form) == form
    assert unicodedata.is_normalized("NFC", form)
    assert lookalike.visible_form(unicodedata.normalize("NFD", text)) == form


def test_stable_ranges_are_stable():
    pattern = re.compile(f"[{lookalike.STABLE}]")
    unstable = lookalike._tables()[0]
    assert not [c for c in range(0x80, 0x11000) if not 0xD800 <= c < 0xE000 and pattern.match(chr(c)) and unstable.match(chr(c))]


def test_forms_in_the_table_equal_the_function(spark):
    texts = [None, "", "plain", "naïve", "Раs", "a\rb", "日本語 ｗｉｄｅ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("form", F.lit("clash"))
    got = {r["id"]: r["form"] for r in lookalike.normalized(df, "id", "text").collect()}
    assert got == {i: t if t is None else lookalike.visible_form(t) for i, t in enumerate(texts)}


def test_pairs(spark):
    rows = [(1, "Password"), (2, "Pаssword"), (3, "Password"), (4, "password"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "Ｐassword"), (10, "x"), (11, "x")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {tuple(r) for r in lookalike.lookalike_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9)}
    assert lookalike.lookalike_pairs(df.limit(0), "id", "text").count() == 0


def test_pairs_of_a_hot_form(spark):
    rows = [(i, "Password") for i in range(4000)] + [(4000, "Pаssword"), (4001, "Pаssword"), (4002, "Ｐassword")]
    got = {tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(i, j) for i in range(4000) for j in (4000, 4001, 4002)} | {(4000, 4002), (4001, 4002)}


# ---- ids ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_text(reference, text):
    assert encode.encoder(FILE).encode(text) == reference(text)


def test_ids_of_hard_texts(reference):
    rng = random.Random(3)
    texts = ["<|endoftext|>", "a" * 20000, "".join(rng.choices("ab", k=20000)), "日本語" * 2000, "  \n\n \t x"]
    texts += ["".join(rng.choices(k, k=60)) for k in ("the", "aA", "-=", "0123", "éàö", "!.?") for _ in range(150)]
    for text in texts:
        assert encode.encoder(FILE).encode(text) == reference(text)


def test_compatible_pairs_are_those_that_merge_to_themselves():
    e = encode.encoder(FILE)
    rng = random.Random(4)

    def merged(word):
        p = list(word)
        while len(p) > 1:
            best = min(range(len(p) - 1), key=lambda i: e.ranks.get(p[i] + p[i + 1], 1 << 60))
            if p[best] + p[best + 1] not in e.ranks:
                break
            p[best : best + 2] = [p[best] + p[best + 1]]
        return [e.ranks[x] for x in p]

    short = [r for r, w in e.word_of.items() if len(w) < 6]
    for _ in range(20000):
        a, b = rng.choice(short), rng.choice(short)
        assert e._fits(a, b) == (merged(e.word_of[a] + e.word_of[b]) == [a, b])


def test_encoded_table(spark, reference):
    df = spark.createDataFrame([(1, "Hello wörld"), (2, ""), (3, None), (3, "x" * 5000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode.encode_corpus(df).collect())
    assert got == sorted([(1, reference("Hello wörld")), (2, []), (3, []), (3, reference("x" * 5000))])
    assert sorted(r["n_tokens"] for r in encode.token_counts(df).collect()) == sorted(len(i) for _, i in got)
    assert encode.encode_corpus(df.limit(0)).count() == 0
