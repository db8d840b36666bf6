"""Problems 1, 2, 5, 6, 8 and 9 against brute force on small tables."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.functions.runtime import shared_dir
from wardflow.llm import components, copies, mixture, near, overlap, packing, sketch, subjects
from wardflow.llm.words import shared, words

WORDS = [f"w{i}" for i in range(400)]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        k = rng.random()
        i = rng.randrange(len(out))
        if k < 0.5:
            out[i] = rng.choice(WORDS)
        elif k < 0.75:
            out.insert(i, rng.choice(WORDS))
        else:
            del out[i]
    return out


# ---- copies -------------------------------------------------------------------------------------

RECORD = "Title: A b?\nTags: x, y\nBody: Hello, world"
COPIES = [
    (1, "Hello, World!"), (2, "hello  WORLD"), (3, "hel lo(world)"), (4, "hello worlds"), (5, None), (6, ""), (7, " \n"), (8, "..."), (9, "..."), (10, RECORD), (11, '{"tags": "x,y", "body": "HELLO world", "title": "a B"}'), (12, "body: hello world | title: A b? | tags: X Y"),
    (13, "Title: A b?\nTags: x, y"), (14, "title a b tags x y"), (15, "Straße"), (16, "STRASSE"), (17, '{"title": broken'), (18, "Title: A b\nTitle: A b\nBody: c"), (19, "HELLO　world"),
]


def test_copies(spark):
    df = spark.createDataFrame(COPIES, "doc_id long, text string").withColumn("k1", F.lit(0)).withColumn("n", F.lit(0))
    for share in (0.001, 0.2, 2.0):  # no hot keys, some, all of them
        got = {tuple(r) for r in copies.copies_found(df, hot_share=share).collect()}
        assert got == {(1, 2), (1, 3), (1, 19), (10, 11), (10, 12), (13, 14), (15, 16)}
    counts = {r["first_id"]: r["n_copies"] for r in copies.copy_counts(df).collect()}
    assert counts[1] == 4 and counts[10] == 3 and counts[8] == 2 and counts[5] == 1 and sum(counts.values()) == len(COPIES)


def test_copies_of_an_empty_table_and_a_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Hot! "), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")), F.lit("text"))).otherwise(F.col("id").cast("string")).alias("text"))
    got = copies.copies_found(df).groupBy("first_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 999)]
    assert copies.copies_found(df.limit(0)).count() == 0 and copies.copy_counts(df.limit(0)).count() == 0


# ---- near-duplicates ----------------------------------------------------------------------------


def corpus(seed, families=25, size=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = rng.choices(WORDS, k=rng.randrange(22, 90))
        rows += [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 8))) for _ in range(size)]
    rows += [rows[0]] * 40 + [" ".join(reversed(rows[1].split()))] + [None, "", "a b c", "x " * 19, "y " * 25, "y " * 26]
    rng.shuffle(rows)
    return list(enumerate(rows))


def groups_by_force(rows, least=20, threshold=0.8):
    bags = {i: Counter(words(t)) for i, t in rows if t and len(words(t)) >= least}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(bags, 2):
        if shared(bags[a], bags[b]) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(find(i), i) for i in bags if find(i) != i}


@pytest.mark.parametrize(("whole_bucket", "hot_rows", "max_pairs"), [(64, 1000, 10**6), (3, 1000, 10**6), (3, 4, 3)])
def test_near_groups(spark, monkeypatch, whole_bucket, hot_rows, max_pairs):
    """Also with buckets of more than three rows going the way of large ones, with hot ones, and with pairs that aren't broadcast."""
    monkeypatch.setattr(near, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(near, "MAX_PAIRS", max_pairs)
    rows = corpus(5)
    links = near.links
    monkeypatch.setattr(near, "links", lambda *a: links(*a, whole_bucket=whole_bucket))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    assert {tuple(r) for r in near.near_groups(df).collect()} == groups_by_force(rows)


def test_near_groups_of_nothing(spark):
    assert near.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near.near_groups(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0


def shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_large_buckets_of_unlike_texts_are_not_copied_to_every_partition(spark, monkeypatch):
    """Buckets above ``whole_bucket`` whose rows are not alike; at 6 GB such are common, and each row went to every shuffle partition."""
    rng = random.Random(12)
    common = rng.choices(WORDS, k=45)  # 45 of 61 words are shared
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(8)])) for i in range(120)]
    links = near.links
    monkeypatch.setattr(near, "links", lambda *a: links(*a, whole_bucket=8))
    keep, shared = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}, Path(shared_dir(spark).removeprefix("file://"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, there = shuffled_rows(spark), set(shared.iterdir())
        assert near.near_groups(df, threshold=0.98).count() == 0
        moved = sum(n for s, n in shuffled_rows(spark).items() if s not in before)
        names = {p.name.split("-", 1)[1].rsplit("-", 1)[0] for p in set(shared.iterdir()) - there}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert moved < 6 * sketch.BANDS * len(rows)
    assert not names & {"signatures", "distinct", "met", "named", "left-out"}  # deleted when they were read


@pytest.mark.parametrize(("block_rows", "a_partition"), [(5, 20_000), (1 << 14, 1)])
def test_near_groups_in_blocks_and_parts(spark, monkeypatch, block_rows, a_partition):
    monkeypatch.setattr(near, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(near, "PASS_TEXTS", 20)
    monkeypatch.setattr(near, "PAIRS_A_PARTITION", a_partition)
    monkeypatch.setattr(near, "MAX_PAIRS", 3)
    monkeypatch.setattr(near, "HOT_ROWS", 30)
    rows = corpus(7, 12)
    links = near.links
    monkeypatch.setattr(near, "links", lambda *a: links(*a, whole_bucket=2))
    assert {tuple(r) for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == groups_by_force(rows)


def test_sketches_tell_unlike_texts():
    """Pairs that meet in a band by chance grow with the square of the input; hardly any may pass."""
    rng = random.Random(13)
    rows = [rng.choices(WORDS, k=25) + [f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(300)]
    signed = sketch._sign([Counter(x) for x in rows], sketch._Hashes())
    longs = np.stack([signed[f"s{i}"] for i in range(sketch.LONGS)], 1).view(np.uint64)
    differ = sum(np.bitwise_count(longs[:, None, i] ^ longs[None, :, i]).astype(int) for i in range(sketch.LONGS))
    assert (differ[np.triu_indices(len(rows), 1)] <= sketch.limit(0.8)).sum() == 0


def test_sketches_estimate_similarity():
    rng = random.Random(6)
    rows = [rng.choices(WORDS, k=60) for _ in range(40)]
    pairs = [(a, edited(rng, a, k)) for a in rows for k in (0, 3, 6, 20)] + list(zip(rows, rows[1:]))
    signed = sketch._sign([Counter(x) for p in pairs for x in p], sketch._Hashes())
    longs = np.stack([signed[f"s{i}"] for i in range(sketch.LONGS)], 1).view(np.uint64)
    differ = [sum(int(x).bit_count() for x in longs[2 * i] ^ longs[2 * i + 1]) for i in range(len(pairs))]
    for (a, b), d in zip(pairs, differ):
        if shared(Counter(a), Counter(b)) >= 0.8:
            assert d <= sketch.limit(0.8)
    same = [d for (a, b), d in zip(pairs, differ) if a == b]
    assert same and max(same) == 0
    far = [d for (a, b), d in zip(pairs, differ) if shared(Counter(a), Counter(b)) < 0.35]
    assert np.mean([d > sketch.limit(0.8) for d in far]) > 0.7


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, i) for i in range(101, 140)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (500, 499), (101, 100)], "a long, b long")
    got = {tuple(r) for r in components.components(df).collect()}
    assert got == {(i, 0) for i in range(1, 31)} | {(i, 100) for i in range(101, 140)} | {(500, 499)}
    assert components.components(df.limit(0)).count() == 0


# ---- overlaps -----------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_overlaps(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(near, "HOT_ROWS", hot_rows)
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["train", "train", "val", "test", " Train", None]), "src") for i, t in corpus(9, 15)]
    rows += [(1000, "Short one!", "train", "a-B "), (1001, "short  ONE", "val", " A_b"), (1002, "...", "train", "x"), (1003, "!!!", "test", "x"), (1004, "short one", "test", "x")]
    df = spark.createDataFrame(rows, "sample_id long, text string, split_name string, source string").withColumn("id", F.lit(0)).withColumn("train", F.lit(0))
    split = {i: s.strip().lower() for i, _, s, _ in rows if s}
    bags = {i: Counter(words(t)) for i, t, s, _ in rows if t and s and len(words(t)) >= 20}
    bare = defaultdict(list)
    for i, t, s, _ in rows:
        if t and s and any(c.isalnum() for c in t):
            bare["".join(c for c in t.lower() if c.isalnum())].append(i)
    expected = {p for v in bare.values() for p in combinations(sorted(v), 2)} | {tuple(sorted(p)) for p in combinations(bags, 2) if shared(bags[p[0]], bags[p[1]]) >= 0.8}
    expected = {(a, b) for a, b in expected if (split[a] == "train") != (split[b] == "train")}
    assert {tuple(r) for r in overlap.split_overlaps(df).collect()} == expected
    report = {(r["split_name"], r["source"]): (r["n_pairs"], r["n_records"]) for r in overlap.overlap_report(df).collect()}
    assert report["val", "a_b"] == (1, 1)
    said = defaultdict(Counter)
    for a, b in expected:
        e = a if split[b] == "train" else b
        name = next((s.strip().lower(), src.strip().lower().replace("-", "_")) for i, _, s, src in rows if i == e)
        said[name][e] += 1
    assert report == {k: (v.total(), len(v)) for k, v in said.items()}
    assert overlap.split_overlaps(df.limit(0)).count() == 0


# ---- mixes --------------------------------------------------------------------------------------


def test_poisson_means():
    for rate, cap in ((0.01, 1), (0.5, 1), (0.9, 2), (2.5, 4), (3.99, 4), (800, 2000), (744, 1000), (9_999, 20_000), (1e-7, 3)):
        assert mixture._truncated(mixture.mean_for(rate, cap), cap) == pytest.approx(rate, rel=1e-6)
    assert mixture._cumulative(800, 2000)[799] == pytest.approx(0.5, abs=0.02)
    for rate, cap in ((4, 4), (5, 4), (-1, 2)):
        with pytest.raises(ValueError):
            mixture.mean_for(rate, cap)


def test_mix(spark):
    rng = random.Random(10)
    sizes = {"a": 3000, "b": 300, "c": 20}
    rows = [(f"{s}{i}", "x" * rng.randrange(0, 400), ("train" if i % 10 else "val"), s if i % 3 else f" {s.upper()}", 0) for s, n in sizes.items() for i in range(n)]
    rows += [("n1", None, "train", "a", 0), ("n2", "x", "train", "a", None), ("n3", "x", "train", None, 0)]
    df = spark.createDataFrame(rows, "sample_id string, text string, split_name string, source string, label int").withColumn("u", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0, 0.5, 1), ("b", 0, 0.2, 4), ("c", 0, 0.2, 3), ("none", 0, 0.1, 2)], "source string, label int, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixture.shares(df, targets).collect()}
    whole = sum(len(r[1] or "") for r in rows if r[2] == "train")
    assert got["a"]["actual_share"] == pytest.approx(0.5, abs=0.002)
    assert got["b"]["actual_share"] == pytest.approx(0.2, abs=0.002)
    assert got["c"]["most_repeats"] == 3 and got["c"]["chars_taken"] == 3 * got["c"]["chars_available"]  # all it can give
    assert got["none"]["chars_taken"] == 0 and got["none"]["actual_share"] == 0
    taken = mixture.draw(df, targets).collect()
    assert all(0 <= r["n_times"] <= {"a": 1, "b": 4, "c": 3}[r["source"]] for r in taken)
    assert sum(r["n_times"] * r["n_chars"] for r in taken) == sum(r["chars_taken"] for r in got.values())
    assert taken == mixture.draw(df, targets).collect() or sorted(taken) == sorted(mixture.draw(df, targets).collect())
    placed = mixture.mix(df, targets).collect()
    assert Counter(r["sample_id"] for r in placed) == {r["sample_id"]: r["n_times"] for r in taken if r["n_times"]}
    assert [r["place"] for r in placed] == sorted(r["place"] for r in placed) and whole > 0
    assert mixture.draw(df, targets.limit(0)).count() == 0 and mixture.draw(df.limit(0), targets).count() == 0


# ---- containers ---------------------------------------------------------------------------------


def test_plans_hold_everything_once_and_waste_little():
    for seed in range(30):
        rng = random.Random(seed)
        capacity = rng.choice([10, 100, 2048])
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 3000)))
        used, n = Counter(), 0
        for filling, times in packing.plan(dict(counts), capacity):
            assert sum(s * k for s, k in filling.items()) <= capacity and times > 0
            used.update({s: k * times for s, k in filling.items()})
            n += times
        assert used == counts
        least = -(-sum(s * k for s, k in counts.items()) // capacity)
        large = sum(k for s, k in counts.items() if 2 * s > capacity)
        assert n <= 1.05 * max(least, large) + 2


def test_two_items_replace_the_smallest():
    plan = packing.plan({6: 1, 3: 1, 2: 2, 4: 1}, 10)
    assert sum(t for _, t in plan) == 2


def test_pack(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([7, 7, 7, rng.randrange(1, 300)])) for i in range(2000)] + [(3000, 250), (3001, 0), (3002, None), (3003, 100), (3004, 200)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("rank", F.lit("clash")).withColumn("piece", F.lit("clash"))
    got = packing.pack(df, capacity=100, group_rows=50).collect()
    assert {(r["doc_id"], r["piece"], r["container"]) for r in got} == {(r["doc_id"], r["piece"], r["container"]) for r in packing.pack(df.repartition(7), capacity=100, group_rows=50).collect()}
    load = Counter()
    for r in got:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    total, n = Counter(), Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        n[r["doc_id"]] += 1
    sizes = {i: s for i, s in rows if s}
    assert total == sizes and all(n[i] == -(-s // 100) for i, s in sizes.items())
    assert len(load) <= 1.02 * -(-sum(sizes.values()) // 100) + 1
    assert packing.pack(df.limit(0)).count() == 0
    named = packing.pack(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), capacity=100).collect()
    assert {r["doc_id"] for r in named} == {f"d{i}" for i in sizes}


# ---- subjects -----------------------------------------------------------------------------------

TERMS = {s: [f"{s[:3]}{x}" for x in ("alpha", "beta", "gamma", "delta", "kappa", "sigma")] for s in subjects.SUBJECTS}


def made(rng, of, n=6, aside=None, unseen=False):
    out = [f"Here one sees {rng.choice(TERMS[s] + ([s[:3] + 'omega'] * 3 if unseen else []))} and {rng.choice(TERMS[s])} in the {rng.choice(['old', 'new'])} way." for i in range(n) for s in [of[i % len(of)]]] if of else ["Thanks for the answer."] * n
    if aside:
        out.append(f"Off topic but somebody compared this with {rng.choice(TERMS[aside])}.")
    return " ".join(out)


def examples(rng):
    one = [(made(rng, [s], aside=rng.choice([x for x in TERMS if x != s]) if i % 3 == 0 else None), [s]) for s in TERMS for i in range(12)]
    return one + [(made(rng, ["law", "sport"]), ["law", "sport"]) for _ in range(6)] + [(made(rng, []), []) for _ in range(6)]


def test_subjects(spark):
    rng = random.Random(13)
    ex = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(examples(rng))], "example_id long, text string, subjects array<string>")
    names = list(TERMS)
    truth, rows = {}, []
    for i in range(300):
        of = rng.choice([[rng.choice(names)], rng.sample(names, 2), []])
        rows.append((i, made(rng, of, aside=rng.choice(names) if of and i % 4 == 0 else None, unseen=True)))
        truth[i] = set(of)
    for i, s in enumerate(names):  # a word that no example has
        rows.append((400 + i, f"Here one sees {s[:3]}omega and {s[:3]}omega in the old way."))
        truth[400 + i] = {s}
    rows += [(900, None), (901, ""), (902, " \n"), (903, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subjects", F.lit("clash"))
    got = {r["doc_id"]: set(r["subjects"]) for r in subjects.document_subjects(df, ex).collect()}
    assert all(got[i] == set() for i in (900, 901, 902, 903))
    right = sum(len(got[i] & t) for i, t in truth.items())
    f1 = 2 * right / (sum(len(got[i]) for i in truth) + sum(map(len, truth.values())))
    assert f1 > 0.95
    assert subjects.document_subjects(df.limit(0), ex).count() == 0


def test_learned_words_are_whole(spark):
    rng = random.Random(14)
    ex = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(examples(rng))], "example_id long, text string, subjects array<string>")
    names = list(TERMS)
    rows = [(i, made(rng, [names[i % 8]], unseen=True) + " Anna Berta Carla and Dora said so.") for i in range(160)]
    rows += [(400 + i, f"Here one sees {s[:3]}omega and {s[:3]}omega in the old way.") for i, s in enumerate(names)]
    rows += [(500, rows[-1][1]), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({r["doc_id"]: set(r["subjects"]) for r in subjects.document_subjects(df, ex, p=subjects.Parameters(max_words=n)).collect()} for n in (3, 50_000))
    assert few == many and len(few) == len(rows)
    assert all(few[400 + i] == {s} for i, s in enumerate(names)) and few[500] == few[407]


def test_learned_words_do_not_depend_on_size(spark):
    rng = random.Random(15)
    labelled = [(subjects.tokens(t), [subjects.SUBJECTS.index(x) for x in of]) for t, of in examples(rng)]
    model = subjects.trained(labelled, subjects.Parameters(), (3.5,))
    texts = [made(rng, [s], unseen=True) + f" {s[:3]}rare" * (i < 5) + " mostly" * (i < 4 or s == "law" and i < 15) for s in TERMS for i in range(16)]
    # Of 43 texts that hold it 15 are of law; one in five holders of "leaning" is of another subject, as chance gives it.
    texts += [made(rng, ["law"]) + " leaning"] * 4 + [made(rng, ["music"]) + " leaning"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams, total = subjects.learn(df, model, list(model.words) + ["here one", "never seen"], subjects.Parameters())
    assert {r["ngram"]: sum(r["counts"]) for r in grams.filter("known").collect()}["here one"] == len(texts)
    assert sum(total) == sum(len({w for w in subjects.tokens(t) if w != "."}) for t in texts)
    words = {r["ngram"] for r in grams.filter("NOT known").collect()}
    assert words == {f"{s[:3]}{x}" for s in TERMS for x in ("omega", "rare")}


def test_subjects_without_examples(spark):
    ex = spark.createDataFrame([], "example_id long, text string, subjects array<string>")
    df = spark.createDataFrame([(1, "anything at all")], "doc_id long, text string")
    assert subjects.document_subjects(df, ex).collect()[0]["subjects"] == []


def test_held_out_examples(spark, sf):
    rows = spark.read.parquet(f"{sf}/subject_examples.parquet").orderBy("example_id").collect()
    labelled = [(subjects.tokens(r["text"]), sorted(map(subjects.SUBJECTS.index, r["subjects"]))) for r in rows]
    assert subjects.calibrate(labelled, subjects.Parameters(), (3.5,))[3] > 0.93


def test_evidence_is_the_mean_log_ratio_of_interpolated_models():
    p = subjects.Parameters()
    rows = [(subjects.tokens(t), of) for t, of in [("the old court rules . the court", [1])] * 6 + [("the old drum plays", [7])] * 6 + [("the old way", [])] * 4]
    model = subjects.train(rows, p, 3.5)
    held = {w: [sum(w in t for t, of in rows if of == [c]) for c in range(8)] for w in ("the", "old", "court")}
    total = [sum(len(set(t) - {"."}) for t, of in rows if of == [c]) for c in range(8)]
    every = sum(len(set(t) - {"."}) for t, _ in rows)
    share = [max(1e-6, x / every) for x in total]
    # "the" and "old" are pruned, so that law's model backs off to the background there.
    court = (held["court"][1] / share[1] + p.prior) / (6 + p.prior)
    pair = (6 / 6) / (6 / 16)  # of six texts of law with "the" six hold "the court", and of all sixteen with it six
    value = math.log(p.bigram * pair + p.unigram * court + 1 - p.bigram - p.unigram)
    block = subjects.Block([subjects.tokens("The court unknown word.")], subjects._Ids(model.words))
    s = subjects.score(block, model)
    assert s.subject[0] == 1 and s.evidence[0] == pytest.approx(value / 4, rel=1e-5)
