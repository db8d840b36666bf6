"""Subject area of each document (problem 9).

Interpolated bigram, unigram and background models, one for each subject, are compared with the background model of
the whole corpus: a sentence's evidence for a subject is the mean over its tokens of the log probability that the
subject's model gives less the one that the background gives, which is the difference of their cross-entropies per token.
Counts are of texts that hold an n-gram. They come from the labelled texts and from the texts of the corpus that a first
model gives to just one subject; the background's come from all texts, those without a subject included. An n-gram whose
counts chance may give is pruned from a subject's model, which then backs off to the background; so does a word that no
model has.

A sentence speaks for the subject of most evidence, if that is enough; asides (sentences in the frames in which
labelled texts mention another field, told by the likelihoods of two models of frames) count for nothing. A document is about
the subjects that hold a share of its sentences, none, one or two; both limits are calibrated by cross-validation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.runtime import materialize

#: The subjects.
SUBJECTS = ("science", "law", "sport", "software", "medicine", "cooking", "finance", "music")
#: How much a word must speak for a subject, as log ratio, to belong to it.
CLAIMED = 0.7
#: Classes of counts: the subjects, and everything else.
CLASSES = len(SUBJECTS) + 1
#: A longest run of letters that touches no digit, so that parts of codes are no words; runs of Hiragana and of
#: Kanji or Katakana are words of their own. Else what ends a sentence, and line ends.
_KANA, _KANJI = r"ぁ-ゟ", r"々゠-ヿ一-鿿"
_LETTER = rf"[^\W\d_{_KANA}{_KANJI}]"
TOKEN = re.compile(rf"[{_KANA}]+|[{_KANJI}]+|(?<![^\W_{_KANA}{_KANJI}]){_LETTER}++(?!\d)|[.!?…]+[\"')\]]*(?=\s|$)|[。！？]|[\n\r]")
_ENDS = frozenset(".!?…。！？\n\r")


@dataclass(frozen=True)
class Parameters:
    #: Weights of bigram and unigram in the interpolation; the rest is the background's.
    bigram: float = 0.2
    unigram: float = 0.6
    #: Texts of average composition that are added to the counts of every n-gram.
    prior: float = 0.5
    #: An n-gram is pruned from a subject's model unless twice the log-likelihood ratio of its counts to the subject's share of
    #: all reaches a gain, and the subject would have ``min_lead`` of its texts if all subjects had equally many.
    #: The gain is ``seed_gain`` for labelled texts alone; with the corpus's counts cross-validation chooses among ``gains``.
    seed_gain: float = 3.5
    gains: tuple[float, ...] = (3.5, 16.0)
    min_lead: float = 0.5
    #: Labelled rows used at most, by smallest id.
    max_examples: int = 20_000
    #: A word that only the corpus holds joins the models if ``min_texts`` hold it and its gain is at least twice the logarithm of
    #: the number of words counted, so that chance admits about as few in a corpus of any size.
    min_texts: int = 3
    #: Words of the corpus that workers get as a whole; if there are more, those of a text are joined to it. None is dropped.
    max_words: int = 50_000
    #: Log odds of an aside's frame at which a sentence is one: a single frame word is not enough.
    aside_odds: float = 4.0
    #: Parts of the cross-validation, and the values that it tries: evidence per token, and share of the sentences.
    folds: int = 5
    evidence: tuple[float, ...] = (0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2)
    share: tuple[float, ...] = (0.18, 0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.32, 0.34, 0.36, 0.38)


def tokens(text: str) -> list[str]:
    """The words of a text in lower case, and what ends its sentences."""
    return TOKEN.findall(text.lower())


class Counts:
    """How many texts of each class hold each word, and each pair of neighbours ("v w") of a sentence."""

    def __init__(self) -> None:
        self.of: dict[str, list[int]] = {}
        self.total = [0] * CLASSES

    def add(self, found: Sequence[str], cls: int, pairs: bool = True) -> None:
        words = {t for t in found if t[0] not in _ENDS}
        held = words
        if pairs:
            held = words | {f"{a} {b}" for a, b in zip(found, found[1:]) if a[0] not in _ENDS and b[0] not in _ENDS}
        self.total[cls] += len(words)
        for x in held:
            if x not in self.of:
                self.of[x] = [0] * CLASSES
            self.of[x][cls] += 1

    def with_corpus(self, learned: Learned, total: Sequence[int]) -> Counts:
        """The sum of these counts and those of the corpus; ``learned`` has only the n-grams that matter."""
        out = Counts()
        out.total = [a + b for a, b in zip(self.total, total)]
        out.of = {x: list(n) for x, n in self.of.items()}
        for x, n in learned.items():
            out.of[x] = [a + b for a, b in zip(out.of[x], n)] if x in out.of else list(n)
        return out


#: Of n-grams counted over the corpus, how many texts of each class hold them.
Learned = dict[str, tuple[int, ...]]


def _gain(k: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of ``k`` of ``n`` to a ``share``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(k > 0, k * np.log(k / (n * share)), 0.0)
        b = np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - share))), 0.0)
    return 2 * (a + b)


class Model:
    """Log ratios of each subject's model to the background's, by word, and what a pair of neighbours adds to its second word's."""

    def __init__(self, counts: Counts, p: Parameters, gain: float) -> None:
        words = [x for x in counts.of if " " not in x]
        self.p, self.gain = p, gain
        self.share = np.clip(np.array(counts.total[:-1], float) / max(1, sum(counts.total)), 1e-6, 0.999)
        self.words: dict[str, int] = {w: i for i, w in enumerate(words)}
        k = np.array([counts.of[w] for w in words], float).reshape(-1, CLASSES)
        ratio, _ = self._ratios(k)
        self.values = np.vstack([np.log((p.bigram + p.unigram) * ratio + (1 - p.bigram - p.unigram)), np.zeros((2, len(SUBJECTS)))]).astype(np.float32)
        self._pairs(counts, k, ratio)
        self.telling = np.any(self.values != 0, axis=1)
        self.asides = np.zeros(len(words) + 2, np.float32)
        self.evidence, self.accepted = 0.05, 0.24

    def _ratios(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of counts by class, each subject's probability to the background's, 1 where it is pruned; and where it isn't."""
        p, n = self.p, k.sum(axis=1, keepdims=True)
        ratio = (k[:, :-1] / self.share + p.prior) / (n + p.prior)
        sure = (_gain(k[:, :-1], n, self.share) >= self.gain) & (ratio > 1) & (ratio >= p.min_lead * ratio.sum(axis=1, keepdims=True))
        return np.where(sure, ratio, 1.0), sure

    def _pairs(self, counts: Counts, k: np.ndarray, ratio: np.ndarray) -> None:
        p, size = self.p, len(self.words) + 2
        # A pair seen once says no more than its words.
        pairs = [x for x, n in counts.of.items() if " " in x and sum(n) > 1]
        ends = np.array([[self.words[w] for w in x.split(" ")] for x in pairs], np.int64).reshape(-1, 2)
        both = np.array([counts.of[x] for x in pairs], float).reshape(-1, CLASSES)
        first = k[ends[:, 0]]
        _, sure = self._ratios(both)
        n, n_first = both.sum(axis=1, keepdims=True), first.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            of_first = (both[:, :-1] / first[:, :-1]) / (n / n_first)
        single = ratio[ends[:, 1]]
        two = np.where(sure & (first[:, :-1] > 0), of_first, single)
        rest = 1 - p.bigram - p.unigram
        adds = np.log(p.bigram * two + p.unigram * single + rest) - np.log((p.bigram + p.unigram) * single + rest)
        keep = np.abs(adds).max(axis=1, initial=0) > 0.01
        order = np.argsort((ends[keep, 0] * size + ends[keep, 1]), kind="stable")
        self.keys = (ends[keep, 0] * size + ends[keep, 1])[order]
        self.adds = adds[keep][order].astype(np.float32)

    def widened(self, learned: Learned) -> Model:
        """The same model with more words; asides and pairs stay as they are."""
        if not learned:
            return self
        out = object.__new__(Model)
        out.__dict__.update(self.__dict__)
        new = [w for w in learned if w not in self.words]
        ratio, _ = self._ratios(np.array([learned[w] for w in new], float).reshape(-1, CLASSES))
        more = np.log((self.p.bigram + self.p.unigram) * ratio + (1 - self.p.bigram - self.p.unigram)).astype(np.float32)
        size = len(self.words)
        out.words = self.words | {w: size + i for i, w in enumerate(new)}
        out.values = np.vstack([self.values[:size], more, self.values[size:]])
        out.telling = np.any(out.values != 0, axis=1)
        out.asides = np.concatenate([self.asides[:size], np.zeros(len(new), np.float32), self.asides[size:]])
        out.keys = self.keys // (size + 2) * (size + len(new) + 2) + self.keys % (size + 2)
        return out


class _Ids(dict):
    """Numbers of words; one number for all unknown words, and the next one for what ends a sentence."""

    def __init__(self, words: dict[str, int]) -> None:
        super().__init__(words)
        self.unknown = len(words)

    def __missing__(self, token: str) -> int:
        return self.unknown + (token[0] in _ENDS)


class Block:
    """Texts given as ``tokens``: the number of every word, and the sentence that it stands in, all texts in one array."""

    def __init__(self, found: Sequence[Sequence[str]], ids: _Ids) -> None:
        self.texts, self.ids = found, ids
        end = ids.unknown + 1
        self.words = np.fromiter((i for t in found for i in (*map(ids.__getitem__, t), end)), np.int64)
        stops = self.words == end
        self.sentence = np.cumsum(stops) - stops
        #: Of each sentence its text, how many words it has, and where they begin.
        self.text = np.repeat(np.arange(len(found)), [len(t) + 1 for t in found])[stops]
        self.size = np.bincount(self.sentence[~stops], minlength=len(self.text))
        self.first = np.flatnonzero(stops) - self.size
        self.known = np.flatnonzero(self.words < ids.unknown)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The sentence and the key of each two known words that stand side by side."""
        second = self.known[1:][np.diff(self.known) == 1]
        return self.sentence[second], self.words[second - 1] * (self.ids.unknown + 2) + self.words[second]


def _place(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are ``among`` sorted ones, and where."""
    place = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
    hit = among[place] == keys if len(among) else np.zeros(len(keys), bool)
    return hit, place[hit]


@dataclass
class Scored:
    """Of each sentence of a block the best subject, its evidence per token (0 for a sentence without words), and whether it is an aside."""

    subject: np.ndarray
    evidence: np.ndarray
    aside: np.ndarray


def score(block: Block, model: Model) -> Scored:
    n = len(block.text)
    at, of = block.sentence[block.known], block.words[block.known]
    aside = np.bincount(at, model.asides[of], n) > model.p.aside_odds
    telling = model.telling[of]
    sums = np.stack([np.bincount(at[telling], v, n) for v in model.values[of[telling]].T], axis=1)
    where, keys = block.neighbours()
    hit, place = _place(keys, model.keys)
    if len(place):
        sums += np.stack([np.bincount(where[hit], v, n) for v in model.adds[place].T], axis=1)
    best = sums.argmax(axis=1)
    return Scored(best, sums[np.arange(n), best] / np.maximum(block.size, 1), aside)


def shares(block: Block, s: Scored, evidence: float) -> np.ndarray:
    """The share of each subject in each text's sentences that speak for any."""
    speaks = (s.evidence >= evidence) & ~s.aside
    places = block.text[speaks] * len(SUBJECTS) + s.subject[speaks]
    counts = np.bincount(places, minlength=len(block.texts) * len(SUBJECTS)).reshape(len(block.texts), -1)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def about(block: Block, s: Scored, model: Model) -> np.ndarray:
    """For each text and subject, whether the text is about it."""
    held = shares(block, s, model.evidence)
    return (held >= model.accepted) & (held > 0)


Labelled = list[tuple[list[str], list[int]]]


def _fit_asides(examples: Labelled, model: Model) -> None:
    """Log odds of frame words between the sentences of a field that isn't the text's and the others: two smoothed unigram models.

    Only words that no subject claims are frames; one must stand in two such sentences.
    """
    labelled = [(t, labels) for t, labels in examples if labels]
    model.asides[:] = 0
    if not labelled:
        return
    block = Block([t for t, _ in labelled], _Ids(model.words))
    s = score(block, model)
    frame = (model.values.max(axis=1) < CLAIMED)[block.words]
    aside, plain, n_aside, n_plain = Counter(), Counter(), 0, 0
    for i, (text, first, size) in enumerate(zip(block.text, block.first, block.size)):
        words = block.words[first : first + size]
        words = set(words[frame[first : first + size] & (words < block.ids.unknown)].tolist())
        if s.evidence[i] >= model.evidence and s.subject[i] not in labelled[text][1]:
            aside.update(words)
            n_aside += 1
        elif size:
            plain.update(words)
            n_plain += 1
    if n_aside < 2:
        return
    for w, k in aside.items():
        odds = math.log((k + 0.1) / (n_aside + 0.2)) - math.log((plain[w] + 0.1) / (n_plain + 0.2))
        if k >= 2 and odds > 1.0:
            model.asides[w] = odds
    for w, k in plain.items():
        if not model.asides[w] and k >= 3:
            model.asides[w] = -1.0 if w not in aside else -0.2


def train(examples: Labelled, p: Parameters, gain: float | None = None, learned: Learned | None = None, total: Sequence[int] | None = None) -> Model:
    """The model of labelled texts, and of the counts ``learned`` from the corpus with their ``total``."""
    other = CLASSES - 1
    counts = Counts()
    for found, labels in examples:
        if len(labels) < 2:
            counts.add(found, labels[0] if labels else other)

    def made() -> Model:
        return Model(counts.with_corpus(learned, total) if learned is not None else counts, p, p.seed_gain if gain is None else gain)

    model = made()
    # Sentences of texts of two subjects go to the one of them that models them better.
    several = [x for x in examples if len(x[1]) > 1]
    if several:
        block = Block([t for t, _ in several], _Ids(model.words))
        s = score(block, model)
        ends = np.cumsum([len(t) + 1 for t, _ in several])
        for i, (found, labels) in enumerate(several):
            of: dict[int, list[str]] = {}
            for k in np.flatnonzero(block.text == i):
                at = block.first[k] - (ends[i] - len(found) - 1)
                cls = int(s.subject[k]) if s.evidence[k] >= model.evidence and s.subject[k] in labels else other
                of.setdefault(cls, []).extend((*found[at : at + block.size[k]], "."))
            for cls, words in of.items():
                counts.add(words, cls)
        model = made()
    _fit_asides(examples, model)
    return model


def calibrate(examples: Labelled, p: Parameters, gains: Sequence[float], learned: Learned | None = None, total: Sequence[int] | None = None) -> tuple[float, float, float, float]:
    """(gain, evidence, share, F1): the acceptance that is best in cross-validation over the labelled texts."""
    tried: dict[tuple[float, float, float], list[int]] = {(g, e, s): [0, 0, 0] for g in gains for e in p.evidence for s in p.share}
    for k in range(min(p.folds, len(examples))):
        held = [x for i, x in enumerate(examples) if i % p.folds == k]
        true = np.zeros((len(held), len(SUBJECTS)), bool)
        for i, (_, labels) in enumerate(held):
            true[i, labels] = True
        for gain in gains:
            model = train([x for i, x in enumerate(examples) if i % p.folds != k], p, gain, learned, total)
            block = Block([t for t, _ in held], _Ids(model.words))
            s = score(block, model)
            for e in p.evidence:
                of = shares(block, s, e)
                for share in p.share:
                    said = (of >= share) & (of > 0)
                    n = tried[gain, e, share]
                    n[0], n[1], n[2] = n[0] + int((said & true).sum()), n[1] + int(said.sum()), n[2] + int(true.sum())
    f1 = {x: 2 * right / max(1, said + real) for x, (right, said, real) in tried.items()}
    best = max(f1.values())
    # Of equally good values the most pruning, and of the others those in the middle.
    gain = max(g for (g, _, _), f in f1.items() if f == best)
    good = sorted(e for (g, e, _), f in f1.items() if f == best and g == gain)
    evidence = good[len(good) // 2]
    accepted = sorted(s for (g, e, s), f in f1.items() if f == best and (g, e) == (gain, evidence))
    return gain, evidence, accepted[len(accepted) // 2], best


def trained(examples: Labelled, p: Parameters, gains: Sequence[float], learned: Learned | None = None, total: Sequence[int] | None = None) -> Model:
    """The calibrated model."""
    gain, evidence, accepted, _ = calibrate(examples, p, gains, learned, total)
    model = train(examples, p, gain, learned, total)
    model.evidence, model.accepted = evidence, accepted
    return model


# ---- over the corpus ----------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Rows, a block of ``size`` at a time, with the tokens of their second column; null texts have none."""
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            part = batch.slice(first, size)
            yield part, [tokens(v.as_py()) if v.is_valid else [] for v in part.column(1)]


def _count(given: Broadcast, pairs: Broadcast):
    """For mapInArrow over (id, text): (ngram, class, n), in how many texts of a class each word, and each of ``pairs``, stands.

    A text of one subject counts for it as a whole; of a text of several, the sentences count that speak for one of them. The rest
    is of the last class. The empty n-gram counts all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        ids = _Ids(model.words)
        names: list[str] = pairs.value
        keys = np.array([ids[a] * (ids.unknown + 2) + ids[b] for a, b in (x.split(" ") for x in names)], np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        counts: list[Counter] = [Counter() for _ in range(CLASSES)]
        by_pair = np.zeros((CLASSES, len(names)), np.int64)

        def flush() -> pa.RecordBatch:
            for c, of_pairs in zip(counts, by_pair):
                for w in [w for w in c if w[0] in _ENDS]:
                    del c[w]
                whole = c.total()
                c.update({names[order[i]]: int(of_pairs[i]) for i in np.flatnonzero(of_pairs)})
                c[""] = whole
            by_pair[:] = 0
            grams = [w for c in counts for w in c]
            classes = [i for i, c in enumerate(counts) for _ in range(len(c))]
            n = [k for c in counts for k in c.values()]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(classes, pa.int32()), pa.array(n, pa.int64())], names=["ngram", "class", "n"])

        for _, found in _blocks(batches):
            block = Block(found, ids)
            s = score(block, model)
            yes = about(block, s, model)
            several = yes.sum(axis=1)
            of_text = np.where(several == 1, yes.argmax(axis=1), CLASSES - 1)
            own = (s.evidence >= model.evidence) & ~s.aside & yes[block.text, s.subject]
            of_sentence = np.where((several > 1)[block.text] & own, s.subject, of_text[block.text])
            for i in np.flatnonzero(several < 2):
                counts[of_text[i]].update(set(found[i]))
            flat = [w for t in found for w in (*t, ".")] if (several > 1).any() else []
            for i in np.flatnonzero(several > 1):
                held: dict[int, set[str]] = {}
                for k in range(*np.searchsorted(block.text, (i, i + 1))):
                    held.setdefault(int(of_sentence[k]), set()).update(flat[block.first[k] : block.first[k] + block.size[k]])
                for cls, words in held.items():
                    counts[cls].update(words)
            where, seen = block.neighbours()
            hit, place = _place(seen, keys)
            once = np.unique(np.stack([block.text[where[hit]], of_sentence[where[hit]], place]), axis=1)
            np.add.at(by_pair, (once[1], once[2]), 1)
            if sum(map(len, counts)) > 200_000:
                yield flush()
        yield flush()

    return run


def _gain_of(k: Column, n: Column, share: float) -> Column:
    """The same as ``_gain``, of columns."""
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return 2 * (part(k, n * F.lit(share)) + part(n - k, n * F.lit(1 - share)))


def learn(texts: DataFrame, model: Model, grams: list[str], p: Parameters) -> tuple[DataFrame, list[int]]:
    """((ngram, counts, known), total): counts by class, over all texts, of ``grams`` and of the words that tell subjects apart beyond chance.

    Counts are partial in each task before they are shuffled; total is of all words by class.
    """
    context = texts.sparkSession.sparkContext
    given = context.broadcast(model), context.broadcast([x for x in grams if " " in x])
    counted = texts.mapInArrow(_count(*given), "ngram string, class int, n long").groupBy("ngram")
    by = counted.agg(*[F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(CLASSES)])
    known = texts.sparkSession.createDataFrame(pa.table({"ngram": pa.array(sorted(grams), pa.string()), "known": pa.array([True] * len(grams), pa.bool_())}))
    by = by.join(F.broadcast(known), "ngram", "left").withColumn("known", F.coalesce("known", F.lit(False)))  # n-grams of at most max_examples texts
    n = sum((F.col(f"n{i}") for i in range(1, CLASSES)), F.col("n0"))
    by = materialize(by.withColumn("n", n).filter((F.col("ngram") == "") | F.col("known") | (F.col("n") >= p.min_texts)), "ngrams")
    row = by.filter("ngram = ''").first()
    total = [row[f"n{i}"] for i in range(CLASSES)] if row else [0] * CLASSES
    words = max(2, sum(total))
    share = [min(0.999, max(x / words, 1e-6)) for x in total[:-1]]
    ratio = [F.col(f"n{i}") / F.lit(x) + F.lit(p.prior) for i, x in enumerate(share)]
    every = sum(ratio[1:], ratio[0])
    tells = F.lit(False)
    for i, x in enumerate(share):
        tells |= (_gain_of(F.col(f"n{i}"), F.col("n"), x) >= 2 * math.log(words)) & (ratio[i] >= p.min_lead * every) & (F.col(f"n{i}") > F.col("n") * x)
    found = by.filter("ngram <> ''").filter(F.col("known") | tells)
    return found.select("ngram", F.array(*[F.col(f"n{i}") for i in range(CLASSES)]).alias("counts"), "known"), total


def _collected(grams: DataFrame) -> Learned:
    return {r["ngram"]: tuple(r["counts"]) for r in grams.collect()}


def _classify(given: Broadcast):
    """For mapInArrow over (id, text) or (id, text, extra), extra being learned words of the text that the model doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _blocks(batches):
            model: Model = given.value
            if part.num_columns > 2:
                # Those of all texts of the block at once: each text has all of its own.
                model = model.widened({x["ngram"]: tuple(x["counts"]) for of in part.column(2).to_pylist() for x in of or ()})
            block = Block(found, _Ids(model.words))
            names = [[SUBJECTS[i] for i in np.flatnonzero(row)] for row in about(block, score(block, model), model)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.list_(pa.string()))], names=["id", "subjects"])

    return run


def _words(known: Broadcast):
    """For mapInArrow over (key, text): (key, ngram), the words of each text that the model doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _blocks(batches, 64):
            has = known.value.words
            rows = [(k, w) for k, t in zip(part.column(0).to_pylist(), found) for w in set(t) if w not in has and w[0] not in _ENDS]
            keys, words = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], names=["key", "ngram"])

    return run


def _with_words(texts: DataFrame, words: DataFrame, given: Broadcast) -> DataFrame:
    """(id, text, extra): the learned ``words`` that each text holds; equal texts are looked at once."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    pairs = keyed.filter("text IS NOT NULL").select("key", "text").mapInArrow(_words(given), "key string, ngram string").distinct()
    extra = pairs.join(words.select("ngram", "counts"), "ngram").groupBy("key").agg(F.collect_list(F.struct("ngram", "counts")).alias("extra"))
    return keyed.join(extra, "key", "left").select("id", "text", "extra")


def fit(texts: DataFrame, examples: DataFrame, p: Parameters = Parameters()) -> tuple[Model, DataFrame | None]:
    """The model of labelled ``examples`` (example_id, text, subjects) and of all ``texts`` (id, text), and words that aren't in it.

    Runs jobs: one reads the examples, one counts the corpus. The driver gets the n-grams of at most ``max_examples`` texts and at
    most ``max_words`` others; if more words tell subjects apart, they are given back as a table. Training and calibration see
    the examples only, and so need no others.
    """
    rows = examples.select("example_id", "text", "subjects").orderBy("example_id").limit(p.max_examples).collect()
    labelled = [(tokens(r["text"]), sorted(SUBJECTS.index(s) for s in set(r["subjects"] or []) & set(SUBJECTS))) for r in rows if r["text"]]
    model = trained(labelled, p, (p.seed_gain,))
    counts = Counts()
    for found, _ in labelled:
        counts.add(found, 0)
    grams, total = learn(texts, model, list(counts.of), p)
    wide = trained(labelled, p, p.gains, _collected(grams.filter("known")), total)
    others = grams.filter("NOT known")
    few = _collected(others.limit(p.max_words + 1))
    if len(few) > p.max_words:
        return wide, others
    return wide.widened(few), None


def document_subjects(df: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Parameters = Parameters()) -> DataFrame:
    """(id_col, subjects): the subjects of each document in their order in SUBJECTS; maybe none.

    Null, empty and blank texts have none. The classifier is fitted on at most ``max_examples`` labelled
    rows; what it learns from the corpus is counted over all texts, and every text is classified.
    Without examples no text has a subject. Other columns are ignored.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model, words = fit(texts, examples, p)
    given = texts.sparkSession.sparkContext.broadcast(model)
    if words is not None:
        texts = _with_words(texts, words, given)
    return texts.mapInArrow(_classify(given), "id long, subjects array<string>").withColumnRenamed("id", id_col)
