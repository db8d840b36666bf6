"""MinHash signatures folded to parity bitmaps, computed for whole Arrow batches.

A text's words with repetition are a set of (word, occurrence) pairs, so that the Jaccard similarity of
two such sets is the share of common words counted with repetition. MinHash samples ROWS * BANDS values
of it. Bands of ROWS samples give keys on which candidates meet; the bitmap has one bit of parity for each
sample, so that the population count of two bitmaps' XOR is half the number of samples that differ, on
average. (A bitmap whose bits several samples share lets more unlike pairs pass, and those that meet in a band
by chance grow with the square of the input.) At similarity 0.8 a pair meets in no band with probability (1 - 0.8 ** ROWS) ** BANDS, 2e-4; at
0.9, 4e-10.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.llm.words import words

ROWS, BANDS = 6, 28
SAMPLES = ROWS * BANDS
LONGS = -(-SAMPLES // 64)
_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: Samples are of 32 bits, of which processors multiply several at once; a text has too few tokens for that to matter.
_MUL = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_ROW_MUL = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)
#: Words kept with their hashes in a worker, and tokens signed at once; both only bound memory.
_MEMO, _BLOCK = 200_000, 1 << 14

SCHEMA = "id long, n int, m1 long, m2 long, " + ", ".join(f"s{i} long" for i in range(LONGS)) + ", keys array<long>"


def limit(threshold: float, samples: int = SAMPLES, sigmas: float = 5) -> int:
    """Largest XOR population count that a pair of similarity ``threshold`` reaches, but for ``sigmas`` deviations."""
    differ = (1 - threshold) / 2
    return int(samples * differ + sigmas * math.sqrt(samples * differ * (1 - differ)))


def differing(a: str, b: str) -> Column:
    """XOR population count of the sketches in the columns prefixed ``a`` and ``b``."""
    total = F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0")))
    for i in range(1, LONGS):
        total = total + F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}")))
    return total


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiply and xor-shift."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _tokens(counts: list[Counter], memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the (word, occurrence) pairs of all texts, and where each text's begin."""
    distinct = np.array([len(c) for c in counts])
    h = np.fromiter((memo[w] for c in counts for w in c), np.uint64, distinct.sum())
    n = np.fromiter((k for c in counts for k in c.values()), np.int64, len(h))
    ends = np.cumsum(n)
    occurrence = np.arange(ends[-1]) - np.repeat(ends - n, n)
    totals = np.array([c.total() for c in counts])
    return _mix(np.repeat(h, n) + occurrence.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), np.cumsum(totals) - totals


def _sign(counts: list[Counter], memo: _Hashes) -> dict[str, np.ndarray]:
    x, starts = _tokens(counts, memo)
    docs = len(counts)
    samples = np.empty((SAMPLES, docs), np.uint32)
    short = (x >> _U(32)).astype(np.uint32)
    hashed = np.empty_like(short)
    for i in range(SAMPLES):
        np.multiply(short, _MUL[i], out=hashed)
        np.add(hashed, _ADD[i], out=hashed)
        np.minimum.reduceat(hashed, starts, out=samples[i])
    # The sample's own number is part of it, so that equal values of different samples differ.
    low = _mix(samples.T.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << _U(32)))
    parity = np.zeros((docs, LONGS * 64), np.uint8)
    parity[:, :SAMPLES] = low >> _U(63)
    longs = np.packbits(parity, axis=1).view(np.int64)
    bands = (low * _ROW_MUL).reshape(docs, BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return {
        "n": np.array([c.total() for c in counts], np.int32),
        "m1": np.add.reduceat(_mix(x + _U(1)), starts).view(np.int64),
        "m2": np.add.reduceat(_mix(x + _U(2)), starts).view(np.int64),
        **{f"s{i}": np.ascontiguousarray(longs[:, i]) for i in range(LONGS)},
        "keys": _mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64),
    }


def sign(min_words: int):
    """For mapInArrow over (id, text): the signatures (SCHEMA) of the texts with at least ``min_words`` words.

    m1 and m2 are equal exactly for equal words with equal repetition (128 bits, order ignored).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            ids, counts, size = [], [], 0

            def flush() -> pa.RecordBatch:
                s = _sign(counts, memo)
                keys = s.pop("keys")
                arrays = [pa.array(ids, pa.int64()), *(pa.array(v) for v in s.values())]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())))
                return pa.RecordBatch.from_arrays(arrays, names=["id", *s, "keys"])

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                if len(found) < min_words or i is None:
                    continue
                ids.append(i)
                counts.append(Counter(found))
                size += len(found)
                if size >= _BLOCK:
                    yield flush()
                    ids, counts, size = [], [], 0
            if ids:
                yield flush()

    return run
