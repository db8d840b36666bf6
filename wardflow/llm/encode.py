"""Encoding of the whole corpus with a public byte-pair tokenizer (problem 7).

A piece of text is encoded exactly as its merges would, in linear time: an Aho-Corasick automaton over the
vocabulary, its bytes mapped to Latin-1 characters, gives the longest token at each place; a walk over these
goes back to a shorter token, or to the token before, where two neighbours aren't what merging their bytes
gives. Which neighbours are compatible is memoised.

The automaton gives the longest path from each place where a token begins; its failure links are not followed, since after
a match the next token begins at the match's end. Places are reached once each but for those that are gone back to.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the public vocabulary files, and the one of the queries.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept in a worker's memos, the longest piece kept, and texts encoded at once; they only bound memory.
_MEMO, _LONGEST, _BLOCK = 400_000, 64, 256


class Encoder:
    """Token ids of pieces and texts by the ranks of one vocabulary file."""

    def __init__(self, file: str) -> None:
        lines = Path(file).read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, _, b in (x.partition(b" ") for x in lines if x)}
        self.ranks = {b.decode("latin-1"): r for b, r in ranks.items()}
        self.word_of = {r: w for w, r in self.ranks.items()}
        self.widest = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton()
        for w, r in self.ranks.items():
            self.automaton.add_word(w, r)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.compatible: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[str, int, int]]] = {}
        self.shorter: dict[int, int] = {}
        self.on_path: dict[str, int] = {}
        self.fitting: dict[int, int] = {}
        self.size_of = [0] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.size_of[r] = len(b)
        self.pieces = _Pieces(self)

    def _last_merge(self, word: str) -> tuple[str, str]:
        """The two parts whose merge made a token; for tokens of two characters or more."""
        parts, ranks, own = list(word), self.ranks, self.ranks[word]
        while len(parts) > 2:
            found = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
            best = found.index(min(found))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def _edge(self, token: int, right: bool) -> list[tuple[str, int, int]]:
        """The symbols that stand at one edge of a token while it is merged: (symbol, made at rank, merged at rank)."""
        known = self.edges.get((token, right))
        if known is None:
            known, word, until = [], self.word_of[token], 1 << 60
            while len(word) > 1:
                rank = self.ranks[word]
                known.append((word, rank, until))
                word, until = self._last_merge(word)[right], rank
            known.append((word, -1, until))
            self.edges[token, right] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens side by side gives just these tokens.

        Merges go by rank, so symbols of both edges that exist at the same time would merge across if their
        merge comes before either is merged into its own token; of equal ranks the left one comes first.
        """
        known = self.compatible.get(a << 32 | b)
        if known is None:
            known, ranks = True, self.ranks
            for left, made_l, until_l in self._edge(a, True):
                for right, made_r, until_r in self._edge(b, False):
                    if made_l < until_r and made_r < until_l:
                        rank = ranks.get(left + right)
                        if rank is not None:
                            at = max(rank, made_l, made_r)
                            if at < until_l and (at < until_r or at == rank == until_r):
                                known = False
            if len(self.compatible) >= 2 * _MEMO:
                self.compatible.clear()
            self.compatible[a << 32 | b] = known
        return known

    def _longest(self, text: str, at: int) -> int:
        """The longest token at a place."""
        ahead = text[at : at + self.widest]
        path = ahead[: self.automaton.longest_prefix(ahead)]  # a path in the automaton
        token = self.on_path.get(path)
        if token is None:
            n, ranks = len(path), self.ranks
            while path[:n] not in ranks:
                n -= 1
            token = self.on_path[path] = ranks[path[:n]]
        return token

    def _shorter(self, token: int) -> int:
        """The longest token that begins this token and is shorter; -1 if none."""
        known = self.shorter.get(token)
        if known is None:
            word = self.word_of[token]
            known = next((self.ranks[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.ranks), -1)
            self.shorter[token] = known
        return known

    def _fitting(self, last: int, token: int) -> int:
        """The longest of a token and those that begin it that is compatible with the one before; -1 if none."""
        while token >= 0 and not self._fits(last, token):
            token = self._shorter(token)
        return token

    def encode_piece(self, data: bytes) -> list[int]:
        text = data.decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        size, size_of, fitting = len(text), self.size_of, self.fitting
        dead: set[int] = set()  # places from which no valid rest was found
        out: list[int] = []
        at, last, token = 0, -1, self._longest(text, 0)
        while True:
            if last >= 0 and token >= 0:
                key = last << 32 | token
                known = fitting.get(key)
                if known is None:
                    if len(fitting) >= 2 * _MEMO:
                        fitting.clear()
                    known = fitting[key] = self._fitting(last, token)
                token = known
            if token < 0:  # nothing fits here: the one before must be shorter
                dead.add(at)
                token = out.pop()
                at -= size_of[token]
                token = self._shorter(token)
                last = out[-1] if out else -1
                continue
            end = at + size_of[token]
            if dead and end in dead:
                token = self._shorter(token)
                continue
            out.append(token)
            if end == size:
                return out
            at, last = end, token
            token = self._longest(text, at)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


class _Pieces(dict):
    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode_piece(piece.encode("utf-8", "replace")))
        if len(piece) <= _LONGEST:
            if len(self) >= _MEMO:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(file)


def _ids(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file)
        for batch in batches:
            for first in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(first, _BLOCK)
                found = [e.encode(t) if t else [] for t in part.column(1).to_pylist()]
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(found), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    return run


def _sizes(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file)
        get, split = e.pieces.__getitem__, e.split
        for batch in batches:
            sizes = [sum(map(len, map(get, split(v.as_py())))) if v.is_valid else 0 for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["id", "n_tokens"])

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(id_col, ids): the token ids of every text, an empty list for empty and null texts.

    No special tokens: strings that look like them are ordinary text. ``file``: a rank file, readable at
    the same path on each executor. Other columns are ignored; repeated ids are encoded each.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_ids(file), "id long, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(id_col, n_tokens) of every text, 0 for empty and null ones."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sizes(file), "id long, n_tokens int").withColumnRenamed("id", id_col)
