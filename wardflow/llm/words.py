"""Words of a text, and the share of words that two texts have in common."""

from __future__ import annotations

import re
from collections import Counter

#: A word is a longest run of letters and digits, read in lower case.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shared(a: Counter, b: Counter) -> float:
    """Words common to both, counted with repetition, over all words of both (common ones once)."""
    if len(b) < len(a):
        a, b = b, a
    get = b.get
    common = sum(min(n, get(w, 0)) for w, n in a.items())
    every = a.total() + b.total() - common
    return common / every if every else 0.0
