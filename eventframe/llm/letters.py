"""Words and their parts as numpy arrays: texts as code points, letters marked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import regex

SLAB_CHARS = 1 << 19
BETWEEN_WORDS = regex.compile(r"\W")


@cache
def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def slabs(texts: Sequence[str | None], chars: int = SLAB_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``chars`` characters, with the number of each one's text.

    A longer text is cut into pieces with the same number, before a character that is in no
    word; one word is never cut, however long. Null counts as empty and is left out.
    """
    owners, pieces, total = [], [], 0
    for n, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = len(text)
            if end - at > chars:
                found = BETWEEN_WORDS.search(text, at + chars)
                end = found.start() if found else end
            owners.append(n)
            pieces.append(text[at:end])
            total += end - at
            at = end
            if total >= chars:
                yield owners, pieces
                owners, pieces, total = [], [], 0
    if pieces:
        yield owners, pieces


def code_points(pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all pieces with a 0 before, between and behind them; what is
    not a letter is 0. Then whether each is a letter, and where each piece begins."""
    lowered = [p.lower() for p in pieces]
    sizes = np.array([len(p) + 1 for p in lowered])
    joined = "\0" + "\0".join(lowered) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    is_letter = letter_table()[points]
    points[~is_letter] = 0
    return points, is_letter, np.cumsum(sizes) - sizes + 1


MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(points: np.ndarray, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash of every run of letters."""
    edges = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    room = 1 << max(20, int(len(points)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * _powers(MULTIPLIER, room)[: len(points)], dtype=np.uint64)])
    return begins, ends - begins, mixed((sums[ends] - sums[begins]) * _powers(INVERSE, room)[begins])


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    values = (values ^ values >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(29)
