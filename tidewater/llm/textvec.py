"""Vectorised word scanning of text batches (numpy, inside Arrow tasks).

A batch of texts is lower-cased and laid out as one array of code points;
words are maximal runs of accepted characters.  Work and memory follow the
number of characters in a slice, and long texts are never cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
SLICE_CHARS = 1_000_000


class Words(NamedTuple):
    codes: np.ndarray   # code point per character, 0 outside words
    start: np.ndarray   # first character of each word
    length: np.ndarray  # characters of each word
    doc: np.ndarray     # row of each word inside the slice
    n_docs: int


@functools.cache
def _accepted(kind: str) -> np.ndarray:
    test = {"alpha": str.isalpha, "alnum": str.isalnum}[kind]
    return np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[list]:
    """Consecutive runs of whole texts of about ``limit`` characters (a longer text is its own run)."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def scan(texts: list, kind: str) -> Words:
    """Words of the lower-cased texts (null counts as empty)."""
    low = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)
    inside = _accepted(kind)[codes]
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(step == 1)
    length = np.flatnonzero(step == -1) - start
    first = np.cumsum([0] + [len(t) + 1 for t in low[:-1]])
    doc = np.searchsorted(first, start, side="right") - 1
    return Words(np.where(inside, codes, 0).astype(np.uint32), start, length, doc, len(low))


_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _P, np.uint64))])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word; equal on every worker."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    offset = np.cumsum(w.length) - w.length
    pos = np.arange(int(w.length.sum())) - np.repeat(offset, w.length)
    at = np.repeat(w.start, w.length) + pos
    value = (w.codes[at].astype(np.uint64) + np.uint64(1)) * _pow(int(w.length.max()))[pos]
    return mix(np.add.reduceat(value, offset) + w.length.astype(np.uint64))


def beginnings(w: Words, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``lengths``, ascending: the words that are at least as long, and the hashes of their first characters."""
    total = np.zeros(len(w.start), np.uint64)
    at = np.arange(len(w.start))
    for i in range(max(lengths)):
        at = at[w.length[at] > i]
        total[at] += (w.codes[w.start[at] + i].astype(np.uint64) + np.uint64(1)) * _pow(i + 1)[i]
        if i + 1 in lengths:
            yield at, mix(total[at] + np.uint64(i + 1))


def ngram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word index of each run of ``n`` words inside one row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _P + h[i:len(h) - n + 1 + i]
    at = np.flatnonzero(doc[:len(out)] == doc[n - 1:])
    return mix(out[at]), at
