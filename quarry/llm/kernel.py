"""Vectorised text primitives shared by the operators of this subpackage.

Texts of one Arrow batch are laid end to end as an array of code points, and
words, word hashes and word n-gram hashes are found with whole-array numpy
operations; no Python code runs per word or per character.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.sources import store

#: Texts are laid together up to about this many code points; a longer text stands alone.
BLOCK_CHARS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=1)
def _char_hash() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + _ODD)


#: Odd factors by position, for hashing sequences of hashes.
FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * _ODD) | np.uint64(1)


def combined(h: np.ndarray, positions: list[int], m: int, seed: int = 0) -> np.ndarray:
    """By window of m consecutive ones: one hash of the hashes at these positions in it."""
    x = np.full(m, seed, np.uint64)
    t = np.empty(m, np.uint64)
    for i in positions:
        np.multiply(h[i : i + m], FACTORS[i], out=t)
        x += t
    return mix(x)


class _Powers:
    up = down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", _ODD), ("down", _ODD_INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            setattr(_Powers, name, np.cumprod(p))
    return _Powers.up, _Powers.down


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about BLOCK_CHARS code points, with the index of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text begins."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return cp, starts


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters and digits: hash, index of the text, first and last + 1 offset in that text."""
    cp, starts = code_points(texts)
    inside = _alnum()[cp]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(cp) + 1)
    run = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_char_hash()[cp] * up[: len(cp)], out=run[1:])
    h = mix((run[e] - run[s]) * down[s])
    doc = np.searchsorted(starts, s, side="right") - 1
    return h, doc, s - starts[doc], e - starts[doc]


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, the index of the text and of the first word."""
    if len(h) < n:
        return h[:0], doc[:0], np.zeros(0, np.int64)
    m = len(h) - n + 1
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return combined(h, list(range(n)), m)[at], doc[at], at


_ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"'”’»)]“"], np.uint32)
_SPACE = np.array([9, 10, 32], np.uint32)


def sentence_bounds(cp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of plain sentences (end mark, closers, white space), and whether an end mark with closers is at a position."""
    end = np.isin(cp, _ENDS)
    closer = np.isin(cp, _CLOSERS)
    for _ in range(2):  # closing quotes and brackets belong to the end
        end[1:] |= end[:-1] & closer[1:]
    cut = np.flatnonzero(end[:-1] & np.isin(cp[1:], _SPACE)) + 1
    return np.unique(np.concatenate([begin, cut, [len(cp)]])), end


def group_starts(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins."""
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[at], at


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of spark.checkpoint.dir (see quarry.sources.store)."""
    return store.stored(df)


def filled(values: Iterable) -> list[str]:
    """Null texts as empty ones."""
    return [x if isinstance(x, str) else "" for x in values]
