"""Kernels of the searches: blocks of rows against blocks of queries, as whole arrays.

A task meets its rows in the order that breaks ties and keeps the best k of
each query, so the scores of all pairs never leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Scores that are in memory at once, and queries whose sums are built up side by side.
CELLS, SIDE = 4_000_000, 128


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, half away from zero, as the round of SQL does it."""
    a = np.abs(x) * 1e6
    r = np.copysign(np.floor(a + 0.5) / 1e6, x) + 0.0
    for i in np.flatnonzero(np.abs(a - np.floor(a) - 0.5) < 1e-3):
        r[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return r


class Best:
    """The best k rows of each of n queries, by rounded score above the floor; of equal ones the row that came first. NaN is the greatest."""

    def __init__(self, n: int, k: int, floor: float = -np.inf):
        self.k, self.least = k, np.full(n, floor)  # least: what a later row must exceed
        self.q, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, scores: np.ndarray, rows: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """scores: of each query (first axis) and row, right to 1e-7; exact: those of pairs of places in it."""
        with np.errstate(invalid="ignore"):
            near = ~(scores < (self.least + 4e-7)[:, None])
            if len(many := np.flatnonzero(np.count_nonzero(near, axis=1) > 8 * self.k)):
                some = scores[many]
                near[many] &= ~(some < np.partition(some, -self.k, axis=1)[:, -self.k, None] - 2e-6)
            q, c = np.nonzero(near)
            score = rounded(exact(q, c))
            fits = ~(score <= self.least[q])
        if not fits.any():
            return
        q, row, score = (np.concatenate(x) for x in ((self.q, q[fits]), (self.row, rows[c[fits]]), (self.score, score[fits])))
        order = np.lexsort((row, -np.where(np.isnan(score), np.inf, score), q))
        q, row, score = q[order], row[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
        self.q, self.row, self.score = (x[place < self.k] for x in (q, row, score))


def _found(ids: pa.Array, at: list[str], seen: list[pa.Table], best: list[tuple[np.ndarray, Best]]) -> Iterator[pa.RecordBatch]:
    if seen:
        placed = pa.concat_tables(seen)
        for own, b in best:
            q = ids.take(pa.array(own[b.q]))
            yield from pa.table({"query_id": q, **{c: placed[c].take(pa.array(b.row)) for c in at}, "score": pa.array(b.score)}).combine_chunks().to_batches()


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def nearest(ids: pa.Array, vectors: pa.Array, norms: np.ndarray, at: list[str], k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of at, vec, vn to query_id, at, score: the cosine with the queries of the same length."""
    lengths, flat = _list(vectors)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    groups = {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths)}
    sides = {d: flat[starts[own][:, None] + np.arange(d)].astype(np.float64) for d, own in groups.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen, done = {d: Best(len(own), k) for d, own in groups.items()}, [], 0
        for batch in batches:
            sizes, values = _list(batch.column("vec"))
            begin, vn = np.concatenate([[0], np.cumsum(sizes)]), batch.column("vn").to_numpy()
            for d, own in groups.items():
                fit, a, an = np.flatnonzero(sizes == d), sides[d], norms[own]
                step = max(1, CELLS // len(own))
                for s in range(0, len(fit), step):
                    rows = fit[s : s + step]
                    v, n = values[begin[rows][:, None] + np.arange(d)].astype(np.float64), vn[rows]

                    def exact(q, c, a=a, an=an, v=v, n=n, d=d):
                        dot = np.zeros(len(q))
                        for j in range(d):  # term by term, as the columns of functions.text do it
                            dot += a[q, j] * v[c, j]
                        return dot / (an[q] * n[c])

                    with np.errstate(invalid="ignore"):
                        best[d].add((a / an[:, None]) @ (v / n[:, None]).T, rows + done, exact)
            seen.append(pa.Table.from_batches([batch]).select(at))
            done += len(batch)
        yield from _found(ids, at, seen, [(own, best[d]) for d, own in groups.items()])

    return run


def summed(ids: pa.Array, terms: np.ndarray, lengths: np.ndarray, idf: np.ndarray, at: list[str], k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of at, no, weight (lists: numbers of words, their weight in the row) to query_id, at, score: the sum of idf times weight over the words of a query. terms: the words of all queries, one query after the other."""
    by = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[by], lengths[by]
    places = [terms[starts[: np.count_nonzero(sizes > j)] + j] for j in range(sizes.max(initial=0))]  # the j-th word of each query that has one

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen, done = Best(len(by), k, 0.0), [], 0
        step = max(1, min(512, CELLS // max(len(by), 1), CELLS // max(len(idf), 1)))
        for batch in batches:
            n, numbers = _list(batch.column("no"))
            weights, begin = idf[numbers] * _list(batch.column("weight"))[1], np.concatenate([[0], np.cumsum(n)])
            for s in range(0, len(batch), step):
                m = min(step, len(batch) - s)
                cut = slice(begin[s], begin[s + m])
                part = np.bincount(numbers[cut].astype(np.int64) * m + np.repeat(np.arange(m), n[s : s + m]), weights[cut], len(idf) * m).reshape(len(idf), m)
                scores = np.zeros((len(by), m))
                for i in range(0, len(by), SIDE):
                    for own in places:
                        if len(x := own[i : i + SIDE]) == 0:
                            break
                        scores[i : i + len(x)] += part[x]
                best.add(scores, np.arange(s, s + m) + done, lambda q, c, scores=scores: scores[q, c])
            seen.append(pa.Table.from_batches([batch]).select(at))
            done += len(batch)
        yield from _found(ids, at, seen, [(by, best)])

    return run


def _slots(terms: list[str], dims: int) -> np.ndarray:
    """The signed weights of each word in the slots of a hash embedding: from its SHA-256, a byte a slot."""
    b = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in terms), np.uint8).reshape(len(terms), 32)[:, :dims]
    x = 1 + b / 255.0
    return np.where(b & (1 << np.arange(dims) % 8), x, -x)


def embed(keep: list[str], dims: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of keep, w (words) to keep, vec: the sum of the weights of the words in so many slots, 32 at most. Words are hashed once a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 2000):
                part = batch.slice(s, 2000)
                w = part.column("w")
                n, coded = np.diff(w.offsets.to_numpy()), w.flatten().dictionary_encode()
                sums = np.zeros((len(part), dims))
                if len(coded):
                    weights, full = _slots(coded.dictionary.to_pylist(), dims)[coded.indices.to_numpy()], n > 0
                    sums[full] = np.add.reduceat(weights, (np.cumsum(n) - n)[full], axis=0)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dims, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), vec], [*keep, "vec"])

    return run
