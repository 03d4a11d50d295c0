"""Kernels of the evidence of answers: streams of rows in which what is searched comes before what asks.

Each word of a chunk is stemmed once a task; pairs of queries and chunks leave
it as one row each, with the places that matched and the best line of each
sentence.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import pyarrow as pa

from quarry.functions import text as T

Kernel = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Characters of a line at least, and what is trimmed of it.
LEAST, SPACE = 10, " \t\n\v\f\r"

_PARTS = re.compile(T.LINE_ENDS)
_CUT, _IES = re.compile(T._CUT), re.compile("ies$")
_ENDING = re.compile("^(?:(.*ss)es|(.{3,})ing|(.{3,})ed|(.*[^s])s)$")


def stem(word: str) -> str:
    """functions.text.stem of one word."""
    return word if len(word) <= 3 else _ENDING.sub(r"\1\2\3\4", _IES.sub("y", _CUT.sub(r"\1", word)))


def build_keys(s: str) -> tuple[str, ...]:
    """functions.text.build_keys without those of equal stems that another key implies."""
    return ("5" + s[:5], "4" + s[:4]) if len(s) >= 5 else ("4" + s, "x" + s) if len(s) == 4 else (s,)


def probe_keys(s: str) -> tuple[str, ...]:
    """functions.text.probe_keys without those of equal stems that another key implies."""
    return ("5" + s[:5], "x" + s[:4]) if len(s) >= 5 else ("4" + s,) if len(s) == 4 else (s,)


class _Memo(dict):
    """Values of a function, each found once, as long as they are few."""

    def __init__(self, of: Callable, most: int = 500_000):
        self.of, self.most = of, most

    def __missing__(self, x):
        if len(self) >= self.most:
            self.clear()
        self[x] = y = self.of(x)
        return y


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def asked(stop: list[str]) -> Callable[[pa.Schema], Kernel]:
    """Batches of query_id, attempts, sentences (a line each: 1 or 0 for a question or short one, its words) to query_id, stems, told.

    stems: a line a sentence, empty where it needs no evidence; told: attempt,
    index, free and number of content words of each.
    """
    stop = frozenset(stop)

    def run(schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _Memo(lambda word: "" if word in stop else stem(word)).__getitem__
        for batch in batches:
            out = []
            for query_id, attempts, texts in _rows(batch):
                lines, told = [], []
                for attempt, text in zip(attempts, texts):
                    for i, s in enumerate(text.split("\n") if text else [], 1):
                        content = list(filter(None, map(stems, s[1:].split())))
                        free = not content or (len(content) <= 2 and s[0] == "1")
                        lines.append("" if free else " ".join(content))
                        told.append((attempt, i, free, len(content)))
                out.append((query_id, "\n".join(lines), pickle.dumps(told)))
            yield _batch(out, schema)

    return lambda schema: partial(run, schema)


class _Chunk:
    """What a chunk holds: of each key a bit for the words of the whole text, then one for each piece in which it stands, if that is a line.

    words: those of the text and what parts its lines, in order. A hyphen in a
    word parts lines too; what it leaves of one character is no word.
    """

    def __init__(self, content: str, words: str, keys: _Memo):
        self.lines, self.at = [x.strip(SPACE) for x in _PARTS.split(content)], (at := {})
        of = keys.__getitem__
        for k in chain.from_iterable(map(of, words.split())):
            at[k] = 1
        bit = 1
        for line, own in zip(self.lines, _PARTS.split(words)):
            bit <<= 1
            if len(line) >= LEAST:
                for k in chain.from_iterable(map(of, own.split())):
                    at[k] = at.get(k, 0) | bit

    def support(self, asked: list[list[tuple[str, ...]]]) -> list[tuple]:
        """Of each sentence (keys of its words) that finds anything: its number, places of its words that the chunk holds, most matches in a line, number of the first such line, the line."""
        found, get = [], self.at.get
        for j, sentence in enumerate(asked):
            hits, n = [], {}
            for w, keys in enumerate(sentence):
                mask = 0
                for k in keys:
                    mask |= get(k, 0)
                if mask:
                    if mask & 1:
                        hits.append(w)
                    mask >>= 1
                    while mask:
                        low = mask & -mask
                        n[low] = n.get(low, 0) + 1
                        mask ^= low
            if n:
                m = max(n.values())
                i = min(low for low, x in n.items() if x == m).bit_length() - 1
                found.append((j, hits, m, i, self.lines[i]))
            elif hits:
                found.append((j, hits, 0, 0, None))
        return found


def met(stop: list[str]) -> Callable[[pa.Schema], Kernel]:
    """Batches of chunk_id, doc_id, content, words of chunks, each before the query_id, rank, stems that ask it, to query_id, found: rank, chunk_id, doc_id and support of a pair."""
    stop = frozenset(stop)

    def run(schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Memo(lambda word: () if len(word) < 2 or word in stop else build_keys(stem(word)))
        probes = _Memo(probe_keys)
        at, doc, row, chunk = None, None, None, None
        for batch in batches:
            out = []
            for chunk_id, doc_id, content, words, query_id, rank, stems in _rows(batch):
                if stems is None:
                    at, doc, row, chunk = chunk_id, doc_id, (content or "", words or ""), None
                elif row is not None and chunk_id == at:
                    chunk = chunk or _Chunk(*row, keys)
                    if found := chunk.support([[probes[s] for s in x.split()] for x in stems.split("\n")]):
                        out.append((query_id, pickle.dumps((rank, chunk_id, doc, found))))
            yield _batch(out, schema)

    return lambda schema: partial(run, schema)


def best(schema: pa.Schema) -> Kernel:
    """Batches of query_id, told of queries, each before its query_id, found, to query_id, attempt, sentence_index, free, matched, total, line_matches, best_doc_id, best_snippet.

    The most matches win, then the first rank and the first line.
    """

    def rated(query_id, told: list[tuple], pairs: list[tuple]) -> Iterator[tuple]:
        hits, top = [set() for _ in told], [None] * len(told)
        for rank, chunk_id, doc_id, found in pairs:
            for j, places, m, i, line in found:
                hits[j].update(places)
                place = (m, -math.inf if rank is None else -rank, -i, chunk_id)
                if m and (top[j] is None or place > top[j][0]):
                    top[j] = place, doc_id, line
        for (attempt, index, free, total), x, t in zip(told, hits, top):
            yield (query_id, attempt, index, free, len(x), total, *((t[0][0], *t[1:]) if t else (None, None, None)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told, pairs = None, [], []
        for batch in batches:
            out = []
            for query_id, own, found in _rows(batch):
                if own is not None:
                    out += rated(last, told, pairs)
                    last, told, pairs = query_id, pickle.loads(own), []
                else:
                    pairs.append(pickle.loads(found))
            yield _batch(out, schema)
        yield _batch(list(rated(last, told, pairs)), schema)

    return run
