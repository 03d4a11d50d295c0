"""Boundary-snapped chunks of documents, in parallel over documents.

Each chunk starts where the one before it allows, so a document is walked from
front to back; documents are independent. Offsets count code points and are
those before the text is trimmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
LOOKBACK, MIN_CHUNK, WORD_BACK, SPACE_BACK = 180, 20, 100, 80
# Abbreviations before a full stop that is no boundary, and the marks that may be one.
ABBREVIATIONS = frozenset("vs al eg ie dr prof fig tab ref no etc med vol".split())
MARKS = ".!?\n•"
_JUNK = re.compile(r"[\s\-,;]*")
_WORD = re.compile(r"[^\W\d_]*$")


def _depths(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Depth of square and of round brackets at each position from start, never below zero."""
    square, both, s, r = [], [], 0, 0
    for c in text[start:end]:
        if c == "[":
            s += 1
        elif c == "]":
            s = max(0, s - 1)
        elif c == "(":
            r += 1
        elif c == ")":
            r = max(0, r - 1)
        square.append(s)
        both.append(s + r)
    return square, both


def chunk_spans(text: str, max_tokens: int = 256, overlap: int = 32) -> list[tuple[int, int]]:
    """Start and end of each piece, blank ones included."""
    if overlap >= max_tokens:
        raise ValueError("overlap must be smaller than the chunk")
    size, back = max_tokens * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    spans, start, n = [], _JUNK.match(text).end(), len(text)
    while start < n:
        end = min(start + size, n)
        square, both = _depths(text, start, min(end + 1, n))

        def ends_sentence(i: int, start: int = start, both: list[int] = both) -> bool:
            c, nxt = text[i], text[i + 1 : i + 2]
            if c not in MARKS:
                return False
            if c != ".":
                return True
            if nxt and not (nxt.isspace() or nxt in ")]"):
                return False
            return _WORD.search(text[start:i])[0].lower() not in ABBREVIATIONS and both[i - start] == 0

        if end < n:
            lowest = end - min(LOOKBACK, end - start - MIN_CHUNK)
            cut = next((i + 1 for i in range(end, lowest - 1, -1) if ends_sentence(i)), -1)
            if cut <= start:
                gap = next((i for i in range(end - 1, max(start, end - WORD_BACK) - 1, -1) if text[i] == " " and square[i - start] == 0), None)
                if gap is None:
                    gap = text.rfind(" ", end - min(SPACE_BACK, end - start), end)
                cut = gap + 1 if gap > start else end
            end = cut
        spans.append((start, end))
        if end >= n:
            break
        nxt = max(end - back, start + 1)
        snap = next((i + 1 for i in range(nxt, end) if ends_sentence(i)), -1)
        if start < snap < end:
            nxt = snap
        elif not text[nxt - 1].isspace() and 0 < (gap := text.find(" ", nxt)) < end:
            nxt = gap + 1
        start = max(_JUNK.match(text, nxt).end(), start + 1)
        start = _JUNK.match(text, start).end()
    return spans


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", content: str = "content", metadata: str | None = None, max_tokens: int = 256, overlap: int = 32) -> DataFrame:
    """chunk_id, doc_id, content, chunk_index, start_offset, end_offset, metadata. Null and blank contents have no chunks."""
    if overlap >= max_tokens:
        raise ValueError("overlap must be smaller than the chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, meta in zip(b.doc_id, b.content, b.metadata, strict=True):
                k = 0
                for s, e in chunk_spans(text, max_tokens, overlap) if text.strip() else ():
                    piece = text[s:e].strip().lstrip("-,;:)]").strip()
                    if piece:
                        rows.append((f"{i}_c{k}", i, piece, k, s, e, {**dict(meta if meta is not None else {}), "source_doc_id": i, "chunk_index": str(k)}))
                        k += 1
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "content", "chunk_index", "start_offset", "end_offset", "metadata"])

    meta = F.col(metadata) if metadata else F.lit(None).cast("map<string,string>")
    src = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content"), meta.alias("metadata")).where("doc_id IS NOT NULL AND content IS NOT NULL")
    return src.mapInPandas(run, "chunk_id string, doc_id string, content string, chunk_index int, start_offset int, end_offset int, metadata map<string,string>")
