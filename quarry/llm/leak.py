"""Problem 8: evaluation passages inside a corpus, by spaced-seed hashing.

Words of passages and documents (form of problem 2, folded case, punctuation
dropped) are hashed through fixed masks that ignore some positions, so a hit
survives substituted words there. Test and corpus hashes are joined; around
each hit the two word sequences are compared along the diagonal.

While the test side is at most ``BROADCAST_HASHES`` hashes (8 bytes each) it is
sent to the tasks, which then emit only documents with a hit. A larger test
side is joined by shuffle with the hashes alone; the words of documents with a
hit are then taken in a second pass. Null and empty texts have no words and no
hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm.visual_form import look

SPAN = 12
#: 1: the position counts. They count eight or nine of twelve positions; no position is ignored by all. The last one keeps three words of four, for texts in which every fourth word is another.
MASKS = ("110110110111", "111010011110", "101101111011", "111110110001", "111011101110")
BROADCAST_HASHES = 4_000_000
#: A mismatch inside an overlap costs as much as so many matching words.
MISMATCH = 2
_FOLD = {ord("İ"): "i", ord("I"): "i", ord("ı"): "i"}


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words and the index of their text."""
    h, doc, _, _ = K.words([look(t).translate(_FOLD).casefold() for t in texts])
    return h, doc


def seeds(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By mask and first word: hash of the words the mask keeps. Only windows within one text: their hashes, index of the first word."""
    m = len(h) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[SPAN - 1 :])
    out = [K.combined(h, [i for i, keep in enumerate(mask) if keep == "1"], m, k + 1)[at] for k, mask in enumerate(MASKS)]
    return np.concatenate(out), np.tile(at, len(MASKS))


_BITS = np.uint64(22)


def is_known(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array; a table of their low bits settles most."""
    hit = np.zeros(len(s), bool)
    if len(known):
        low = np.zeros(1 << int(_BITS), bool)
        mask = (np.uint64(1) << _BITS) - np.uint64(1)
        low[(known & mask).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(s & mask).astype(np.int64)])
        x = s[maybe]
        hit[maybe] = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
    return hit


def _rows(batches: Iterator[pd.DataFrame], known: np.ndarray | None, with_words: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, texts = b.id.to_numpy(), K.filled(b.text)
        for first, some in K.blocks(texts):
            h, doc = tokens(some)
            s, at = seeds(h, doc)
            if known is not None and len(s):
                hit = is_known(s, known)
                s, at = s[hit], at[hit]
            if not len(s):
                continue
            order = np.argsort(doc[at], kind="stable")
            s, at = s[order], at[order]
            docs, begin = K.group_starts(doc[at])
            end = np.append(begin[1:], len(s))
            w0, w1 = np.searchsorted(doc, docs), np.searchsorted(doc, docs, side="right")
            yield pd.DataFrame(
                {
                    "id": ids[first + docs],
                    "words": [h[x:y].view(np.int64) if with_words else None for x, y in zip(w0, w1, strict=True)],
                    "seed": [s[x:y].view(np.int64) for x, y in zip(begin, end, strict=True)],
                    "pos": [(at[x:y] - w).astype(np.int32) for x, y, w in zip(begin, end, w0, strict=True)],
                }
            )


_SCHEMA = "id long, words array<long>, seed array<long>, pos array<int>"


def _scan(df: DataFrame, id_col: str, col: str, known=None, with_words: bool = True) -> DataFrame:
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return src.mapInPandas(lambda it: _rows(it, known.value if known is not None else None, with_words), _SCHEMA)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            best = (0, 0, 0, 0, 0)
            longest = 0
            for d in r.shifts:
                lo, hi = max(0, -d), min(len(r.item_words), len(r.words) - d)
                same = np.asarray(r.item_words[lo:hi]) == np.asarray(r.words[lo + d : hi + d])
                gaps = np.flatnonzero(np.concatenate(([True], ~same, [True])))
                longest = max(longest, int(np.diff(gaps).max()) - 1)
                total = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
                gain = total - np.minimum.accumulate(total)
                end = int(gain.argmax())
                start = int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1])
                if gain[end] > best[0]:
                    best = (int(gain[end]), lo + start, lo + start + d, end - start, int(same[start:end].sum()))
            out.append((r.doc_id, r.item_id, longest, *best))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "exact_words", "score", "item_word", "doc_word", "n_words", "same_words"])


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """One row per document and item with a seed in common: the longest run of equal words and the best overlap.

    doc_id, item_id, exact_words, score (matches less MISMATCH a substitution),
    item_word and doc_word (where the overlap begins), n_words, same_words.
    """
    test = K.checkpointed(spark, _scan(items, item_id, passage))
    flat = test.select(F.col("id").alias("item_id"), F.explode(F.arrays_zip("seed", "pos")).alias("z")).select("item_id", F.col("z.seed").alias("seed"), F.col("z.pos").alias("item_pos"))
    small = flat.count() <= BROADCAST_HASHES
    known = spark.sparkContext.broadcast(np.unique(flat.select("seed").distinct().toPandas().seed.to_numpy(np.int64).view(np.uint64))) if small else None
    marked = _scan(docs, doc_id, text, known, with_words=small).withColumnRenamed("id", "doc_id")
    if small:  # documents with a hit only
        marked = K.checkpointed(spark, marked)
    hits = marked.select("doc_id", F.explode(F.arrays_zip("seed", "pos")).alias("z")).select("doc_id", F.col("z.seed").alias("seed"), F.col("z.pos").alias("doc_pos"))
    met = hits.join(F.broadcast(flat) if small else flat, "seed").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("doc_pos") - F.col("item_pos")).alias("shifts"))
    if not small:
        met = K.checkpointed(spark, met)
        hit = docs.join(met.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
        marked = _scan(hit, doc_id, text).withColumnRenamed("id", "doc_id")
    side = test.select(F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    both = met.join(marked.select("doc_id", "words"), "doc_id").join(F.broadcast(side) if small else side, "item_id").select("doc_id", "item_id", "shifts", "words", "item_words")
    return both.mapInPandas(_compare, "doc_id long, item_id long, exact_words int, score int, item_word int, doc_word int, n_words int, same_words int").groupBy("doc_id", "item_id").agg(F.max_by(F.struct("exact_words", "score", "item_word", "doc_word", "n_words", "same_words"), F.struct("exact_words", "score", "doc_word")).alias("x")).select("doc_id", "item_id", "x.*")
