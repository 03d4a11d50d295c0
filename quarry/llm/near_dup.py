"""Problem 6: groups of near-duplicate records by anchor-point covering.

Each text becomes one fingerprint a table: ``symbols`` full min-hash values and
seven one-bit min-hashes, all taken over its distinct word sequences. The
anchors of a table are all (symbols, codeword) with a codeword of the Hamming
[7,4] code, whose covering radius is 1. A text lives at its nearest anchor and
is replicated to every anchor within covering radius plus threshold (1 + 1)
of its fingerprint; so any two texts whose fingerprints differ in at most one
bit meet at the home anchor of either, and texts are compared per anchor. There
are as many tables, of min-hash functions of their own, as keep the share of
pairs at the threshold that never meet below ``MISS``. The
pairs that pass are checked exactly on their sets of word sequences. Texts of
an anchor that many call home are compared in parts, in tasks of their own.

Texts are compared in the form of problem 2, case counts. Texts with the same
form are collapsed before fingerprints travel; only 64-bit keys are shuffled
for them, and word sequences only for texts with a candidate partner.
Null texts and texts below ``min_words`` belong to no group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm.visual_form import digest, form

MISS = 0.001  #: largest share of pairs just at the threshold that are lost, for ideal min-hashes
SKETCH = 42  #: min-hash functions of which three bits each are kept for comparing
SYMBOLS = 2
BITS = 7  #: length of the Hamming code
RADIUS = 1  #: its covering radius
WITHIN = 1  #: largest distance of two fingerprints that must meet
#: Texts of candidates are fetched by broadcast up to so many ids (about 64 bytes each), else by a shuffled join.
BROADCAST_IDS = 500_000
#: An anchor that more texts of a table call home is hot: its texts are compared in SALTS parts.
HOT, SALTS = 1_000, 32
BROADCAST_HOT = 200_000  #: hot anchors that are sent to the tasks, 8 bytes each; more are joined by a shuffle

_CODEWORDS = [c for c in range(128) if not (bin(c & 0b1010101).count("1") % 2 or bin(c & 0b1100110).count("1") % 2 or bin(c & 0b1111000).count("1") % 2)]
_DISTANCE = np.array([[bin(x ^ c).count("1") for c in _CODEWORDS] for x in range(1 << BITS)])
#: By fingerprint bits: the anchors within radius plus threshold, the home anchor first.
ANCHORS = [sorted((int(a) for a in np.flatnonzero(d <= RADIUS + WITHIN)), key=lambda a, d=d: int(d[a])) for d in _DISTANCE]

_NEAR = np.array([[c in a for c in range(len(_CODEWORDS))] for a in ANCHORS])
_MEET = _NEAR[:, [a[0] for a in ANCHORS]]
_MEET = _MEET | _MEET.T  #: by two fingerprints' bits: they meet at the home anchor of either


@lru_cache
def tables_for(min_similarity: float) -> int:
    """The least number of tables in which at most nine tenths of MISS of the pairs at the threshold never meet."""
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be above 0 and at most 1")
    q = (1 - min_similarity) / 2
    apart = np.array([[bin(x ^ y).count("1") for y in range(1 << BITS)] for x in range(1 << BITS)])
    meet = min_similarity**SYMBOLS * float((q**apart * (1 - q) ** (BITS - apart))[_MEET].sum()) / (1 << BITS)
    return 1 if meet >= 1 - MISS / 2 else math.ceil(math.log(0.9 * MISS) / math.log(1 - meet))


@lru_cache
def max_differ(min_similarity: float) -> int:
    """How many of SKETCH min-hashes may differ in three bits: at most a tenth of MISS of the pairs at the threshold differ in more."""
    p = (1 - min_similarity) * 7 / 8
    tail = [sum(math.comb(SKETCH, i) * p**i * (1 - p) ** (SKETCH - i) for i in range(k + 1, SKETCH + 1)) for k in range(SKETCH + 1)]
    return next(k for k, t in enumerate(tail) if t <= 0.1 * MISS)


@lru_cache
def _seeds(tables: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**32, max(SKETCH, tables * (SYMBOLS + BITS)), dtype=np.uint32) | np.uint32(1)


def _grams(texts: list[str], n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """n-word hashes and their text, for texts of at least min_words words."""
    h, doc, _, _ = K.words(texts)
    g, gd, _ = K.ngrams(h, doc, n)
    enough = np.bincount(doc, minlength=len(texts)) >= min_words
    at = enough[gd]
    return g[at], gd[at]


def _fingerprints(g: np.ndarray, gd: np.ndarray, n_tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have any, their (symbols, bits) by table, and two words with three bits of each min-hash."""
    docs, at = K.group_starts(gd)
    seeds = _seeds(n_tables)
    low = np.empty((len(seeds), len(docs)), np.uint64)
    x = (g >> np.uint64(32)).astype(np.uint32)
    y = np.empty_like(x)
    for k, seed in enumerate(seeds):
        np.multiply(x, seed, out=y)
        low[k] = np.minimum.reduceat(y, at)
    low = K.mix(low * np.uint64(0x9E3779B97F4A7C15))
    sketch = np.zeros((len(docs), 2), np.uint64)
    for k in range(SKETCH):
        sketch[:, k // 21] |= (low[k] & np.uint64(7)) << np.uint64(3 * (k % 21))
    bit = low & np.uint64(1)
    tables = np.empty((len(docs), n_tables), np.uint64)
    for t, pick in enumerate(np.arange(n_tables * (SYMBOLS + BITS)).reshape(n_tables, -1)):
        s = np.full(len(docs), t + 1, np.uint64)
        for k in pick[:SYMBOLS]:
            s = K.mix(s * np.uint64(0x9E3779B97F4A7C15) + low[k])
        code = np.zeros(len(docs), np.uint64)
        for i, k in enumerate(pick[SYMBOLS:]):
            code |= bit[k] << np.uint64(i)
        tables[:, t] = (s << np.uint64(BITS)) | code
    return docs, tables, sketch


def _texts(df: DataFrame, row_id: str, col: str) -> DataFrame:
    return df.select(F.col(row_id).cast("string").alias("row_id"), F.col(col).alias("text")).where("text IS NOT NULL AND row_id IS NOT NULL")


def signatures(df: DataFrame, row_id: str, col: str, n: int, min_words: int, n_tables: int) -> DataFrame:
    """row_id, rep (64-bit key of the form), tables, and the sketch u, w."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b.row_id.to_numpy(), [form(t) for t in b.text]
            for first, some in K.blocks(texts):
                g, gd = _grams(some, n, min_words)
                if not len(g):
                    continue
                docs, tables, sketch = _fingerprints(g, gd, n_tables)
                rep = np.array([int(digest(some[d])[:16], 16) for d in docs], np.uint64)
                yield pd.DataFrame({"row_id": ids[first + docs], "rep": rep.view(np.int64), "tables": list(tables.view(np.int64)), "u": sketch[:, 0].copy().view(np.int64), "w": sketch[:, 1].copy().view(np.int64)})

    return _texts(df, row_id, col).mapInPandas(sign, "row_id string, rep long, tables array<long>, u long, w long")


def _differ(x: Column) -> Column:
    """In how many of its 21 groups of three bits a word has any."""
    ones = F.lit(0o111111111111111111111)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))


def candidates(sig: DataFrame, max_differ: int) -> DataFrame:
    """tbl, a < b: forms that meet at the home anchor of either, with at most so many different min-hashes."""
    reps = sig.groupBy("tbl", "rep").agg(F.first("tables").alias("tables"), F.first("u").alias("u"), F.first("w").alias("w"))
    each = reps.select("tbl", "rep", "u", "w", F.explode("tables").alias("x"))
    at = F.element_at(F.lit(ANCHORS), (F.col("x").bitwiseAND((1 << BITS) - 1) + 1).cast("int"))
    spread = each.select("tbl", "rep", "u", "w", F.shiftrightunsigned("x", BITS).alias("s"), at.alias("at"))
    home = spread.select(F.xxhash64("tbl", "s", F.col("at")[0]).alias("k"), "tbl", F.col("rep").alias("a"), F.col("u").alias("ua"), F.col("w").alias("wa"))
    spots = spread.select("tbl", "s", "rep", "u", "w", F.explode("at").alias("at")).select(F.xxhash64("tbl", "s", "at").alias("k"), F.col("rep").alias("b"), F.col("u").alias("ub"), F.col("w").alias("wb"))
    # A sixteenth of the texts says which anchors are hot; all rows are compared either way.
    some_home = home.where(F.pmod(F.col("a"), F.lit(16)) == 0)
    hot = K.checkpointed(sig.sparkSession, some_home.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT / 32).select("k"))
    n_hot = hot.count()
    if n_hot:
        sent = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
        some = home.join(sent, "k", "left_semi").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        met = home.join(sent, "k", "left_anti").join(spots.join(sent, "k", "left_anti"), "k")
        met = met.unionByName(some.join(spots.join(sent, "k", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["k", "salt"]).drop("salt"))
    else:
        met = home.join(spots, "k")
    apart = _differ(F.col("ua").bitwiseXOR(F.col("ub"))) + _differ(F.col("wa").bitwiseXOR(F.col("wb")))
    return met.where(F.col("a") != F.col("b")).where(apart <= max_differ).select("tbl", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(df: DataFrame, n: int) -> DataFrame:
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reps, texts = b.rep.to_numpy(), [form(t) for t in b.text]
            for first, some in K.blocks(texts):
                g, gd = _grams(some, n, 0)
                docs, at = K.group_starts(gd)
                if not len(docs):
                    continue
                parts = np.split((g >> np.uint64(32)).astype(np.uint32).view(np.int32), at[1:])
                yield pd.DataFrame({"rep": reps[first + docs], "grams": [np.unique(p) for p in parts]})

    return df.mapInPandas(sets, "rep long, grams array<int>")


def links(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, str]], n: int, min_similarity: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): tbl, rep, row_id of every text long enough; tbl, a, b of different forms that are similar."""
    parts = [signatures(df, k, c, n, min_words, tables_for(min_similarity)).select(F.lit(t).alias("tbl"), "*") for t, (df, k, c) in tables.items()]
    sig = parts[0]
    for p in parts[1:]:
        sig = sig.unionByName(p)
    sig = K.checkpointed(spark, sig)
    cand = K.checkpointed(spark, candidates(sig, max_differ(min_similarity)))
    need = cand.select("tbl", F.explode(F.array("a", "b")).alias("rep")).distinct()
    one = K.checkpointed(spark, sig.join(F.broadcast(need) if cand.count() * 2 <= BROADCAST_IDS else need, ["tbl", "rep"], "left_semi").groupBy("tbl", "rep").agg(F.min("row_id").alias("row_id")))
    small = one.count() <= BROADCAST_IDS
    sets = None
    for t, (df, k, c) in tables.items():
        ids = one.where(F.col("tbl") == t).select("row_id", "rep")
        got = _sets(_texts(df, k, c).join(F.broadcast(ids) if small else ids, "row_id").select("rep", "text"), n).select(F.lit(t).alias("tbl"), "*")
        sets = got if sets is None else sets.unionByName(got)
    left, right = sets.select("tbl", F.col("rep").alias("a"), F.col("grams").alias("ga")), sets.select("tbl", F.col("rep").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    linked = cand.join(left, ["tbl", "a"]).join(right, ["tbl", "b"]).where(both >= min_similarity * (F.size("ga") + F.size("gb") - both))
    return sig.select("tbl", "rep", "row_id"), linked.select("tbl", "a", "b")


def near_duplicate_pairs(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, str]], n: int = 3, min_similarity: float = 0.7, min_words: int = 30) -> DataFrame:
    """tbl, row_id_1 < row_id_2 of similar or identical rows. tables: name -> (frame, id column, text column)."""
    members, linked = links(spark, tables, n, min_similarity, min_words)
    same = members.groupBy("tbl", "rep").agg(F.count("*").alias("c")).where("c > 1").select("tbl", F.col("rep").alias("a"), F.col("rep").alias("b"))
    all_links = linked.unionByName(same)
    m1, m2 = members.select("tbl", F.col("rep").alias("a"), F.col("row_id").alias("r1")), members.select("tbl", F.col("rep").alias("b"), F.col("row_id").alias("r2"))
    pairs = all_links.join(m1, ["tbl", "a"]).join(m2, ["tbl", "b"]).where("a <> b OR r1 < r2").where("r1 <> r2")
    return pairs.select("tbl", F.least("r1", "r2").alias("row_id_1"), F.greatest("r1", "r2").alias("row_id_2")).distinct()


def near_duplicate_groups(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, str]], n: int = 5, min_similarity: float = 0.8, min_words: int = 30) -> DataFrame:
    """tbl, row_id, class_id, n_links, n_copies: one row per text long enough.

    class_id is the least form key among all texts linked directly or through
    others; n_links counts similar different forms, n_copies the rows of the
    same form. Labels travel along links and jump to the label of their label
    until none changes.
    """
    members, linked = links(spark, tables, n, min_similarity, min_words)
    linked = K.checkpointed(spark, linked)
    edges = linked.unionByName(linked.select("tbl", F.col("b").alias("a"), F.col("a").alias("b")))
    label = K.checkpointed(spark, edges.groupBy("tbl", "a").agg(F.least(F.min("a"), F.min("b")).alias("label")))
    changed = linked.limit(1).count()
    while changed:
        near = edges.join(label.select("tbl", F.col("a").alias("b"), "label"), ["tbl", "b"]).groupBy("tbl", "a").agg(F.min("label").alias("near"))
        jump = label.select("tbl", F.col("a").alias("label"), F.col("label").alias("far"))
        step = label.join(near, ["tbl", "a"]).join(jump, ["tbl", "label"], "left").select("tbl", "a", F.least("label", "near", "far").alias("label"), (F.least("near", F.coalesce("far", "label")) < F.col("label")).alias("moved"))
        step = K.checkpointed(spark, step)
        changed = step.where("moved").limit(1).count()
        label = step.drop("moved")
    degree = edges.groupBy("tbl", "a").agg(F.countDistinct("b").cast("int").alias("n_links"))
    info = label.join(degree, ["tbl", "a"]).withColumnRenamed("a", "rep")
    copies = members.groupBy("tbl", "rep").agg(F.count("*").alias("n_copies"))
    return members.join(copies, ["tbl", "rep"]).join(info, ["tbl", "rep"], "left").select("tbl", "row_id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
