"""Problem 9: subject areas of documents.

One-versus-rest linear classifiers over hashed words and word pairs are fitted
to sentences whose weak label is the subject in the path of their file or,
where the path names none, the subject of their section in the metadata. Every
sentence of every document is scored; a document has a subject when at least a
quarter of its sentences belong to it. How sure a sentence must be is
calibrated for each subject on all documents labelled by hand.

The sample that the classifiers are fitted to is bounded (``TRAIN_DOCS`` a
subject) and taken in a hash order. Null, empty and sentence-free texts have no
subject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm.visual_form import form

HASH_BITS = 17
TRAIN_DOCS = 160
MIN_SECTION, SECTION_SHARE = 20, 0.8  #: documents of a section that name a subject, and their share
SHARE = 0.25
EPOCHS, BATCH, RATE = 4, 512, 0.5
MARGINS = np.round(np.arange(-3.0, 2.01, 0.25), 2)  #: tried for calibration
MIN_LABELLED = 30  #: labelled documents from which a subject gets its own margin


class Sentences:
    """Sentences of a block of texts: their text, and hashed features of all laid end to end."""

    def __init__(self, texts: list[str]):
        folded = [t.lower() for t in texts]
        cp, begin = K.code_points(folded)
        bounds, _ = K.sentence_bounds(cp, begin)
        h, doc, s, _ = K.words(folded)
        own = np.searchsorted(bounds, begin[doc] + s, side="right") - 1
        digit = (cp[begin[doc] + s] >= 48) & (cp[begin[doc] + s] <= 57)
        h, own = h[~digit], own[~digit]  # numbers say nothing of a subject
        g, go, _ = K.ngrams(h, own, 2)
        mask = np.uint64((1 << HASH_BITS) - 1)
        feats, of = np.concatenate([h, g]) & mask, np.concatenate([own, go])
        order = np.argsort(of, kind="stable")
        which, self.at = K.group_starts(of[order])
        self.features = feats[order].astype(np.int64)
        self.doc = np.searchsorted(begin, bounds[which], side="right") - 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.zeros((0, weights.shape[1]))
        n = np.diff(np.append(self.at, len(self.features)))
        return np.add.reduceat(weights[self.features], self.at, axis=0) / np.sqrt(n)[:, None]


def fit(texts: list[str], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (feature, class) of logistic one-versus-rest classifiers of the sentences of labelled texts."""
    s = Sentences(texts)
    n = np.diff(np.append(s.at, len(s.features)))
    y = np.eye(classes)[labels[s.doc]]
    w, seen = np.zeros((1 << HASH_BITS, classes)), np.full((1 << HASH_BITS, classes), 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(n))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            size = n[pick]
            first = np.cumsum(size) - size
            f = s.features[np.repeat(s.at[pick] - first, size) + np.arange(size.sum())]
            scale = 1 / np.sqrt(size)[:, None]
            z = np.add.reduceat(w[f], first, axis=0) * scale
            grad = (1 / (1 + np.exp(-z)) - y[pick]) * scale
            uniq, inv = np.unique(f, return_inverse=True)
            g = np.zeros((len(uniq), classes))
            np.add.at(g, inv, np.repeat(grad, size, axis=0))
            seen[uniq] += g * g
            w[uniq] -= RATE * g / np.sqrt(seen[uniq])
    return w.astype(np.float32)


def _sample(df: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("h", "id")
    return df.withColumn("h", F.xxhash64("id")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def weak_labels(docs: DataFrame, doc_id: str, path: Column, section: Column | None, subjects: list[str]) -> DataFrame:
    """id, subject: the first word of the file name in the path, where that is a subject; else the subject of the section.

    A section (a value of the metadata) names a subject where at least
    SECTION_SHARE of MIN_SECTION or more documents that have it, and a subject
    in their path, agree on that subject.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.regexp_extract(F.lower(path), r"([a-z]+)_[^/]*$", 1).alias("stem"), (section if section is not None else F.lit(None).cast("string")).alias("section"))
    known = known.withColumn("subject", F.when(F.col("stem").isin(subjects), F.col("stem"))).where("id IS NOT NULL")
    if section is None:
        return known.where("subject IS NOT NULL").select("id", "subject")
    by = known.where("subject IS NOT NULL AND section IS NOT NULL").groupBy("section", "subject").agg(F.count("*").alias("n"))
    best = by.groupBy("section").agg(F.sum("n").alias("all"), F.max(F.struct("n", "subject")).alias("x")).where((F.col("all") >= MIN_SECTION) & (F.col("x.n") >= SECTION_SHARE * F.col("all")))
    named = known.join(best.select("section", F.col("x.subject").alias("of_section")), "section", "left")
    return named.select("id", F.coalesce("subject", "of_section").alias("subject")).where("subject IS NOT NULL")


def train(docs: DataFrame, doc_id: str, text: str, path: Column, subjects: list[str], section: Column | None = None) -> tuple[np.ndarray, list[str]]:
    """Weights from weak labels, and the subjects they stand for: those of the given ones that any label names."""
    few = _sample(weak_labels(docs, doc_id, path, section, subjects), ["subject"], TRAIN_DOCS)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id").where("text IS NOT NULL").orderBy("h", "id").select("subject", "text").toPandas()
    if not len(rows):
        raise ValueError("no document has a subject in its path")
    trained = sorted(set(rows.subject))
    return fit([form(t) for t in rows.text], rows.subject.map(trained.index).to_numpy(), len(trained)), trained


def belonging(spark: SparkSession, weights: np.ndarray, margins: np.ndarray, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_of (by subject and margin): how many sentences belong to a subject when its score must exceed the margin.

    margins: (tried, subjects). A sentence belongs to its best subject only.
    """
    shared = spark.sparkContext.broadcast((weights, margins))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, least = shared.value
        for b in batches:
            ids, texts = b.doc_id.to_numpy(), [form(t) for t in b.text]
            for first, some in K.blocks(texts):
                s = Sentences(some)
                if not len(s.at):
                    continue
                z = s.scores(w)
                best = z.argmax(axis=1)
                top = z[np.arange(len(z)), best]
                total = np.bincount(s.doc, minlength=len(some))
                of = np.zeros((len(some), *least.shape), np.int32)
                for k, m in enumerate(least):
                    sure = top > m[best]
                    np.add.at(of[:, k], (s.doc[sure], best[sure]), 1)
                has = np.flatnonzero(total)
                yield pd.DataFrame({"doc_id": ids[first + has], "n_sentences": total[has].astype(np.int32), "n_of": list(of[has].reshape(len(has), -1))})

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInPandas(run, "doc_id long, n_sentences int, n_of array<int>")


def calibrate(spark: SparkSession, weights: np.ndarray, docs: DataFrame, labels: DataFrame, subjects: list[str]) -> np.ndarray:
    """The margin of each subject with which all hand labels are met best (F1); of all subjects together where it has few labels.

    Every labelled document counts; only sums by margin and subject reach the driver.
    """
    k = len(subjects)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_set("subject").alias("marks"))
    tried = np.repeat(MARGINS[:, None], k, axis=1)
    named = F.array(*[F.lit(x) for x in subjects])
    got = belonging(spark, weights, tried, docs.join(marks.select("doc_id"), "doc_id", "left_semi")).join(marks, "doc_id")
    each = got.select("n_sentences", "marks", F.posexplode("n_of").alias("i", "n")).select((F.col("i") / k).cast("int").alias("margin"), (F.col("i") % k).alias("subject"), (F.col("n") >= SHARE * F.col("n_sentences")).alias("said"), F.array_contains("marks", F.get(named, F.col("i") % k)).alias("true"))
    sums = each.groupBy("margin", "subject").agg(F.count_if(F.col("said") & F.col("true")).alias("hit"), F.count_if("said").alias("said"), F.count_if("true").alias("true")).toPandas()
    if sums.empty:
        return np.zeros(k)
    hit, any_, true = (np.zeros((len(MARGINS), k)) for _ in range(3))
    hit[sums.margin, sums.subject], any_[sums.margin, sums.subject], true[sums.margin, sums.subject] = sums.hit, sums.said + sums.true, sums.true
    middle = lambda f: MARGINS[np.flatnonzero(f >= f.max() - 1e-9)].mean()
    overall = middle(2 * hit.sum(axis=1) / np.maximum(any_.sum(axis=1), 1))
    own = [middle(2 * hit[:, i] / np.maximum(any_[:, i], 1)) if true[0, i] >= MIN_LABELLED else overall for i in range(k)]
    return np.array(own)


def classify(spark: SparkSession, docs: DataFrame, corpus: DataFrame, labels: DataFrame, subjects_table: DataFrame) -> DataFrame:
    """doc_id, n_sentences, subject, sentences: a row for each document and subject with any sentence of its own, or null subject without any.

    Every subject of the table may be found for which a weak label exists.
    """
    listed = sorted(r.subject for r in subjects_table.select("subject").where("subject IS NOT NULL").distinct().collect())
    w, subjects = train(corpus, "id", "content", F.col("file_name"), listed, F.col("metadata")["Journal"])
    margins = calibrate(spark, w, docs, labels, subjects)
    found = belonging(spark, w, margins[None], docs)
    named = F.expr("filter(transform(n_of, (n, i) -> struct(i, n)), x -> x.n > 0)")
    return found.select("doc_id", "n_sentences", F.explode_outer(named).alias("x")).select("doc_id", "n_sentences", F.element_at(F.array(*[F.lit(s) for s in subjects]), F.col("x.i") + 1).alias("subject"), F.col("x.n").alias("sentences"))


def composition(found: DataFrame) -> DataFrame:
    """subject (null: no subject), n_documents with that subject, n_sentences of it, share of all sentences."""
    total = found.select("doc_id", "n_sentences").distinct().agg(F.sum("n_sentences").alias("all"))
    named = found.where("subject IS NOT NULL").groupBy("subject").agg(F.count_if(F.col("sentences") >= SHARE * F.col("n_sentences")).alias("n_documents"), F.sum("sentences").alias("n_sentences"))
    rest = found.groupBy("doc_id").agg(F.first("n_sentences").alias("n"), F.coalesce(F.sum("sentences"), F.lit(0)).alias("s")).agg(F.lit(None).cast("string").alias("subject"), F.count_if(F.col("s") == 0).alias("n_documents"), F.sum(F.col("n") - F.col("s")).alias("n_sentences"))
    return named.unionByName(rest).join(F.broadcast(total), how="cross").select("subject", "n_documents", "n_sentences", F.round(F.col("n_sentences") / F.col("all"), 6).alias("share"))
