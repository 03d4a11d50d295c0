"""Hybrid index and retrieval for a table of queries: sparse and dense, fused, reranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.sources import corpus, store


@dataclass
class Index:
    """Tables that searches read: words by chunk, postings by term, one row of statistics, vectors by chunk."""

    words: DataFrame
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame


def build(chunks: DataFrame, dims: int = retrieval.DIMS) -> Index:
    """An index of chunks (chunk_id, doc_id, chunk_index, content) for one session. Nothing is stored: words take several times the room of the contents, so each reader cuts the contents anew."""
    return indexed(retrieval.chunk_words(chunks), dims)


def indexed(words: DataFrame, dims: int = retrieval.DIMS) -> Index:
    """The index of chunk words."""
    return Index(words, retrieval.postings(words), retrieval.corpus_stats(words), retrieval.hash_embeddings(words, dims=dims))


def write_index(spark: SparkSession, chunks: DataFrame, path: str, dims: int = retrieval.DIMS) -> bool:
    """Writes the index of chunks into tables under path; False, and nothing is touched, where there are no chunks.

    Words, postings and statistics are those of these chunks alone; vectors
    are upserted, so chunks of earlier calls keep theirs and their place.
    Postings lie in ranges of terms, so a search reads few files of them.
    """
    words = retrieval.chunk_words(chunks)
    if not words.limit(1).count():
        return False
    corpus.write(spark, words, f"{path}/words")
    index = indexed(corpus.read(spark, f"{path}/words"), dims)
    corpus.write(spark, index.postings.repartitionByRange("term").sortWithinPartitions("term"), f"{path}/postings")
    corpus.write(spark, index.stats, f"{path}/stats")
    old = corpus.read(spark, f"{path}/vectors")
    new = index.vectors
    vectors = retrieval.upsert(old, new, "chunk_id") if old is not None else retrieval.ordinals(new, "chunk_id")
    corpus.write(spark, vectors, f"{path}/vectors")
    return True


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(corpus.read(spark, f"{path}/{x}") for x in ("words", "postings", "stats", "vectors")))


def retrieve(queries: DataFrame, index: Index, k: int = 3, cutoff: float = 0.20, rrf_k: int = retrieval.RRF_K, k1: float = retrieval.K1, b: float = retrieval.B, dims: int = retrieval.DIMS) -> DataFrame:
    """query_id, chunk_id, coverage, affinity, score, rank. Twice k hits of either kind are fused, twice k of these reranked; blank queries have no rows."""
    queries = store.stored(queries.select("query_id", "query"))
    lists = [retrieval.bm25(queries, index.postings, index.stats, 2 * k, k1, b), retrieval.dense(retrieval.embedded_queries(queries, dims), index.vectors, 2 * k)]
    ranked = [x.select("query_id", F.lit(n).alias("list_no"), F.lit(1.0).alias("weight"), "chunk_id", "rank") for n, x in enumerate(lists)]
    fused = retrieval.fuse(ranked[0].unionByName(ranked[1]), rrf_k, 2 * k)
    return retrieval.rerank(fused, queries, index.words, cutoff, k)
