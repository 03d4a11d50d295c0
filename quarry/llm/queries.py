"""Registered queries of the numbered problems: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm import language, leak, names, near_dup, oracle, packing, scans, sentences, subjects, visual_form


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _by_table(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("tbl"), "*") for t, df in parts.items()])


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every content, and that without regard to case."""
    keyed = {t: (_t(spark, sf, t), k) for t, k in (("corpus_documents", "id"), ("corpus_chunks", "chunk_id"))}
    return _by_table({t: visual_form.with_form(df, "content", "form", "folded").select(F.col(k).alias("row_id"), "form", "folded") for t, (df, k) in keyed.items()})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _by_table({t: visual_form.look_alikes(_t(spark, sf, t), k, "content") for t, k in (("corpus_documents", "id"), ("corpus_chunks", "chunk_id"))})


def _texts(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"documents": (_t(spark, sf, "documents"), "doc_id", "text"), "corpus_documents": (_t(spark, sf, "corpus_documents"), "id", "content"), "corpus_chunks": (_t(spark, sf, "corpus_chunks"), "chunk_id", "content")}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(spark, _texts(spark, sf))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicate_groups(spark, _texts(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(spark, _t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("exact_words >= 12").select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("score >= 12")


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(K.checkpointed(spark, packing.sized(_t(spark, sf, "documents"))), _t(spark, sf, "pack_budgets"))


def p7_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fit(p7_packing(spark, sf), _t(spark, sf, "pack_budgets"))


def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    return packing.whole(p7_packing(spark, sf), _t(spark, sf, "pack_budgets"))


def _languages(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    docs, corpus = _t(spark, sf, "documents"), _t(spark, sf, "corpus_documents")
    models = language.train(spark, docs, "doc_id", "text", F.col("lang"))
    return {
        "documents": language.segments(spark, models, docs, "doc_id", "text", F.col("lang")),
        "corpus_documents": language.segments(spark, models, corpus, "id", "content", F.col("metadata")["Language"]),
    }


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = {t: language.languages(df) for t, df in _languages(spark, sf).items()}
    return _by_table(found).where("label IS NULL OR label <> lang").select("tbl", "row_id", "lang")


def p5_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _by_table({t: df.select("row_id", "label", F.inline("segments")) for t, df in _languages(spark, sf).items()})


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.classify(spark, _t(spark, sf, "documents"), _t(spark, sf, "corpus_documents"), _t(spark, sf, "subject_labels"), _t(spark, sf, "subjects"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).where("subject IS NOT NULL AND sentences >= 0.25 * n_sentences").select("doc_id", "subject")


def p9_makeup(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.composition(K.checkpointed(spark, _subjects(spark, sf)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.true_sentences(_t(spark, sf, "sentence_details")).select("query_id", "sentence_index", "end_offset").distinct()


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.true_sentences(_t(spark, sf, "sentence_details"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return names.link_names(_t(spark, sf, "corpus_documents"), _t(spark, sf, "name_registry"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("id", "field_name", "entity_id")


def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.Scans(spark, _t(spark, sf, "corpus_documents")).found().select("id", "line_no", "kind", "repaired").distinct()


def p1_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scans.Scans(spark, _t(spark, sf, "corpus_documents")).paragraphs()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
