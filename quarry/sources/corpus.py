"""The stored corpus: documents and chunks as tables, written by replacing whole documents.

Folders hold one Parquet table each. A change writes a new version beside the
old one and then renames; readers through ``read`` see one or the other, and a
lost executor loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import squeezed
from quarry.operators import chunking
from quarry.sources import store


def summaries(docs: DataFrame) -> DataFrame:
    """Documents without their content, newest first; ties by id."""
    return docs.drop("content").orderBy(F.desc("uploaded_at"), F.asc("id"))


def all_documents(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.asc("uploaded_at"), F.asc("id"))


def all_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks in the order that breaks ties, with that order as ordinal by document."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    return chunks.withColumn("ordinal", F.row_number().over(w).cast("long")).orderBy("doc_id", "chunk_index", "chunk_id")


def document(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("id") == doc_id)


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def totals(docs: DataFrame) -> DataFrame:
    """documents, characters, chunks, bytes of the corpus."""
    return docs.agg(F.count("*").alias("documents"), F.sum(F.col("total_characters").cast("long")).alias("characters"), F.sum(F.col("total_chunks").cast("long")).alias("chunks"), F.sum("file_size_bytes").alias("bytes"))


def save(docs: DataFrame, chunks: DataFrame, new_docs: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks with the new documents in place of those of the same id, and all their chunks replaced."""
    ids = new_docs.select("id").distinct()
    kept = docs.join(ids, "id", "left_anti")
    kept_chunks = chunks.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select(*chunks.columns)
    return kept.unionByName(new_docs), kept_chunks.unionByName(new_chunks)


def delete(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the given ids (column id)."""
    return docs.join(ids, "id", "left_anti"), chunks.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select(*chunks.columns)


def upload(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """file, total_pages, total_characters, total_chunks, content: pages (file, page_no, text) of each file joined by blank lines, with the number of its chunks (column file)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    whole = pages.groupBy("file").agg(F.count("*").cast("int").alias("total_pages"), joined.alias("content"))
    n = chunks.groupBy("file").agg(F.count("*").alias("total_chunks"))
    return whole.join(n, "file", "left").select("file", "total_pages", F.length("content").cast("long").alias("total_characters"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), "content")


def ingest(pages: DataFrame, max_tokens: int = 256, overlap: int = 32) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of uploaded files: each page (file, page_no, text) is chunked, pages are joined, totals taken.

    Chunks name their file as document and keep the page in their id. Files
    without any text give no row.
    """
    filled = store.stored(pages.where(F.coalesce(squeezed(F.col("text")), F.lit("")) != ""))
    named = filled.select(F.concat("file", F.lit("#Sayfa_"), F.col("page_no").cast("string")).alias("doc_id"), "text")
    chunks = store.stored(chunking.chunk_documents(named, "doc_id", "text", max_tokens=max_tokens, overlap=overlap))
    chunks = chunks.withColumn("doc_id", F.regexp_replace("doc_id", r"#Sayfa_\d+$", ""))
    return upload(filled, chunks.select(F.col("doc_id").alias("file"))), chunks


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hadoop.Path(path), hadoop.Path(f"{path}.new"), hadoop.Path(f"{path}.old")


def settle(spark: SparkSession, path: str) -> bool:
    """Ends a replacement that was cut off between its renames; whether there is a table then."""
    fs, now, new, old = _files(spark, path)
    if not fs.exists(now):
        if fs.exists(new.suffix("/_SUCCESS")):
            fs.rename(new, now)
        elif fs.exists(old):
            fs.rename(old, now)
    return fs.exists(now)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; null where there is none."""
    return spark.read.parquet(path) if settle(spark, path) else None


def write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replaces the table at path by the frame, which may be read from it: written beside, then renamed.

    If the job dies between the two renames, the next read or write through
    this module ends them, so either the old or the new table is there.
    """
    settle(spark, path)
    fs, now, new, old = _files(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(now):
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def clear(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replaces the table at path by an empty one of the same columns."""
    write(spark, df.limit(0), path)
