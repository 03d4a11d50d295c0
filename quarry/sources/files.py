"""Sources: files to documents, routed by their extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import squeezed

TEXT_TYPES = ("txt", "md", "json", "csv", "log")
PAGE_TYPES = ("pdf",)
SCANNED_BELOW = 10  #: characters of a page that then counts as scanned
WARNING = "No selectable text on this page; it may be a scanned image."


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(path: Column) -> Column:
    """text, pages or null for a file that no loader takes."""
    return F.when(extension(path).isin(*PAGE_TYPES), "pages").when(extension(path).isin(*TEXT_TYPES), "text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, content, metadata of text files; each is one opaque text, whatever its type. CharacterCount is that before trimming."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("raw"))
    keep = raw.where(route(F.col("doc_id")) == "text")
    meta = F.create_map(F.lit("SourceFile"), F.col("doc_id"), F.lit("FileType"), F.upper(extension(F.col("doc_id"))), F.lit("CharacterCount"), F.length("raw").cast("string"))
    return keep.select("doc_id", squeezed(F.col("raw")).alias("content"), meta.alias("metadata"))


def read_pages(spark: SparkSession, path: str, extract: Callable[..., list[str]], password: str | None = None) -> DataFrame:
    """doc_id (file#Sayfa_n), file, page_no, content, metadata: pages of binary files by a pluggable extractor.

    A page of fewer than SCANNED_BELOW characters gets a warning in place of
    its text and the mark IsScannedOrImageOnly; a file that cannot be read
    gives one row with page 0 and the error in its metadata. A password goes to
    the extractor as its second argument.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b.file, b.content, strict=True):
                try:
                    for n, t in enumerate(extract(bytes(data), password) if password else extract(bytes(data)), 1):
                        thin = len(t.strip()) < SCANNED_BELOW
                        rows.append((f"{name}#Sayfa_{n}", name, n, WARNING if thin else t, {"SourceFile": name, "FileType": "PDF", "PageNumber": str(n), "IsScannedOrImageOnly": str(thin)}))
                except Exception as e:  # noqa: BLE001 - any broken file becomes a row
                    rows.append((f"{name}#Sayfa_0", name, 0, None, {"SourceFile": name, "Error": str(e)[:500]}))
            yield pd.DataFrame(rows, columns=["doc_id", "file", "page_no", "content", "metadata"])

    src = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").where(route(F.col("file")) == "pages")
    return src.mapInPandas(run, "doc_id string, file string, page_no int, content string, metadata map<string,string>")


def split_inline(text: DataFrame, marks: tuple[str, ...] = ("Doküman 1:", "Doküman 2:"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, content of inline corpora (column content) and the columns to keep: with a mark one document per filled line, else one in all."""
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("content", F.lit(m))
    lines = F.filter(F.transform(F.split("content", "\n"), squeezed), lambda x: x != "")
    return text.select(*keep, F.posexplode(F.when(marked, lines).otherwise(F.array(squeezed(F.col("content"))))).alias("n", "piece")).select(*keep, F.concat(F.lit("doc_"), F.col("n") + 1).alias("doc_id"), F.col("piece").alias("content"))
