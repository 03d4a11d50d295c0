"""Numbers behind charts: positions, links and neighbours of scored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def polar(points: DataFrame) -> DataFrame:
    """query_id, chunk_id, x, y of points (query_id, doc, chunk_id, distance): a sector for each document, the distance as radius.

    Sectors are numbered over the documents, places within a document only.
    """
    docs = Window.partitionBy("query_id")
    each = points.groupBy("query_id", "doc").agg(F.count("*").alias("n"))
    each = each.withColumn("sector", F.row_number().over(docs.orderBy("doc")) - 1).withColumn("sectors", F.count("*").over(docs))
    own = Window.partitionBy("query_id", "doc").orderBy("chunk_id")
    p = points.withColumn("i", F.row_number().over(own) - 1).join(each, ["query_id", "doc"])
    step = 2 * F.pi() / F.col("sectors")
    span = F.least(step * 0.85, F.col("n") * 0.25)
    angle = -F.pi() / 2 + F.col("sector") * step + F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1) * span).otherwise(span / 2)
    r = F.greatest(F.lit(0.12), F.least(F.lit(1.0), F.col("distance") * 1.1))
    return p.select("query_id", "chunk_id", F.round(r * F.cos(angle), 3).alias("x"), F.round(r * F.sin(angle), 3).alias("y"))


def nearest(points: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "distance", F.col("rank").cast("int").alias("rank"))


def chunk_links(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, next_id: each chunk and the one after it."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    return chunks.select("doc_id", "chunk_id", F.lead("chunk_id").over(w).alias("next_id")).where("next_id IS NOT NULL")


def bridges(points: DataFrame, width: float = 0.06, near: float = 0.5) -> DataFrame:
    """query_id, a, b: chunks of different documents whose distances differ by less than width, the first of them near.

    a is of the document that comes first. A range self-join on cells of that
    width and their neighbours.
    """
    cell = F.floor(F.col("distance") / width)
    a = points.where(F.col("distance") < near).select("query_id", F.col("doc").alias("da"), F.col("chunk_id").alias("a"), F.col("distance").alias("xa"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = points.select("query_id", F.col("doc").alias("db"), F.col("chunk_id").alias("b"), F.col("distance").alias("xb"), cell.alias("cell"))
    return a.join(b, ["query_id", "cell"]).where((F.col("da") < F.col("db")) & (F.abs(F.col("xa") - F.col("xb")) < width)).select("query_id", "a", "b")


def bridge_counts(points: DataFrame, width: float = 0.06, near: float = 0.5) -> DataFrame:
    """query_id, a, n_bridges: how many bridges begin at each chunk. Points of one document at one distance are counted first, so no pair is formed."""
    cell = F.floor(F.col("distance") / width)
    n = points.groupBy("query_id", "doc", "distance").agg(F.count("*").alias("n"))
    a = n.where(F.col("distance") < near).select("query_id", "doc", "distance", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = n.select("query_id", F.col("doc").alias("db"), F.col("distance").alias("xb"), "n", cell.alias("cell"))
    m = a.join(b, ["query_id", "cell"]).where((F.col("doc") < F.col("db")) & (F.abs(F.col("distance") - F.col("xb")) < width)).groupBy("query_id", "doc", "distance").agg(F.sum("n").alias("n_bridges"))
    return points.join(m, ["query_id", "doc", "distance"]).select("query_id", F.col("chunk_id").alias("a"), "n_bridges")


def locate_lines(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """row_id, line_no (from 0, -1 without a match): the line of a text that a sentence or snippet comes from.

    asked: row_id, doc_id, sentence, snippet; texts: doc_id, content. The first
    line holding the first 30 characters of the snippet, else the line with
    most words (four letters or more) of the sentence, at least two.
    """
    lines = texts.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).select("doc_id", "line_no", F.lower("line").alias("line"))
    snip = F.lower(F.trim(F.regexp_replace("snippet", r"^[0-9]\.\s*", "")))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("sentence", F.lit(""))), r"[.,\/#!$%\^&\*;:{}=\-_`~()?\"'0-9]", " "), r"\s+"), lambda x: F.length(x) >= 4)
    q = asked.select("row_id", "doc_id", F.when(F.length(snip) > 6, F.substring(snip, 1, 30)).alias("head"), words.alias("words"))
    j = q.join(lines, "doc_id")
    n = F.size(F.filter("words", lambda x: F.contains("line", x)))
    s = j.select("row_id", "line_no", F.coalesce(F.contains("line", "head"), F.lit(False)).alias("holds"), n.alias("n"))
    best = s.groupBy("row_id").agg(F.min(F.when(F.col("holds"), F.col("line_no"))).alias("first"), F.max_by("line_no", F.when(F.col("n") >= 2, F.struct("n", -F.col("line_no")))).alias("most"), F.max("n").alias("top"))
    return q.select("row_id").join(best, "row_id", "left").select("row_id", F.coalesce("first", F.when(F.col("top") >= 2, F.col("most")), F.lit(-1)).cast("int").alias("line_no"))
