"""Frames kept for several readers: reliable checkpoints, and joins that spread hot keys."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Rows of a key from which it is hot, and the parts its rows are spread over.
HOT_ROWS, SALTS = 100_000, 32


def stored(df: DataFrame) -> DataFrame:
    """The frame, computed once and written to the folder of spark.checkpoint.dir, so a lost executor loses nothing.

    A folder of our own is taken in local mode only; on a cluster, whose
    executors would each write to a disk of their own, a missing setting is an
    error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint while the frame has at most so many rows, else the frame as it is."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of a stored frame with one that has one row a key; the rows of hot keys are spread over SALTS parts."""
    hot = stored(left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(key, F.lit(True).alias("_hot")))
    if not hot.limit(1).count():
        return left.join(right, key)
    sent = small(hot)
    spread = left.join(sent, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.floor(F.rand(7) * SALTS)).otherwise(0).cast("int")).drop("_hot")
    copies = right.join(sent, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return spread.join(copies, [key, "_salt"]).drop("_salt")


def spread(rows: DataFrame, single: DataFrame, key: str, by: str, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with _salt: rows of hot keys go by their column by to SALTS parts, each of which has a copy of the key's single row. Keys are counted in a frame that is cheaper to read than the rows."""
    hot = [r[0] for r in counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(key).collect()]  # one in HOT_ROWS rows at most
    part = lambda x, cold: F.when(F.col(key).isin(hot), x).otherwise(cold) if hot else cold
    salt = part(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"), F.lit(0))
    return rows.withColumn("_salt", salt), single.withColumn("_salt", F.explode(part(F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0)))))
