"""Chunks that arrive as a stream, kept as an up-to-date table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 256


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, late: str = "1 day", buckets: int = BUCKETS) -> StreamingQuery:
    """Writes arriving chunks (chunk_id, ..., arrived_at) over those of the same id in the table at path, once each batch.

    The table is partitioned by the bucket of the chunk_id (column bucket); a
    batch rewrites only the buckets that its chunks fall in. Repeats of a chunk
    within the watermark are dropped before they reach the table.
    """

    def batch(new: DataFrame, _: int) -> None:
        spark = new.sparkSession
        newest = new.groupBy("chunk_id").agg(F.max_by(F.struct(*new.columns), "arrived_at").alias("x")).select("x.*")
        newest = newest.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in newest.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if _exists(spark, path):
            old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
            merged = old.join(newest.select("chunk_id"), "chunk_id", "left_anti").unionByName(newest)
        else:
            merged = newest
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        newest.unpersist()

    distinct = chunks.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["chunk_id", "arrived_at"])
    return distinct.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(batch).trigger(availableNow=True).start()
