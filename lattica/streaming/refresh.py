"""Keeping leaves up to date while documents arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.sources import lenient_json


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that shreds each new Parquet file of documents (asset_id, doc, read_at) once and appends the leaves to out.

    Each micro-batch is written to a folder of its own number, so a batch that is repeated after a failure
    replaces itself and no document's leaves are lost or doubled.
    """
    docs = spark.readStream.schema("asset_id long, doc string, read_at timestamp_ntz").parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        last = batch.where("doc is not null").groupBy("asset_id").agg(F.max(F.struct("read_at", "doc")).alias("m")).select("asset_id", "m.*")
        lenient_json.leaves(last).join(last.select("asset_id", "read_at"), "asset_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def values_per_hour(leaves: DataFrame, late: str = "1 hour") -> DataFrame:
    """Leaves (schema_pointer, read_at) counted by field and hour; rows later than `late` are no longer counted, and rows
    without a time have no hour. For streams and tables alike."""
    timed = leaves.withColumn("read_at", F.col("read_at").cast("timestamp"))
    timed = timed.withWatermark("read_at", late) if leaves.isStreaming else timed
    return timed.groupBy(F.window("read_at", "1 hour").alias("w"), "schema_pointer").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "schema_pointer", "n")
