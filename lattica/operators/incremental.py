"""Processing only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.intervals import islands, numbers, subtract


def unprocessed(records: DataFrame, processed: DataFrame) -> DataFrame:
    """Sequence numbers of records that the next run has to process.

    records: (seq, digest, epoch), what is there. processed: (seq, run, digest, epoch), what runs that
    were not rolled back have done; the row of the highest run is a record's last processing. Its number
    counts as processed if both digests are there and equal, or one is missing and the record's epoch is
    not later. The processed numbers are kept as disjoint intervals and subtracted from the ranges of
    numbers available; the gaps, late commits among them, are the result (seq).

    Defined cases: null numbers name nothing; repeated rows count once (a record given with several
    digests or epochs is processed only if all of them are covered); of several rows of one run the one
    with the later epoch, then the greater digest, holds; a missing epoch, where it decides, means
    "process"; empty tables are fine. Other columns are not read.

    Scale: one aggregation with map-side combine, one join keyed by the number, then windows over blocks
    of bounded width. The intervals, not the numbers, are what a ledger has to keep.
    """
    there = records.select(F.col("seq").cast("long").alias("seq"), F.col("digest").alias("d"), F.col("epoch").alias("e")).where("seq is not null").distinct()
    last = (
        processed.select(F.col("seq").cast("long").alias("seq"), F.struct("run", "epoch", "digest").alias("x"))
        .where("seq is not null and x.run is not null")
        .groupBy("seq")
        .agg(F.max("x").alias("x"))
        .select("seq", F.col("x.digest").alias("ld"), F.col("x.epoch").alias("le"))
    )
    covered = F.when(F.col("d").isNotNull() & F.col("ld").isNotNull(), F.col("d") == F.col("ld")).otherwise(F.coalesce(F.col("e") <= F.col("le"), F.lit(False)))
    done = there.join(last, "seq").groupBy("seq").agg(F.min(covered).alias("ok")).where("ok")
    return numbers(subtract(islands(there, "seq"), islands(done, "seq")), "seq")
