"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.canonical import row_hash
from lattica.session import settle, small_side


def snapshot_changes(
    rows: DataFrame,
    *,
    version: Column,
    scope: Column,
    key: Column,
    identity: list[Column],
    digest: Column,
    delivered: Column,
    ties: list[Column],
) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots of a scope.

    A full outer join on (scope, key, version) holds each snapshot's canonical row hashes against
    those of the scope's last earlier snapshot: a missing side is an addition or a removal, unequal
    hashes are a change. The hash has two parts: that of `identity`, always compared, and that of
    `digest`, compared only where both rows have one.

    Result: (version, scope, key, change), one row for each record and version.
    Defined cases: a null in version, scope or key names no record and yields nothing; of several rows
    of a record in one snapshot the one delivered last holds (null delivery is the earliest; equal ones
    are decided by `ties`, then by the hashes); repeated rows count once; the first snapshot of a scope
    yields nothing; an empty table yields no rows. Only the given expressions are read, so other columns
    of whatever name do no harm.

    Scale: one aggregation with map-side combine (which also reduces hot records) and one co-hashed full
    outer join of hashes, both keyed by the record, so a scope with most of the rows is spread out. The
    list of a scope's versions is broadcast only if it was counted to be small.
    """
    slim = rows.select(
        version.alias("v"), scope.alias("s"), key.alias("k"),
        F.struct(delivered.alias("d"), *[t.alias(f"t{i}") for i, t in enumerate(ties)]).alias("o"),
        row_hash(*identity).alias("hi"),
        F.when(digest.isNotNull(), row_hash(digest)).alias("hd"),
    ).where("v is not null and s is not null and k is not null")
    latest = slim.groupBy("s", "k", "v").agg(F.max(F.struct("o", "hi", "hd")).alias("m")).select("s", "k", "v", "m.hi", "m.hd")
    by_scope = Window.partitionBy("s").orderBy("v")
    seen = small_side(settle(slim.select("s", "v").distinct().select("s", "v", F.lead("v").over(by_scope).alias("next_v"), F.lag("v").over(by_scope).alias("prev_v"))))
    placed = latest.join(seen, ["s", "v"])
    new = placed.where("prev_v is not null").select("s", "k", "v", "hi", "hd")
    old = placed.where("next_v is not null").select("s", "k", F.col("next_v").alias("v"), F.col("hi").alias("old_hi"), F.col("hd").alias("old_hd"))
    both = new.join(old, ["s", "k", "v"], "full_outer")
    change = (
        F.when(F.col("old_hi").isNull(), "added")
        .when(F.col("hi").isNull(), "removed")
        .when((F.col("hi") != F.col("old_hi")) | F.coalesce(F.col("hd") != F.col("old_hd"), F.lit(False)), "changed")
    )
    return both.select(F.col("v").alias("version"), F.col("s").alias("scope"), F.col("k").alias("key"), change.alias("change")).where("change is not null")
