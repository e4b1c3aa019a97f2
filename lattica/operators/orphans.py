"""References to records that do not exist, or not at the time of reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import settle

#: Stays of a key, from arrival to removal, that a reference looks up one by one.
MOST_STAYS = 64


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a target that is there when they are made.

    refs: (ref_id, target, key, at); parents: (target, key, added_at, removed_at). `target` names a table
    (or a part of it), `key` is held against the parents' keys exactly. A parent is there from added_at
    up to, but not including, removed_at (null: for good).
    Result: (ref_id, target, at, reason). reason is `missing` if no parent has the key at all, else `late`
    if some parent with the key is added after `at`, else `deleted`.
    Defined cases: a null target or key refers to nothing and is no orphan; with a null `at` only `missing`
    can be told; repeated references are the caller's to drop; repeated parents do no harm; a parent with
    null added_at only has its key known. Empty tables are fine.

    Method: the distinct keys referred to are held against the parents' distinct keys by a left anti-join,
    and both verdicts are joined back to the references. Whether a key that exists was there at the time
    follows for most references from its first arrival, last removal and first arrival for good; the others
    look their key's stays up, up to MOST_STAYS of them, in an anti-join. Keys with more stays go through a
    sweep over time that adds up arrivals and removals and carries the sums from day to day.
    Scale: keys and stays are reduced on the map side; the tables joined to the references have one row a
    key, or at most MOST_STAYS, so a key with a third of all references only skews the left side, which
    adaptive execution splits; a key with as many stays is only sorted day by day. The references and their
    verdicts are settled, as each is used several times.
    """
    r = refs.select(F.col("ref_id").alias("i"), F.col("target").alias("t"), F.col("key").alias("k"), F.col("at").cast("timestamp_ntz").alias("x")).where("t is not null and k is not null")
    r = settle(r)
    p = parents.select(F.col("target").alias("t"), F.col("key").alias("k"), F.col("added_at").cast("timestamp_ntz").alias("a"), F.col("removed_at").cast("timestamp_ntz").alias("z")).where("t is not null and k is not null")
    is_stay = F.expr("a is not null and (z is null or a < z)")
    stay = lambda c: F.when(is_stay, c)
    keys = p.groupBy("t", "k").agg(
        F.max("a").alias("last_added"), F.count(stay(F.lit(1))).alias("stays"), F.min(stay(F.col("a"))).alias("first"),
        F.max(stay(F.col("z"))).alias("last"), F.min(stay(F.when(F.col("z").isNull(), F.col("a")))).alias("for_good"),
    ).withColumn("known", F.lit(True))
    missing = r.select("t", "k").distinct().join(keys.select("t", "k"), ["t", "k"], "left_anti").withColumn("known", F.lit(False))
    x = F.col("x")
    there = (
        F.when(F.col("stays") == 0, False)
        .when(x >= F.col("for_good"), True)
        .when((x < F.col("first")) | F.coalesce(x >= F.col("last"), F.lit(True)), False)
        .when(F.col("stays") == 1, True)
    )
    judged = r.join(missing.unionByName(keys, allowMissingColumns=True), ["t", "k"]).select("i", "t", "k", "x", "known", "last_added", "stays", there.alias("there"))
    judged = settle(judged.where("not known or x is not null and (there is null or not there)"))
    reason = F.when(F.col("last_added") > x, "late").otherwise("deleted")
    out = judged.where("not known or not there").select("i", "t", "x", F.when(~F.col("known"), "missing").otherwise(reason).alias("reason"))
    stays = p.where(is_stay).select(F.col("t").alias("t2"), F.col("k").alias("k2"), "a", "z").distinct()
    few = judged.where(F.col("known") & F.col("there").isNull() & (F.col("stays") <= MOST_STAYS))
    held = (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2")) & (F.col("a") <= x) & (F.col("z").isNull() | (F.col("z") > x))
    out = out.unionByName(few.join(stays, held, "left_anti").select("i", "t", "x", reason.alias("reason")))
    many = judged.where(F.col("known") & F.col("there").isNull() & (F.col("stays") > MOST_STAYS))
    if not many.isEmpty():
        out = out.unionByName(_swept(many, stays.select(F.col("t2").alias("t"), F.col("k2").alias("k"), "a", "z")))
    return out.select(F.col("i").alias("ref_id"), F.col("t").alias("target"), F.col("x").alias("at"), "reason")


def _swept(probes: DataFrame, stays: DataFrame) -> DataFrame:
    """(i, t, x, reason) of the probes (i, t, k, x, last_added) at whose time none of their key's stays holds."""
    day = F.date_trunc("day", F.col("x")).alias("day")
    change = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct(F.col("z").alias("x"), F.lit(-1).alias("d"))))
    changes = (
        stays.join(probes.select("t", "k").distinct(), ["t", "k"], "left_semi")
        .select("t", "k", change.alias("e"))
        .select("t", "k", "e.x", "e.d")
        .where("x is not null")
        .groupBy("t", "k", "x")
        .agg(F.sum("d").alias("d"))
    )
    changes = settle(changes)
    asked = probes.select("t", "k", "x", F.lit(0).cast("long").alias("d"), "i", "last_added")
    events = changes.withColumn("i", F.lit(None).cast(probes.schema["i"].dataType)).withColumn("last_added", F.lit(None).cast("timestamp_ntz")).unionByName(asked).select("*", day)
    by_key = Window.partitionBy("t", "k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = changes.select("*", day).groupBy("t", "k", "day").agg(F.sum("d").alias("d"))
    days = events.select("t", "k", "day").distinct().join(carried, ["t", "k", "day"], "left").select("t", "k", "day", F.coalesce(F.sum("d").over(by_key), F.lit(0)).alias("before"))
    by_day = Window.partitionBy("t", "k", "day").orderBy("x", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("there", F.sum("d").over(by_day)).where("i is not null").join(days, ["t", "k", "day"])
    return swept.where("there + before <= 0").select("i", "t", "x", F.when(F.col("last_added") > F.col("x"), "late").otherwise("deleted").alias("reason"))


def missing(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The rows of refs whose key is not null and no parent's, for parents that have no times.

    The distinct keys are held against the parents' by a left anti-join, and what is left is joined back.
    """
    lost = refs.select(key).where(F.col(key).isNotNull()).distinct().join(parents.select(key), key, "left_anti")
    return refs.join(lost, key, "left_semi").select(*refs.columns)


def report(found: DataFrame) -> DataFrame:
    """Orphans counted per target and month: (target, period, reason, n)."""
    return found.groupBy("target", F.date_format("at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n"))
