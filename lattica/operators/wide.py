"""Attribute-value rows into wide tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import dealt


def widen(rows: DataFrame, readers: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row per entity with a typed column for each attribute.

    rows: (entity, attribute, value, seen, tie). readers: column -> (attribute, how to read a value, giving
    null for what can't be read). Of several values of an attribute the readable one seen last holds; equal
    times are decided by the greater `tie`, then by the greater value; a null time is the earliest.
    Result: (entity, one column per reader); entities without any readable value have no row.
    Defined cases: null entities, attributes and values give nothing; repeated rows count once; attributes
    without a reader are left out; an empty table yields no rows. Other columns are not read.

    Method: rows are reduced to the last readable value of each entity and attribute, and written once as
    narrow tables, a folder for each attribute, all dealt into the same buckets by entity. Each attribute's
    typed narrow table is one such folder; they meet in a balanced tree of outer joins on the entity, each
    half of which starts from the entities it has to hold, so every join keeps the buckets.
    Scale: one shuffle reduces (map-side combine takes hot entities apart), one deals the reduced rows; the
    joins need none, however many attributes there are. No pivot ever holds an entity's rows together.
    """
    # the readable value, as text in its typed form, of attributes that are asked for
    slim = rows.select(F.col("entity").alias("e"), F.col("attribute").alias("a"), F.col("value").alias("v"), F.col("seen").alias("s"), F.col("tie").alias("t")).where("e is not null and v is not null")
    typed, readable = {}, None
    for name, (attribute, read) in readers.items():
        typed[name] = slim.select(read(F.col("v")).alias("x")).schema["x"].dataType
        cell = F.when(F.col("a") == attribute, read(F.col("v")).cast("string"))
        readable = cell if readable is None else F.coalesce(readable, cell)
    wanted = sorted({a for a, _ in readers.values()})
    last = slim.where(F.col("a").isin(wanted)).select("e", "a", F.struct(F.col("s"), F.col("t"), readable.alias("x")).alias("m")).where("m.x is not null").groupBy("e", "a").agg(F.max("m").alias("m"))
    narrow = dealt(last.select("e", "a", F.col("m.x").alias("x")), "e", ["a"])
    tables = [narrow.where(F.col("a") == attribute).select("e", F.col("x").cast(typed[name]).alias(name)) for name, (attribute, _) in readers.items()]
    entities = narrow.groupBy("e").agg(F.lit(True).alias("there")).select("e")
    half = -(-len(tables) // 2)
    sides = []
    for part in (tables[:half], tables[half:]):
        side = entities
        for t in part:
            side = side.join(t, "e", "left")
        sides.append(side)
    return sides[0].join(sides[1], "e").select(F.col("e").alias("entity"), *readers)
