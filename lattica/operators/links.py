"""Fields that draw their values from other fields, and prefix joins on pointers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ValueLink:
    """Values at `declared` fields are what values at `referenced` fields may be; both as (scope, pointer)."""

    name: str
    declared: tuple[tuple[str, str], ...]
    referenced: tuple[tuple[str, str], ...]


def value_links(candidates: DataFrame, links: list[ValueLink]) -> DataFrame:
    """(link, value, asset_id, json_pointer, role, resolved) of each place that declares or refers to a value."""
    c = candidates.where("value_kind = 'string'").select(F.col("schema_scope").alias("scope"), F.col("schema_pointer").alias("field"), F.col("raw_value").alias("value"), "asset_id", "json_pointer").distinct()
    spec = [(x.name, role, s, p) for x in links for role, at in (("declared", x.declared), ("referenced", x.referenced)) for s, p in at]
    places = c.join(F.broadcast(c.sparkSession.createDataFrame(spec, "link string, role string, scope string, field string")), ["scope", "field"])
    declared = places.where("role = 'declared'").select("link", "value").distinct().withColumn("_there", F.lit(True))
    return places.join(declared, ["link", "value"], "left").select("link", "value", "asset_id", "json_pointer", "role", F.coalesce("_there", F.lit(False)).alias("resolved"))


def summary(links: DataFrame) -> DataFrame:
    """(link, n_declared, n_values, n_referenced, n_resolved, unresolved) of each link; unresolved lists the distinct values that nothing declares."""
    d, r = F.col("role") == "declared", F.col("role") == "referenced"
    return links.groupBy("link").agg(
        F.count(F.when(d, 1)).alias("n_declared"), F.countDistinct(F.when(d, F.col("value"))).alias("n_values"), F.count(F.when(r, 1)).alias("n_referenced"), F.count(F.when(r & F.col("resolved"), 1)).alias("n_resolved"),
        F.array_sort(F.collect_set(F.when(r & ~F.col("resolved"), F.col("value")))).alias("unresolved"),
    )


def who_uses(links: DataFrame, assets: DataFrame, link: str, value: str, role: str) -> DataFrame:
    """(logical_id, type, json_pointer) of the assets that declare or refer to a value by a link."""
    at = links.where((F.col("link") == link) & (F.col("value") == value) & (F.col("role") == role)).select(F.col("asset_id").alias("id"), "json_pointer").distinct()
    return at.join(assets.select("id", "logical_id", "type"), "id").select("logical_id", "type", "json_pointer").distinct()


def sites(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """(schema_scope, schema_pointer, n, example): the fields at which a link's places stand, and how many of them."""
    c = candidates.select("asset_id", "json_pointer", "schema_scope", "schema_pointer").distinct()
    j = links.select("asset_id", "json_pointer").distinct().join(c, ["asset_id", "json_pointer"])
    return j.groupBy("schema_scope", "schema_pointer").agg(F.countDistinct("asset_id", "json_pointer").alias("n"), F.min("json_pointer").alias("example"))


def enclosing(leaves: DataFrame, holders: DataFrame) -> DataFrame:
    """Each leaf (asset_id, json_pointer) with the holder (asset_id, at, holder) whose pointer is its longest prefix; null if none.

    A join on every prefix of the leaf, which has few segments, instead of a range join.
    """
    parts = F.split("json_pointer", "/")
    prefixes = leaves.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("at", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "/"))
    best = prefixes.join(holders.select("asset_id", "at", "holder").distinct(), ["asset_id", "at"]).groupBy("asset_id", "json_pointer").agg(F.max_by("holder", F.struct("_n", "holder")).alias("holder"))
    return leaves.join(best, ["asset_id", "json_pointer"], "left")
