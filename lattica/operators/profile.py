"""Observed profiles of fields, held beside what is declared without ever mixing the two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import is_container

# How many distinct values make an enumeration, and how often a field must be seen for it
MOST_VALUES, LEAST_SEEN = 40, 8


def field_stats(candidates: DataFrame) -> DataFrame:
    """(asset_type, json_pointer, n, n_assets, cardinality, value_types, observed_values) of each aligned field.

    Exact counts over all rows. Kinds and values are sorted; values are listed only up to MOST_VALUES.
    Distinct values are first reduced per field, so no list longer than the bound is ever built.
    """
    rows = candidates.where("schema_scope is not null").select(F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("json_pointer"), "id", "asset_id", "raw_value", "value_kind").distinct()
    key = ["asset_type", "json_pointer"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("asset_id").alias("n_assets"), F.array_sort(F.collect_set("value_kind")).alias("value_types"))
    distinct = rows.groupBy(*key, "raw_value").agg(F.count("*").alias("c"))
    card = distinct.groupBy(*key).agg(F.count("*").alias("cardinality"))
    few = distinct.join(card.where(F.col("cardinality") <= MOST_VALUES).select(*key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("raw_value")).alias("observed_values"))
    return counts.join(card, key).join(few, key, "left")


def inferred_enums(stats: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(asset_type, json_pointer, enum_values) of declared fields without a declared enumeration that were seen often enough with few enough values."""
    s = schema_fields if "enum_values" in schema_fields.columns else schema_fields.withColumn("enum_values", F.lit(None).cast("array<string>"))
    free = s.where(F.col("enum_values").isNull() | (F.size("enum_values") == 0)).select("asset_type", "json_pointer").distinct()
    often = stats.where((F.col("cardinality").between(1, MOST_VALUES)) & (F.col("n") >= LEAST_SEEN))
    return often.join(free, ["asset_type", "json_pointer"], "left_semi").select("asset_type", "json_pointer", F.col("observed_values").alias("enum_values"))


def target_types(candidates: DataFrame, edges: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """The types that fields declared to refer to one really reach."""
    declared = schema_fields.where("reference_target is not null").select(F.col("asset_type").alias("schema_scope"), F.col("json_pointer").alias("schema_pointer")).distinct()
    leaf = candidates.select(F.col("asset_id").alias("src"), "json_pointer", "schema_scope", "schema_pointer").distinct().join(declared, ["schema_scope", "schema_pointer"], "left_semi")
    e = edges.where("dst_kind = 'asset'").select("src", "json_pointer", F.col("dst").alias("id")).distinct()
    kinds = assets.where("type is not null").select("id", "type").distinct()
    return leaf.join(e, ["src", "json_pointer"]).join(kinds, "id").groupBy(F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("json_pointer")).agg(F.array_sort(F.collect_set("type")).alias("target_types"))


def describe(schema_fields: DataFrame, field_stats_: DataFrame) -> DataFrame:
    """Every declared or observed field, with both sides; which of them has it is told by declared and observed."""
    s = schema_fields.where("json_pointer != ''").select("asset_type", "json_pointer", "declared_type", "optional", "reference_target", F.lit(True).alias("declared"))
    o = field_stats_.select("asset_type", "json_pointer", F.col("count").alias("n"), "cardinality", F.lit(True).alias("observed"))
    no = F.lit(False)
    return s.join(o, ["asset_type", "json_pointer"], "full_outer").withColumns({"declared": F.coalesce("declared", no), "observed": F.coalesce("observed", no)})


def undocumented(schema_fields: DataFrame, field_stats_: DataFrame) -> DataFrame:
    """Declared scalar fields that are never observed."""
    s = schema_fields.where((F.col("json_pointer") != "") & ~is_container(F.col("declared_type")))
    return s.join(field_stats_.select("asset_type", "json_pointer"), ["asset_type", "json_pointer"], "left_anti").select("asset_type", "json_pointer", "declared_type")


def undeclared(schema_fields: DataFrame, field_stats_: DataFrame) -> DataFrame:
    """Observed fields that are not declared."""
    return field_stats_.join(schema_fields.select("asset_type", "json_pointer"), ["asset_type", "json_pointer"], "left_anti").select("asset_type", "json_pointer", F.col("count").alias("n"))
