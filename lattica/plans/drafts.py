"""Drafts: documents that are not indexed, seen as if they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import align, graph
from lattica.session import settle
from lattica.sources import lenient_json


def infer_types(paths: DataFrame, known: DataFrame) -> DataFrame:
    """paths (id, path) with inferred, the type that most of the known (path, type) below their deepest such folder have; equal numbers go to the greater name."""
    folders = lambda df, *keep: df.select(*keep, F.split("path", "/").alias("p")).where(F.size("p") > 1).select(*keep, F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"), "p").select(*keep, "n", F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("dir"))
    votes = folders(known.where("type is not null"), "type").groupBy("dir", "n", "type").agg(F.count("*").alias("c")).groupBy("dir", "n").agg(F.max_by("type", F.struct("c", "type")).alias("vote"))
    return folders(paths, "id").join(votes, ["dir", "n"]).groupBy("id").agg(F.max_by("vote", "n").alias("inferred"))


def leaves(docs: DataFrame, drafts: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(asset_id, json_pointer, raw_value, value_kind, schema_pointer, schema_scope) of drafts' documents (asset_id, doc), shredded and aligned as indexed ones are.

    drafts: (id, type[, parent_id]). Drafts' own parents are taken for unions that a draft doesn't decide itself.
    """
    shredded = settle(lenient_json.leaves(docs.join(drafts.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")).drop("schema_pointer"))
    parent = F.col("parent_id") if "parent_id" in drafts.columns else F.lit(None).cast("long").alias("parent_id")
    return align.align(shredded, drafts.select("id", "type", parent), schema_fields)


def lay(docs: DataFrame, drafts: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> dict[str, DataFrame]:
    """The overlay for plans.answers.Index: drafts' assets, leaves and edges. Drafts without a type get the one inferred from their folder.

    drafts: (id, pack_id, logical_id, type, path), whose ids and pack the caller chose apart from those indexed.
    """
    guessed = infer_types(drafts.where("type is null").select("id", "path"), assets.select("path", "type"))
    typed = settle(drafts.join(guessed, "id", "left").select("id", "pack_id", "logical_id", F.coalesce("type", "inferred").alias("type"), "path", F.lit(True).alias("is_effective")))
    rows = settle(leaves(docs, typed, schema_fields))
    edges = graph.draft_edges(rows, typed, assets, schema_fields)
    return {"assets": typed, "candidates": rows.withColumn("id", -F.abs(F.xxhash64("asset_id", "json_pointer"))), "edges": edges}


def values(rows: DataFrame) -> DataFrame:
    """(asset_type, json_pointer, values, n, n_assets): the distinct values that drafts' leaves give each field. Drafts are one session's, so a field's values fit a row."""
    out = rows.where("schema_scope is not null").groupBy(F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("json_pointer"))
    return out.agg(F.array_sort(F.collect_set("raw_value")).alias("values"), F.count("*").alias("n"), F.countDistinct("asset_id").alias("n_assets"))
