"""Stations at which things are made: who declares them, their categories, and which plans require them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import parent_pointer, translation_key
from lattica.operators.graph import merged
from lattica.operators.links import enclosing


@dataclass(frozen=True)
class Spec:
    """Where stations, their categories and requirements stand: scopes and pointers of the aligned leaves.

    branches: the scopes of station objects (a union's), which carry id, type and plain categories.
    category, nested: the scopes of category objects and of categories within them (two levels further down).
    required: (scope, pointer) of a requirement's station id; its categories stand beside it.
    """

    branches: tuple[str, ...]
    category: str = "common:BenchCategory"
    nested: str = "common:BenchItemCategory"
    required: tuple[str, str] = ("common:BenchRequirement", "/Id")
    required_categories: str = "/Categories/*"


@dataclass
class Stations:
    stations: DataFrame
    declarations: DataFrame
    categories: DataFrame
    requirements: DataFrame
    requirement_categories: DataFrame


def extract(candidates: DataFrame, spec: Spec) -> Stations:
    """The five tables of stations out of the leaves.

    stations (station, station_type): each declared id once; of several types beside it the least.
    declarations (station, asset_id, n): how often an asset declares it.
    categories (station, category, parent, name_key, icon): a category belongs to the station object around
    it, the nearest one; of several places of a category each column takes the first non-null value, in the
    order plain, object, nested, then of asset and pointer. requirements (asset_id, at, station, resolved):
    of several ids at a place the least holds. requirement_categories (asset_id, at, category).
    All joins are on an asset and a pointer derived from the leaf's own.
    """
    leaves = candidates.select("asset_id", "json_pointer", "schema_scope", "schema_pointer", "raw_value").where("schema_scope is not null").distinct()
    at = parent_pointer(F.col("json_pointer")).alias("at")

    def field(scopes: list[str], pointer: str, name: str) -> DataFrame:
        return leaves.where(F.col("schema_scope").isin(scopes) & (F.col("schema_pointer") == pointer)).select("asset_id", at, F.col("raw_value").alias(name), "json_pointer")

    branches = list(spec.branches)
    kinds = field(branches, "/Type", "station_type").groupBy("asset_id", "at").agg(F.min("station_type").alias("station_type"))
    ids = field(branches, "/Id", "station")
    stations = ids.join(kinds, ["asset_id", "at"], "left").groupBy("station").agg(F.min("station_type").alias("station_type"))
    declarations = ids.groupBy("station", "asset_id").agg(F.count("*").alias("n"))

    holders = ids.groupBy("asset_id", "at").agg(F.min("station").alias("holder"))
    plain = field(branches, "/Categories/*", "category").select("asset_id", "json_pointer", "category", *[F.lit(None).cast("string").alias(c) for c in ("parent", "name_key", "icon")], F.lit(0).alias("level"))
    objects = []
    for level, scope in ((1, spec.category), (2, spec.nested)):
        own = field([scope], "/Id", "category").select("asset_id", "at", "category")
        name = field([scope], "/Name", "name").groupBy("asset_id", "at").agg(translation_key(F.min("name")).alias("name_key"))
        icon = field([scope], "/Icon", "icon").groupBy("asset_id", "at").agg(F.min("icon").alias("icon"))
        above = field([spec.category], "/Id", "parent").groupBy("asset_id", F.col("at").alias("above")).agg(F.min("parent").alias("parent"))
        o = own.join(name, ["asset_id", "at"], "left").join(icon, ["asset_id", "at"], "left").withColumn("above", parent_pointer(parent_pointer(F.col("at"))))
        o = o.join(above, ["asset_id", "above"], "left") if level == 2 else o.withColumn("parent", F.lit(None).cast("string"))
        objects.append(o.select("asset_id", F.col("at").alias("json_pointer"), "category", "parent", "name_key", "icon", F.lit(level).alias("level")))
    placed = enclosing(reduce(DataFrame.unionByName, objects, plain), holders).where("holder is not null")
    each = placed.select(F.col("holder").alias("station"), "category", "parent", "name_key", "icon", F.struct("level", "asset_id", "json_pointer").alias("seq"))
    categories = merged(each, ["station", "category"], "seq", "first_known")

    scope, pointer = spec.required
    required = field([scope], pointer, "station").groupBy("asset_id", "at").agg(F.min("station").alias("station"))
    known = stations.select("station", F.lit(True).alias("known"))
    requirements = required.join(known, "station", "left").select("asset_id", "at", "station", F.coalesce("known", F.lit(False)).alias("resolved"))
    beside = field([scope], spec.required_categories, "category").select("asset_id", parent_pointer(F.col("at")).alias("at"), "category").distinct()
    return Stations(stations, declarations, categories, requirements, beside)


def craftable_at(s: Stations, assets: DataFrame) -> DataFrame:
    """(station, logical_id, category) of the effective assets that require each station; without categories one row with none."""
    a = assets.where("is_effective").select(F.col("id").alias("asset_id"), "logical_id").distinct()
    return s.requirements.join(a, "asset_id").join(s.requirement_categories, ["asset_id", "at"], "left").select("station", "logical_id", "category").distinct()


def listing(s: Stations, assets: DataFrame) -> DataFrame:
    """Every station that is declared or required: (station, station_type, declared, declarers, n_declarers, n_categories, n_crafted, n_requirements)."""
    names = assets.select(F.col("id").alias("asset_id"), "logical_id").distinct()
    effective = assets.where("is_effective").select(F.col("id").alias("asset_id"), "logical_id").distinct()
    ids = s.stations.select("station").union(s.requirements.select("station")).distinct()
    by = s.declarations.join(names, "asset_id").groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("logical_id")), ", ").alias("declarers"), F.countDistinct("logical_id").alias("n_declarers"))
    cats = s.categories.groupBy("station").agg(F.count("*").alias("n_categories"))
    made = s.requirements.join(effective, "asset_id").groupBy("station").agg(F.countDistinct("logical_id").alias("n_crafted"))
    places = s.requirements.groupBy("station").agg(F.count("*").alias("n_requirements"))
    out = ids.join(s.stations.withColumn("declared", F.lit(True)), "station", "left").join(by, "station", "left").join(cats, "station", "left").join(made, "station", "left").join(places, "station", "left")
    return out.fillna(0, ["n_declarers", "n_categories", "n_crafted", "n_requirements"]).withColumn("declared", F.coalesce("declared", F.lit(False)))


def category_tree(s: Stations, lang_keys: DataFrame) -> DataFrame:
    """(station, category, parent, icon, english, place): the categories with their English name, numbered in the order of the tree, parents before their children."""
    english = lang_keys.where("locale = 'en-US'").groupBy(F.col("key").alias("name_key")).agg(F.max_by("value", F.struct("pack_id", "id")).alias("english"))
    from pyspark.sql import Window

    order = Window.partitionBy("station").orderBy(F.coalesce("parent", "category"), F.col("parent").isNotNull(), "category")
    return s.categories.join(english, "name_key", "left").select("station", "category", "parent", "icon", "english", F.row_number().over(order).cast("long").alias("place"))


def summary(s: Stations) -> DataFrame:
    """One row: stations, declarations, categories, nested, requirements, resolved, and the ids declared more than once and required but never declared."""
    twice = s.declarations.groupBy("station").agg(F.sum("n").alias("n")).where("n > 1")
    parts = {
        "stations": s.stations.agg(F.count("*").alias("n")), "declarations": s.declarations.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "categories": s.categories.agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("n")),
        "nested": s.categories.agg(F.count("parent").alias("n")), "requirements": s.requirements.agg(F.count("*").alias("n")), "resolved": s.requirements.agg(F.count(F.when(F.col("resolved"), 1)).alias("n")),
    }
    numbers = reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("what"), F.col("n").cast("string").alias("value")) for k, p in parts.items()])
    names = twice.select(F.lit("declared more than once").alias("what"), F.col("station").alias("value")).unionByName(
        s.requirements.where("not resolved").select(F.lit("never declared").alias("what"), F.col("station").alias("value")).distinct()
    )
    return numbers.unionByName(names)
