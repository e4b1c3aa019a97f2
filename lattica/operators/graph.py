"""The reference graph: which definitions are effective, edges between assets, files and language keys.

All functions take the tables of the index and return new DataFrames. Joins are equi-joins that adaptive
execution broadcasts or splits by measured size; nothing is broadcast by hint, and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import follows_convention, is_identifier, is_noise
from lattica.session import settle

EDGE = ["src", "dst", "dst_kind", "kind", "json_pointer", "confidence"]


def effective(assets: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, effective): whether no other definition of the same name and type overlays an asset.

    A lower priority wins, of equal ones the later pack; definitions of one pack tie and are all effective.
    A null type is a type of its own.
    """
    order = Window.partitionBy("logical_id", "type").orderBy("priority", F.desc("pack_id"))
    a = assets.select("id", "pack_id", "logical_id", "type").distinct()
    p = packs.select(F.col("id").alias("pack_id"), "priority").distinct()
    return a.join(p, "pack_id").select("id", (F.rank().over(order) == 1).alias("effective"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], policy: dict[str, str] | str) -> DataFrame:
    """Rows of both tables, one per key; each column takes the `first`, the `last`, the last non-null (`coalesce`) or the first non-null (`first_known`) value. policy: one for all, or by column."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return merged(both, key, "_seq", policy).select(*old.columns)


def merged(rows: DataFrame, key: list[str], seq: str, policy: dict[str, str] | str) -> DataFrame:
    """upsert over any number of deliveries, in the order of the column seq, in one aggregation. A null in the key is a value of its own; a key may occur once in a delivery."""
    how = {c: policy if isinstance(policy, str) else policy.get(c, "last") for c in rows.columns if c not in (*key, seq)}
    pick = {"first": lambda c: F.min_by(F.struct(c), seq)[c], "last": lambda c: F.max_by(F.struct(c), seq)[c], "coalesce": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))), "first_known": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))}
    return rows.groupBy(*key).agg(*[pick[h](c).alias(c) for c, h in how.items()])


STRINGS = ["asset_id", "json_pointer", "schema_pointer", "schema_scope", "raw_value"]


def strings(candidates: DataFrame) -> DataFrame:
    """String leaves that may name something, each once."""
    return candidates.where((F.col("value_kind") == "string") & ~is_noise(F.col("raw_value"))).select(*STRINGS).distinct()


def _typed(leaves: DataFrame, assets: DataFrame) -> DataFrame:
    return leaves.join(assets.select(F.col("id").alias("asset_id"), F.col("type").alias("src_type")).distinct(), "asset_id")


def _targets(assets: DataFrame, effective_only: bool = True) -> DataFrame:
    known = assets.where("is_effective") if effective_only else assets
    return known.select(F.col("id").alias("dst"), F.col("logical_id").alias("raw_value"), F.col("type").alias("dst_type")).distinct()


def _declared(schema_fields: DataFrame, scope: str) -> DataFrame:
    return schema_fields.where("reference_target is not null").select(F.col("asset_type").alias(scope), F.col("json_pointer").alias("schema_pointer"), "reference_target").distinct()


def _edge(df: DataFrame, dst_kind: str, kind: str, confidence) -> DataFrame:
    level = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select(F.col("asset_id").alias("src"), "dst", F.lit(dst_kind).alias("dst_kind"), F.lit(kind).alias("kind"), "json_pointer", level.alias("confidence")).distinct()


def _inherits(typed: DataFrame, targets: DataFrame) -> DataFrame:
    found = typed.where("json_pointer = '/Parent'").join(targets, "raw_value").where("dst_type = src_type and dst != asset_id")
    return _edge(found, "asset", "INHERITS_FROM", "high")


def _localized_by(leaves: DataFrame, lang_keys: DataFrame) -> DataFrame:
    keys = lang_keys.where("locale = 'en-US'").select(F.col("id").alias("dst"), F.concat("root", F.lit("."), "key").alias("raw_value")).where("raw_value is not null").distinct()
    return _edge(leaves.where("raw_value like '%.%.%'").join(keys, "raw_value"), "lang_key", "LOCALIZED_BY", "high")


def _references_file(leaves: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select(F.col("id").alias("dst"), "path").distinct()
    c = leaves.where("raw_value like '%.%' and raw_value not like '% %'").withColumn("path", F.concat(F.lit("Common/"), "raw_value"))
    return _edge(c.join(f, "path"), "file", "REFERENCES_FILE", "high")


def _references(typed: DataFrame, targets: DataFrame, schema_fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of fields that declare a target's type, and of fields that declare none."""
    fields = _declared(schema_fields, "src_type")
    named = typed.where("json_pointer != '/Parent'")
    c = named.join(fields, ["src_type", "schema_pointer"])
    declared = _edge(c.join(targets, "raw_value").where("dst_type = reference_target and dst != asset_id"), "asset", "REFERENCES", "high")
    free = named.join(fields.select("src_type", "schema_pointer"), ["src_type", "schema_pointer"], "left_anti")
    level = F.when(follows_convention(F.col("json_pointer")), "medium").otherwise("low")
    return declared, _edge(free.join(targets, "raw_value").where("dst != asset_id"), "asset", "REFERENCES", level)


def inherits(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """/Parent names the effective asset of that name and of the same (known) type, not itself."""
    return _inherits(_typed(strings(candidates.where("json_pointer = '/Parent'")), assets), _targets(assets))


def localized_by(candidates: DataFrame, lang_keys: DataFrame) -> DataFrame:
    """root.key names the English text of a language key."""
    return _localized_by(strings(candidates), lang_keys)


def references_file(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """A value with a dot and without a space is the path of a file below Common/."""
    return _references_file(strings(candidates), files)


def declared_references(candidates: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Fields declared to refer to a type name the effective asset of that type."""
    return _references(_typed(strings(candidates), assets), _targets(assets), schema_fields)[0]


def heuristic_references(candidates: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Fields without a declared target name effective assets of any type: medium if the field's name follows a convention, else low."""
    return _references(_typed(strings(candidates), assets), _targets(assets), schema_fields)[1]


def resolve(candidates: DataFrame, assets: DataFrame, files: DataFrame, lang_keys: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """All edges of the first pass, settled. The leaves are filtered, made distinct and given their asset's type once, for all kinds of edges."""
    kinds = assets.select(F.col("id").alias("asset_id"), F.col("type").alias("src_type"), F.lit(True).alias("owned")).distinct()
    leaves = settle(strings(candidates).join(kinds, "asset_id", "left"))
    typed, targets = leaves.where("owned").drop("owned"), _targets(assets)
    return settle(reduce(DataFrame.unionByName, [_inherits(typed, targets), _localized_by(leaves, lang_keys), _references_file(leaves, files), *_references(typed, targets, schema_fields)]))


def draft_edges(leaves: DataFrame, drafts: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Edges of drafts (their leaves and assets) to assets, drafts or indexed: inheritance, declared and heuristic references.

    Unlike resolve(), drafts see every definition, effective or not, and no value counts as noise.
    """
    typed = settle(_typed(leaves.where("value_kind = 'string'").select(*STRINGS).distinct(), drafts))
    targets = _targets(assets.select("id", "logical_id", "type", "is_effective").unionByName(drafts.select("id", "logical_id", "type", F.lit(True).alias("is_effective"))), effective_only=False)
    return reduce(DataFrame.unionByName, [_inherits(typed, targets), *_references(typed, targets, schema_fields)])


def broken_references(candidates: DataFrame, assets: DataFrame, schema_fields: DataFrame, aligned: bool = False) -> DataFrame:
    """(asset_id, json_pointer, raw_value, reference_target): declared references whose type has no asset of the name.

    Before alignment a field is looked up under its asset's type, afterwards under its own scope.
    """
    if aligned:
        c = strings(candidates).join(_declared(schema_fields, "schema_scope"), ["schema_scope", "schema_pointer"])
    else:
        c = _typed(strings(candidates), assets).join(_declared(schema_fields, "src_type"), ["src_type", "schema_pointer"])
    there = assets.select(F.col("logical_id").alias("raw_value"), F.col("type").alias("reference_target")).distinct()
    return c.join(there, ["raw_value", "reference_target"], "left_anti").select("asset_id", "json_pointer", "raw_value", "reference_target").distinct()


def dangling(candidates: DataFrame, assets: DataFrame, lang_keys: DataFrame, edges: DataFrame, broken: DataFrame) -> DataFrame:
    """(asset_id, json_pointer, raw_value) of identifiers that name no asset, no language key and have no edge."""
    names = assets.select(F.col("logical_id").alias("raw_value")).unionByName(lang_keys.select(F.col("key").alias("raw_value"))).distinct()
    with_edge = edges.select(F.col("src").alias("asset_id"), "json_pointer").distinct()
    return (
        strings(candidates)
        .where(is_identifier(F.col("raw_value")))
        .select("asset_id", "json_pointer", "raw_value")
        .distinct()
        .join(names, "raw_value", "left_anti")
        .join(with_edge, ["asset_id", "json_pointer"], "left_anti")
        .join(broken.select("asset_id", "json_pointer", "raw_value"), ["asset_id", "json_pointer", "raw_value"], "left_anti")
    )


def promote(edges: DataFrame, candidates: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Edges with the confidence and kind that alignment supports.

    REFERENCES become high if the aligned field declares the destination's type, medium if low and it
    declares any; nested /Parent references whose field's scope is a branch of the destination's root union
    become INHERITS_FROM, high.
    """
    leaf = candidates.select(F.col("asset_id").alias("src"), "json_pointer", "schema_scope", "schema_pointer").where("schema_scope is not null").distinct()
    declared = leaf.join(_declared(schema_fields, "schema_scope"), ["schema_scope", "schema_pointer"]).groupBy("src", "json_pointer").agg(F.collect_set("reference_target").alias("declared"))
    kinds = assets.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")).distinct()
    roots = schema_fields.where("json_pointer = '' and ref_scope is not null").select(F.col("asset_type").alias("dst_type"), F.explode("ref_scope").alias("schema_scope")).distinct()
    nested = leaf.where("json_pointer like '%/Parent' and json_pointer != '/Parent'").join(roots, "schema_scope").select("src", "json_pointer", "dst_type").distinct().withColumn("nested", F.lit(True))
    e = edges.join(kinds, "dst", "left").withColumn("dst_type", F.when(F.col("dst_kind") == "asset", F.col("dst_type")))
    e = e.join(declared, ["src", "json_pointer"], "left").join(nested, ["src", "json_pointer", "dst_type"], "left")
    ref = F.col("kind") == "REFERENCES"
    named = F.array_contains("declared", F.col("dst_type"))
    level = F.when(ref & (F.coalesce(named, F.lit(False)) | F.coalesce("nested", F.lit(False))), "high").when(ref & (F.col("confidence") == "low") & F.col("declared").isNotNull(), "medium").otherwise(F.col("confidence"))
    kind = F.when(ref & F.coalesce("nested", F.lit(False)), "INHERITS_FROM").otherwise(F.col("kind"))
    return e.select("src", "dst", "dst_kind", kind.alias("kind"), "json_pointer", level.alias("confidence")).distinct()


def contradicted(edges: DataFrame, candidates: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(src, dst, json_pointer) of edges to assets of another type than the field declares, where an asset of the declared type has the name."""
    leaf = candidates.select(F.col("asset_id").alias("src"), "json_pointer", "schema_scope", "schema_pointer").distinct().join(_declared(schema_fields, "schema_scope"), ["schema_scope", "schema_pointer"])
    a = assets.select(F.col("id").alias("dst"), "logical_id", F.col("type").alias("dst_type")).distinct()
    there = assets.select("logical_id", F.col("type").alias("reference_target")).distinct()
    e = edges.where("dst_kind = 'asset'").select("src", "dst", "json_pointer").distinct().join(leaf.select("src", "json_pointer", "reference_target").distinct(), ["src", "json_pointer"])
    return e.join(a, "dst").where("dst_type != reference_target").join(there, ["logical_id", "reference_target"], "left_semi").select("src", "dst", "json_pointer").distinct()


def inbound(edges: DataFrame, candidates: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Uncontradicted edges to each asset: (target, target_type, logical_id, type, kind, json_pointer, confidence)."""
    bad = contradicted(edges, candidates, assets, schema_fields)
    e = edges.where("dst_kind = 'asset'").join(bad, ["src", "dst", "json_pointer"], "left_anti")
    s = assets.select(F.col("id").alias("src"), "logical_id", "type").distinct()
    t = assets.select(F.col("id").alias("dst"), F.col("logical_id").alias("target"), F.col("type").alias("target_type")).distinct()
    return e.join(s, "src").join(t, "dst").select("target", "target_type", "logical_id", "type", "kind", "json_pointer", "confidence").distinct()


def overlap(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """(logical_id, type, shared): how many of the places (src, json_pointer) that refer to an asset also refer to a namesake of another type."""
    t = assets.select(F.col("id").alias("dst"), "logical_id", "type").distinct()
    g = edges.where("dst_kind = 'asset'").join(t, "dst").select("src", "json_pointer", "logical_id", "type").distinct()
    kinds = g.groupBy("src", "json_pointer", "logical_id").agg(F.countDistinct(F.struct("type")).alias("k")).where("k > 1").select("src", F.coalesce("json_pointer", F.lit("")).alias("place"), "logical_id")
    return g.withColumn("place", F.coalesce("json_pointer", F.lit(""))).join(kinds, ["src", "place", "logical_id"], "left_semi").groupBy("logical_id", "type").agg(F.count("*").alias("shared"))
