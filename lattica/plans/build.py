"""Building an index: archives and declared fields in, tables and a completion marker out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import align, graph, profile, search
from lattica.operators import stations as stations_
from lattica.operators.links import ValueLink, value_links
from lattica.session import numbered, settle
from lattica.sources import archives, lang, lenient_json

PIPELINE = 2


def typed(paths: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """paths (path...) with the type of the best rule (prefix, suffix, type): rules with a suffix first, then the longest prefix, then the earlier. Rules are parameters, so the conditions are built in."""
    ranked = sorted(enumerate(rules), key=lambda r: (not r[1][1], -len(r[1][0]), r[0]))
    kind = F.lit(None).cast("string")
    for _, (prefix, suffix, name) in reversed(ranked):
        kind = F.when(F.col("path").startswith(prefix) & F.col("path").endswith(suffix), name).otherwise(kind)
    return paths.withColumn("type", kind)


@dataclass(frozen=True)
class Settings:
    """What a build is told beside its packs and declared fields.

    rules: (prefix, suffix, type) of asset types; suffixes of asset files and the folders below which they
    lie; folders whose documents give no leaves; value links and the places of stations to index.
    """

    rules: tuple[tuple[str, str, str], ...] = ()
    suffixes: tuple[str, ...] = (".json",)
    roots: tuple[str, ...] = ("Server/",)
    without_leaves: tuple[str, ...] = ("Server/Prefabs/", "Server/World/")
    links: tuple[ValueLink, ...] = ()
    stations: stations_.Spec = stations_.Spec(("common:Bench",))


def build(spark: SparkSession, packs: list[tuple[str, str, int]], schema_fields: DataFrame, rules: list[tuple[str, str, str]], out: str, settings: Settings = Settings(), types: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """Reads packs (archive, kind, priority), writes all tables below out, and last a marker that says they are complete. Returns the report, (what, n).

    The marker of an earlier build is taken away first, and every table is overwritten, so a build may be
    repeated after a failure; a folder without the marker is no index. Archives that hold neither assets nor
    texts are not admitted. Documents are parsed once; edges are resolved before alignment and judged again
    after it. Numbers of rows are dense, given after the rows are settled.
    """
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/complete.parquet")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, True)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        return spark.read.parquet(f"{out}/{name}.parquet")

    given = spark.createDataFrame([(i + 1, a, k, p) for i, (a, k, p) in enumerate(packs)], "id long, path string, kind string, priority int")
    listed = keep(archives.entries(spark, [a for a, _, _ in packs]), "archive_entries")
    admitted = given.join(archives.admitted(listed).withColumnRenamed("archive", "path"), "path", "left_semi")
    manifest = archives.manifests(archives.with_content(listed.where("path = 'manifest.json'"), 1).select(F.col("archive").alias("path"), "content")).withColumnRenamed("name", "title")
    sizes = listed.groupBy(F.col("archive").alias("path")).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("\0", "path", "size", "crc"), 256))), ""), 256), 1, 16).alias("source_hash"))
    named = admitted.join(manifest, "path", "left").join(sizes, "path", "left")
    p = keep(named.select("id", "group_name", F.coalesce("title", F.element_at(F.split("path", "/"), -1)).alias("name"), "version", "path", "kind", "priority", "source_hash"), "packs")
    listed = listed.join(F.broadcast(p.select(F.col("id").alias("pack_id"), F.col("path").alias("archive"))), "archive")

    path = F.col("path")
    is_asset, under, wanted = F.lit(False), F.lit(False), F.lit(True)
    for x in settings.suffixes:
        is_asset = is_asset | path.endswith(x)
    for x in settings.roots:
        under = under | path.startswith(x)
    for x in settings.without_leaves:
        wanted = wanted & ~path.startswith(x)
    found = typed(listed.where(is_asset & under), [*settings.rules, *rules]).select("pack_id", T.asset_id_from_path(path).alias("logical_id"), "type", "path")
    order = Window.partitionBy("logical_id", "type").orderBy("priority", F.desc("pack_id"))
    ranked = found.join(p.select(F.col("id").alias("pack_id"), "priority"), "pack_id").withColumn("is_effective", F.rank().over(order) == 1).drop("priority")
    assets = keep(numbered(ranked), "assets")
    files = keep(numbered(listed.where(~is_asset & ~path.endswith(".lang")).select("pack_id", "path", T.file_kind(path).alias("kind"))), "files")

    texts = archives.with_content(listed.where(path.endswith(".lang")).drop("pack_id")).join(F.broadcast(p.select(F.col("id").alias("pack_id"), F.col("path").alias("archive"))), "archive")
    each = lang.entries(texts.select(F.concat_ws("\n", "pack_id", "path").alias("path"), F.col("content").cast("string").alias("content")))
    place = F.split("path", "\n")
    each = each.select(place[0].cast("long").alias("pack_id"), "key", T.locale_from_path(place[1]).alias("locale"), "value", F.regexp_extract(place[1], r"([^/]+)\.lang$", 1).alias("root"), place[1].alias("source_path"))
    keys = keep(numbered(each.where("locale is not null")), "lang_keys")

    bodies = archives.with_content(listed.where(is_asset & under & wanted).drop("pack_id")).join(F.broadcast(p.select(F.col("id").alias("pack_id"), F.col("path").alias("archive"))), "archive")
    docs = bodies.select("pack_id", "path", F.col("content").cast("string").alias("doc")).join(assets.select(F.col("id").alias("asset_id"), "pack_id", "path"), ["pack_id", "path"])
    docs = settle(docs.select("asset_id", "doc"))
    leaves = keep(lenient_json.leaves(docs).withColumn("schema_scope", F.lit(None).cast("string")), "leaves")
    unread = keep(lenient_json.unreadable(docs, ["asset_id"]), "unreadable")
    fields = keep(schema_fields, "schema_fields")
    kinds = types if types is not None else fields.where("asset_type not like '%:%'").select(F.col("asset_type").alias("id")).distinct()
    keep(kinds, "asset_types")
    if definitions is not None:
        keep(definitions, "schema_defs")

    first = graph.resolve(leaves, assets, files, keys, fields)
    parents = graph.inherits(leaves, assets).groupBy("src").agg(F.min("dst").alias("parent_id"))
    lineage = assets.join(parents.withColumnRenamed("src", "id"), "id", "left").select("id", "type", "parent_id")
    candidates = keep(numbered(align.align(leaves, lineage, fields)), "candidates")
    roles = lenient_json.text_references(docs).select(F.col("asset_id").alias("src"), "json_pointer", "role").distinct()
    edges = graph.promote(first, candidates, assets, fields).join(roles, ["src", "json_pointer"], "left")
    edges = keep(numbered(edges), "edges")
    keep(profile.field_stats(candidates).select("asset_type", "json_pointer", F.col("n").alias("count"), F.col("n_assets").alias("of_total"), "value_types", "cardinality", "observed_values"), "field_stats")
    if settings.links:
        keep(value_links(candidates, list(settings.links)), "value_links")
    made = stations_.extract(candidates, settings.stations)
    for name, df in (("benches", made.stations), ("bench_declarations", made.declarations), ("bench_categories", made.categories), ("bench_requirements", made.requirements), ("bench_requirement_categories", made.requirement_categories)):
        keep(df, name)
    search_docs = keep(numbered(search.search_docs(assets, edges, keys), "doc"), "search_docs")
    # ordered by term, so that a search for words with some beginning reads the few stretches that hold them
    postings = keep(search.postings(search_docs, ["doc"], ["display_name", "description"]).repartitionByRange("term").sortWithinPartitions("term", "doc"), "postings")

    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    report = [count("packs", p), count("assets", assets), count("typed", assets.where("type is not null")), count("files", files), count("lang_keys", keys), count("leaves", candidates), count("edges", edges), count("unreadable", unread), count("stations", made.stations), count("postings", postings)]
    done = report[0]
    for r in report[1:]:
        done = done.unionByName(r)
    done = keep(done, "meta")
    spark.createDataFrame([(PIPELINE,)], "pipeline int").write.mode("overwrite").parquet(f"{out}/complete.parquet")
    return done


def state(spark: SparkSession, out: str) -> str:
    """ready, stale (built by another pipeline) or incomplete."""
    try:
        n = spark.read.parquet(f"{out}/complete.parquet").first()[0]
    except Exception:  # noqa: BLE001 - a missing marker is the answer
        return "incomplete"
    return "ready" if n == PIPELINE else "stale"
