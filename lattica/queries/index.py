"""Queries of the asset index: overlay, edges, profiles, answers; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions.canonical import schema_pointer
from lattica.operators import graph, profile
from lattica.plans import drafts
from lattica.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# --- SQL shared by the oracles -------------------------------------------------------------------
_NOISE = "lower(raw_value) NOT IN ('none', 'default', 'null', 'true', 'false', 'any', 'all')"
_C = f"""c AS (SELECT DISTINCT asset_id, json_pointer, schema_pointer, schema_scope, raw_value FROM candidates WHERE value_kind = 'string' AND {_NOISE}),
a AS (SELECT DISTINCT id, logical_id, type, is_effective FROM assets),
sf AS (SELECT DISTINCT asset_type, json_pointer, reference_target FROM schema_fields WHERE reference_target IS NOT NULL),
leaf AS (SELECT DISTINCT asset_id, json_pointer, schema_scope, schema_pointer FROM candidates)"""
_CONVENTION = "json_pointer GLOB '*Id' OR json_pointer GLOB '*/Set' OR json_pointer GLOB '*/Model' OR json_pointer GLOB '*/BlockType' OR json_pointer GLOB '*/BlockTypes/*' OR json_pointer GLOB '*/BlockSets/*'"
_E1 = "SELECT DISTINCT c.asset_id src, t.id dst, 'asset' dst_kind, 'INHERITS_FROM' kind, c.json_pointer, 'high' confidence FROM c JOIN a s ON s.id = c.asset_id JOIN a t ON t.logical_id = c.raw_value AND t.type = s.type AND t.is_effective WHERE c.json_pointer = '/Parent' AND t.id <> c.asset_id"
_E2 = "SELECT DISTINCT c.asset_id src, l.id dst, 'lang_key' dst_kind, 'LOCALIZED_BY' kind, c.json_pointer, 'high' confidence FROM c JOIN lang_keys l ON l.root || '.' || l.key = c.raw_value WHERE c.raw_value LIKE '%.%.%' AND l.locale = 'en-US'"
_E3 = "SELECT DISTINCT c.asset_id src, f.id dst, 'file' dst_kind, 'REFERENCES_FILE' kind, c.json_pointer, 'high' confidence FROM c JOIN files f ON f.path = 'Common/' || c.raw_value WHERE c.raw_value LIKE '%.%' AND c.raw_value NOT LIKE '% %'"
# fields with their asset's type and, where one is declared, the type they refer to
_FIELDS = "(SELECT c.*, s.type own, sf.reference_target wanted FROM c JOIN a s ON s.id = c.asset_id LEFT JOIN sf ON sf.asset_type = s.type AND sf.json_pointer = c.schema_pointer)"
_E4 = f"SELECT DISTINCT f.asset_id src, t.id dst, 'asset' dst_kind, 'REFERENCES' kind, f.json_pointer, 'high' confidence FROM a t JOIN {_FIELDS} f ON (f.raw_value, f.wanted) = (t.logical_id, t.type) WHERE t.is_effective AND f.asset_id <> t.id AND f.json_pointer <> '/Parent'"
_E5 = f"SELECT DISTINCT f.asset_id src, t.id dst, 'asset' dst_kind, 'REFERENCES' kind, f.json_pointer, CASE WHEN {_CONVENTION.replace('json_pointer GLOB', 'f.json_pointer GLOB')} THEN 'medium' ELSE 'low' END confidence FROM a t JOIN {_FIELDS} f ON f.raw_value = t.logical_id WHERE f.wanted IS NULL AND t.is_effective AND f.asset_id <> t.id AND f.json_pointer <> '/Parent'"
_E = f"{_C}, e AS ({_E1} UNION ALL {_E2} UNION ALL {_E3} UNION ALL {_E4} UNION ALL {_E5})"
_BROKEN = f"SELECT DISTINCT f.asset_id, f.json_pointer, f.raw_value, f.wanted reference_target FROM {_FIELDS} f ANTI JOIN a t ON t.logical_id = f.raw_value AND t.type = f.wanted WHERE f.wanted IS NOT NULL"
_CONTRA = "bad AS (SELECT DISTINCT e.src, e.dst, e.json_pointer FROM e JOIN leaf c ON c.asset_id = e.src AND c.json_pointer = e.json_pointer JOIN sf ON sf.asset_type = c.schema_scope AND sf.json_pointer = c.schema_pointer JOIN a d ON d.id = e.dst WHERE e.dst_kind = 'asset' AND d.type <> sf.reference_target AND EXISTS (SELECT 1 FROM a t WHERE t.logical_id = d.logical_id AND t.type = sf.reference_target))"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve(*_t(spark, d, "candidates", "assets", "files", "lang_keys", "schema_fields"))


# --- overlay -------------------------------------------------------------------------------------
@query("WITH x AS (SELECT DISTINCT a.id, a.pack_id, logical_id, type, priority FROM assets a JOIN packs p ON p.id = a.pack_id) SELECT id, NOT EXISTS (SELECT 1 FROM x o WHERE o.logical_id = x.logical_id AND o.type IS NOT DISTINCT FROM x.type AND (o.priority < x.priority OR o.priority = x.priority AND o.pack_id > x.pack_id)) effective FROM x")
def join08_effective(spark, d):
    return graph.effective(*_t(spark, d, "assets", "packs"))


@query("SELECT a.logical_id, a.type, p.name pack, a.path, a.is_effective FROM (SELECT DISTINCT pack_id, logical_id, type, path, is_effective FROM assets) a JOIN packs p ON p.id = a.pack_id WHERE a.logical_id IN (SELECT logical_id FROM assets GROUP BY 1 HAVING count(DISTINCT pack_id) > 1)")
def join24_pack_definitions(spark, d):
    """Every definition of the names that several packs define."""
    a, p = _t(spark, d, "assets", "packs")
    a = a.select("pack_id", "logical_id", "type", "path", "is_effective").distinct()
    several = a.groupBy("logical_id").agg(F.countDistinct("pack_id").alias("n")).where("n > 1").select("logical_id")
    return a.join(several, "logical_id", "left_semi").join(p.select(F.col("id").alias("pack_id"), F.col("name").alias("pack")), "pack_id").select("logical_id", "type", "pack", "path", "is_effective")


@query("SELECT logical_id, id, type, pack FROM (SELECT a.logical_id, a.id, a.type, p.name pack, row_number() OVER (PARTITION BY a.logical_id ORDER BY a.is_effective DESC, p.priority, a.type NULLS FIRST, a.id) n FROM (SELECT DISTINCT id, pack_id, logical_id, type, is_effective FROM assets) a JOIN packs p ON p.id = a.pack_id) WHERE n = 1")
def join23_loader(spark, d):
    """The definition that a name alone loads."""
    a, p = _t(spark, d, "assets", "packs")
    a = a.select("id", "pack_id", "logical_id", "type", "is_effective").distinct().join(p.select(F.col("id").alias("pack_id"), F.col("name").alias("pack"), "priority"), "pack_id")
    best = F.min_by(F.struct("id", "type", "pack"), F.struct((~F.col("is_effective")).alias("x"), "priority", "type", "id"))
    return a.groupBy("logical_id").agg(best.alias("b")).select("logical_id", "b.id", "b.type", "b.pack")


@query("SELECT locale, key, value FROM (SELECT *, row_number() OVER (PARTITION BY locale, key ORDER BY pack_id DESC, id DESC) n FROM lang_keys) WHERE n = 1")
def win06_last_wins(spark, d):
    """The text of each key in each locale that the last pack gives."""
    (k,) = _t(spark, d, "lang_keys")
    return k.groupBy("locale", "key").agg(F.max_by("value", F.struct("pack_id", "id")).alias("value"))


@query("WITH s AS (SELECT snapshot_no, logical_id, type, max(path) path FROM asset_snapshots GROUP BY ALL) SELECT logical_id, type, arg_min(path, snapshot_no) first_path, arg_max(path, snapshot_no) last_path FROM s GROUP BY ALL")
def snk02_upsert(spark, d):
    """All deliveries merged in the order of snapshot_no: one column keeps the first value, one takes the last."""
    (s,) = _t(spark, d, "asset_snapshots")
    s = s.groupBy("snapshot_no", "logical_id", "type").agg(F.max("path").alias("first_path")).withColumn("last_path", F.col("first_path"))
    return graph.merged(s, ["logical_id", "type"], "snapshot_no", {"first_path": "first", "last_path": "last"})


# --- edges ---------------------------------------------------------------------------------------
@query(f"WITH {_C} {_E1}")
def join01_inherits(spark, d):
    return graph.inherits(*_t(spark, d, "candidates", "assets"))


@query(f"WITH {_C} {_E2}")
def join02_localized_by(spark, d):
    return graph.localized_by(*_t(spark, d, "candidates", "lang_keys"))


@query(f"WITH {_C} {_E3}")
def join03_file_refs(spark, d):
    return graph.references_file(*_t(spark, d, "candidates", "files"))


@query(f"WITH {_C} {_E4}")
def join04_declared_refs(spark, d):
    return graph.declared_references(*_t(spark, d, "candidates", "assets", "schema_fields"))


@query(f"WITH {_C} {_E5}")
def join05_heuristic_refs(spark, d):
    return graph.heuristic_references(*_t(spark, d, "candidates", "assets", "schema_fields"))


@query(f"WITH {_C} {_BROKEN}")
def join06_broken_declared(spark, d):
    return graph.broken_references(*_t(spark, d, "candidates", "assets", "schema_fields"))


@query(f"WITH {_E}, b AS ({_BROKEN}) SELECT DISTINCT c.asset_id, c.json_pointer, c.raw_value FROM c WHERE regexp_matches(c.raw_value, '(?s)^[A-Za-z].*[_A-Za-z0-9]') AND c.raw_value NOT LIKE '% %' AND NOT EXISTS (SELECT 1 FROM a WHERE a.logical_id = c.raw_value) AND NOT EXISTS (SELECT 1 FROM lang_keys l WHERE l.key = c.raw_value) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.asset_id AND e.json_pointer = c.json_pointer) AND NOT EXISTS (SELECT 1 FROM b WHERE b.asset_id = c.asset_id AND b.json_pointer = c.json_pointer AND b.raw_value = c.raw_value)")
def join07_dangling(spark, d):
    c, a, k, s = _t(spark, d, "candidates", "assets", "lang_keys", "schema_fields")
    return graph.dangling(c, a, k, _edges(spark, d), graph.broken_references(c, a, s))


_PROMOTED = f"""{_E}, dec AS (SELECT c.asset_id src, c.json_pointer, list(DISTINCT sf.reference_target) l FROM leaf c JOIN sf ON sf.asset_type = c.schema_scope AND sf.json_pointer = c.schema_pointer GROUP BY ALL),
pr AS (SELECT DISTINCT e.src, e.dst, e.dst_kind, e.kind, e.json_pointer, CASE WHEN e.kind = 'REFERENCES' AND e.dst_kind = 'asset' AND list_contains(dec.l, t.type) THEN 'high' WHEN e.kind = 'REFERENCES' AND e.confidence = 'low' AND dec.l IS NOT NULL THEN 'medium' ELSE e.confidence END confidence FROM e LEFT JOIN dec ON dec.src = e.src AND dec.json_pointer = e.json_pointer LEFT JOIN a t ON t.id = e.dst)"""


@query(f"WITH {_PROMOTED} SELECT * FROM pr")
def join09_promoted(spark, d):
    """Edges after alignment; declared targets raise their confidence (no root unions are declared here)."""
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    return graph.promote(_edges(spark, d), c, a, s)


@query(f"WITH {_PROMOTED} SELECT kind, confidence, count(*) n FROM pr GROUP BY ALL")
def agg15_edge_counts(spark, d):
    return join09_promoted(spark, d).groupBy("kind", "confidence").agg(F.count("*").alias("n"))


@query(f"WITH {_C} SELECT DISTINCT c.asset_id, c.json_pointer, c.raw_value, sf.reference_target FROM c JOIN sf ON sf.asset_type = c.schema_scope AND sf.json_pointer = c.schema_pointer WHERE NOT EXISTS (SELECT 1 FROM a t WHERE t.logical_id = c.raw_value AND t.type = sf.reference_target)")
def join12_broken_aligned(spark, d):
    return graph.broken_references(*_t(spark, d, "candidates", "assets", "schema_fields"), aligned=True)


@query(f"WITH {_E}, {_CONTRA} SELECT DISTINCT t.logical_id target, t.type target_type, s.logical_id, s.type, e.kind, e.json_pointer, e.confidence FROM e JOIN a s ON s.id = e.src JOIN a t ON t.id = e.dst WHERE e.dst_kind = 'asset' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.src = e.src AND bad.dst = e.dst AND bad.json_pointer = e.json_pointer)")
def join17_refs(spark, d):
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    return graph.inbound(_edges(spark, d), c, a, s)


@query(f"WITH {_E}, {_CONTRA}, g AS (SELECT DISTINCT e.src, e.dst, e.json_pointer, t.logical_id, t.type FROM e JOIN a t ON t.id = e.dst WHERE e.dst_kind = 'asset' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.src = e.src AND bad.dst = e.dst AND bad.json_pointer = e.json_pointer)) SELECT g.logical_id, g.type, count(DISTINCT (g.src, g.json_pointer)) shared FROM g WHERE EXISTS (SELECT 1 FROM g o WHERE o.src = g.src AND o.json_pointer IS NOT DISTINCT FROM g.json_pointer AND o.logical_id = g.logical_id AND o.type IS DISTINCT FROM g.type) GROUP BY ALL")
def join18_overlap(spark, d):
    """For each asset, how many of its edges also point at a namesake of another type."""
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    e = _edges(spark, d)
    bad = graph.contradicted(e, c, a, s)
    return graph.overlap(e.join(bad, ["src", "dst", "json_pointer"], "left_anti"), a)


@query("SELECT l.key, count(DISTINCT e.src) n_users, min(a.logical_id) first_user FROM (SELECT DISTINCT src, dst FROM edges WHERE dst_kind = 'lang_key') e JOIN lang_keys l ON l.id = e.dst JOIN (SELECT DISTINCT id, logical_id FROM assets) a ON a.id = e.src GROUP BY 1")
def join25_lang_users(spark, d):
    e, k, a = _t(spark, d, "edges", "lang_keys", "assets")
    e = e.where("dst_kind = 'lang_key'").select("src", F.col("dst").alias("id")).distinct()
    e = e.join(k.select("id", "key"), "id").join(a.select(F.col("id").alias("src"), "logical_id").distinct(), "src")
    return e.groupBy("key").agg(F.countDistinct("src").alias("n_users"), F.min("logical_id").alias("first_user"))


@query("SELECT f.path, a.logical_id, a.type, e.json_pointer FROM (SELECT DISTINCT src, dst, json_pointer FROM edges WHERE dst_kind = 'file') e JOIN (SELECT DISTINCT id, path FROM files) f ON f.id = e.dst JOIN (SELECT DISTINCT id, logical_id, type FROM assets) a ON a.id = e.src")
def join26_file_users(spark, d):
    e, f, a = _t(spark, d, "edges", "files", "assets")
    e = e.where("dst_kind = 'file'").select("src", "dst", "json_pointer").distinct()
    e = e.join(f.select(F.col("id").alias("dst"), "path").distinct(), "dst").join(a.select(F.col("id").alias("src"), "logical_id", "type").distinct(), "src")
    return e.select("path", "logical_id", "type", "json_pointer")


@query("SELECT c.schema_scope asset_type, c.schema_pointer json_pointer, count(DISTINCT (a.logical_id, coalesce(a.type, ''))) n_assets, min(a.path) example FROM candidates c JOIN assets a ON a.id = c.asset_id WHERE c.schema_scope IS NOT NULL GROUP BY ALL")
def join27_declarers(spark, d):
    """How many definitions, told apart by name and type, carry a field; an example."""
    c, a = _t(spark, d, "candidates", "assets")
    j = c.where("schema_scope is not null").select("schema_scope", "schema_pointer", "asset_id").distinct().join(a.select(F.col("id").alias("asset_id"), "logical_id", "type", "path").distinct(), "asset_id")
    return j.groupBy(F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("json_pointer")).agg(F.countDistinct(F.struct("logical_id", F.coalesce("type", F.lit("")))).alias("n_assets"), F.min("path").alias("example"))


@query("SELECT c.schema_scope asset_type, c.schema_pointer json_pointer, c.raw_value, bool_or(p.kind = 'vanilla') in_vanilla, min(CASE WHEN p.kind <> 'vanilla' THEN p.name END) pack FROM candidates c JOIN assets a ON a.id = c.asset_id JOIN packs p ON p.id = a.pack_id WHERE c.schema_scope IS NOT NULL AND c.value_kind = 'string' GROUP BY ALL HAVING NOT bool_or(p.kind = 'vanilla')")
def agg09_third_party(spark, d):
    """Values that no vanilla pack uses, with a pack that does."""
    c, a, p = _t(spark, d, "candidates", "assets", "packs")
    j = c.where("schema_scope is not null and value_kind = 'string'").select("schema_scope", "schema_pointer", "raw_value", "asset_id").distinct()
    j = j.join(a.select(F.col("id").alias("asset_id"), "pack_id").distinct(), "asset_id").join(p.select(F.col("id").alias("pack_id"), "kind", "name"), "pack_id")
    out = j.groupBy(F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("json_pointer"), "raw_value")
    return out.agg(F.bool_or(F.col("kind") == "vanilla").alias("in_vanilla"), F.min(F.when(F.col("kind") != "vanilla", F.col("name"))).alias("pack")).where("not in_vanilla")


@query("SELECT DISTINCT c.asset_id, c.json_pointer, c.raw_value FROM candidates c WHERE c.value_kind = 'string' AND EXISTS (SELECT 1 FROM assets a WHERE a.logical_id = c.raw_value) AND NOT EXISTS (SELECT 1 FROM edges e JOIN assets a ON a.id = e.dst WHERE e.dst_kind = 'asset' AND e.src = c.asset_id AND a.logical_id = c.raw_value)")
def join29_value_no_edge(spark, d):
    """Values that are some asset's name, in assets without an edge to one of that name."""
    c, a, e = _t(spark, d, "candidates", "assets", "edges")
    names = a.select(F.col("logical_id").alias("raw_value")).distinct()
    linked = e.where("dst_kind = 'asset'").select(F.col("src").alias("asset_id"), "dst").distinct().join(a.select(F.col("id").alias("dst"), F.col("logical_id").alias("raw_value")).distinct(), "dst")
    rows = c.where("value_kind = 'string'").select("asset_id", "json_pointer", "raw_value").distinct()
    return rows.join(names, "raw_value", "left_semi").join(linked, ["asset_id", "raw_value"], "left_anti").select("asset_id", "json_pointer", "raw_value")


@query("SELECT DISTINCT c.asset_id, p.id parent_id FROM candidates c JOIN assets s ON s.id = c.asset_id JOIN assets p ON p.logical_id = c.raw_value AND p.type IS NOT DISTINCT FROM s.type WHERE c.json_pointer = '/Parent'")
def join30_parent_map(spark, d):
    c, a = _t(spark, d, "candidates", "assets")
    s = a.select(F.col("id").alias("asset_id"), F.coalesce("type", F.lit("\0")).alias("kind")).distinct()
    p = a.select(F.col("id").alias("parent_id"), F.col("logical_id").alias("raw_value"), F.coalesce("type", F.lit("\0")).alias("kind")).distinct()
    return c.where("json_pointer = '/Parent'").select("asset_id", "raw_value").distinct().join(s, "asset_id").join(p, ["raw_value", "kind"]).select("asset_id", "parent_id").distinct()


@query("WITH d AS (SELECT DISTINCT id, path, type FROM assets), x AS (SELECT id, type, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') dir, n FROM d, range(1, 12) r(n) WHERE n < len(string_split(path, '/'))), m AS (SELECT dir, n, max_by(type, (c, type)) type FROM (SELECT dir, n, type, count(*) c FROM x WHERE type IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT x.id, max_by(m.type, m.n) inferred FROM x JOIN m USING (dir, n) GROUP BY x.id")
def join33_type_inference(spark, d):
    """Each asset's type as the majority of its deepest directory has it."""
    (a,) = _t(spark, d, "assets")
    a = a.select("id", "path", "type").distinct()
    return drafts.infer_types(a.select("id", "path"), a)


@query("WITH k AS (SELECT locale, key, max_by(value, (pack_id, id)) value FROM lang_keys GROUP BY ALL) SELECT key, count(*) n_locales, max(CASE WHEN locale = 'en-US' THEN value END) english, string_agg(locale, ',' ORDER BY locale) locales FROM k GROUP BY 1")
def join37_cross_locale(spark, d):
    k = win06_last_wins(spark, d)
    return k.groupBy("key").agg(F.count("*").alias("n_locales"), F.max(F.when(F.col("locale") == "en-US", F.col("value"))).alias("english"), F.array_join(F.array_sort(F.collect_list("locale")), ",").alias("locales"))


# --- profiles ------------------------------------------------------------------------------------
_ROWS = "r AS (SELECT DISTINCT id, asset_id, schema_scope asset_type, schema_pointer json_pointer, raw_value, value_kind FROM candidates WHERE schema_scope IS NOT NULL)"
_STATS = f"{_ROWS}, st AS (SELECT asset_type, json_pointer, count(*) n, count(DISTINCT asset_id) n_assets, count(DISTINCT raw_value) cardinality, list_sort(list(DISTINCT value_kind)) value_types, list_sort(list(DISTINCT raw_value)) vals FROM r GROUP BY ALL)"


@query(f"WITH {_STATS} SELECT asset_type, json_pointer, n, n_assets, cardinality FROM st")
def agg01_field_stats(spark, d):
    return profile.field_stats(*_t(spark, d, "candidates")).select("asset_type", "json_pointer", "n", "n_assets", "cardinality")


@query(f"WITH {_STATS} SELECT asset_type, json_pointer, array_to_string(value_types, ',') value_types FROM st")
def agg02_value_types(spark, d):
    return profile.field_stats(*_t(spark, d, "candidates")).select("asset_type", "json_pointer", F.array_join("value_types", ",").alias("value_types"))


@query(f"WITH {_STATS} SELECT asset_type, json_pointer, CASE WHEN cardinality <= 40 THEN array_to_string(vals, '|') END observed_values FROM st")
def agg03_observed_values(spark, d):
    return profile.field_stats(*_t(spark, d, "candidates")).select("asset_type", "json_pointer", F.array_join("observed_values", "|").alias("observed_values"))


@query(f"WITH {_C}, b AS (SELECT DISTINCT c.asset_id, c.json_pointer, c.raw_value, c.schema_scope, c.schema_pointer FROM c JOIN sf ON sf.asset_type = c.schema_scope AND sf.json_pointer = c.schema_pointer WHERE NOT EXISTS (SELECT 1 FROM a t WHERE t.logical_id = c.raw_value AND t.type = sf.reference_target)), g AS (SELECT schema_scope asset_type, schema_pointer field, raw_value, count(*) n FROM b GROUP BY ALL) SELECT asset_type, field, raw_value, n, total, distinct_values FROM (SELECT *, row_number() OVER (PARTITION BY asset_type, field ORDER BY n DESC, raw_value) k, sum(n) OVER (PARTITION BY asset_type, field)::BIGINT total, count(*) OVER (PARTITION BY asset_type, field) distinct_values FROM g) WHERE k <= 8")
def agg05_broken_refs(spark, d):
    """The eight commonest values that break each field's declared references (a top-k report)."""
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    broken = graph.broken_references(c, a, s, aligned=True).select("asset_id", "json_pointer", "raw_value")
    leaf = c.select("asset_id", "json_pointer", "raw_value", F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("field")).distinct()
    declared = s.where("reference_target is not null").select("asset_type", F.col("json_pointer").alias("field"), "reference_target").distinct()
    there = a.select(F.col("logical_id").alias("raw_value"), F.col("type").alias("reference_target")).distinct()
    hits = leaf.join(broken, ["asset_id", "json_pointer", "raw_value"], "left_semi").join(declared, ["asset_type", "field"]).join(there, ["raw_value", "reference_target"], "left_anti")
    g = hits.groupBy("asset_type", "field", "raw_value").agg(F.countDistinct("asset_id", "json_pointer").alias("n"))
    totals = g.groupBy("asset_type", "field").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))
    # the rank stands alone, so that each task keeps only eight rows of a field before the shuffle
    first = g.withColumn("k", F.row_number().over(Window.partitionBy("asset_type", "field").orderBy(F.desc("n"), "raw_value"))).where("k <= 8")
    return first.join(totals, ["asset_type", "field"]).select("asset_type", "field", "raw_value", "n", "total", "distinct_values")


@query("WITH f AS (SELECT asset_type type, count(*) n_fields FROM schema_fields WHERE json_pointer <> '' GROUP BY 1) SELECT a.type, count(DISTINCT a.logical_id) n_assets, min(a.path) first_path, max(a.path) last_path, coalesce(any_value(f.n_fields), 0) n_fields FROM assets a LEFT JOIN f ON f.type = a.type WHERE a.type IS NOT NULL GROUP BY a.type")
def agg07_types(spark, d):
    a, s = _t(spark, d, "assets", "schema_fields")
    n = s.where("json_pointer != ''").groupBy(F.col("asset_type").alias("type")).agg(F.count("*").alias("n_fields"))
    t = a.where("type is not null").groupBy("type").agg(F.countDistinct("logical_id").alias("n_assets"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    return t.join(n, "type", "left").fillna(0, ["n_fields"])


@query("SELECT (SELECT count(DISTINCT id) FROM assets) assets, (SELECT count(DISTINCT id) FROM assets WHERE type IS NOT NULL) typed, (SELECT count(*) FROM schema_fields WHERE json_pointer <> '') declared, (SELECT count(*) FROM field_stats) observed, (SELECT count(*) FROM schema_fields s JOIN field_stats f USING (asset_type, json_pointer)) joined, (SELECT count(DISTINCT id) FROM edges) edges, (SELECT count(DISTINCT locale) FROM lang_keys) locales, (SELECT max(last_changed_epoch) FROM assets) epoch")
def agg08_status(spark, d):
    a, s, f, e, k = _t(spark, d, "assets", "schema_fields", "field_stats", "edges", "lang_keys")
    parts = [
        a.agg(F.countDistinct("id").alias("assets"), F.countDistinct(F.when(F.col("type").isNotNull(), F.col("id"))).alias("typed"), F.max("last_changed_epoch").alias("epoch")),
        s.where("json_pointer != ''").agg(F.count("*").alias("declared")),
        f.agg(F.count("*").alias("observed")),
        s.join(f, ["asset_type", "json_pointer"]).agg(F.count("*").alias("joined")),
        e.agg(F.countDistinct("id").alias("edges")),
        k.agg(F.countDistinct("locale").alias("locales")),
    ]
    named = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in p.columns])).alias("x")).select("x.*") for p in parts]
    wanted = ["assets", "typed", "declared", "observed", "joined", "edges", "locales", "epoch"]
    return reduce(DataFrame.unionByName, named).groupBy().pivot("what", wanted).agg(F.first("n"))


@query("SELECT logical_id token, count(DISTINCT id) n_assets, string_agg(DISTINCT type, ',' ORDER BY type) types, coalesce(any_value(v.n), 0) n_values, coalesce(any_value(e.n), 0) n_edges FROM assets LEFT JOIN (SELECT raw_value, count(DISTINCT id) n FROM candidates GROUP BY 1) v ON v.raw_value = logical_id LEFT JOIN (SELECT a.logical_id t, count(DISTINCT e.id) n FROM edges e JOIN assets a ON a.id = e.dst WHERE e.dst_kind = 'asset' GROUP BY 1) e ON e.t = logical_id GROUP BY logical_id")
def agg21_identify(spark, d):
    """What each name is: its definitions and types, and how often it is a value or a target."""
    a, c, e = _t(spark, d, "assets", "candidates", "edges")
    names = a.groupBy(F.col("logical_id").alias("token")).agg(F.countDistinct("id").alias("n_assets"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types")).withColumn("types", F.nullif("types", F.lit("")))
    values = c.groupBy(F.col("raw_value").alias("token")).agg(F.countDistinct("id").alias("n_values"))
    targets = e.where("dst_kind = 'asset'").select("id", "dst").distinct().join(a.select(F.col("id").alias("dst"), F.col("logical_id").alias("token")).distinct(), "dst").groupBy("token").agg(F.countDistinct("id").alias("n_edges"))
    return names.join(values, "token", "left").join(targets, "token", "left").fillna(0, ["n_values", "n_edges"])


@query(f"WITH {_E} SELECT c.schema_scope asset_type, c.schema_pointer json_pointer, string_agg(DISTINCT t.type, ',' ORDER BY t.type) target_types FROM leaf c JOIN sf ON sf.asset_type = c.schema_scope AND sf.json_pointer = c.schema_pointer JOIN e ON e.src = c.asset_id AND e.json_pointer = c.json_pointer AND e.dst_kind = 'asset' JOIN a t ON t.id = e.dst WHERE t.type IS NOT NULL GROUP BY ALL")
def join13_target_types(spark, d):
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    return profile.target_types(c, _edges(spark, d), a, s).withColumn("target_types", F.array_join("target_types", ","))


@query("SELECT coalesce(s.asset_type, f.asset_type) asset_type, coalesce(s.json_pointer, f.json_pointer) json_pointer, s.declared_type, s.optional, s.reference_target, f.count n, f.cardinality, s.json_pointer IS NOT NULL declared, f.json_pointer IS NOT NULL observed FROM (SELECT * FROM schema_fields WHERE json_pointer <> '') s FULL JOIN field_stats f ON f.asset_type = s.asset_type AND f.json_pointer = s.json_pointer")
def join14_describe(spark, d):
    return profile.describe(*_t(spark, d, "schema_fields", "field_stats")).select("asset_type", "json_pointer", "declared_type", "optional", "reference_target", "n", "cardinality", "declared", "observed")


@query("SELECT asset_type, json_pointer, declared_type FROM schema_fields s WHERE json_pointer <> '' AND coalesce(NOT (declared_type LIKE '%object%' OR declared_type LIKE '%array%' OR declared_type LIKE '$ref%' OR declared_type IN ('anyOf', 'oneOf')), true) AND NOT EXISTS (SELECT 1 FROM field_stats f WHERE f.asset_type = s.asset_type AND f.json_pointer = s.json_pointer)")
def join15_undocumented(spark, d):
    return profile.undocumented(*_t(spark, d, "schema_fields", "field_stats"))


@query("SELECT asset_type, json_pointer, count n FROM field_stats f WHERE NOT EXISTS (SELECT 1 FROM schema_fields s WHERE f.asset_type = s.asset_type AND f.json_pointer = s.json_pointer)")
def join16_undeclared(spark, d):
    return profile.undeclared(*_t(spark, d, "schema_fields", "field_stats"))


@query("SELECT asset_type, json_pointer FROM schema_fields WHERE json_pointer <> '' UNION SELECT asset_type, json_pointer FROM field_stats")
def set01_union(spark, d):
    s, f = _t(spark, d, "schema_fields", "field_stats")
    return s.where("json_pointer != ''").select("asset_type", "json_pointer").union(f.select("asset_type", "json_pointer")).distinct()


# --- projections ---------------------------------------------------------------------------------
@query(r"SELECT id, regexp_replace(path, '^.*/', '') base, CASE lower(regexp_extract(path, '\.([^./]*)$', 1)) WHEN 'png' THEN 'texture' WHEN 'jpg' THEN 'texture' WHEN 'jpeg' THEN 'texture' WHEN 'tga' THEN 'texture' WHEN 'blockymodel' THEN 'model' WHEN 'bbmodel' THEN 'model' WHEN 'ogg' THEN 'audio' WHEN 'wav' THEN 'audio' WHEN 'mp3' THEN 'audio' WHEN 'ui' THEN 'ui' ELSE 'other' END kind FROM files")
def prj02_file_kind(spark, d):
    (f,) = _t(spark, d, "files")
    return f.select("id", F.element_at(F.split("path", "/"), -1).alias("base"), T.file_kind(F.col("path")).alias("kind"))


@query(r"SELECT id, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') name, logical_id FROM assets")
def prj01_asset_id(spark, d):
    (a,) = _t(spark, d, "assets")
    return a.select("id", T.asset_id_from_path(F.col("path")).alias("name"), "logical_id")


@query(f"SELECT id, length(trim(raw_value)) BETWEEN 1 AND CASE WHEN raw_value LIKE '%/%' AND raw_value LIKE '%.%' AND raw_value NOT LIKE '% %' THEN 192 ELSE 96 END leaf, NOT {_NOISE} noise, regexp_matches(raw_value, '(?s)^[A-Za-z].*[_A-Za-z0-9]') AND raw_value NOT LIKE '% %' identifier, {_CONVENTION} convention, " + r"regexp_matches(raw_value, '^(server|common)\.[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)+$') translation FROM candidates")
def prj10_predicates(spark, d):
    """The leaf, noise, identifier, convention and translation predicates of each leaf."""
    (c,) = _t(spark, d, "candidates")
    v = F.col("raw_value")
    return c.select("id", T.is_leaf_value(v).alias("leaf"), T.is_noise(v).alias("noise"), T.is_identifier(v).alias("identifier"), T.follows_convention(F.col("json_pointer")).alias("convention"), T.is_translation(v).alias("translation"))


@query(r"SELECT id, regexp_replace(regexp_replace(json_pointer, '/\d+(/|$)', '/*\1', 'g'), '/\d+(/|$)', '/*\1', 'g') pointer FROM candidates")
def nst02_schema_pointer(spark, d):
    (c,) = _t(spark, d, "candidates")
    return c.select("id", schema_pointer(F.col("json_pointer")).alias("pointer"))


@query("SELECT asset_type, json_pointer, coalesce(declared_type LIKE '%object%' OR declared_type LIKE '%array%' OR declared_type LIKE '$ref%' OR declared_type IN ('anyOf', 'oneOf'), false) container FROM schema_fields")
def prj14_container(spark, d):
    (s,) = _t(spark, d, "schema_fields")
    return s.select("asset_type", "json_pointer", T.is_container(F.col("declared_type")).alias("container"))


@query(r"SELECT id, regexp_replace(key, '^(server|common)\.', '') bare, nullif(regexp_extract(source_path, '/Languages/([A-Za-z]{2}(?:-[A-Za-z0-9]+)?)/', 1), '') from_path FROM lang_keys")
def prj16_translation_key(spark, d):
    (k,) = _t(spark, d, "lang_keys")
    return k.select("id", T.translation_key(F.col("key")).alias("bare"), T.locale_from_path(F.col("source_path")).alias("from_path"))


@query("SELECT id, regexp_matches(logical_id, '^(Prototype|Debug|Template|Filter|Test)_') scaffolding, CASE WHEN instr(logical_id, '_') > 1 THEN split_part(logical_id, '_', 1) ELSE logical_id END family FROM assets")
def prj18_family(spark, d):
    (a,) = _t(spark, d, "assets")
    return a.select("id", T.is_scaffolding(F.col("logical_id")).alias("scaffolding"), T.family(F.col("logical_id")).alias("family"))


@query("WITH x AS (SELECT DISTINCT a.logical_id, a.pack_id, c.schema_pointer p, c.raw_value v FROM assets a JOIN candidates c ON c.asset_id = a.id WHERE a.type IS NOT NULL), k AS (SELECT logical_id, min(pack_id) lo, max(pack_id) hi FROM x GROUP BY 1 HAVING count(DISTINCT pack_id) > 1), l AS (SELECT k.logical_id, p, list_sort(list(v)) v FROM k JOIN x ON x.logical_id = k.logical_id AND pack_id = lo GROUP BY ALL), h AS (SELECT k.logical_id, p, list_sort(list(v)) v FROM k JOIN x ON x.logical_id = k.logical_id AND pack_id = hi GROUP BY ALL) SELECT coalesce(l.logical_id, h.logical_id) logical_id, coalesce(l.p, h.p) json_pointer, CASE WHEN h.p IS NULL THEN '-' WHEN l.p IS NULL THEN '+' ELSE '~' END mark FROM l FULL JOIN h ON l.logical_id = h.logical_id AND l.p = h.p WHERE h.p IS NULL OR l.p IS NULL OR l.v <> h.v")
def set05_pack_diff(spark, d):
    """Fields that the last pack's definition of a name lacks (-), adds (+) or changes (~) against the first one's."""
    a, c = _t(spark, d, "assets", "candidates")
    x = a.where("type is not null").select(F.col("id").alias("asset_id"), "logical_id", "pack_id").distinct().join(c.select("asset_id", F.col("schema_pointer").alias("json_pointer"), "raw_value").distinct(), "asset_id").drop("asset_id").distinct()
    k = x.groupBy("logical_id").agg(F.min("pack_id").alias("lo"), F.max("pack_id").alias("hi")).where("lo != hi")
    side = lambda p, name: x.join(k.select("logical_id", F.col(p).alias("pack_id")), ["logical_id", "pack_id"]).groupBy("logical_id", "json_pointer").agg(F.array_sort(F.collect_set("raw_value")).alias(name))
    mark = F.when(F.col("h").isNull(), "-").when(F.col("l").isNull(), "+").when(F.col("l") != F.col("h"), "~")
    return side("lo", "l").join(side("hi", "h"), ["logical_id", "json_pointer"], "full_outer").select("logical_id", "json_pointer", mark.alias("mark")).where("mark is not null")
