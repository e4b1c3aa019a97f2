"""Further queries of the index: rules, counters, orders and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import graph, search
from lattica.plans import build
from lattica.queries.answers import join32_value_links
from lattica.queries.index import _C, _t
from lattica.session import small_side

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


_RULES = [("Server/Item/", "", "Item"), ("Server/Item/Items/Glass/", "", "GlassItem"), ("Server/", "", "Other"), ("Server/", "Raft.json", "Raft"), ("Server/Drops/", "", "DropTable")]


@query("SELECT id, path, CASE WHEN path LIKE 'Server/%' AND path LIKE '%Raft.json' THEN 'Raft' WHEN path LIKE 'Server/Item/Items/Glass/%' THEN 'GlassItem' WHEN path LIKE 'Server/Drops/%' THEN 'DropTable' WHEN path LIKE 'Server/Item/%' THEN 'Item' WHEN path LIKE 'Server/%' THEN 'Other' END resolved FROM assets")
def prj07_type_resolver(spark, d):
    """Types by rules of prefix and suffix: rules with a suffix first, then the longest prefix."""
    (a,) = _t(spark, d, "assets")
    return build.typed(a.select("id", "path"), _RULES).withColumnRenamed("type", "resolved")


@query("SELECT id, coalesce(type, CASE WHEN path LIKE 'Server/Loose/%' THEN 'Loose' END) type FROM assets")
def prj08_apply_types(spark, d):
    """Missing types filled in by a rule."""
    (a,) = _t(spark, d, "assets")
    typed = build.typed(a.select("id", "path", F.col("type").alias("known")), [("Server/Loose/", "", "Loose")])
    return typed.select("id", F.coalesce("known", "type").alias("type"))


@query("SELECT id, path LIKE 'Server/%' AND path LIKE '%.json' asset, path LIKE 'Server/%' AND path NOT LIKE 'Server/Loose/%' leaves FROM assets")
def prj09_roots(spark, d):
    """Which paths are assets, and which of them lie where leaves are wanted."""
    (a,) = _t(spark, d, "assets")
    p = F.col("path")
    return a.select("id", (p.startswith("Server/") & p.endswith(".json")).alias("asset"), (p.startswith("Server/") & ~p.startswith("Server/Loose/")).alias("leaves"))


@query("SELECT DISTINCT key, length(key) n, CASE WHEN length(key) >= 5 THEN substr(key, 1, greatest(4, length(key) - 2)) ELSE key END stem FROM lang_keys")
def txt03_relax(spark, d):
    (k,) = _t(spark, d, "lang_keys")
    return k.select("key", F.length("key").cast("long").alias("n"), T.relax(F.col("key"), 2).alias("stem")).distinct()


@query("WITH s AS (SELECT asset_type, json_pointer FROM schema_fields WHERE json_pointer <> ''), c AS (SELECT DISTINCT schema_scope, schema_pointer FROM candidates WHERE schema_scope IS NOT NULL) SELECT c.schema_scope, c.schema_pointer, coalesce(e.json_pointer, w.json_pointer) rule FROM c LEFT JOIN s e ON e.asset_type = c.schema_scope AND e.json_pointer = c.schema_pointer LEFT JOIN s w ON w.asset_type = c.schema_scope AND w.json_pointer = regexp_replace(c.schema_pointer, '/[^/]*$', '') || '/*'")
def nst14_rule_at(spark, d):
    """The declared field of each observed pointer: itself, else its parent's wildcard."""
    c, s = _t(spark, d, "candidates", "schema_fields")
    f = s.where("json_pointer != ''").select(F.col("asset_type").alias("schema_scope"), F.col("json_pointer").alias("rule"))
    c = c.where("schema_scope is not null").select("schema_scope", "schema_pointer").distinct().withColumn("wild", F.concat(T.parent_pointer(F.col("schema_pointer")), F.lit("/*")))
    exact, wild = f.withColumnRenamed("rule", "schema_pointer").withColumn("e", F.col("schema_pointer")), f.withColumnRenamed("rule", "wild").withColumn("w", F.col("wild"))
    return c.join(exact, ["schema_scope", "schema_pointer"], "left").join(wild, ["schema_scope", "wild"], "left").select("schema_scope", "schema_pointer", F.coalesce("e", "w").alias("rule"))


@query("WITH c AS (SELECT DISTINCT asset_id, json_pointer, raw_value, schema_scope s, schema_pointer p FROM candidates WHERE value_kind = 'string'), dec AS (SELECT DISTINCT raw_value FROM c WHERE s = 'common:DropContainer' AND p = '/Entries/*/Item/ItemId') SELECT raw_value v, count(*) n, count(DISTINCT asset_id) n_assets FROM c WHERE s = 'CraftPlan' AND p IN ('/Input/*/ItemId', '/Input/*/Alternatives/*/ItemId') AND raw_value NOT IN (SELECT raw_value FROM dec) GROUP BY 1")
def op13_unresolved_values(spark, d):
    """Values referred to that nothing declares, with who uses them."""
    w = join32_value_links(spark, d).where("role = 'referenced' and not resolved")
    return w.groupBy(F.col("value").alias("v")).agg(F.count("*").alias("n"), F.countDistinct("asset_id").alias("n_assets"))


@query("SELECT asset_type, json_pointer FROM schema_fields WHERE json_pointer LIKE '/Input%' ORDER BY length(json_pointer), json_pointer, asset_type LIMIT 5")
def join35_pointers_like(spark, d):
    """The five nearest declared pointers below a prefix (a top-k report)."""
    (s,) = _t(spark, d, "schema_fields")
    return s.where(F.col("json_pointer").startswith("/Input")).orderBy(F.length("json_pointer"), "json_pointer", "asset_type").limit(5).select("asset_type", "json_pointer")


@query("SELECT c.schema_pointer json_pointer, string_agg(DISTINCT c.schema_scope, ', ' ORDER BY c.schema_scope) scopes, count(DISTINCT c.schema_scope) n FROM candidates c WHERE c.schema_scope IS NOT NULL GROUP BY 1")
def agg11_scopes(spark, d):
    """Which scopes know a pointer, in one text."""
    (c,) = _t(spark, d, "candidates")
    pairs = c.where("schema_scope is not null").select("schema_scope", F.col("schema_pointer").alias("json_pointer")).distinct()
    return pairs.groupBy("json_pointer").agg(F.array_join(F.array_sort(F.collect_list("schema_scope")), ", ").alias("scopes"), F.count("*").alias("n"))


@query("SELECT logical_id, type, count(DISTINCT id) n FROM assets WHERE type IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1")
def win01_several_definitions(spark, d):
    """Identities with several definitions."""
    (a,) = _t(spark, d, "assets")
    return a.where("type is not null").groupBy("logical_id", "type").agg(F.countDistinct("id").alias("n")).where("n > 1")


@query("""WITH e AS (SELECT DISTINCT src, dst, json_pointer FROM edges WHERE dst_kind = 'lang_key'),
n AS (SELECT DISTINCT e.src, e.json_pointer, k.key, coalesce(k.root, '') root FROM e JOIN lang_keys k ON k.id = e.dst),
x AS (SELECT DISTINCT key, coalesce(root, '') root, locale, value FROM lang_keys),
j AS (SELECT n.src, x.locale, n.json_pointer, x.value, regexp_replace(lower(n.json_pointer), '^.*/', '') LIKE '%desc%' de FROM n JOIN x USING (key, root)),
g AS (SELECT src, locale, coalesce(string_agg(CASE WHEN NOT de THEN value END, ' ' ORDER BY json_pointer, value), '') display_name, coalesce(string_agg(CASE WHEN de THEN value END, ' ' ORDER BY json_pointer, value), '') description FROM j GROUP BY ALL)
SELECT g.src asset_id, a.logical_id, a.type, g.locale, g.display_name, g.description FROM g JOIN (SELECT DISTINCT id, logical_id, type FROM assets) a ON a.id = g.src""")
def agg18_search_docs(spark, d):
    """Each asset's name and description in each locale."""
    return search.search_docs(*_t(spark, d, "assets", "edges", "lang_keys")).where("locale != ''")


@query("SELECT count(*) observed, count(*) FILTER (s.json_pointer IS NOT NULL) joined FROM field_stats f LEFT JOIN schema_fields s ON s.asset_type = f.asset_type AND s.json_pointer = f.json_pointer")
def agg22_join_ratio(spark, d):
    """How many observed fields are declared."""
    f, s = _t(spark, d, "field_stats", "schema_fields")
    j = f.select("asset_type", "json_pointer").join(s.select("asset_type", "json_pointer", F.lit(1).alias("x")), ["asset_type", "json_pointer"], "left")
    return j.agg(F.count("*").alias("observed"), F.count("x").alias("joined"))


@query("SELECT logical_id, type, level FROM (SELECT logical_id, type, level, row_number() OVER (PARTITION BY logical_id, type ORDER BY level) n FROM (SELECT logical_id, type, 0 AS \"level\" FROM assets WHERE type IS NOT NULL AND logical_id ILIKE '%lantern%' UNION ALL SELECT logical_id, type, 1 FROM assets WHERE type IS NOT NULL AND logical_id ILIKE '%lant%')) WHERE n = 1")
def win02_strictest(spark, d):
    """The strictest of two levels at which an identity is found."""
    (a,) = _t(spark, d, "assets")
    a = a.where("type is not null").select("logical_id", "type")
    hits = a.where(F.col("logical_id").ilike("%lantern%")).withColumn("level", F.lit(0)).unionByName(a.where(F.col("logical_id").ilike("%lant%")).withColumn("level", F.lit(1)))
    return hits.groupBy("logical_id", "type").agg(F.min("level").alias("level"))


@query("SELECT DISTINCT logical_id FROM assets WHERE logical_id NOT IN (SELECT a.logical_id FROM assets a JOIN edges e ON e.src = a.id WHERE e.dst_kind = 'lang_key')")
def set06_without_text(spark, d):
    """Names that no text can find: none of their assets has a language key."""
    a, e = _t(spark, d, "assets", "edges")
    named = a.join(e.where("dst_kind = 'lang_key'").select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("logical_id").distinct()
    return a.select("logical_id").distinct().join(named, "logical_id", "left_anti")


@query("SELECT kind, confidence, count(*) n, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS \"place\" FROM (SELECT DISTINCT * FROM edges) GROUP BY ALL")
def ord03_confidence(spark, d):
    (e,) = _t(spark, d, "edges")
    place = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return e.distinct().groupBy("kind", "confidence").agg(F.count("*").alias("n")).withColumn("place", place)


@query("WITH p AS (SELECT a.id, a.logical_id, a.type, p.kind = 'vanilla' vanilla FROM (SELECT DISTINCT id, pack_id, logical_id, type FROM assets) a JOIN packs p ON p.id = a.pack_id) SELECT logical_id, count(DISTINCT type) n_types, bool_or(vanilla) in_vanilla, bool_or(NOT vanilla) third_party FROM p GROUP BY 1")
def agg07_owners(spark, d):
    """What the third-party and ambiguity caveats are computed from."""
    a, p = _t(spark, d, "assets", "packs")
    j = a.select("id", "pack_id", "logical_id", "type").distinct().join(small_side(p.select(F.col("id").alias("pack_id"), (F.col("kind") == "vanilla").alias("vanilla"))), "pack_id")
    return j.groupBy("logical_id").agg(F.countDistinct("type").alias("n_types"), F.bool_or("vanilla").alias("in_vanilla"), F.bool_or(~F.col("vanilla")).alias("third_party"))


@query("WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE dst_kind = 'asset'), a AS (SELECT DISTINCT id, logical_id FROM assets), d AS (SELECT a.logical_id, count(DISTINCT e.src) n FROM e JOIN a ON a.id = e.dst GROUP BY 1) SELECT a.logical_id, coalesce(any_value(d.n), 0) n_inbound FROM a LEFT JOIN d USING (logical_id) GROUP BY 1")
def agg15_inbound_counts(spark, d):
    """How many assets refer to each name."""
    e, a = _t(spark, d, "edges", "assets")
    a = a.select("id", "logical_id").distinct()
    n = e.where("dst_kind = 'asset'").select("src", F.col("dst").alias("id")).distinct().join(a, "id").groupBy("logical_id").agg(F.countDistinct("src").alias("n_inbound"))
    return a.select("logical_id").distinct().join(n, "logical_id", "left").fillna(0, ["n_inbound"])


@query(f"WITH {_C}, u AS (SELECT DISTINCT c.asset_id, c.json_pointer, c.raw_value FROM c JOIN a ON a.logical_id = c.raw_value AND a.is_effective) SELECT raw_value token, count(*) n_sites, count(DISTINCT asset_id) n_assets FROM u GROUP BY 1")
def agg06_value_sites(spark, d):
    """Where effective names occur as values."""
    c, a = _t(spark, d, "candidates", "assets")
    names = a.where("is_effective").select(F.col("logical_id").alias("raw_value")).distinct()
    rows = c.where((F.col("value_kind") == "string") & ~T.is_noise(F.col("raw_value"))).select("asset_id", "json_pointer", "raw_value").distinct().join(names, "raw_value", "left_semi")
    return rows.groupBy(F.col("raw_value").alias("token")).agg(F.count("*").alias("n_sites"), F.countDistinct("asset_id").alias("n_assets"))


@query("WITH x AS (SELECT DISTINCT a.id, a.pack_id, a.logical_id, a.type, p.priority FROM assets a JOIN packs p ON p.id = a.pack_id), w AS (SELECT *, rank() OVER (PARTITION BY logical_id, type ORDER BY priority, pack_id DESC) r, count(*) OVER (PARTITION BY logical_id, type) n FROM x) SELECT logical_id, type, min(id) FILTER (r = 1) winner, count(*) FILTER (r = 1) n_winners, count(*) n FROM w WHERE n > 1 GROUP BY ALL")
def win01_contested(spark, d):
    """Identities with several definitions, and which of them is effective."""
    a, p = _t(spark, d, "assets", "packs")
    e = graph.effective(a, p).join(a.select("id", "logical_id", "type").distinct(), "id")
    win = F.col("effective")
    return e.groupBy("logical_id", "type").agg(F.min(F.when(win, F.col("id"))).alias("winner"), F.count(F.when(win, 1)).alias("n_winners"), F.count("*").alias("n")).where("n > 1")
