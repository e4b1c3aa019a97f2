"""Queries of the index's answers, each with its caveats in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import links, search
from lattica.plans import answers
from lattica.queries.answers import join32_value_links
from lattica.queries.index import _C, _CONTRA, _t
from lattica.queries.stations import _SQL as _STATIONS
from lattica.queries.stations import _leaves

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


def _index(spark: SparkSession, d: str) -> answers.Index:
    return answers.Index(spark, d)


@query("SELECT 'packs' what, count(*) n, 'join-incomplete' caveats FROM packs" + "".join(f" UNION ALL SELECT '{t}', count(*), 'join-incomplete' FROM {t}" for t in answers.TABLES[1:]) + " UNION ALL SELECT 'typed', count(DISTINCT id), 'join-incomplete' FROM assets WHERE type IS NOT NULL UNION ALL SELECT 'declared', count(*), 'join-incomplete' FROM schema_fields WHERE json_pointer <> '' UNION ALL SELECT 'joined', count(*), 'join-incomplete' FROM (SELECT asset_type, json_pointer FROM schema_fields WHERE json_pointer <> '') s JOIN field_stats USING (asset_type, json_pointer) UNION ALL SELECT 'locales', count(DISTINCT locale), 'join-incomplete' FROM lang_keys")
def op01_status(spark, d):
    return _index(spark, d).status().table()


_PREFIX = "coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i] OR i >= least(len(a), len(b)))), 1) - 1"


@query(f"WITH f AS (SELECT asset_type type, count(*) n FROM schema_fields WHERE json_pointer <> '' GROUP BY 1), t AS (SELECT type, count(DISTINCT logical_id) n, string_split(min(path), '/') a, string_split(max(path), '/') b FROM assets WHERE type IS NOT NULL GROUP BY 1), k AS (SELECT *, {_PREFIX} s FROM t) SELECT k.type, k.n, coalesce(f.n, 0) n_fields, CASE WHEN s > 0 THEN array_to_string(list_slice(a, 1, s), '/') || '/' ELSE '' END folder, '' caveats FROM k LEFT JOIN f USING (type)")
def op02_types(spark, d):
    return _index(spark, d).types().table()


@query("WITH x AS (SELECT logical_id, min(path) path FROM assets WHERE type = 'Item' GROUP BY 1) SELECT logical_id, path, CASE WHEN (SELECT count(*) FROM x) > 200 THEN 'truncated' ELSE '' END caveats FROM x ORDER BY logical_id LIMIT 200")
def op02_assets_of_a_type(spark, d):
    """The first 200 items (the answer's own limit)."""
    return _index(spark, d).types("Item").table()


@query("SELECT 'common:DropContainer' \"type\", 'miss' caveats")
def op02_unknown_type(spark, d):
    """What a type that isn't there may mean: DropBox shares a word with one scope more than with others."""
    return _index(spark, d).types("ContainerBox").table()


@query("WITH x AS (SELECT DISTINCT logical_id, type, lower(logical_id) = 'lantern_' exact FROM assets WHERE logical_id ILIKE '%ntern!_%' ESCAPE '!') SELECT logical_id, type, false exact, 'identifier-only,names-not-values' || CASE WHEN (SELECT count(*) FROM x) > 20 THEN ',truncated' ELSE '' END caveats FROM x ORDER BY length(logical_id), logical_id, type NULLS FIRST LIMIT 20")
def op03_search_literal(spark, d):
    """A search that no text answers falls back on names that hold it."""
    return _index(spark, d).search("ntern\\_").table()


@query(None)
def op03_search(spark, d):
    """A ranked answer (a top-k report)."""
    return _index(spark, d).search("crooked lantern").table()


_SEVERAL = "SELECT min(logical_id) FROM (SELECT logical_id FROM assets GROUP BY 1 HAVING count(DISTINCT pack_id) > 1)"


@query(
    f"""WITH n AS (SELECT ({_SEVERAL}) name), x AS (SELECT DISTINCT a.id, a.pack_id, a.logical_id, a.type, a.path, a.is_effective, p.name pack, p.kind pack_kind, p.priority FROM assets a JOIN packs p ON p.id = a.pack_id WHERE a.logical_id = (SELECT name FROM n)),
s AS (SELECT arg_min(id, (NOT is_effective, priority, id)) shown FROM x), v AS (SELECT asset_id, schema_pointer p, list_sort(list(DISTINCT raw_value)) v FROM candidates WHERE asset_id IN (SELECT id FROM x) GROUP BY ALL),
m AS (SELECT o.asset_id id, CASE WHEN f.p IS NULL THEN '+' || o.p WHEN f.v <> o.v THEN '~' || o.p END m FROM v o LEFT JOIN v f ON f.p = o.p AND f.asset_id = (SELECT shown FROM s) WHERE o.asset_id <> (SELECT shown FROM s)
 UNION ALL SELECT x.id, '-' || f.p FROM x JOIN v f ON f.asset_id = (SELECT shown FROM s) WHERE x.id <> f.asset_id AND NOT EXISTS (SELECT 1 FROM v o WHERE o.asset_id = x.id AND o.p = f.p)),
c AS (SELECT CASE WHEN count(DISTINCT coalesce(type, '')) > 1 THEN 'ambiguous-identifier' END a, CASE WHEN count(DISTINCT pack_id) > 1 THEN CASE WHEN count(DISTINCT CASE WHEN priority = (SELECT min(priority) FROM x) THEN pack_id END) > 1 THEN 'contested-packs' ELSE 'shadowed' END END b, CASE WHEN bool_or(pack_kind = 'archive') THEN 'third-party' END t, CASE WHEN bool_or(pack_kind = 'working') THEN 'working-pack' END w FROM x)
SELECT x.id, x.pack_id, x.logical_id, x.type, x.path, x.is_effective, x.pack, x.pack_kind, x.priority, coalesce(string_agg(DISTINCT m.m, ' ' ORDER BY m.m), '') differs, (SELECT concat_ws(',', a, b, t, w) FROM c) caveats FROM x LEFT JOIN m ON m.id = x.id AND m.m IS NOT NULL GROUP BY ALL"""
)
def op04_get(spark, d):
    """Every definition of a name that several packs define, and how each differs from the one that holds."""
    (a,) = _t(spark, d, "assets")
    name = a.groupBy("logical_id").agg(F.countDistinct("pack_id").alias("n")).where("n > 1").agg(F.min("logical_id").alias("x")).first()["x"]
    return _index(spark, d).get(name or "").table()


_BROKEN_ITEM = f"WITH {_C}, b AS (SELECT c.schema_pointer json_pointer, count(DISTINCT (c.asset_id, c.raw_value)) n FROM c JOIN sf ON sf.asset_type = c.schema_scope AND sf.json_pointer = c.schema_pointer WHERE c.schema_scope = 'Item' AND NOT EXISTS (SELECT 1 FROM a t WHERE t.logical_id = c.raw_value AND t.type = sf.reference_target) GROUP BY 1)"


@query(
    _BROKEN_ITEM
    + """, d AS (SELECT coalesce(s.asset_type, f.asset_type) asset_type, coalesce(s.json_pointer, f.json_pointer) json_pointer, s.declared_type, s.optional, s.reference_target, f.count n, f.cardinality, s.json_pointer IS NOT NULL declared, f.json_pointer IS NOT NULL observed FROM (SELECT * FROM schema_fields WHERE json_pointer <> '' AND asset_type = 'Item') s FULL JOIN (SELECT * FROM field_stats WHERE asset_type = 'Item') f ON f.json_pointer = s.json_pointer)
SELECT d.*, coalesce(b.n, 0) n_broken, concat_ws(',', CASE WHEN (SELECT bool_or(cardinality > 40) FROM d) THEN 'cardinality-elided' END, CASE WHEN (SELECT bool_or(declared_type LIKE '%object%' OR declared_type LIKE '%array%' OR declared_type LIKE '$ref%') FROM d) THEN 'container-no-observations' END, 'pre-inheritance', CASE WHEN (SELECT count(*) FROM d) > 60 THEN 'truncated' END) caveats FROM d LEFT JOIN b USING (json_pointer) ORDER BY json_pointer LIMIT 60"""
)
def op05_describe(spark, d):
    """Declared and observed fields of items, and how many values break their references."""
    return _index(spark, d).describe("Item").table()


@query("SELECT 'DropTable' asset_type, '/Container/Rolls/Min' json_pointer, '/Container' AS \"at\", 'common:DropContainer' AS \"into\", '/Rolls/Min' continue_at, 'crosses-into,pointer-repaired,pre-inheritance' caveats")
def op05_describe_elsewhere(spark, d):
    """A field, spelt by a shell's habits, that its type does not declare but another scope does."""
    return _index(spark, d).describe("DropTable", "C:/Program Files/Git/Container/Rolls/Min/").table()


_RANK = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_NAMED = "Stone_Plain_Block_Common"


@query(
    f"WITH {_C}, e AS (SELECT DISTINCT src, dst, dst_kind, kind, json_pointer, confidence FROM edges), {_CONTRA}, r AS (SELECT DISTINCT t.logical_id target, t.type target_type, s.logical_id, s.type, e.kind, e.json_pointer, e.confidence FROM e JOIN a s ON s.id = e.src JOIN a t ON t.id = e.dst WHERE e.dst_kind = 'asset' AND t.logical_id = '{_NAMED}' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.src = e.src AND bad.dst = e.dst AND bad.json_pointer = e.json_pointer))"
    + f" SELECT *, concat_ws(',', CASE WHEN (SELECT count(DISTINCT coalesce(type, '')) FROM assets WHERE logical_id = '{_NAMED}') > 1 THEN 'ambiguous-identifier' END, CASE WHEN (SELECT count(*) FROM r) > 40 THEN 'truncated' END, 'untyped-blind-spot') caveats FROM r ORDER BY {_RANK}, logical_id, json_pointer NULLS FIRST, kind, type NULLS FIRST LIMIT 40"
)
def op06_refs_of_an_asset(spark, d):
    return _index(spark, d).refs(_NAMED).table()


@query("WITH r AS (SELECT schema_scope, schema_pointer, count(DISTINCT id) n, count(DISTINCT asset_id) n_assets FROM candidates WHERE raw_value = 'Rare' GROUP BY ALL) SELECT *, concat_ws(',', 'argument-ignored', 'pre-inheritance', CASE WHEN (SELECT count(*) FROM r) > 40 THEN 'truncated' END) caveats FROM r ORDER BY n DESC LIMIT 40")
def op06_refs_of_a_value(spark, d):
    return _index(spark, d).refs("Rare", "Item").table()


_FILE = "SELECT min(path) FROM files WHERE substr(path, 8) NOT IN (SELECT raw_value FROM candidates) AND id IN (SELECT dst FROM edges WHERE dst_kind = 'file')"


@query(f"WITH p AS (SELECT ({_FILE}) path) SELECT DISTINCT f.path, a.logical_id, a.type, e.json_pointer, '' caveats FROM files f JOIN edges e ON e.dst = f.id AND e.dst_kind = 'file' JOIN assets a ON a.id = e.src WHERE f.path = (SELECT path FROM p)")
def op06_refs_of_a_file(spark, d):
    """Who refers to a file that no value names letter by letter."""
    f, e, c = _t(spark, d, "files", "edges", "candidates")
    used = f.join(e.where("dst_kind = 'file'").select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    path = used.join(c.select(F.concat(F.lit("Common/"), "raw_value").alias("path")).distinct(), "path", "left_anti").agg(F.min("path").alias("p")).first()["p"]
    return _index(spark, d).refs(path or "").table()


@query("SELECT asset_type, json_pointer, 'container-no-observations,miss' caveats FROM (VALUES ('X', '/A'), ('X', '/B')) t(asset_type, json_pointer)")
def op06_refs_of_a_constant(spark, d):
    """A text that nothing uses but fields declare."""
    more = spark.createDataFrame([("X", "/A", "No Such Thing", None), ("X", "/B", None, ["u", "No Such Thing"]), ("X", "/C", "Other", ["v"])], "asset_type string, json_pointer string, type_constant string, enum_values array<string>")
    return answers.Index(spark, d, {"schema_fields": more}).refs("No Such Thing").table()


_FIELD_WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(asset_type || ' ' || json_pointer, '[^\pL\pN]+', ' ', 'g') || ' ' || regexp_replace(asset_type || ' ' || json_pointer, '[^\pL\pN]+', ' ', 'g'), '([\p{Ll}\pN])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')) || ' ' || lower(regexp_replace(asset_type || ' ' || json_pointer, '[^\pL\pN]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"WITH w AS (SELECT asset_type, json_pointer, {_FIELD_WORDS} ws FROM schema_fields), h AS (SELECT * FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'item'))) > 0 AND len(list_filter(ws, lambda x: starts_with(x, 'quantity'))) > 0) SELECT asset_type, json_pointer, 0::INTEGER AS \"level\", false widened, CASE WHEN (SELECT count(*) FROM h) > 20 THEN 'truncated' ELSE '' END caveats FROM h ORDER BY asset_type, json_pointer LIMIT 20")
def op07_search_schema(spark, d):
    """Declared fields by their words."""
    return _index(spark, d).search_schema("item quantity").table()


@query(f"WITH w AS (SELECT asset_type, json_pointer, {_FIELD_WORDS} ws FROM schema_fields) SELECT asset_type, json_pointer, 0::INTEGER AS \"level\", true widened FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'zzz') OR starts_with(x, 'weight'))) > 0")
def fts06_widened(spark, d):
    """A schema search of which no field holds all words is widened to fields that hold some."""
    return search.search_fields(_t(spark, d, "schema_fields")[0], "zzzzz weight")


@query(f"WITH w AS (SELECT asset_type, json_pointer, {_FIELD_WORDS} ws FROM schema_fields) SELECT asset_type, json_pointer, 0::INTEGER AS \"level\", true widened FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'item') OR starts_with(x, 'reference') OR starts_with(x, 'quantity'))) > 0")
def fts06_schema_search(spark, d):
    return search.search_fields(_t(spark, d, "schema_fields")[0], "item reference quantity")


@query("WITH k AS (SELECT DISTINCT key, locale, value, CASE WHEN key = 'lantern' THEN 'key' WHEN concat_ws('.', root, key) = 'lantern' THEN 'reference' WHEN key ILIKE '%lantern%' THEN 'in key' WHEN value ILIKE '%lantern%' THEN 'in value' END how FROM lang_keys), h AS (SELECT * FROM k WHERE how IS NOT NULL), u AS (SELECT l.key, count(DISTINCT e.src) n FROM edges e JOIN lang_keys l ON l.id = e.dst WHERE e.dst_kind = 'lang_key' GROUP BY 1), r AS (SELECT key, min(root || '.' || key) reference FROM lang_keys GROUP BY 1) SELECT h.key, h.locale, h.value, h.how, r.reference, coalesce(u.n, 0) n_users, CASE WHEN (SELECT count(*) FROM h) > 20 THEN 'truncated' ELSE '' END caveats FROM h LEFT JOIN u USING (key) LEFT JOIN r USING (key) ORDER BY length(key), key, locale, value LIMIT 20")
def op08_search_lang(spark, d):
    return _index(spark, d).search_lang("lantern").table()


def _workshop(spark: SparkSession, d: str) -> answers.Index:
    """The index with plans laid out as stations, as a layer over it."""
    return answers.Index(spark, d, {"candidates": _leaves(spark, d)})


@query(f"""WITH {_STATIONS}, n AS (SELECT DISTINCT id asset_id, logical_id FROM assets), m AS (SELECT DISTINCT rq.station, ef.logical_id, rc.category FROM rq JOIN ef USING (asset_id) LEFT JOIN rc ON rc.asset_id = rq.asset_id AND rc.at_ = rq.at_ WHERE rq.station = 'Loombench'),
o AS (SELECT p.kind FROM assets a JOIN packs p ON p.id = a.pack_id WHERE a.logical_id IN (SELECT logical_id FROM m))
SELECT *, concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM st WHERE station = 'Loombench') THEN 'bench-undeclared' END, CASE WHEN (SELECT bool_or(kind = 'archive') FROM o) THEN 'third-party' END, CASE WHEN (SELECT count(*) FROM m) > 200 THEN 'truncated' END, CASE WHEN (SELECT bool_or(kind = 'working') FROM o) THEN 'working-pack' END) caveats FROM m ORDER BY category NULLS FIRST, logical_id LIMIT 200""")
def op09_bench(spark, d):
    """What is made at one station."""
    return _workshop(spark, d).bench("Loombench").table()


@query("WITH s AS (SELECT * FROM schema_fields WHERE json_pointer <> '' AND asset_type = 'BlockShape'), x AS (SELECT *, coalesce(declared_type LIKE '%object%' OR declared_type LIKE '%array%' OR declared_type LIKE '$ref%' OR declared_type IN ('anyOf', 'oneOf'), false) box FROM s) SELECT asset_type, json_pointer, declared_type, (SELECT count(*) FROM x WHERE box) n_containers, concat_ws(',', CASE WHEN (SELECT bool_or(box) FROM x) THEN 'container-no-observations' END, 'join-incomplete') caveats FROM x WHERE NOT box AND NOT EXISTS (SELECT 1 FROM field_stats f WHERE f.asset_type = x.asset_type AND f.json_pointer = x.json_pointer)")
def op10_undocumented(spark, d):
    return _index(spark, d).undocumented("BlockShape").table()


@query("WITH c AS (SELECT DISTINCT asset_id, json_pointer, raw_value, schema_scope s, schema_pointer p FROM candidates WHERE value_kind = 'string'), r AS (SELECT DISTINCT asset_id, json_pointer FROM c WHERE s = 'CraftPlan' AND p IN ('/Input/*/ItemId', '/Input/*/Alternatives/*/ItemId') AND raw_value = 'Stone_Plain_Block_Common') SELECT DISTINCT a.logical_id, a.type, r.json_pointer FROM r JOIN assets a ON a.id = r.asset_id")
def op13_who_uses(spark, d):
    """The assets that refer to a value by a link."""
    (a,) = _t(spark, d, "assets")
    return links.who_uses(join32_value_links(spark, d), a, "drop-or-ingredient", _NAMED, "referenced")


@query("WITH l AS (SELECT DISTINCT asset_id, json_pointer, raw_value, schema_scope s, schema_pointer p FROM candidates WHERE value_kind = 'string'), dec AS (SELECT DISTINCT raw_value FROM l WHERE s = 'common:DropContainer' AND p = '/Entries/*/Item/ItemId'), w AS (SELECT DISTINCT asset_id, json_pointer FROM l WHERE s = 'CraftPlan' AND p IN ('/Input/*/ItemId', '/Input/*/Alternatives/*/ItemId')) SELECT c.schema_scope, c.schema_pointer, count(DISTINCT (c.asset_id, c.json_pointer)) n, min(c.json_pointer) example FROM w JOIN candidates c ON c.asset_id = w.asset_id AND c.json_pointer = w.json_pointer GROUP BY ALL")
def join19_link_sites(spark, d):
    """The fields at which a link's references stand."""
    (c,) = _t(spark, d, "candidates")
    return links.sites(join32_value_links(spark, d).where("role = 'referenced'"), c)


@query("WITH c AS (SELECT DISTINCT asset_id, json_pointer, raw_value, schema_scope s, schema_pointer p FROM candidates WHERE value_kind = 'string'), d AS (SELECT * FROM c WHERE s = 'common:DropContainer' AND p = '/Entries/*/Item/ItemId'), r AS (SELECT *, raw_value IN (SELECT raw_value FROM d) ok FROM c WHERE s = 'CraftPlan' AND p IN ('/Input/*/ItemId', '/Input/*/Alternatives/*/ItemId')) SELECT 'drop-or-ingredient' link, (SELECT count(*) FROM d) n_declared, (SELECT count(DISTINCT raw_value) FROM d) n_values, count(*) n_referenced, count(*) FILTER (ok) n_resolved, coalesce(string_agg(DISTINCT raw_value, ',' ORDER BY raw_value) FILTER (NOT ok), '') unresolved FROM r")
def agg16_link_summary(spark, d):
    return links.summary(join32_value_links(spark, d)).withColumn("unresolved", F.array_join("unresolved", ","))


@query(f"""WITH {_STATIONS}, t AS (SELECT DISTINCT logical_id token FROM assets UNION SELECT raw_value FROM candidates WHERE id % 100 = 0 UNION SELECT root || '.' || key FROM lang_keys WHERE id % 100 = 0 AND root IS NOT NULL UNION SELECT regexp_replace(path, '^.*/', '') FROM files WHERE id % 100 = 0 UNION SELECT category FROM ca),
v AS (SELECT raw_value, count(DISTINCT id) n, count(DISTINCT asset_id) m FROM candidates GROUP BY 1), g AS (SELECT logical_id, count(DISTINCT id) n, string_agg(DISTINCT coalesce(type, 'untyped'), ',' ORDER BY coalesce(type, 'untyped')) types FROM assets GROUP BY 1),
fe AS (SELECT id, array_to_string(list_slice(string_split(path, '/'), i, 100), '/') x FROM files, range(1, 12) r(i) WHERE i <= len(string_split(path, '/'))), fn AS (SELECT x, count(DISTINCT id) n FROM fe GROUP BY 1), k AS (SELECT DISTINCT key FROM lang_keys)
SELECT t.token, coalesce(g.n, 0) n_assets, g.types, coalesce(v.n, 0) n_values, coalesce(v.m, 0) n_value_assets, coalesce(fn.n, 0) n_files, coalesce(k1.key, k2.key) lang_key, t.token IN (SELECT station FROM st) station, t.token IN (SELECT category FROM ca) category
FROM t LEFT JOIN g ON g.logical_id = t.token LEFT JOIN v ON v.raw_value = t.token LEFT JOIN fn ON fn.x = t.token LEFT JOIN k k1 ON k1.key = t.token LEFT JOIN k k2 ON k2.key = regexp_replace(t.token, '^(server|common)\\.', '')""")
def op14_identify(spark, d):
    """What each of many tokens is, by eight facets: all names and categories, and of values, texts and files every hundredth."""
    a, c, k, f = _t(spark, d, "assets", "candidates", "lang_keys", "files")
    tokens = a.select(F.col("logical_id").alias("token")).union(c.where("id % 100 = 0").select("raw_value")).union(k.where("id % 100 = 0 and root is not null").select(F.concat("root", F.lit("."), "key"))).union(f.where("id % 100 = 0").select(F.element_at(F.split("path", "/"), -1)))
    shop = _workshop(spark, d)
    cats = shop._stations().categories.select("category")
    # the stations' own leaves are a layer of the answer; values are counted over the index alone
    return _StationsOver(spark, d).identify(tokens.union(cats))


class _StationsOver(answers.Index):
    def _stations(self):
        return _workshop(self.spark, self.folder)._stations()


@query("WITH r AS (SELECT DISTINCT id, asset_id, schema_scope s, schema_pointer p, raw_value v FROM candidates), x AS (SELECT v, count(*) occurrences, count(DISTINCT asset_id) n_assets, count(*) FILTER (s IS NULL) unattributed FROM r GROUP BY 1), f AS (SELECT v, count(*) n_fields, arg_max(s || ' ' || p, (n, s || ' ' || p)) top_field, max(n) top_n FROM (SELECT v, s, p, count(*) n FROM r WHERE s IS NOT NULL GROUP BY ALL) GROUP BY 1), e AS (SELECT v, min(a.logical_id) example FROM r JOIN assets a ON a.id = r.asset_id GROUP BY 1) SELECT x.v raw_value, occurrences, n_assets, unattributed, coalesce(n_fields, 0) n_fields, top_field, top_n, example FROM x LEFT JOIN f USING (v) LEFT JOIN e USING (v)")
def agg06_value_usage(spark, d):
    """How each value is used: rows, assets, rows without a scope, fields, the commonest field, an example."""
    c, a = _t(spark, d, "candidates", "assets")
    rows = c.select("id", "asset_id", "schema_scope", "schema_pointer", "raw_value").distinct()
    x = rows.groupBy("raw_value").agg(F.count("*").alias("occurrences"), F.countDistinct("asset_id").alias("n_assets"), F.count(F.when(F.col("schema_scope").isNull(), 1)).alias("unattributed"))
    by = rows.where("schema_scope is not null").groupBy("raw_value", F.concat_ws(" ", "schema_scope", "schema_pointer").alias("field")).agg(F.count("*").alias("n"))
    f = by.groupBy("raw_value").agg(F.count("*").alias("n_fields"), F.max_by("field", F.struct("n", "field")).alias("top_field"), F.max("n").alias("top_n"))
    e = rows.select("raw_value", F.col("asset_id").alias("id")).distinct().join(a.select("id", "logical_id"), "id").groupBy("raw_value").agg(F.min("logical_id").alias("example"))
    return x.join(f, "raw_value", "left").join(e, "raw_value", "left").fillna(0, ["n_fields"])


@query("SELECT logical_id, type, scaffold, family, row_number() OVER (ORDER BY scaffold, logical_id, type) AS \"place\" FROM (SELECT DISTINCT s logical_id, type, regexp_matches(s, '^(Prototype|Debug|Template|Filter|Test)_') scaffold, CASE WHEN instr(s, '_') > 1 THEN split_part(s, '_', 1) ELSE s END family FROM (SELECT CASE WHEN id % 5 = 0 THEN 'Template_' || logical_id WHEN id % 7 = 0 THEN 'Debugger_' || logical_id ELSE logical_id END s, type FROM assets WHERE type IS NOT NULL AND logical_id LIKE '%Raft%')) ORDER BY scaffold, logical_id, type LIMIT 50")
def win03_scaffolding_last(spark, d):
    """Scaffolding moved behind all other names, the order kept otherwise (a top-k report). Every fifth name is made scaffolding, every seventh only looks like it."""
    (a,) = _t(spark, d, "assets")
    name = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Template_"), "logical_id")).when(F.col("id") % 7 == 0, F.concat(F.lit("Debugger_"), "logical_id")).otherwise(F.col("logical_id"))
    x = a.where("type is not null and logical_id like '%Raft%'").select(name.alias("logical_id"), "type")
    x = x.select("logical_id", "type", T.is_scaffolding(F.col("logical_id")).alias("scaffold"), T.family(F.col("logical_id")).alias("family")).distinct()
    from pyspark.sql import Window

    top = x.orderBy("scaffold", "logical_id", "type").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy("scaffold", "logical_id", "type")).cast("long"))


@query("WITH r AS (SELECT DISTINCT schema_scope s, schema_pointer p, raw_value v FROM candidates WHERE schema_scope IS NOT NULL), f AS (SELECT s, p, list_sort(list(v)) l, bool_and(coalesce(isfinite(try_cast(trim(v) AS DOUBLE)), false)) num FROM r GROUP BY ALL HAVING count(*) <= 40) SELECT s asset_type, p json_pointer, CASE WHEN num THEN (SELECT string_agg(x, '|' ORDER BY try_cast(trim(x) AS DOUBLE), x) FROM (SELECT unnest(l) x)) ELSE array_to_string(l, '|') END vals FROM f")
def ord07_numeric_order(spark, d):
    """The values of fields with few of them, in the order of their numbers where all are numbers."""
    (c,) = _t(spark, d, "candidates")
    rows = c.where("schema_scope is not null").select("schema_scope", "schema_pointer", "raw_value").distinct()
    few = rows.groupBy("schema_scope", "schema_pointer").agg(F.count("*").alias("n")).where("n <= 40").drop("n")
    v = rows.join(few, ["schema_scope", "schema_pointer"], "left_semi").groupBy(F.col("schema_scope").alias("asset_type"), F.col("schema_pointer").alias("json_pointer")).agg(F.array_sort(F.collect_list("raw_value")).alias("v"))
    return v.select("asset_type", "json_pointer", F.array_join(answers.numeric_order(F.col("v")), "|").alias("vals"))


@query("WITH p AS (SELECT DISTINCT schema_pointer FROM candidates) SELECT schema_pointer given, '/' || regexp_replace(schema_pointer, '^/+|/+$', '', 'g') repaired FROM p")
def prj19_pointers(spark, d):
    """Pointers as they are asked for, repaired. The declared and observed pointers are a fixed number."""
    (c,) = _t(spark, d, "candidates")
    fix = F.pandas_udf(lambda given: given.map(lambda p: answers.repaired_pointer(p)[0]), "string")
    return c.select(F.col("schema_pointer").alias("given")).distinct().withColumn("repaired", fix("given"))


@query("SELECT (SELECT count(DISTINCT id) FROM assets WHERE type IS NOT NULL) typed, (SELECT count(DISTINCT src) FROM edges WHERE dst_kind = 'lang_key') localized, (SELECT count(*) FROM (SELECT DISTINCT * FROM candidates)) leaves, (SELECT count(DISTINCT locale) FROM lang_keys) locales")
def agg14_build_counters(spark, d):
    """What a build reports of itself, from one pass over each table."""
    a, e, c, k = _t(spark, d, "assets", "edges", "candidates", "lang_keys")
    parts = [a.where("type is not null").agg(F.countDistinct("id").alias("n")), e.where("dst_kind = 'lang_key'").agg(F.countDistinct("src").alias("n")), c.distinct().agg(F.count("*").alias("n")), k.agg(F.countDistinct("locale").alias("n"))]
    rows = [p.select(F.lit(w).alias("w"), "n") for w, p in zip(("typed", "localized", "leaves", "locales"), parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy().pivot("w", ["typed", "localized", "leaves", "locales"]).agg(F.first("n"))


@query("WITH s AS (SELECT asset_type, json_pointer, reference_target FROM schema_fields), r AS (SELECT DISTINCT id, schema_scope a, schema_pointer p, raw_value v FROM candidates WHERE schema_scope IS NOT NULL), g AS (SELECT a, p, count(*) n, list_sort(list(DISTINCT v)) l FROM r GROUP BY ALL) SELECT g.a asset_type, g.p json_pointer, array_to_string(l, '|') enum_values FROM g JOIN s ON s.asset_type = g.a AND s.json_pointer = g.p WHERE n >= 8 AND len(l) BETWEEN 1 AND 40 AND s.reference_target IS NULL")
def agg04_inferred_enum(spark, d):
    """Values of declared fields seen often enough with few enough of them, unless the field declares its own. Fields with a reference's target are given a declared enumeration here."""
    from lattica.operators import profile

    c, s = _t(spark, d, "candidates", "schema_fields")
    s = s.withColumn("enum_values", F.when(F.col("reference_target").isNotNull(), F.array("reference_target")))
    return profile.inferred_enums(profile.field_stats(c), s).select("asset_type", "json_pointer", F.array_join("enum_values", "|").alias("enum_values"))



@query(None)
def op12_evaluate(spark, d):
    """How many searches for the texts of every hundredth language key find an asset that has the text, by locale."""
    a, e, k = _t(spark, d, "assets", "edges", "lang_keys")
    docs = search.search_docs(a, e, k)
    asked = k.where("id % 100 = 0").select(F.col("value").alias("phrase"), F.col("locale").alias("tier")).distinct()
    holders = docs.where("locale != ''").select(F.explode(F.array("display_name", "description")).alias("phrase"), "logical_id").where("phrase != ''").groupBy("phrase").agg(F.collect_set("logical_id").alias("expected_any"))
    return search.evaluate(docs, asked.join(holders, "phrase"))
