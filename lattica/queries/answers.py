"""Queries of search, links, alignment and inheritance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import align, graph, links, search
from lattica.queries.index import _C, _E, _E1, _t

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


_WORDS = r"list_filter(regexp_split_to_array(lower(strip_accents(replace(replace(value, 'Ґ', 'Г'), 'ґ', 'г'))), '[^\pL\pN]+'), lambda x: x <> '')"


@query(f"WITH k AS (SELECT DISTINCT key, locale, value FROM lang_keys), w AS (SELECT key, locale, {_WORDS} ws FROM k), l AS (SELECT key, locale, CASE WHEN len(list_filter(ws, lambda x: starts_with(x, 'rusted'))) > 0 THEN 0 WHEN len(list_filter(ws, lambda x: starts_with(x, 'ruste'))) > 0 THEN 1 WHEN len(list_filter(ws, lambda x: starts_with(x, 'rust'))) > 0 THEN 2 END a, CASE WHEN len(list_filter(ws, lambda x: starts_with(x, 'lanterns'))) > 0 THEN 0 WHEN len(list_filter(ws, lambda x: starts_with(x, 'lantern'))) > 0 THEN 1 WHEN len(list_filter(ws, lambda x: starts_with(x, 'lanter'))) > 0 THEN 2 WHEN len(list_filter(ws, lambda x: starts_with(x, 'lante'))) > 0 THEN 3 END b FROM w) SELECT key, locale, b::INTEGER level FROM l WHERE b IS NOT NULL")
def fts05_matches(spark, d):
    """Texts of all locales in which a word begins like `lanterns`, with the letters cut off."""
    (k,) = _t(spark, d, "lang_keys")
    k = k.select("key", "locale", "value").distinct()
    return search.matches(k, ["value"], ["lanterns"]).select("key", "locale", "level")


@query(None)
def fts05_search(spark, d):
    """A ranked answer (a top-k report)."""
    a, e, k = _t(spark, d, "assets", "edges", "lang_keys")
    return search.search(search.search_docs(a, e, k), "crooked lantern", 20)


@query(None)
def fts05_search_batch(spark, d):
    """The ranked answers to the text of every language key whose id is divisible by 100."""
    a, e, k = _t(spark, d, "assets", "edges", "lang_keys")
    return search.search_batch(search.search_docs(a, e, k), k.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("value").alias("text")), 20)


@query("SELECT DISTINCT logical_id, type, lower(logical_id) = 'glass_lantern' exact FROM assets WHERE logical_id ILIKE '%glass_lantern%'")
def fts08_literal(spark, d):
    return search.literal(_t(spark, d, "assets")[0], "glass_lantern")


@query("SELECT * FROM (SELECT DISTINCT key, locale, value, CASE WHEN key = 'lantern' THEN 'key' WHEN concat_ws('.', root, key) = 'lantern' THEN 'reference' WHEN key ILIKE '%lantern%' THEN 'in key' WHEN value ILIKE '%lantern%' THEN 'in value' END how FROM lang_keys) WHERE how IS NOT NULL")
def fts09_lang_search(spark, d):
    return search.search_texts(_t(spark, d, "lang_keys")[0], "lantern")


@query("WITH c AS (SELECT DISTINCT asset_id, json_pointer, raw_value, schema_scope s, schema_pointer p FROM candidates WHERE value_kind = 'string'), dec AS (SELECT DISTINCT raw_value FROM c WHERE s = 'common:DropContainer' AND p = '/Entries/*/Item/ItemId') SELECT 'drop-or-ingredient' link, raw_value \"value\", asset_id, json_pointer, CASE WHEN s = 'CraftPlan' THEN 'referenced' ELSE 'declared' END role, raw_value IN (SELECT raw_value FROM dec) resolved FROM c WHERE s = 'CraftPlan' AND p IN ('/Input/*/ItemId', '/Input/*/Alternatives/*/ItemId') OR s = 'common:DropContainer' AND p = '/Entries/*/Item/ItemId'")
def join32_value_links(spark, d):
    """Ingredients of plans, and whether anything drops them."""
    link = links.ValueLink("drop-or-ingredient", (("common:DropContainer", "/Entries/*/Item/ItemId"),), (("CraftPlan", "/Input/*/ItemId"), ("CraftPlan", "/Input/*/Alternatives/*/ItemId")))
    return links.value_links(_t(spark, d, "candidates")[0], [link])


_STARRED = r"regexp_replace(regexp_replace(json_pointer, '/\d+(/|$)', '/*\1', 'g'), '/\d+(/|$)', '/*\1', 'g')"
_ALIGNED = rf"""l AS (SELECT DISTINCT asset_id, json_pointer, raw_value, value_kind, {_STARRED} p FROM candidates),
t AS (SELECT DISTINCT id asset_id, type FROM assets),
k AS (SELECT DISTINCT asset_type FROM schema_fields),
x AS (SELECT l.*, CASE WHEN t.type IN (SELECT asset_type FROM k) THEN t.type END kind, CASE WHEN t.type = 'DropTable' THEN regexp_extract(p, '^/Container(?:/Entries/\*/Container)*(/.*)$', 1) ELSE '' END inner_ FROM l LEFT JOIN t USING (asset_id)),
al AS (SELECT asset_id, json_pointer, raw_value, value_kind, CASE WHEN inner_ <> '' THEN inner_ ELSE p END schema_pointer, CASE WHEN inner_ <> '' THEN 'common:DropContainer' ELSE kind END schema_scope FROM x)"""


def _aligned(spark, d, more: list[tuple] = ()):
    """The leaves aligned by schema_fields and further fields (asset_type, json_pointer, ref_scope, discriminator_property, discriminator_values)."""
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    if more:
        s = s.unionByName(spark.createDataFrame(more, "asset_type string, json_pointer string, ref_scope array<string>, discriminator_property string, discriminator_values array<string>"), allowMissingColumns=True)
    parents = graph.inherits(c, a).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent_id"))
    lineage = a.select("id", "type").distinct().join(parents, "id", "left")
    return align.align(c.select("asset_id", "json_pointer", "raw_value", "value_kind").distinct(), lineage, s)


@query(f"WITH {_ALIGNED} SELECT * FROM al")
def nst10_align(spark, d):
    """Leaves with the scope and pointer of the declared field they belong to."""
    return _aligned(spark, d)


@query(f"WITH {_ALIGNED}, b AS (SELECT DISTINCT asset_id, json_pointer, schema_scope, schema_pointer FROM candidates), a AS (SELECT DISTINCT asset_id, json_pointer, schema_scope, schema_pointer FROM al) SELECT count(*) n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM b WHERE b.asset_id = a.asset_id AND b.json_pointer = a.json_pointer AND b.schema_pointer = a.schema_pointer AND b.schema_scope IS NOT DISTINCT FROM a.schema_scope)) changed, count(*) FILTER (schema_scope IS NULL) without_scope FROM a")
def nst13_changes(spark, d):
    """How many leaves alignment gives another scope or pointer than candidates has."""
    return align.changes(_t(spark, d, "candidates")[0], _aligned(spark, d))


_DROPS, _MOODS = ["Single", "Choice", "Multi"], ["calm", "shy", "wary"]


@query(rf"""WITH RECURSIVE {_C}, l AS (SELECT DISTINCT asset_id, json_pointer, raw_value, value_kind, {_STARRED} p FROM candidates),
up AS (SELECT src, min(dst) dst FROM ({_E1}) GROUP BY 1),
ch AS (SELECT DISTINCT id, id own, 0 hop FROM assets UNION ALL SELECT ch.id, up.dst, ch.hop + 1 FROM ch JOIN up ON up.src = ch.own WHERE ch.hop < 8),
told AS (SELECT ch.id asset_id, l.json_pointer at_, arg_min(l.raw_value, (ch.hop, l.raw_value)) v FROM ch JOIN l ON l.asset_id = ch.own WHERE l.value_kind = 'string' AND l.json_pointer IN ('/Container/Type', '/Mood') GROUP BY ALL),
t AS (SELECT DISTINCT id asset_id, type FROM assets)
SELECT l.asset_id, l.json_pointer, l.value_kind, CASE WHEN t.type = 'DropTable' AND m.v IN ('Single', 'Choice', 'Multi') AND regexp_matches(p, '^/Container/.') THEN 'drop:' || m.v WHEN t.type = 'CreatureRole' AND r.v IS NOT NULL AND (SELECT min(x) FROM (VALUES ('calm'), ('shy'), ('wary')) z(x) WHERE starts_with(x, r.v)) IS NOT NULL THEN 'role:' || (SELECT arg_min(x, (length(x), x)) FROM (VALUES ('calm'), ('shy'), ('wary')) z(x) WHERE starts_with(x, r.v)) WHEN t.type IN (SELECT asset_type FROM schema_fields) THEN t.type END schema_scope,
CASE WHEN t.type = 'DropTable' AND m.v IN ('Single', 'Choice', 'Multi') AND regexp_matches(p, '^/Container/.') THEN regexp_replace(p, '^/Container', '') ELSE p END schema_pointer
FROM l LEFT JOIN t USING (asset_id) LEFT JOIN told m ON m.asset_id = l.asset_id AND m.at_ = '/Container/Type' LEFT JOIN told r ON r.asset_id = l.asset_id AND r.at_ = '/Mood'""")
def nst11_unions(spark, d):
    """Alignment across unions: drop tables by the constants of their container's type, roles, a union at their root, by the mood
    they or the nearest of their parents have, which begins a branch's name."""
    c, a, s = _t(spark, d, "candidates", "assets", "schema_fields")
    s = s.where("not (asset_type = 'DropTable' and json_pointer = '/Container')")
    union = [("DropTable", "/Container", [f"drop:{x}" for x in _DROPS], "Type", _DROPS), ("CreatureRole", "", [f"role:{x}" for x in _MOODS], "Mood", None)]
    union += [(f"drop:{x}", "/Type", None, None, None) for x in _DROPS] + [(f"role:{x}", "/Mood", None, None, None) for x in _MOODS]
    s = s.unionByName(spark.createDataFrame(union, "asset_type string, json_pointer string, ref_scope array<string>, discriminator_property string, discriminator_values array<string>"), allowMissingColumns=True)
    parents = graph.inherits(c, a).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent_id"))
    lineage = a.select("id", "type").distinct().join(parents, "id", "left")
    return align.align(c.select("asset_id", "json_pointer", "raw_value", "value_kind").distinct(), lineage, s).select("asset_id", "json_pointer", "value_kind", "schema_scope", "schema_pointer")


@query(f"WITH {_E} SELECT src asset_id, count(*) n_out, count(DISTINCT dst_kind) n_kinds FROM e GROUP BY 1")
def agg15_out_degree(spark, d):
    e = graph.resolve(*_t(spark, d, "candidates", "assets", "files", "lang_keys", "schema_fields"))
    return e.groupBy(F.col("src").alias("asset_id")).agg(F.count("*").alias("n_out"), F.countDistinct("dst_kind").alias("n_kinds"))
