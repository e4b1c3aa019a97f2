"""Queries of stations. The tables' plans carry no station objects of their own, so each plan's benches, groups and inputs are
laid out as such: the plans of the first pack declare stations, all plans require them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import stations as S
from lattica.queries.index import _t

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


_DECLARED = "common:Bench"


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    """(asset_id, json_pointer, schema_scope, schema_pointer, raw_value) of plans laid out as station objects, categories and requirements."""
    c, a = _t(spark, d, "candidates", "assets")
    c = c.where("schema_scope = 'CraftPlan'").select("asset_id", "json_pointer", "schema_pointer", "raw_value").distinct()
    first = a.where("pack_id = 1").select(F.col("id").alias("asset_id")).distinct()
    p, j = F.col("schema_pointer"), F.col("json_pointer")
    lay = lambda where, scope, pointer, json_pointer: c.where(where).select("asset_id", json_pointer.alias("json_pointer"), F.lit(scope).alias("schema_scope"), F.lit(pointer).alias("schema_pointer"), "raw_value")
    moved = F.regexp_replace(F.regexp_replace(j, "^/Input/", "/Bench/0/Categories/"), "/Alternatives/", "/ItemCategories/")
    inputs, alternatives = "/Input/*/", "/Input/*/Alternatives/*/"
    declared = [
        lay(p == "/Bench/*/Id", _DECLARED, "/Id", j), lay(p == "/Seconds", _DECLARED, "/Type", F.lit("/Bench/0/Type")), lay(p == "/Bench/*/Groups/*", _DECLARED, "/Categories/*", j),
        lay(p == inputs + "ItemId", "common:BenchCategory", "/Id", F.regexp_replace(moved, "ItemId$", "Id")), lay(p == inputs + "Quantity", "common:BenchCategory", "/Name", F.regexp_replace(moved, "Quantity$", "Name")),
        lay(p == alternatives + "ItemId", "common:BenchItemCategory", "/Id", F.regexp_replace(moved, "ItemId$", "Id")), lay(p == alternatives + "Ratio", "common:BenchItemCategory", "/Icon", F.regexp_replace(moved, "Ratio$", "Icon")),
    ]
    out = declared[0]
    for x in declared[1:]:
        out = out.unionByName(x)
    out = out.join(first, "asset_id", "left_semi")
    required = [lay(p == "/Bench/*/Id", "common:BenchRequirement", "/Id", j), lay(p == "/Bench/*/Groups/*", "common:BenchRequirement", "/Categories/*", j)]
    return out.unionByName(required[0]).unionByName(required[1])


def _stations(spark: SparkSession, d: str) -> S.Stations:
    return S.extract(_leaves(spark, d), S.Spec((_DECLARED,)))


_UP = "regexp_replace({}, '/[^/]*$', '')"
_SQL = f"""c AS (SELECT DISTINCT asset_id a, json_pointer j, schema_pointer p, raw_value v FROM candidates WHERE schema_scope = 'CraftPlan'),
f AS (SELECT c.*, {_UP.format('j')} up, regexp_replace(regexp_replace(j, '^/Input/', '/Bench/0/Categories/'), '/Alternatives/', '/ItemCategories/') m FROM c WHERE a IN (SELECT id FROM assets WHERE pack_id = 1)),
ids AS (SELECT a, up at_, v station FROM f WHERE p = '/Bench/*/Id'),
ty AS (SELECT a, min(v) t FROM f WHERE p = '/Seconds' GROUP BY 1),
st AS (SELECT station, min(CASE WHEN at_ = '/Bench/0' THEN t END) station_type FROM ids LEFT JOIN ty USING (a) GROUP BY 1),
de AS (SELECT station, a asset_id, count(*) n FROM ids GROUP BY ALL),
ho AS (SELECT a, at_, min(station) station FROM ids GROUP BY ALL),
na AS (SELECT a, {_UP.format('m')} at_, min(v) x FROM f WHERE p = '/Input/*/Quantity' GROUP BY ALL),
ic AS (SELECT a, {_UP.format('m')} at_, min(v) x FROM f WHERE p = '/Input/*/Alternatives/*/Ratio' GROUP BY ALL),
ob AS (SELECT DISTINCT a, {_UP.format('m')} at_, v FROM f WHERE p = '/Input/*/ItemId'),
ne AS (SELECT DISTINCT a, {_UP.format('m')} at_, v FROM f WHERE p = '/Input/*/Alternatives/*/ItemId'),
pa AS (SELECT a, at_, min(v) v FROM ob GROUP BY ALL),
al AS (SELECT a, j at_, v category, NULL::VARCHAR parent, NULL::VARCHAR name_key, NULL::VARCHAR icon, 0 l FROM f WHERE p = '/Bench/*/Groups/*'
 UNION ALL SELECT ob.a, ob.at_, ob.v, NULL, na.x, NULL, 1 FROM ob LEFT JOIN na ON na.a = ob.a AND na.at_ = ob.at_
 UNION ALL SELECT ne.a, ne.at_, ne.v, pa.v, NULL, ic.x, 2 FROM ne LEFT JOIN pa ON pa.a = ne.a AND pa.at_ = {_UP.format(_UP.format('ne.at_'))} LEFT JOIN ic ON ic.a = ne.a AND ic.at_ = ne.at_),
pl AS (SELECT ho.station, al.* FROM al JOIN ho ON ho.a = al.a AND (al.at_ = ho.at_ OR starts_with(al.at_, ho.at_ || '/'))),
ca AS (SELECT station, category, arg_min(parent, (l, a, at_)) FILTER (parent IS NOT NULL) parent, arg_min(name_key, (l, a, at_)) FILTER (name_key IS NOT NULL) name_key, arg_min(icon, (l, a, at_)) FILTER (icon IS NOT NULL) icon FROM pl GROUP BY ALL),
re AS (SELECT a asset_id, {_UP.format('j')} at_, min(v) station FROM c WHERE p = '/Bench/*/Id' GROUP BY ALL),
rq AS (SELECT *, station IN (SELECT station FROM st) resolved FROM re),
rc AS (SELECT DISTINCT a asset_id, {_UP.format(_UP.format('j'))} at_, v category FROM c WHERE p = '/Bench/*/Groups/*'),
ef AS (SELECT DISTINCT id asset_id, logical_id FROM assets WHERE is_effective)"""


@query(f"WITH {_SQL} SELECT station, station_type, asset_id, n FROM de JOIN st USING (station)")
def join31_declarations(spark, d):
    """Which assets declare which stations, how often, and the station's type, read beside its id."""
    s = _stations(spark, d)
    return s.declarations.join(s.stations, "station").select("station", "station_type", "asset_id", "n")


@query(f"WITH {_SQL} SELECT station, category, parent, name_key, icon FROM ca")
def snk02_categories(spark, d):
    """The categories of each station, plain ones, objects and those nested in them, merged column by column."""
    return _stations(spark, d).categories


@query(f"WITH {_SQL} SELECT station, category, parent, icon, k.english, row_number() OVER (PARTITION BY station ORDER BY coalesce(parent, category), parent IS NOT NULL, category) place FROM ca LEFT JOIN (SELECT '1' name_key, arg_max(value, (pack_id, id)) english FROM lang_keys WHERE locale = 'en-US') k ON k.name_key = ca.name_key")
def join20_category_tree(spark, d):
    """The categories in the order of their tree, with an English name."""
    (k,) = _t(spark, d, "lang_keys")
    return S.category_tree(_stations(spark, d), k.withColumn("key", F.lit("1")))


@query(f"WITH {_SQL} SELECT DISTINCT rq.station, ef.logical_id, rc.category FROM rq JOIN ef USING (asset_id) LEFT JOIN rc ON rc.asset_id = rq.asset_id AND rc.at_ = rq.at_")
def join21_craftable_at(spark, d):
    """What is made at each station, by category."""
    (a,) = _t(spark, d, "assets")
    return S.craftable_at(_stations(spark, d), a)


@query(f"""WITH {_SQL}, n AS (SELECT DISTINCT id asset_id, logical_id FROM assets), u AS (SELECT station FROM st UNION SELECT station FROM rq)
SELECT u.station, st.station_type, st.station IS NOT NULL declared, d.declarers, coalesce(d.n, 0) n_declarers, coalesce(k.n, 0) n_categories, coalesce(m.n, 0) n_crafted, coalesce(q.n, 0) n_requirements FROM u LEFT JOIN st USING (station)
LEFT JOIN (SELECT station, string_agg(DISTINCT logical_id, ', ' ORDER BY logical_id) declarers, count(DISTINCT logical_id) n FROM de JOIN n USING (asset_id) GROUP BY 1) d USING (station)
LEFT JOIN (SELECT station, count(*) n FROM ca GROUP BY 1) k USING (station) LEFT JOIN (SELECT station, count(DISTINCT logical_id) n FROM rq JOIN ef USING (asset_id) GROUP BY 1) m USING (station) LEFT JOIN (SELECT station, count(*) n FROM rq GROUP BY 1) q USING (station)""")
def join22_stations(spark, d):
    """Every station that is declared or required, with its declarers, categories and what is made there."""
    (a,) = _t(spark, d, "assets")
    return S.listing(_stations(spark, d), a)


@query(f"WITH {_SQL} SELECT station FROM st UNION SELECT station FROM rq")
def set02_station_ids(spark, d):
    s = _stations(spark, d)
    return s.stations.select("station").union(s.requirements.select("station")).distinct()


@query(f"""WITH {_SQL} SELECT 'stations' what, count(*)::VARCHAR "value" FROM st UNION ALL SELECT 'declarations', coalesce(sum(n), 0)::BIGINT::VARCHAR FROM de UNION ALL SELECT 'categories', count(*) FILTER (parent IS NULL)::VARCHAR FROM ca UNION ALL SELECT 'nested', count(parent)::VARCHAR FROM ca
UNION ALL SELECT 'requirements', count(*)::VARCHAR FROM rq UNION ALL SELECT 'resolved', count(*) FILTER (resolved)::VARCHAR FROM rq UNION ALL SELECT 'declared more than once', station FROM de GROUP BY station HAVING sum(n) > 1 UNION ALL SELECT DISTINCT 'never declared', station FROM rq WHERE NOT resolved""")
def agg17_station_summary(spark, d):
    """What stations amount to, those declared more than once and those never declared among them."""
    return S.summary(_stations(spark, d))
