"""Queries of inheritance, over documents whose types are told apart by a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.canonical import trimmed
from lattica.operators import inherit
from lattica.queries.index import _t
from lattica.queries.problems import _trim

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


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent, name): what each asset's /Parent, as read last, names within its type."""
    a, c = _t(spark, d, "assets", "candidates")
    a = a.select("id", "logical_id", "type", "is_effective").distinct()
    named = c.where("json_pointer = '/Parent'").groupBy(F.col("asset_id").alias("child")).agg(F.max_by(trimmed(F.col("raw_value")), F.struct("seen_at", "id")).alias("name"))
    named = named.join(a.select(F.col("id").alias("child"), "type"), "child")
    there = a.where("is_effective").groupBy(F.col("logical_id").alias("name"), "type").agg(F.min("id").alias("parent"))
    return named.join(there, ["name", "type"], "left").select("child", "parent", "name")


_CHAINS = f"""a AS (SELECT DISTINCT id, logical_id, type, is_effective FROM assets),
n AS (SELECT asset_id child, arg_max({_trim('raw_value')}, (seen_at, id)) name FROM candidates WHERE json_pointer = '/Parent' GROUP BY 1),
c AS (SELECT n.child, n.name, (SELECT min(t.id) FROM a t WHERE t.logical_id = n.name AND t.type = a.type AND t.is_effective) parent FROM n JOIN a ON a.id = n.child),
r AS (SELECT DISTINCT id, [id] chain, id cur FROM a UNION ALL SELECT r.id, list_append(r.chain, c.parent), c.parent FROM r JOIN c ON c.child = r.cur WHERE c.parent IS NOT NULL AND NOT list_contains(r.chain, c.parent) AND len(r.chain) < 16),
z AS (SELECT id, arg_max(chain, len(chain)) chain, arg_max(cur, len(chain)) cur FROM r GROUP BY 1),
chains AS (SELECT z.id asset_id, z.chain, coalesce(list_contains(z.chain, c.parent) OR len(z.chain) >= 16 AND c.name IS NOT NULL, false) truncated, CASE WHEN c.parent IS NULL AND len(z.chain) < 16 THEN c.name END missing_parent FROM z LEFT JOIN c ON c.child = z.cur)"""


@query(f"WITH RECURSIVE {_CHAINS} SELECT asset_id, array_to_string(chain, '/') chain, truncated, missing_parent FROM chains")
def inh01_chains(spark, d):
    """Each asset's chain of parents within its type, at most 16 long, and the parent that is not there."""
    (a,) = _t(spark, d, "assets")
    found = inherit.chains(a.select(F.col("id").alias("asset_id")), _parents(spark, d))
    return found.select("asset_id", F.concat_ws("/", F.transform("chain", lambda x: x.cast("string"))).alias("chain"), "truncated", "missing_parent")


# Roles are a union told apart by their mood; only the branches of calm and shy ones take their states for a map.
_BRANCHES = ["calm", "shy", "wary"]


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    docs, a, s = _t(spark, d, "asset_docs", "assets", "schema_fields")
    last = docs.where("doc is not null").groupBy("asset_id").agg(F.max_by("doc", F.struct("read_at", "doc")).alias("doc"))
    last = last.join(a.select(F.col("id").alias("asset_id"), "type").distinct(), "asset_id")
    root = [("CreatureRole", "", [f"role:{b}" for b in _BRANCHES], "Mood", _BRANCHES)] + [(f"role:{b}", "/States/*", None, None, None) for b in _BRANCHES[:2]]
    more = spark.createDataFrame(root, "asset_type string, json_pointer string, ref_scope array<string>, discriminator_property string, discriminator_values array<string>")
    return inherit.resolve_documents(last, _parents(spark, d), s.unionByName(more, allowMissingColumns=True))


_LAYERS = f"""{_CHAINS},
d AS (SELECT asset_id, arg_max(doc, (read_at, doc)) doc FROM (SELECT DISTINCT * FROM asset_docs WHERE doc IS NOT NULL) GROUP BY 1),
j AS (SELECT asset_id, CASE WHEN json_valid(n) THEN n::JSON END doc FROM (SELECT asset_id, regexp_replace(ltrim(doc, chr(65279)), '([:\\[,]\\s*)(NaN|-?Infinity)', '\\1null', 'g') n FROM d)),
s AS (SELECT c.asset_id, c.truncated, c.missing_parent, unnest(c.chain) layer, generate_subscripts(c.chain, 1) hop FROM chains c WHERE c.asset_id IN (SELECT asset_id FROM d)),
l AS (SELECT s.*, j.doc, min(CASE WHEN j.doc IS NULL THEN s.hop END) OVER (PARTITION BY s.asset_id) gap FROM s LEFT JOIN j ON j.asset_id = s.layer),
u AS (SELECT * FROM l WHERE gap IS NULL OR hop < gap),
t AS (SELECT DISTINCT id asset_id, type FROM assets),
m AS (SELECT asset_id, arg_min(json_extract_string(doc, '$.Mood'), hop) mood FROM u WHERE json_type(doc) = 'OBJECT' AND json_type(doc, '$.Mood') = 'VARCHAR' AND json_extract_string(doc, '$.Mood') IN ('calm', 'shy', 'wary') GROUP BY 1),
scopes AS (SELECT t.asset_id, CASE WHEN t.type = 'CreatureRole' AND m.mood IS NOT NULL THEN 'role:' || m.mood ELSE t.type END scope FROM t LEFT JOIN m USING (asset_id)),
nb AS (SELECT asset_id, coalesce(min(CASE WHEN json_type(doc) <> 'OBJECT' THEN hop END), 99) bad FROM u GROUP BY 1),
k AS (SELECT u.asset_id, u.layer, u.hop, unnest(json_keys(u.doc)) k, u.doc FROM u JOIN nb USING (asset_id) WHERE u.hop < nb.bad),
depths AS (SELECT asset_id, max(hop) n FROM u GROUP BY 1),
o AS (SELECT k.asset_id, k.k, min(k.hop) near, arg_min(k.layer, k.hop) layer, arg_min(json_extract(k.doc, '$."' || k.k || '"'), k.hop) v, count(*) holders, arg_min(json_type(k.doc, '$."' || k.k || '"'), k.hop) ty FROM k GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_LAYERS} SELECT d.asset_id, p.n - 1 depth, coalesce(c.truncated AND g.gap IS NULL, false) truncated, coalesce(g.layer::VARCHAR, c.missing_parent) missing_parent, sc.scope FROM (SELECT DISTINCT asset_id FROM d) d JOIN chains c USING (asset_id) JOIN depths p USING (asset_id) JOIN scopes sc USING (asset_id) LEFT JOIN (SELECT asset_id, layer, gap FROM l WHERE hop = gap) g USING (asset_id)")
def inh02_scopes(spark, d):
    """Whose rules each readable document is merged by, how many parents it has, and which one is not there."""
    return _resolved(spark, d).where("depth is not null").select("asset_id", F.col("depth").cast("long").alias("depth"), "truncated", "missing_parent", "scope")


@query(f"WITH RECURSIVE {_LAYERS} SELECT asset_id, k \"key\", CASE WHEN ty IN ('VARCHAR', 'BOOLEAN') THEN json_extract_string(v, '$') WHEN ty IN ('BIGINT', 'UBIGINT') THEN json_extract_string(v, '$') END \"value\" FROM o WHERE ty NOT IN ('DOUBLE')")
def inh03_documents(spark, d):
    """The top-level fields of each document with what it inherits; values of texts, flags and whole numbers."""
    # the values of the map keep their own JSON text
    each = _resolved(spark, d).where("doc is not null").select("asset_id", F.explode(F.map_entries(F.from_json("doc", "map<string,string>"))).alias("e")).select("asset_id", "e.key", "e.value")
    text = F.when(~F.substring("value", 1, 1).isin("{", "["), F.col("value"))
    return each.where(F.coalesce(~F.col("value").rlike(r"^-?\d*\.\d|^-?\d+(\.\d+)?[eE]"), F.lit(True))).select("asset_id", "key", text.alias("value"))


_ORIGINS = f"""{_LAYERS},
w AS (SELECT o.asset_id, o.k, o.layer, o.near, CASE WHEN o.near > 1 THEN 'inherited' WHEN o.k = 'States' AND sc.scope IN ('role:calm', 'role:shy') AND o.ty = 'OBJECT' AND o.holders > 1 THEN 'merged' ELSE 'declared' END how FROM o JOIN scopes sc USING (asset_id) JOIN depths p USING (asset_id) JOIN nb USING (asset_id) WHERE p.n > 1 AND nb.bad > 2)"""


@query(f"WITH RECURSIVE {_ORIGINS} SELECT asset_id, '/' || replace(replace(k, '~', '~0'), '/', '~1') pointer, how, layer::VARCHAR source FROM w")
def inh04_origins(spark, d):
    """Where each top-level field of a document with parents came from."""
    each = _resolved(spark, d).select("asset_id", F.explode(F.from_json("origins", "map<string,array<string>>")).alias("pointer", "o"))
    return each.where(~F.col("pointer").substr(2, 1 << 30).contains("/")).select("asset_id", "pointer", F.col("o")[0].alias("how"), F.col("o")[1].alias("source"))


@query(f"WITH RECURSIVE {_ORIGINS} SELECT asset_id, count(*) FILTER (how = 'declared') declared, count(*) FILTER (how = 'inherited') inherited, count(*) FILTER (how = 'merged') merged FROM w GROUP BY 1")
def agg13_origin_tallies(spark, d):
    """How many top-level fields of each document with parents are its own, inherited or merged."""
    return inherit.origin_tallies(_resolved(spark, d))
