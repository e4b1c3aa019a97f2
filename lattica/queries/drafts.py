"""Queries of drafts laid over an index, of unions and of crossings between scopes. The first pack stands for the index, all other packs for drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.canonical import schema_pointer
from lattica.operators import crossings, graph, search
from lattica.plans import drafts
from lattica.queries.answers import _STARRED
from lattica.queries.index import _CONVENTION, _E, _t
from lattica.queries.more import ORACLE as _MORE
from lattica.queries.sources import _LEAVES, _STRINGS, _last_documents

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


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    (a,) = _t(spark, d, "assets")
    a = a.select("id", "pack_id", "logical_id", "type", "path", "is_effective").distinct()
    return a.where("pack_id = 1"), a.where("pack_id != 1")


_S = "c AS (SELECT DISTINCT asset_id, json_pointer, schema_pointer, raw_value FROM candidates WHERE value_kind = 'string'), a AS (SELECT DISTINCT id, pack_id, logical_id, type FROM assets), sf AS (SELECT DISTINCT asset_type, json_pointer, reference_target FROM schema_fields WHERE reference_target IS NOT NULL), s AS (SELECT c.*, a.type FROM c JOIN a ON a.id = c.asset_id WHERE a.pack_id <> 1)"


@query(
    f"""WITH {_S} SELECT DISTINCT s.asset_id src, t.id dst, 'asset' dst_kind, 'INHERITS_FROM' kind, s.json_pointer, 'high' confidence FROM s JOIN a t ON t.logical_id = s.raw_value AND t.type = s.type WHERE s.json_pointer = '/Parent' AND t.id <> s.asset_id
UNION ALL SELECT DISTINCT s.asset_id, t.id, 'asset', 'REFERENCES', s.json_pointer, 'high' FROM s JOIN sf ON sf.asset_type = s.type AND sf.json_pointer = s.schema_pointer JOIN a t ON t.logical_id = s.raw_value AND t.type = sf.reference_target WHERE s.json_pointer <> '/Parent' AND t.id <> s.asset_id
UNION ALL SELECT DISTINCT s.asset_id, t.id, 'asset', 'REFERENCES', s.json_pointer, CASE WHEN {_CONVENTION.replace('json_pointer', 's.json_pointer')} THEN 'medium' ELSE 'low' END FROM s LEFT JOIN sf ON sf.asset_type = s.type AND sf.json_pointer = s.schema_pointer JOIN a t ON t.logical_id = s.raw_value WHERE sf.asset_type IS NULL AND s.json_pointer <> '/Parent' AND t.id <> s.asset_id"""
)
def join34_draft_edges(spark, d):
    """Edges of drafts to whatever definition has the name, effective or not."""
    indexed, own = _split(spark, d)
    c, s = _t(spark, d, "candidates", "schema_fields")
    rows = c.join(own.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return graph.draft_edges(rows, own, indexed, s)


_DRAFT_LEAVES = (
    _LEAVES
    + rf""", r AS (SELECT asset_id, pointer json_pointer, s raw_value, 'string' value_kind FROM {_STRINGS} WHERE length(s) BETWEEN 1 AND CASE WHEN s LIKE '%/%' AND s LIKE '%.%' AND s NOT LIKE '% %' THEN 192 ELSE 96 END
UNION ALL SELECT asset_id, pointer, s, 'boolean' FROM v WHERE ty = 'BOOLEAN'
UNION ALL SELECT asset_id, pointer, CASE WHEN s::DOUBLE = floor(s::DOUBLE) THEN s::DOUBLE::BIGINT::VARCHAR ELSE s::DOUBLE::VARCHAR END, 'number' FROM v WHERE ty IN ('BIGINT', 'UBIGINT', 'DOUBLE')),
y AS (SELECT DISTINCT id asset_id, type FROM assets WHERE pack_id <> 1),
x AS (SELECT r.*, {_STARRED} p, CASE WHEN y.type IN (SELECT asset_type FROM schema_fields) THEN y.type END kind, CASE WHEN y.type = 'DropTable' THEN regexp_extract({_STARRED}, '^/Container(?:/Entries/\*/Container)*(/.*)$', 1) ELSE '' END inner_ FROM r JOIN y USING (asset_id)),
al AS (SELECT asset_id, json_pointer, raw_value, value_kind, CASE WHEN inner_ <> '' THEN inner_ ELSE p END schema_pointer, CASE WHEN inner_ <> '' THEN 'common:DropContainer' ELSE kind END schema_scope FROM x)
"""
)


def _draft_leaves(spark: SparkSession, d: str) -> DataFrame:
    (s,) = _t(spark, d, "schema_fields")
    return drafts.leaves(_last_documents(spark, d), _split(spark, d)[1], s)


@query(_DRAFT_LEAVES + "SELECT * FROM al")
def nst18_draft_leaves(spark, d):
    """Drafts' documents shredded and aligned."""
    return _draft_leaves(spark, d)


@query(_DRAFT_LEAVES + "SELECT schema_scope asset_type, schema_pointer json_pointer, string_agg(DISTINCT raw_value, '|' ORDER BY raw_value) vals, count(*) n, count(DISTINCT asset_id) n_assets FROM al WHERE schema_scope IS NOT NULL GROUP BY ALL")
def op16_draft_values(spark, d):
    """The values that drafts give each field."""
    return drafts.values(_draft_leaves(spark, d)).select("asset_type", "json_pointer", F.array_join("values", "|").alias("vals"), "n", "n_assets")


@query("WITH l AS (SELECT DISTINCT id, pack_id, path, type FROM assets), x AS (SELECT id, pack_id, type, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') dir, n FROM l, range(1, 12) r(n) WHERE n < len(string_split(path, '/'))), m AS (SELECT dir, n, max_by(type, (c, type)) type FROM (SELECT dir, n, type, count(*) c FROM x WHERE pack_id = 1 AND type IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT x.id, max_by(m.type, m.n) inferred FROM x JOIN m USING (dir, n) WHERE x.pack_id <> 1 GROUP BY x.id")
def join33_draft_types(spark, d):
    """Drafts' types as the majority of the index has them in the deepest folder."""
    indexed, own = _split(spark, d)
    return drafts.infer_types(own.select("id", "path"), indexed.select("path", "type"))


@query("SELECT type, count(DISTINCT logical_id) n, min(path) example, count(*) FILTER (pack_id <> 1) n_drafts FROM (SELECT DISTINCT id, pack_id, logical_id, type, path FROM assets) WHERE type IS NOT NULL GROUP BY 1")
def set04_overlay(spark, d):
    """Types over the index with drafts laid over it."""
    indexed, own = _split(spark, d)
    both = indexed.unionByName(own, allowMissingColumns=True)
    return both.where("type is not null").groupBy("type").agg(F.countDistinct("logical_id").alias("n"), F.min("path").alias("example"), F.count(F.when(F.col("pack_id") != 1, 1)).alias("n_drafts"))


@query(f"WITH docs AS ({_MORE['agg18_search_docs']}), l AS (SELECT docs.*, (SELECT min(pack_id) FROM assets WHERE id = docs.asset_id) = 1 indexed FROM docs) SELECT asset_id, locale, display_name, NOT indexed draft FROM l")
def set03_search_layers(spark, d):
    """The search documents of both layers, those of drafts marked."""
    (a, e, k) = _t(spark, d, "assets", "edges", "lang_keys")
    layer = lambda cond, mark: search.search_docs(a.where(cond), e, k).where("locale != ''").select("asset_id", "locale", "display_name", F.lit(mark).alias("draft"))
    return layer("pack_id = 1", False).unionByName(layer("pack_id != 1", True))


_DROP_POINTERS = rf"SELECT DISTINCT 'DropTable' asset_type, {_STARRED} json_pointer FROM candidates JOIN (SELECT DISTINCT id FROM assets WHERE type = 'DropTable') a ON a.id = asset_id"


@query(rf"""WITH q AS ({_DROP_POINTERS}), k AS (SELECT asset_type, json_pointer FROM schema_fields UNION SELECT asset_type, json_pointer FROM field_stats), i AS (SELECT *, regexp_extract(json_pointer, '^/Container(?:/Entries(?:/\*)?/Container){{0,8}}(/.*)$', 1) rest FROM q WHERE json_pointer <> '/Container') SELECT asset_type, json_pointer, '/Container' AS "at", 'common:DropContainer' AS "into", CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.asset_type = 'common:DropContainer' AND k.json_pointer = rest) THEN rest ELSE '' END continue_at FROM i WHERE starts_with(json_pointer, '/Container/')""")
def nst17_crossings(spark, d):
    """Where the pointers of drop tables go on that the type itself does not declare."""
    c, a, s, f = _t(spark, d, "candidates", "assets", "schema_fields", "field_stats")
    own = a.where("type = 'DropTable'").select(F.col("id").alias("asset_id")).distinct()
    asked = c.join(own, "asset_id", "left_semi").select(F.lit("DropTable").alias("asset_type"), schema_pointer(F.col("json_pointer")).alias("json_pointer")).distinct()
    return crossings.crossings(asked.where("json_pointer like '/Container/%'"), s, f)


@query("SELECT asset_type, '' json_pointer, 'Type' property, 'kind:' || asset_type || ':' || v branch, v \"value\" FROM (SELECT DISTINCT asset_type FROM schema_fields WHERE asset_type NOT LIKE '%:%'), (VALUES ('a'), ('b')) t(v)")
def op15_unions(spark, d):
    """The branches of unions and their discriminators' values; every type of the tables is given a union at its root."""
    (s,) = _t(spark, d, "schema_fields")
    types = s.where("asset_type not like '%:%'").select("asset_type").distinct()
    branches = F.array(*[F.concat(F.lit("kind:"), "asset_type", F.lit(f":{v}")) for v in "ab"])
    roots = types.select("asset_type", F.lit("").alias("json_pointer"), branches.alias("ref_scope"), F.array(F.lit("a"), F.lit("b")).alias("discriminator_values"))
    return crossings.unions(s.unionByName(roots, allowMissingColumns=True))


_NESTED = "'/Repair/Plan', '/Repair/Parent'"


@query(rf"""WITH {_E}, n AS (SELECT src, dst, dst_kind, kind, replace(json_pointer, {_NESTED}) json_pointer, confidence FROM e WHERE json_pointer = '/Repair/Plan'), l AS (SELECT DISTINCT asset_id, schema_scope FROM candidates WHERE json_pointer = '/Repair/Plan' AND schema_scope IS NOT NULL)
SELECT DISTINCT n.src, n.dst, n.dst_kind, CASE WHEN x THEN 'INHERITS_FROM' ELSE n.kind END kind, n.json_pointer, CASE WHEN x THEN 'high' ELSE n.confidence END confidence FROM (SELECT n.*, n.kind = 'REFERENCES' AND n.dst_kind = 'asset' AND EXISTS (SELECT 1 FROM l JOIN a ON a.id = n.dst WHERE l.asset_id = n.src AND l.schema_scope = 'Item' AND a.type = 'CraftPlan') x FROM n) n""")
def join11_nested_parents(spark, d):
    """References of nested parents become inheritance where the field's scope is a branch of the target's root union. Repairs' plans are
    taken for nested parents, and plans for a union of items."""
    c, a, f, k, s = _t(spark, d, "candidates", "assets", "files", "lang_keys", "schema_fields")
    nested = lambda name: F.replace(F.col(name), F.lit("/Repair/Plan"), F.lit("/Repair/Parent")).alias(name)
    e = graph.resolve(c, a, f, k, s).where("json_pointer = '/Repair/Plan'")
    e = e.select("src", "dst", "dst_kind", "kind", nested("json_pointer"), "confidence")
    leaves = c.select("asset_id", nested("json_pointer"), "schema_scope", nested("schema_pointer")).distinct()
    roots = spark.createDataFrame([("CraftPlan", "", ["Item", "Other"])], "asset_type string, json_pointer string, ref_scope array<string>")
    return graph.promote(e, leaves, a, s.unionByName(roots, allowMissingColumns=True))


@query(f"""WITH {_E}, tw AS (SELECT id, logical_id, type FROM a UNION ALL SELECT -id, logical_id, 'Twin' FROM a WHERE id % 3 = 0),
te AS (SELECT DISTINCT src, dst, json_pointer FROM e WHERE dst_kind = 'asset' UNION ALL SELECT DISTINCT src, -dst, json_pointer FROM e WHERE dst_kind = 'asset' AND dst % 3 = 0),
g AS (SELECT DISTINCT te.src, te.json_pointer, tw.logical_id, tw.type FROM te JOIN tw ON tw.id = te.dst)
SELECT g.logical_id, g.type, count(*) shared FROM g WHERE EXISTS (SELECT 1 FROM g o WHERE o.src = g.src AND o.json_pointer = g.json_pointer AND o.logical_id = g.logical_id AND o.type IS DISTINCT FROM g.type) GROUP BY ALL""")
def join18_overlap_of_namesakes(spark, d):
    """How many of a name's edges also point at its namesake of another type, where every third asset has one."""
    c, a, f, k, s = _t(spark, d, "candidates", "assets", "files", "lang_keys", "schema_fields")
    e = graph.resolve(c, a, f, k, s).where("dst_kind = 'asset'")
    twins = a.where("id % 3 = 0").select((-F.col("id")).alias("id"), "logical_id", F.lit("Twin").alias("type"))
    doubled = e.unionByName(e.where("dst % 3 = 0").withColumn("dst", -F.col("dst")))
    return graph.overlap(doubled, a.select("id", "logical_id", "type").unionByName(twins))
