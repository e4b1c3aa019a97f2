"""Queries p1 to p6 over the asset index tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.canonical import canonical_digest, canonical_kind, canonical_path, canonical_pointer, decimal_value, flag_value, trimmed, whole_value
from lattica.operators import hierarchy, incremental, intervals, nested, orphans, snapshots, wide
from lattica.session import shared_folder, small_side, table

# Texts that stand for "no reference" (compared in lower case)
NO_REFERENCE = ("none", "default", "null", "true", "false", "any", "all")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = snapshots.snapshot_changes(
        table(spark, d, "asset_snapshots"),
        version=F.col("snapshot_no"), scope=F.col("pack_id"), key=canonical_path(F.col("path")),
        identity=[F.col("logical_id")], digest=canonical_digest(F.col("content_hash")), delivered=F.col("delivered_at"), ties=[F.col("id")],
    )
    return found.select(F.col("version").alias("snapshot_no"), F.col("scope").alias("pack_id"), F.col("key").alias("path"), "change")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("snapshot_no", "pack_id", "change").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "index_runs").where(F.lower(trimmed(F.col("status"))) == "ok").select("run_no").distinct()
    done = table(spark, d, "run_items").where(F.lower(trimmed(F.col("state"))) == "done").join(ok, "run_no", "left_semi")
    live = table(spark, d, "assets").where("removed_at is null")
    digest = canonical_digest(F.col("content_hash")).alias("digest")
    return incremental.unprocessed(
        live.select(F.col("id").alias("seq"), digest, F.col("last_changed_epoch").alias("epoch")),
        done.select(F.col("asset_id").alias("seq"), F.col("run_no").alias("run"), digest, "epoch"),
    ).withColumnRenamed("seq", "asset_id")


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Which run of a ledger processed each asset: run 0 sees the first pack's assets, the next run fails before it
    commits, and run 1 finds all other numbers, late ones in between the first run's among them."""
    a = table(spark, d, "assets").select("id", "pack_id")
    ledger = intervals.Ledger(spark, shared_folder(spark, f"ledger-{uuid.uuid4().hex}"))

    def output(run: int, gaps: intervals.Gaps) -> DataFrame:
        todo = intervals.numbers(gaps.intervals, "id")
        return a.select("id").distinct().join(todo, "id").select(F.col("id").alias("asset_id"), F.lit(run).alias("run"))

    gaps = ledger.gaps(intervals.islands(a.where("pack_id = 1"), "id"))
    ledger.commit(output(0, gaps), gaps)
    everything = intervals.islands(a, "id")
    lost = ledger.gaps(everything)
    output(-1, lost).write.parquet(f"{ledger.path}/run-lost/output")
    gaps = ledger.gaps(everything)
    ledger.commit(output(1, gaps), gaps)
    return ledger.outputs()


def _parent_links(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "assets").select("id").distinct()
    links = table(spark, d, "edges").where(
        (F.col("dst_kind") == "asset") & (canonical_pointer(F.col("json_pointer")) == "/Parent") & (canonical_kind(F.col("kind")) == "INHERITSFROM")
    )
    links = links.select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()
    return links.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.roots(_parent_links(spark, d))
    return found.select(F.col("node").alias("asset_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.paths(_parent_links(spark, d))
    return found.select(F.col("node").alias("asset_id"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.descendants(hierarchy.paths(_parent_links(spark, d)))
    return found.select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("descendant_id"), "distance")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fields = (
        table(spark, d, "schema_fields")
        .where("reference_target is not null")
        .select(F.col("asset_type").alias("schema_scope"), canonical_pointer(F.col("json_pointer")).alias("field"), "reference_target")
        .distinct()
    )
    value = trimmed(F.col("raw_value"))
    refs = (
        table(spark, d, "candidates")
        .where("value_kind = 'string'")
        .select("id", "schema_scope", canonical_pointer(F.col("schema_pointer")).alias("field"), "raw_value", "seen_at")
        .join(small_side(fields), ["schema_scope", "field"])
        .withColumn("value", value)
        .where((F.col("value") != "") & ~F.lower("value").isin(*NO_REFERENCE))
    )
    kind = F.col("reference_target")
    refs = refs.select(
        F.col("id").alias("ref_id"),
        F.when(kind == "file", "files").when(kind == "lang_key", "lang_keys").otherwise(F.concat(F.lit("assets:"), kind)).alias("target"),
        F.when(kind == "file", F.concat(F.lit("Common/"), F.col("value"))).otherwise(F.col("value")).alias("key"),
        F.col("seen_at").alias("at"),
    )
    times = ["added_at", "removed_at"]
    parents = (
        table(spark, d, "assets")
        .select(F.concat(F.lit("assets:"), F.col("type")).alias("target"), F.col("logical_id").alias("key"), *times)
        .unionByName(table(spark, d, "files").select(F.lit("files").alias("target"), F.col("path").alias("key"), *times))
        .unionByName(table(spark, d, "lang_keys").select(F.lit("lang_keys").alias("target"), F.concat("root", F.lit("."), "key").alias("key"), *times))
    )
    return refs, parents


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs, parents = _references(spark, d)
    named = orphans.orphans(refs, parents).select(F.col("ref_id").alias("candidate_id"), F.split("target", ":")[0].alias("target_table"), "at", "reason")
    resolved = table(spark, d, "candidates").select("id", F.col("resolved_edge_id").alias("edge"), "seen_at")
    lost = orphans.missing(resolved, table(spark, d, "edges").select(F.col("id").alias("edge")), "edge")
    edges = lost.select(F.col("id").alias("candidate_id"), F.lit("edges").alias("target_table"), F.col("seen_at").alias("at"), F.lit("missing").alias("reason"))
    return named.unionByName(edges).select("candidate_id", "target_table", F.date_format("at", "yyyy-MM").alias("period"), "reason").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("target_table", "period", "reason").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "assets").where("type = 'Item'").select(F.col("id").alias("asset_id")).distinct()
    rows = table(spark, d, "candidates").select("asset_id", "id", "seen_at", "raw_value", canonical_pointer(F.col("schema_pointer")).alias("attribute"))
    rows = rows.join(items, "asset_id", "left_semi")

    def text(c):
        return F.when(trimmed(c) != "", trimmed(c))

    def milli(c):
        return F.round(decimal_value(c) * 1000).cast("bigint")

    found = wide.widen(
        rows.select(F.col("asset_id").alias("entity"), "attribute", F.col("raw_value").alias("value"), F.col("seen_at").alias("seen"), F.col("id").alias("tie")),
        {
            "quality": ("/Quality", text),
            "item_level": ("/ItemLevel", whole_value),
            "max_stack": ("/MaxStack", whole_value),
            "weight_milli": ("/Weight", milli),
            "tradable": ("/Tradable", flag_value),
            "durability": ("/Durability", whole_value),
        },
    )
    return found.withColumnRenamed("entity", "asset_id")


def _present_nodes(spark: SparkSession, d: str, rows_only: bool = False) -> DataFrame:
    """Nodes of the document of each asset that was read last and can be read."""
    docs = table(spark, d, "asset_docs").where("doc is not null").select("asset_id", "doc", "read_at")
    last = docs.where(nested.readable(F.col("doc"))).groupBy("asset_id").agg(F.max(F.struct("read_at", "doc")).alias("m"))
    return nested.shred(last.select(F.col("asset_id").alias("rid"), F.col("m.doc").alias("doc")), rows_only=rows_only)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.elements(_present_nodes(spark, d, rows_only=True)).select(F.col("rid").alias("asset_id"), "element_pointer", "parent_pointer")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.elements(_present_nodes(spark, d, rows_only=True))
    return rows.groupBy(F.col("table").alias("schema_path")).agg(F.count("*").alias("n_rows"), F.countDistinct("rid").alias("n_assets"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    cells = nested.leaves(_present_nodes(spark, d))
    return cells.select(F.col("rid").alias("asset_id"), F.col("table").alias("schema_path"), F.array_join(F.col("row_label").cast("array<string>"), ".").alias("row_label"), F.col("column").alias("column_path"), "kind", "value")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_ledger, p3_found, p3_paths, p3_descendants, p4_found, p4_report, p5_found, p6_found, p6_tables, p6_values)}

_WS = r"[\s\x1c-\x1f\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _digest(c: str) -> str:
    return f"nullif(regexp_replace(lower({_trim(c)}), '^[a-z0-9_-]*:\\s*', ''), '')"


def _pointer(c: str) -> str:
    return f"('/' || regexp_replace({_trim(c)}, '^/+|/+$', '', 'g'))"


_P1 = f"""
WITH d AS (SELECT DISTINCT * FROM asset_snapshots),
c AS (SELECT snapshot_no v, pack_id p, array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') k, logical_id l, {_digest('content_hash')} h, delivered_at t, id FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY v, p, k ORDER BY t DESC NULLS LAST, id DESC) n FROM c),
l AS (SELECT v, p, k, l, h FROM r WHERE n = 1),
s AS (SELECT p, v, lag(v) OVER (PARTITION BY p ORDER BY v) pv FROM (SELECT DISTINCT p, v FROM l)),
b AS (SELECT coalesce(n.v, o.v2) v, coalesce(n.p, o.p) p, coalesce(n.k, o.k) k,
  CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN n.l <> o.l OR n.h <> o.h THEN 'changed' END change
  FROM (SELECT l.*, s.pv FROM l JOIN s USING (p, v) WHERE s.pv IS NOT NULL) n
  FULL OUTER JOIN (SELECT l.*, s.v v2 FROM l JOIN s ON s.p = l.p AND s.pv = l.v) o ON n.p = o.p AND n.k = o.k AND n.v = o.v2)
"""

_P3 = f"""
WITH RECURSIVE a AS (SELECT DISTINCT id FROM assets),
e AS (SELECT DISTINCT src, dst FROM edges WHERE dst_kind = 'asset' AND {_pointer('json_pointer')} = '/Parent' AND upper(regexp_replace(kind, '[^\\pL\\pN]', '', 'g')) = 'INHERITSFROM'
  AND src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)),
n AS (SELECT src id FROM e UNION SELECT dst FROM e),
t AS (SELECT id, id root, 0 depth, [id] path FROM n WHERE id NOT IN (SELECT src FROM e)
  UNION ALL SELECT e.src, t.root, t.depth + 1, list_append(t.path, e.src) FROM t JOIN e ON e.dst = t.id),
bad AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM t)),
w AS (SELECT id, e.dst x, 1 steps FROM bad JOIN e ON e.src = id UNION SELECT w.id, e.dst, w.steps + 1 FROM w JOIN e ON e.src = w.x WHERE w.steps <= (SELECT count(*) FROM bad)),
ring AS (SELECT DISTINCT id FROM w WHERE x = id)
"""

_P4 = f"""
WITH c AS (SELECT DISTINCT id, schema_scope, {_pointer('schema_pointer')} f, {_trim('raw_value')} v, value_kind, seen_at FROM candidates),
s AS (SELECT DISTINCT asset_type, {_pointer('json_pointer')} f, reference_target g FROM schema_fields WHERE reference_target IS NOT NULL),
r AS (SELECT c.id, c.seen_at, CASE g WHEN 'file' THEN 'files' WHEN 'lang_key' THEN 'lang_keys' ELSE 'assets' END t, CASE WHEN g NOT IN ('file', 'lang_key') THEN g ELSE '' END y,
  CASE g WHEN 'file' THEN 'Common/' || v ELSE v END k FROM c JOIN s ON s.asset_type = c.schema_scope AND s.f = c.f
  WHERE value_kind = 'string' AND v <> '' AND lower(v) NOT IN ('none', 'default', 'null', 'true', 'false', 'any', 'all')),
p AS (SELECT 'assets' t, type y, logical_id k, added_at, removed_at FROM assets WHERE type IS NOT NULL UNION ALL SELECT 'files', '', path, added_at, removed_at FROM files
  UNION ALL SELECT 'lang_keys', '', root || '.' || key, added_at, removed_at FROM lang_keys WHERE root IS NOT NULL),
j AS (SELECT r.id, r.t, r.seen_at, count(p.k) n, bool_or(p.added_at <= r.seen_at AND (p.removed_at IS NULL OR p.removed_at > r.seen_at)) here, bool_or(p.added_at > r.seen_at) later
  FROM r LEFT JOIN p ON p.t = r.t AND p.y = r.y AND p.k = r.k GROUP BY r.id, r.t, r.y, r.k, r.seen_at),
o AS (SELECT id candidate_id, t target_table, strftime(seen_at, '%Y-%m') period, CASE WHEN n = 0 THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END reason FROM j WHERE here IS NOT TRUE
  UNION ALL SELECT DISTINCT id, 'edges', strftime(seen_at, '%Y-%m'), 'missing' FROM candidates WHERE resolved_edge_id IS NOT NULL AND resolved_edge_id NOT IN (SELECT id FROM edges))
"""

_NUM = f"CASE WHEN regexp_full_match({_trim('raw_value')}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]{{1,3}})?') THEN try_cast(ltrim({_trim('raw_value')}, '+') AS DOUBLE) END"


def _last(pointer: str, read: str) -> str:
    return f"(SELECT asset_id, arg_max({read}, (seen_at, id)) x FROM i WHERE f = '{pointer}' AND {read} IS NOT NULL GROUP BY 1)"


_WHOLE = "CASE WHEN num = floor(num) THEN num::BIGINT END"
_FLAG = "CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', '0') THEN 'false' END"
_P5 = f"""
WITH i AS (SELECT DISTINCT asset_id, id, seen_at, {_pointer('schema_pointer')} f, {_trim('raw_value')} v, {_NUM} num FROM candidates WHERE asset_id IN (SELECT id FROM assets WHERE type = 'Item'))
SELECT asset_id, q.x quality, l.x item_level, m.x max_stack, w.x weight_milli, t.x tradable, u.x durability
FROM {_last('/Quality', "nullif(v, '')")} q FULL JOIN {_last('/ItemLevel', _WHOLE)} l USING (asset_id) FULL JOIN {_last('/MaxStack', _WHOLE)} m USING (asset_id)
FULL JOIN {_last('/Weight', 'round(num * 1000)::BIGINT')} w USING (asset_id) FULL JOIN {_last('/Tradable', _FLAG)} t USING (asset_id) FULL JOIN {_last('/Durability', _WHOLE)} u USING (asset_id)
"""

_P6 = r"""
WITH RECURSIVE d AS (SELECT DISTINCT asset_id, ltrim(doc, chr(65279)) doc, read_at FROM asset_docs WHERE doc IS NOT NULL),
u AS (SELECT asset_id, read_at, CASE WHEN starts_with(doc, '"') AND json_valid(doc) THEN ltrim(json_extract_string(doc, '$'), chr(65279)) ELSE doc END doc FROM d),
n AS (SELECT asset_id, read_at, regexp_replace(doc, '([:\[,]\s*)(NaN|-?Infinity)', '\1null', 'g') doc FROM u),
l AS (SELECT asset_id, arg_max(doc, (read_at, doc)) doc FROM n WHERE json_valid(doc) AND json_type(doc) = 'OBJECT' GROUP BY 1),
t AS (SELECT asset_id, doc::JSON node, '' pointer, '' nearest, '' parent, '' path, false el FROM l
 UNION ALL SELECT * FROM (
  SELECT asset_id, json_extract(node, '$."' || k || '"') node, pointer || '/' || replace(replace(k, '~', '~0'), '/', '~1') pointer, nearest, parent, path || '/' || replace(replace(k, '~', '~0'), '/', '~1') path, false el
  FROM (SELECT *, unnest(json_keys(node)) k FROM t WHERE json_type(node) = 'OBJECT') WHERE NOT starts_with(k, '$')
  UNION ALL
  SELECT asset_id, e, pointer || '/' || (i - 1), CASE WHEN json_type(e) = 'OBJECT' THEN pointer || '/' || (i - 1) ELSE nearest END, nearest, path || '/*', json_type(e) = 'OBJECT'
  FROM (SELECT *, unnest(node::JSON[]) e, generate_subscripts(node::JSON[], 1) i FROM t WHERE json_type(node) = 'ARRAY'))),
x AS (SELECT asset_id, pointer element_pointer, parent parent_pointer, path schema_path FROM t WHERE el)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT v snapshot_no, p pack_id, k path, change FROM b WHERE change IS NOT NULL",
    "p1_counts": _P1 + "SELECT v snapshot_no, p pack_id, change, count(*) n FROM b WHERE change IS NOT NULL GROUP BY ALL",
    "p2_found": f"""
WITH ok AS (SELECT DISTINCT run_no FROM index_runs WHERE lower({_trim('status')}) = 'ok'),
i AS (SELECT asset_id, {_digest('content_hash')} h, epoch, row_number() OVER (PARTITION BY asset_id ORDER BY run_no DESC, epoch DESC) n FROM run_items WHERE lower({_trim('state')}) = 'done' AND run_no IN (SELECT run_no FROM ok)),
a AS (SELECT DISTINCT id, {_digest('content_hash')} h, last_changed_epoch e FROM assets WHERE removed_at IS NULL)
SELECT DISTINCT a.id asset_id FROM a LEFT JOIN i ON i.asset_id = a.id AND i.n = 1
WHERE i.asset_id IS NULL OR a.h <> i.h OR ((a.h IS NULL OR i.h IS NULL) AND a.e > i.epoch)""",
    "p2_ledger": "SELECT id asset_id, CASE WHEN bool_or(pack_id = 1) THEN 0 ELSE 1 END run FROM assets GROUP BY id",
    "p3_found": _P3 + "SELECT id asset_id, root root_id, depth FROM t UNION ALL SELECT w.id, min(w.x), -1 FROM w JOIN ring ON ring.id = w.x GROUP BY w.id",
    "p3_paths": _P3 + "SELECT id asset_id, array_to_string(path, '/') path FROM t UNION ALL SELECT id, '' FROM bad",
    "p3_descendants": _P3 + ", d AS (SELECT id, depth, unnest(path) anc, unnest(range(len(path))) lvl FROM t) SELECT anc ancestor_id, id descendant_id, depth - lvl distance FROM d WHERE anc <> id",
    "p4_found": _P4 + "SELECT * FROM o",
    "p4_report": _P4 + "SELECT target_table, period, reason, count(*) n FROM o GROUP BY ALL",
    "p5_found": _P5,
    "p6_found": _P6 + "SELECT asset_id, element_pointer, parent_pointer FROM x",
    "p6_tables": _P6 + "SELECT schema_path, count(*) n_rows, count(DISTINCT asset_id) n_assets FROM x GROUP BY 1",
}
