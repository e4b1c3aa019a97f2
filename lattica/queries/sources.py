"""Queries of sources and sinks: what is written in a source's format and read back must be what the tables hold."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions.canonical import trimmed
from lattica.operators import nested
from lattica.queries.index import _t
from lattica.queries.problems import _P6, _trim, p6_values
from lattica.session import shared_folder
from lattica.sources import archives, declared, evaluation, lang, lenient_json

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


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that Python reads: the folder has to be one of a mounted file system."""
    path = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    if not path.startswith(("file:", "/")):
        raise RuntimeError(f"{path}: archives are read by Python and need a mounted file system")
    return "/" + path.removeprefix("file:").lstrip("/")


_DOCS = "SELECT DISTINCT 'Server/docs/' || asset_id || '/' || md5(doc) || '.json' path, doc FROM asset_docs WHERE doc IS NOT NULL"


def _archived(spark: SparkSession, d: str) -> list[str]:
    """The documents of asset_docs in zip archives."""
    (docs,) = _t(spark, d, "asset_docs")
    rows = docs.where("doc is not null").select(F.concat(F.lit("Server/docs/"), "asset_id", F.lit("/"), F.md5("doc"), F.lit(".json")).alias("path"), F.encode("doc", "utf-8").alias("content")).distinct()
    return archives.write(rows.repartition("path"), _folder(spark, "archives"))


@query(f"SELECT path, strlen(doc) size FROM ({_DOCS})")
def src01_archive_entries(spark, d):
    """The directory of archives that hold all documents."""
    return archives.entries(spark, _archived(spark, d)).select("path", "size")


@query(f"SELECT path, md5(doc) digest, strlen(doc) n FROM ({_DOCS})")
def src02_point_reads(spark, d):
    """Each document read at its stored place, without its archive's directory."""
    found = archives.entries(spark, _archived(spark, d), content=True, prefix="Server/")
    return found.select("path", F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("n"))


@query("SELECT DISTINCT id, strlen(m) size, md5(m) digest FROM (SELECT id, '{\"Group\":' || coalesce('\"' || group_name || '\"', 'null') || ',\"Name\":\"' || name || '\",\"Version\":' || coalesce('\"' || version || '\"', '7') || '}' || chr(10) m FROM packs)")
def src03_folder(spark, d):
    """A folder of files, one for each pack's manifest."""
    files = archives.folder(spark, _manifests(spark, d))
    return files.select(F.regexp_extract("path", r"id=(\d+)/", 1).cast("long").alias("id"), "size", F.md5("content").alias("digest"))


def _manifests(spark: SparkSession, d: str) -> str:
    (packs,) = _t(spark, d, "packs")
    quoted = lambda c, other: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit(other))
    m = F.concat(F.lit('{"Group":'), quoted("group_name", "null"), F.lit(',"Name":"'), "name", F.lit('","Version":'), quoted("version", "7"), F.lit("}"))
    path = _folder(spark, "manifests")
    packs.select("id", m.alias("m")).distinct().repartition("id").write.partitionBy("id").text(path)
    return path


@query("SELECT DISTINCT id, group_name, name, version FROM packs")
def src09_manifests(spark, d):
    """Group, name and version of each pack out of its manifest; what is no text is null."""
    files = archives.folder(spark, _manifests(spark, d)).where("path like '%.txt'")
    return archives.manifests(files.select(F.regexp_extract("path", r"id=(\d+)/", 1).cast("long").alias("id"), "content"))


_READABLE = r"""SELECT DISTINCT asset_id, read_at, doc, CASE WHEN json_valid(n) THEN json_type(n) = 'OBJECT' ELSE false END ok, len(regexp_extract_all(u, '[:\[,]\s*(NaN|-?Infinity)')) repairs FROM (SELECT *, regexp_replace(u, '([:\[,]\s*)(NaN|-?Infinity)', '\1null', 'g') n FROM (SELECT *, CASE WHEN starts_with(b, '"') AND json_valid(b) THEN ltrim(json_extract_string(b, '$'), chr(65279)) ELSE b END u FROM (SELECT *, ltrim(doc, chr(65279)) b FROM asset_docs WHERE doc IS NOT NULL)))"""


@query(f"SELECT asset_id, read_at, md5(doc) digest FROM ({_READABLE}) WHERE NOT ok")
def src04_unreadable(spark, d):
    """The documents that cannot be read."""
    (docs,) = _t(spark, d, "asset_docs")
    return nested.unreadable(docs.distinct(), ["asset_id", "read_at", "doc"]).select("asset_id", "read_at", F.md5("doc").alias("digest"))


@query(f"SELECT asset_id, read_at, repairs::BIGINT repairs FROM ({_READABLE}) WHERE ok AND repairs > 0 AND NOT starts_with(ltrim(doc, chr(65279)), '\"')")
def src04_repairs(spark, d):
    """How many numbers of each readable document are not finite."""
    (docs,) = _t(spark, d, "asset_docs")
    fixed = docs.distinct().where("doc is not null").select("asset_id", "read_at", lenient_json.repaired(F.col("doc")).alias("r"))
    return fixed.where("r.error is null and size(r.repairs) > 0").select("asset_id", "read_at", F.size("r.repairs").cast("long").alias("repairs"))


@query("SELECT pack_id, locale, key, arg_max(value, id) \"value\" FROM lang_keys GROUP BY ALL")
def src05_lang_files(spark, d):
    """Language files of one key each, with comments, continued lines and repeated keys, read back."""
    (k,) = _t(spark, d, "lang_keys")
    line = F.concat(F.lit("# "), "id", F.lit(" = no\n"), "key", F.lit(" = \\\n"), "value", F.lit("\n"))
    files = k.groupBy("pack_id", "locale", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("id", line.alias("l")))), lambda x: x["l"]), "").alias("content"))
    read = lang.entries(files.select(F.concat_ws("\n", "pack_id", "locale", "key").alias("path"), "content"))
    place = F.split("path", "\n")
    return read.select(place[0].cast("long").alias("pack_id"), place[1].alias("locale"), "key", "value")


_CHAIN = ["pt-BR", "uk-UA", "fr-FR", "pt", "en-US"]


@query("SELECT key, arg_min(value, (p, value)) \"value\", arg_min(locale, (p, value)) locale FROM (SELECT DISTINCT key, locale, value, list_position(['pt-BR', 'uk-UA', 'fr-FR', 'pt', 'en-US'], locale) p FROM lang_keys) WHERE p > 0 GROUP BY 1")
def src06_fallbacks(spark, d):
    """Each key as seen from one locale, by a fallback file: what it names, then the language, then the default."""
    (k,) = _t(spark, d, "lang_keys")
    files = spark.createDataFrame([("Server/Languages/fallback.lang", "# from = to\npt-BR = uk-UA\nuk-UA = fr-FR\n")], "path string, content string")
    ways = lang.fallbacks(files)
    assert lang.chain("pt-BR", ways) == _CHAIN
    return lang.resolve(k.select("key", "locale", "value").distinct(), "pt-BR", ways)


def _schema_documents(spark: SparkSession, d: str) -> str:
    """A folder of JSON-Schema files that say what schema_fields says. The declared fields are parameters of a fixed number."""
    (fields,) = _t(spark, d, "schema_fields")
    roots: dict[str, dict] = {}
    for f in fields.orderBy("asset_type", "json_pointer").collect():
        node = roots.setdefault(f["asset_type"], {"properties": {}, "x-asset": {"path": f["asset_type"]}})
        steps = f["json_pointer"].split("/")[1:]
        for i, step in enumerate(steps):
            leaf = i == len(steps) - 1
            if step == "*":
                node = node.setdefault("items", {"type": "any"} if leaf else {"type": "object"})
                continue
            if leaf and not f["optional"]:
                node.setdefault("required", []).append(step)
            node = node.setdefault("properties", {}).setdefault(step, {"type": "array"} if not leaf and steps[i + 1] == "*" else {"type": "object"})
        scopes = list(f["ref_scope"] or [])
        if f["declared_type"] == "$ref":
            node.clear()
            node["$ref"] = f"{scopes[0].split(':')[0]}.json#/definitions/{scopes[0].split(':')[1]}"
        else:
            node["type"] = f["declared_type"]
        if f["reference_target"]:
            node["x-asset"] = {"reference": f["reference_target"]}
    path = Path(_folder(spark, "schema"))
    path.mkdir(parents=True)
    for name, root in roots.items():
        if ":" not in name:
            (path / f"{name}.json").write_text(json.dumps(root))
    shared = {n.split(":")[1]: r for n, r in roots.items() if ":" in n}
    (path / "common.json").write_text(json.dumps({"definitions": shared}))
    return str(path)


@query("SELECT DISTINCT asset_type, json_pointer, declared_type, optional, reference_target, array_to_string(ref_scope, ',') ref_scope FROM schema_fields WHERE json_pointer NOT LIKE '%/*'")
def nst04_declared_fields(spark, d):
    """The declared fields flattened out of JSON-Schema files; the objects and lists on the way to them are left out."""
    found = declared.read(spark, _schema_documents(spark, d)).where("declared_type not in ('object', 'array') and json_pointer not like '%/*'")
    return found.select("asset_type", "json_pointer", "declared_type", "optional", "reference_target", F.array_join("ref_scope", ",").alias("ref_scope"))


@query("WITH RECURSIVE p AS (SELECT DISTINCT asset_type, json_pointer, regexp_replace(json_pointer, '/[^/]*$', '') up FROM schema_fields UNION SELECT asset_type, up, regexp_replace(up, '/[^/]*$', '') FROM p WHERE up <> '') SELECT asset_type, count(DISTINCT json_pointer) n FROM p WHERE json_pointer <> '' GROUP BY 1")
def src07_schema_folder(spark, d):
    """How many fields each namespace of a folder of schema files has, those on the way to others included."""
    return declared.read_all(spark, _schema_documents(spark, d)).fields.where("json_pointer != ''").groupBy("asset_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT asset_type \"type\", 'Server/' || asset_type || '/**/*.json' \"glob\", 'Server/' || asset_type || '/' prefix FROM schema_fields WHERE asset_type NOT LIKE '%:%'")
def src08_bindings(spark, d):
    """Types bound to globs by an editor's settings, and the folders before the globs' first wildcard."""
    (fields,) = _t(spark, d, "schema_fields")
    names = [r[0] for r in fields.where("asset_type not like '%:%'").select("asset_type").distinct().collect()]
    settings = json.dumps({"json.schemas": [{"fileMatch": [f"Server/{n}/**/*.json"], "url": f"./Schema/{n}.json"} for n in names] + [{"fileMatch": ["x"]}]})
    return spark.createDataFrame(declared.bindings(settings), "type string, glob string").withColumn("prefix", T.glob_prefix(F.col("glob")))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """(archive, path) of everything the packs hold."""
    p, a, f, k = _t(spark, d, "packs", "assets", "files", "lang_keys")
    each = a.select("pack_id", "path").unionByName(f.select("pack_id", "path")).unionByName(k.where("source_path is not null").select("pack_id", F.col("source_path").alias("path")))
    return each.join(p.select(F.col("id").alias("pack_id"), F.col("path").alias("archive")), "pack_id").select("archive", "path").distinct()


_ALL = "x AS (SELECT DISTINCT p.path archive, u.path FROM (SELECT pack_id, path FROM assets UNION ALL SELECT pack_id, path FROM files UNION ALL SELECT pack_id, source_path FROM lang_keys WHERE source_path IS NOT NULL) u JOIN packs p ON p.id = u.pack_id)"


@query(rf"WITH {_ALL} SELECT archive FROM x GROUP BY 1 HAVING bool_or(regexp_matches(path, '^(Server|Common|Client)/.+\.(json|lang)$'))")
def src10_admitted(spark, d):
    """The packs that hold assets or texts."""
    return archives.admitted(_paths(spark, d))


@query(rf"WITH {_ALL} SELECT archive, path FROM x WHERE path NOT LIKE '%.lang' AND path NOT LIKE '%.json'")
def prj03_files(spark, d):
    """What is neither an asset nor a text, by its suffix alone."""
    p = F.col("path")
    return _paths(spark, d).where(~p.endswith(".lang") & ~p.endswith(".json"))


@query("SELECT DISTINCT regexp_replace(path, '[^/]*$', '') prefix, count(*) n FROM (SELECT DISTINCT path FROM assets) GROUP BY 1")
def prj06_prefixes(spark, d):
    """The folders that globs over the assets' own folders stand for."""
    (a,) = _t(spark, d, "assets")
    glob = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.lit("*?.json"))
    return a.select("path").distinct().groupBy(T.glob_prefix(glob).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT phrase, tier, expected_any, must_not_rank_first FROM (SELECT value phrase, locale tier, string_agg(DISTINCT key, ',' ORDER BY key) expected_any, '' must_not_rank_first FROM lang_keys WHERE id % 100 = 0 GROUP BY value, locale)")
def src15_evaluation_set(spark, d):
    """Search cases, written as an evaluation set and read back: the texts of every hundredth language key."""
    (k,) = _t(spark, d, "lang_keys")
    cases = k.where("id % 100 = 0").groupBy(F.col("value").alias("phrase"), F.col("locale").alias("tier")).agg(F.array_sort(F.collect_set("key")).alias("expected_any"))
    path = _folder(spark, "evaluation")
    cases.repartition("phrase").select(F.to_json(F.struct(F.array(F.struct("phrase", "tier", "expected_any")).alias("cases"))).alias("doc")).write.text(path)
    lines = spark.read.text(path).select(F.from_json("value", f"cases array<{evaluation._CASE}>").alias("c")).select(F.explode("c.cases").alias("c")).select("c.*")
    return lines.select("phrase", "tier", F.array_join("expected_any", ",").alias("expected_any"), F.array_join(F.coalesce("must_not_rank_first", F.array().cast("array<string>")), ",").alias("must_not_rank_first"))


# --- documents -----------------------------------------------------------------------------------
_LAST = r"""d AS (SELECT asset_id, arg_max(doc, (read_at, doc)) doc FROM (SELECT DISTINCT * FROM asset_docs WHERE doc IS NOT NULL) GROUP BY 1),
l AS (SELECT asset_id, n doc FROM (SELECT asset_id, regexp_replace(ltrim(doc, chr(65279)), '([:\[,]\s*)(NaN|-?Infinity)', '\1null', 'g') n FROM d) WHERE json_valid(n))"""
_KEYS = "json_extract(node, '$.\"' || k || '\"') node, pointer || '/' || replace(replace(k, '~', '~0'), '/', '~1') pointer"
_WALK = r"""WITH RECURSIVE {last},
t AS (SELECT asset_id, doc::JSON node, '' pointer, '' schema FROM l
 UNION ALL SELECT * FROM (
  SELECT asset_id, {keys}, schema || '/' || CASE WHEN regexp_full_match(k, '[0-9]+') THEN '*' ELSE replace(replace(k, '~', '~0'), '/', '~1') END schema
  FROM (SELECT *, unnest(json_keys(node)) k FROM t WHERE json_type(node) = 'OBJECT') {skip}
  UNION ALL
  SELECT asset_id, e, pointer || '/' || (i - 1), schema || '/*' FROM (SELECT *, unnest(node::JSON[]) e, generate_subscripts(node::JSON[], 1) i FROM t WHERE json_type(node) = 'ARRAY'))),
v AS (SELECT *, json_type(node) ty, json_extract_string(node, '$') s FROM t WHERE json_type(node) NOT IN ('OBJECT', 'ARRAY', 'NULL'))
"""
_LEAVES = _WALK.format(last=_LAST, keys=_KEYS, skip="WHERE NOT starts_with(k, '$')")
_STRINGS = f"(SELECT asset_id, pointer, schema, {_trim('s')} s FROM v WHERE ty = 'VARCHAR')"


def _last_documents(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = _t(spark, d, "asset_docs")
    return docs.where("doc is not null").groupBy("asset_id").agg(F.max_by("doc", F.struct("read_at", "doc")).alias("doc"))


@query(
    _LEAVES
    + f"""SELECT asset_id, pointer json_pointer, schema schema_pointer, s raw_value, 'string' value_kind FROM {_STRINGS} WHERE length(s) BETWEEN 1 AND CASE WHEN s LIKE '%/%' AND s LIKE '%.%' AND s NOT LIKE '% %' THEN 192 ELSE 96 END
UNION ALL SELECT asset_id, pointer, schema, s, 'boolean' FROM v WHERE ty = 'BOOLEAN'
UNION ALL SELECT asset_id, pointer, schema, CASE WHEN s::DOUBLE = floor(s::DOUBLE) THEN s::DOUBLE::BIGINT::VARCHAR ELSE s::DOUBLE::VARCHAR END, 'number' FROM v WHERE ty IN ('BIGINT', 'UBIGINT', 'DOUBLE')"""
)
def nst01_shred(spark, d):
    """The leaves of the documents read last of all that are not null."""
    return lenient_json.leaves(_last_documents(spark, d))


@query(
    _WALK.format(last=_LAST, keys=_KEYS, skip="")
    + r"SELECT asset_id, pointer json_pointer, regexp_extract(pointer, '[^/]*$') role, s reference FROM v WHERE ty = 'VARCHAR' AND regexp_full_match(s, '(server|common)\.[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)+')"
)
def nst03_text_references(spark, d):
    """The references to texts in the documents read last, with the role that their field's name gives them."""
    return lenient_json.text_references(_last_documents(spark, d))


@query(
    _P6
    + "SELECT asset_id, count(*) n_values, count(*) FILTER (json_type(node) = 'VARCHAR') n_strings, count(*) FILTER (json_type(node) IN ('BIGINT', 'UBIGINT', 'DOUBLE')) n_numbers, count(DISTINCT nearest) n_rows FROM t WHERE json_type(node) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND NOT el GROUP BY 1"
)
def p6_cells(spark, d):
    """How many values of what kind each asset's flat tables hold, nulls and numbers that are not finite left out, and in how many rows."""
    v = p6_values(spark, d).where("kind != 'null' and not (kind = 'number' and value in ('NaN', 'Infinity', '-Infinity'))")
    return v.groupBy("asset_id").agg(
        F.count("*").alias("n_values"), F.count(F.when(F.col("kind") == "string", 1)).alias("n_strings"), F.count(F.when(F.col("kind") == "number", 1)).alias("n_numbers"),
        F.countDistinct("schema_path", "row_label").alias("n_rows"),
    )


@query(f"SELECT DISTINCT id, {_trim('raw_value')} \"value\" FROM candidates WHERE {_trim('raw_value')} <> raw_value")
def prj10_trimmed(spark, d):
    """Values that carry white space at an end, without it."""
    (c,) = _t(spark, d, "candidates")
    return c.select("id", "raw_value", trimmed(F.col("raw_value")).alias("value")).where("value != raw_value").select("id", "value").distinct()


_BUILT = f"""WITH d AS (SELECT DISTINCT asset_id, doc FROM asset_docs WHERE doc IS NOT NULL), a AS (SELECT DISTINCT id, type, path FROM assets WHERE id IN (SELECT asset_id FROM d)),
l AS (SELECT key, root, locale, arg_max(value, id) FROM lang_keys WHERE root IS NOT NULL AND locale <> '' GROUP BY ALL)"""


@query(f"{_BUILT} SELECT 'assets' what, count(DISTINCT id) n FROM a UNION ALL SELECT 'typed', count(DISTINCT id) FROM a WHERE type IS NOT NULL UNION ALL SELECT 'files', count(DISTINCT path) FROM files UNION ALL SELECT 'lang_keys', count(*) FROM l UNION ALL SELECT 'search names', count(DISTINCT id) FROM a")
def op11_index(spark, d):
    """An index built from archives that hold the tables' documents, files and texts: what it reports of itself."""
    from lattica.plans import build

    docs, a, f, k, s = _t(spark, d, "asset_docs", "assets", "files", "lang_keys", "schema_fields")
    last = docs.where("doc is not null").groupBy(F.col("asset_id").alias("id")).agg(F.max_by("doc", F.struct("read_at", "doc")).alias("content"))
    kinds = a.select("id", F.coalesce("type", F.lit("Loose")).alias("kind")).distinct()
    assets = last.join(kinds, "id").select(F.concat(F.lit("Server/"), "kind", F.lit("/"), "id", F.lit(".json")).alias("path"), "content")
    texts = k.where("root is not null and locale != ''").groupBy("key", "root", "locale").agg(F.max_by("value", "id").alias("value"), F.floor(F.min("id") / 1000).alias("part"))
    lines = texts.groupBy("locale", "root", "part").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit(" = "), "value"))), "\n").alias("content"))
    lines = lines.select(F.concat(F.lit("Server/Languages/"), "locale", F.lit("/"), "part", F.lit("/"), "root", F.lit(".lang")).alias("path"), "content")
    every = assets.unionByName(lines).unionByName(f.select("path", F.lit("").alias("content")).distinct())
    paths = archives.write(every.repartition("path"), _folder(spark, "pack"))
    types = [r[0] for r in a.where("type is not null").select("type").distinct().collect()]
    report = build.build(spark, [(p, "vanilla", 3) for p in paths], s, [(f"Server/{t}/", "", t) for t in types], shared_folder(spark, f"index-{uuid.uuid4().hex}"))
    names = spark.read.parquet(_index_of(report) + "/search_docs.parquet").where("locale = ''").agg(F.count("*").alias("n")).select(F.lit("search names").alias("what"), "n")
    return report.where("what in ('assets', 'typed', 'files', 'lang_keys')").unionByName(names)


def _index_of(report: DataFrame) -> str:
    return report.inputFiles()[0].rsplit("/meta.parquet", 1)[0]
