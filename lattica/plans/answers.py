"""The questions the index answers, each as a DataFrame with caveats."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.canonical import trimmed
from lattica.functions.text import is_container, translation_key
from lattica.operators import crossings, graph, inherit, profile, search
from lattica.operators import stations as stations_
from lattica.session import table

TABLES = ("packs", "assets", "files", "lang_keys", "edges", "candidates", "schema_fields", "field_stats")
#: Rows of answers by default, and at most.
LIMITS = {"search": 20, "search_schema": 20, "search_lang": 20, "describe": 60, "refs": 40, "types": 200, "undocumented": 40, "bench": 200}
MOST_ROWS = 1000
#: Rows of parts of answers: values that break a field's references, namesakes, and declarers of a link.
BROKEN, SAME_NAME, LINK_DECLARERS = 8, 8, 6
STATIONS = stations_.Spec(("common:Bench",))


@dataclass
class Result:
    rows: DataFrame
    caveats: list[str] = field(default_factory=list)

    def table(self) -> DataFrame:
        """The rows with the caveats, sorted, in a column of their own."""
        return self.rows.withColumn("caveats", F.lit(",".join(sorted(set(self.caveats)))))


def repaired_pointer(pointer: str) -> tuple[str, bool]:
    """A field's pointer with one leading and no trailing slash, and whether a shell had made a path of this machine of it: such a path is cut behind its git or usr folder, else behind its drive."""
    mangled = re.match(r"[A-Za-z]:[\\/]", pointer) is not None
    if mangled:
        parts = pointer.replace("\\", "/").split("/")
        root = next((i for i, p in enumerate(parts) if p.lower() in ("git", "usr")), 0)
        pointer = "/".join(parts[root + 1 :])
    return "/" + pointer.strip("/"), mangled


def shared_folder_of(first: Column, last: Column) -> Column:
    """The folder that the least and the greatest of some paths share, and so all between them."""
    a, b = F.split(first, "/"), F.split(last, "/")
    n = F.least(F.size(a), F.size(b)) - 1
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda k, i: F.when((k == i) & (i < n) & (F.get(a, i) == F.get(b, i)), k + 1).otherwise(k))
    return F.when(same > 0, F.concat(F.array_join(F.slice(a, F.lit(1), same), "/"), F.lit("/"))).otherwise("")


def numeric_order(values: Column) -> Column:
    """A list of texts in the order of their numbers if all are numbers, else as it is."""
    number = F.transform(values, lambda v: F.struct(trimmed(v).try_cast("double").alias("n"), v.alias("v")))
    every = F.forall(number, lambda x: x["n"].isNotNull() & ~F.isnan(x["n"]) & (F.abs(x["n"]) != float("inf")))
    return F.when(every, F.transform(F.array_sort(number), lambda x: x["v"])).otherwise(values)


class Index:
    """A folder of index tables, with a session's drafts laid over it.

    overlay maps table names to rows of drafts; answers see both, statistics only what is indexed.
    """

    def __init__(self, spark: SparkSession, folder: str, overlay: dict[str, DataFrame] | None = None, spec: stations_.Spec = STATIONS):
        self.spark, self.folder, self.overlay, self.spec = spark, folder, overlay or {}, spec

    def indexed(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        base = self.indexed(name)
        return base.unionByName(self.overlay[name], allowMissingColumns=True) if name in self.overlay else base

    def _cut(self, df: DataFrame, limit: int, caveats: list[str]) -> DataFrame:
        """At most limit rows; one more is fetched to tell that there are more."""
        limit = min(limit, MOST_ROWS)
        if df.limit(limit + 1).count() > limit:
            caveats.append("truncated")
        return df.limit(limit)

    def _owners(self, names: DataFrame, caveats: list[str]) -> None:
        """Caveats of the packs, other than the game's own, that names (logical_id[, type]) come from."""
        on = [F.col("a.logical_id") == F.col("n.logical_id"), *([F.col("a.type").eqNullSafe(F.col("n.type"))] if "type" in names.columns else [])]
        mine = self.assets.alias("a").join(names.distinct().alias("n"), on, "left_semi")
        kinds = mine.join(self.packs.select(F.col("id").alias("pack_id"), "kind"), "pack_id").agg(F.max(F.col("kind") == "archive").alias("other"), F.max(F.col("kind") == "working").alias("own")).first()
        caveats += [c for flag, c in ((kinds["other"], "third-party"), (kinds["own"], "working-pack")) if flag]

    def status(self) -> Result:
        """How many rows the tables have, and what of it is typed, declared, observed and joined."""
        a, k = self.indexed("assets"), self.indexed("lang_keys")
        s, f = self.indexed("schema_fields").where("json_pointer != ''"), self.indexed("field_stats")
        n = lambda name, df, count=F.count("*"): df.agg(count.cast("long").alias("n")).select(F.lit(name).alias("what"), "n")
        parts = [n(t, self.indexed(t)) for t in TABLES]
        parts += [n("typed", a.where("type is not null"), F.countDistinct("id")), n("declared", s), n("joined", s.select("asset_type", "json_pointer").join(f, ["asset_type", "json_pointer"])), n("locales", k, F.countDistinct("locale"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Result(out, ["join-incomplete"])

    def types(self, kind: str | None = None, limit: int = LIMITS["types"]) -> Result:
        """Every type with its assets, declared fields and shared folder, or the assets of one type."""
        c: list[str] = []
        if kind is None:
            n = self.schema_fields.where("json_pointer != ''").groupBy(F.col("asset_type").alias("type")).agg(F.count("*").alias("n_fields"))
            t = self.assets.where("type is not null").groupBy("type").agg(F.countDistinct("logical_id").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))
            return Result(t.join(n, "type", "left").fillna(0, ["n_fields"]).select("type", "n", "n_fields", shared_folder_of(F.col("first"), F.col("last")).alias("folder")).orderBy("type"), c)
        mine = self.assets.where(F.col("type") == kind)
        if mine.isEmpty():
            return Result(self.type_alternatives(kind), ["miss"])
        return Result(self._cut(mine.groupBy("logical_id").agg(F.min("path").alias("path")).orderBy("logical_id"), limit, c), c)

    def type_alternatives(self, kind: str) -> DataFrame:
        """(type): up to five declared scopes that a name may mean: other spellings of its namespace, else those that share most of its words."""
        scopes = self.schema_fields.select(F.col("asset_type").alias("type")).distinct()
        bare = kind.partition(":")[2]
        exact = scopes.where(F.col("type").endswith(f":{kind}") | (F.col("type") == bare))
        if not exact.isEmpty():
            return exact.orderBy("type").limit(5)
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", bare or kind) if len(w) >= 3]
        name = F.lower(F.element_at(F.split("type", ":"), -1))
        hits = [F.when(name.contains(w), F.lit(len(w))) for w in words] or [F.lit(None).cast("int")]
        score, letters = sum((F.when(h.isNotNull(), 1).otherwise(0) for h in hits), F.lit(0)), sum((F.coalesce(h, F.lit(0)) for h in hits), F.lit(0))
        ranked = scopes.withColumns({"score": score, "cover": letters / F.greatest(F.length(name), F.lit(1))}).where("score > 0")
        return ranked.orderBy(F.desc("score"), F.desc("cover"), F.length("type"), "type").limit(5).select("type")

    def search(self, query: str, limit: int = LIMITS["search"], kind: str | None = None) -> Result:
        c: list[str] = []
        if not self.overlay and self._has("postings"):
            found = search.search_index(self.indexed("search_docs"), self.indexed("postings"), query, limit + 1, kind)
        else:
            found = search.search(search.search_docs(self.assets, self.edges, self.lang_keys), query, limit + 1, kind)
        n = found.count()
        if not n:
            return Result(self._cut(search.literal(self.assets, query).orderBy(F.desc("exact"), F.length("logical_id"), "logical_id", "type"), limit, c), ["names-not-values", "identifier-only", *c])
        if n > limit:
            c.append("truncated")
        if found.where("level > 0").count():
            c.append("relaxed")
        self._owners(found.select("logical_id", "type"), c)
        return Result(found.where(F.col("rank") < limit), c)

    def definitions(self, name: str, kind: str | None = None) -> DataFrame:
        """(id, logical_id, type, path, is_effective, pack, pack_kind, priority) of every definition of a name."""
        mine = self.assets.where((F.col("logical_id") == name) if kind is None else (F.col("logical_id") == name) & (F.col("type") == kind))
        packs = self.packs.select(F.col("id").alias("pack_id"), F.col("name").alias("pack"), F.col("kind").alias("pack_kind"), "priority")
        return mine.select("id", "pack_id", "logical_id", "type", "path", "is_effective").distinct().join(packs, "pack_id")

    def get(self, name: str, kind: str | None = None, documents: DataFrame | None = None) -> Result:
        """The definitions of a name, each with the fields it lacks (-), adds (+) or changes (~) against the one that holds; with documents (asset_id, doc) and only one definition, the document with what it inherits."""
        all_ = self.definitions(name, kind)
        top = all_.agg(F.min("priority").alias("p")).first()["p"]
        told = all_.agg(F.countDistinct(F.coalesce("type", F.lit(""))).alias("types"), F.countDistinct("pack_id").alias("packs"), F.countDistinct(F.when(F.col("priority") == top, F.col("pack_id"))).alias("at_top"), F.count("*").alias("n")).first()
        c: list[str] = []
        if told["types"] > 1:
            c.append("ambiguous-identifier")
        if told["packs"] > 1:
            c.append("contested-packs" if told["at_top"] > 1 else "shadowed")
        self._owners(all_.select("logical_id").distinct(), c)
        if documents is None or told["n"] != 1:
            return Result(self._compared(all_).orderBy("priority", F.desc("pack_id"), "id"), c)
        one = all_.first()
        docs = self.assets.where(F.col("type").eqNullSafe(one["type"])).select(F.col("id").alias("asset_id"), "type").distinct().join(documents.select("asset_id", "doc"), "asset_id")
        links_ = graph.inherits(self.candidates, self.assets).select(F.col("src").alias("child"), F.col("dst").alias("parent"))
        done = inherit.resolve_documents(docs, links_, self.schema_fields)
        return Result(done.where(F.col("asset_id") == one["id"]), c)

    def _compared(self, definitions: DataFrame) -> DataFrame:
        shown = definitions.agg(F.min_by("id", F.struct((~F.col("is_effective")).alias("x"), "priority", "id")).alias("shown"))
        cells = self.candidates.join(definitions.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").groupBy("asset_id", "schema_pointer").agg(F.array_sort(F.collect_set("raw_value")).alias("v"))
        first = cells.join(shown, F.col("asset_id") == F.col("shown"), "left_semi").select("schema_pointer", F.col("v").alias("v0"))
        keys = definitions.select("id").join(F.broadcast(shown), F.col("id") != F.col("shown")).select(F.col("id").alias("asset_id"))
        have = keys.join(cells, "asset_id")
        extra = have.join(first, "schema_pointer", "left").select("asset_id", F.when(F.col("v0").isNull(), F.concat(F.lit("+"), "schema_pointer")).when(F.col("v0") != F.col("v"), F.concat(F.lit("~"), "schema_pointer")).alias("m"))
        lacks = keys.withColumn("_p", F.lit(0)).join(first.groupBy(F.lit(0).alias("_p")).agg(F.collect_set("schema_pointer").alias("all")), "_p").select("asset_id", F.explode("all").alias("schema_pointer")).join(have.select("asset_id", "schema_pointer"), ["asset_id", "schema_pointer"], "left_anti").select("asset_id", F.concat(F.lit("-"), "schema_pointer").alias("m"))
        marks = extra.where("m is not null").unionByName(lacks).groupBy(F.col("asset_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("m")), " ").alias("differs"))
        return definitions.join(marks, "id", "left").withColumn("differs", F.coalesce("differs", F.lit("")))

    def describe(self, kind: str, pointer: str | None = None, limit: int = LIMITS["describe"]) -> Result:
        """Declared and observed fields of a type, or of one field, with how many values break its references; a field that is not there gives where it goes on."""
        c = ["pre-inheritance"]
        stats, s = self.indexed("field_stats"), self.schema_fields
        d = profile.describe(s, stats).where(F.col("asset_type") == kind)
        if pointer is not None:
            fixed, mangled = repaired_pointer(pointer)
            if mangled or fixed != pointer:
                c.append("pointer-repaired")
            d = d.where(F.col("json_pointer") == fixed)
            if d.isEmpty():
                asked = self.spark.createDataFrame([(kind, fixed)], "asset_type string, json_pointer string")
                on = crossings.crossings(asked, s, stats)
                return Result(on, [*c, "crosses-into" if not on.isEmpty() else "miss"])
        flags = d.agg(F.max((F.col("cardinality") > profile.MOST_VALUES) & F.lit(True)).alias("elided"), F.max(is_container(F.col("declared_type"))).alias("container")).first()
        c += [x for flag, x in ((flags["elided"], "cardinality-elided"), (flags["container"], "container-no-observations")) if flag]
        broken = graph.broken_references(self.candidates.where(F.col("schema_scope") == kind), self.assets, s, aligned=True)
        places = self.candidates.where(F.col("schema_scope") == kind).select("asset_id", "json_pointer", F.col("schema_pointer").alias("field")).distinct()
        counted = broken.join(places, ["asset_id", "json_pointer"]).groupBy(F.col("field").alias("json_pointer")).agg(F.countDistinct("asset_id", "raw_value").alias("n_broken"))
        out = d.join(counted, "json_pointer", "left").withColumn("n_broken", F.coalesce("n_broken", F.lit(0)))
        return Result(self._cut(out.orderBy("json_pointer"), limit, c), c)

    def refs(self, token: str, kind: str | None = None, limit: int = LIMITS["refs"]) -> Result:
        """What refers to a name: as an asset, else as a value, else as a file; else where it is a declared constant, else nothing."""
        c: list[str] = []
        known = self.assets.where(F.col("logical_id") == token)
        told = known.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("type", F.lit(""))).alias("types"), F.max(F.coalesce(F.col("type") == kind, F.lit(False)) if kind else F.lit(True)).alias("fits")).first()
        if told["n"] and not told["fits"]:
            return Result(known.select("logical_id", "type").distinct().orderBy("type").limit(SAME_NAME), ["wrong-type"])
        if told["n"]:
            into = graph.inbound(self.edges, self.candidates, self.assets, self.schema_fields).where(F.col("target") == token)
            into = into if kind is None else into.where(F.col("target_type") == kind)
            if told["types"] > 1:
                c.append("ambiguous-identifier")
            rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
            return Result(self._cut(into.orderBy(rank, "logical_id", "json_pointer", "kind", "type"), limit, c), ["untyped-blind-spot", *c])
        if kind is not None:
            c.append("argument-ignored")
        value = self.candidates.where(F.col("raw_value") == token)
        if not value.isEmpty():
            return Result(self._cut(value.groupBy("schema_scope", "schema_pointer").agg(F.countDistinct("id").alias("n"), F.countDistinct("asset_id").alias("n_assets")).orderBy(F.desc("n"), "schema_scope", "schema_pointer"), limit, c), ["pre-inheritance", *c])
        f = self.files.where((F.col("path") == token) | F.col("path").ilike(f"%/{token}")).select(F.col("id").alias("dst"), "path").distinct()
        if not f.isEmpty():
            users = self.edges.where("dst_kind = 'file'").join(f, "dst").join(self.assets.select(F.col("id").alias("src"), "logical_id", "type"), "src")
            return Result(self._cut(users.select("path", "logical_id", "type", "json_pointer").distinct().orderBy("path", "logical_id", "json_pointer"), limit, c), c)
        return Result(self.declared_constant(token), [*c, "container-no-observations", "miss"])

    def declared_constant(self, value: str) -> DataFrame:
        """(asset_type, json_pointer) of fields that declare a value, as their constant or in their enumeration."""
        s = self.schema_fields
        tests = [F.col("type_constant") == value] if "type_constant" in s.columns else []
        tests += [F.array_contains("enum_values", value)] if "enum_values" in s.columns else []
        hit = tests[0] if tests else F.lit(False)
        for t in tests[1:]:
            hit = F.coalesce(hit, F.lit(False)) | F.coalesce(t, F.lit(False))
        return s.where(hit).select("asset_type", "json_pointer").distinct().orderBy("asset_type", "json_pointer")

    def search_schema(self, query: str, limit: int = LIMITS["search_schema"]) -> Result:
        c: list[str] = []
        found = search.search_fields(self.schema_fields, query)
        if not found.limit(1).count():
            c.append("lexical-only")
        elif found.where("widened or level > 0").limit(1).count():
            c += ["relaxed", "lexical-only"]
        return Result(self._cut(found.orderBy("asset_type", "json_pointer"), limit, c), c)

    def search_lang(self, query: str, limit: int = LIMITS["search_lang"]) -> Result:
        """Language keys that are, hold or mean a text, with both spellings and how many assets use them."""
        c: list[str] = []
        users = self.edges.where("dst_kind = 'lang_key'").select(F.col("dst").alias("id"), "src").distinct()
        k = self.lang_keys.select("id", "key", "root").distinct().join(users, "id").groupBy("key").agg(F.countDistinct("src").alias("n_users"))
        roots = self.lang_keys.groupBy("key").agg(F.min(F.concat("root", F.lit("."), "key")).alias("reference"))
        found = search.search_texts(self.lang_keys, query).join(k, "key", "left").join(roots, "key", "left").withColumn("n_users", F.coalesce("n_users", F.lit(0)))
        return Result(self._cut(found.orderBy(F.length("key"), "key", "locale", "value"), limit, c), c)

    def _stations(self) -> stations_.Stations:
        return stations_.extract(self.candidates, self.spec)

    def bench(self, station: str | None = None, limit: int = LIMITS["bench"]) -> Result:
        """Every station that is declared or required, or what is made at one."""
        s, c = self._stations(), []
        if station is None:
            return Result(stations_.listing(s, self.assets).orderBy("station"), c)
        if s.stations.where(F.col("station") == station).isEmpty():
            c.append("bench-undeclared")
        made = stations_.craftable_at(s, self.assets).where(F.col("station") == station)
        self._owners(made.select("logical_id"), c)
        return Result(self._cut(made.orderBy("category", "logical_id"), limit, c), c)

    def undocumented(self, kind: str | None = None, limit: int = LIMITS["undocumented"]) -> Result:
        """Declared scalar fields that are never observed, with how many containers of the type were left out."""
        c = ["join-incomplete"]
        u, s = profile.undocumented(self.schema_fields, self.indexed("field_stats")), self.schema_fields.where("json_pointer != ''")
        if kind is not None:
            u, s = u.where(F.col("asset_type") == kind), s.where(F.col("asset_type") == kind)
        left_out = s.where(is_container(F.col("declared_type"))).groupBy("asset_type").agg(F.count("*").alias("n_containers"))
        if not left_out.isEmpty():
            c.append("container-no-observations")
        out = u.join(left_out, "asset_type", "left").withColumn("n_containers", F.coalesce("n_containers", F.lit(0)))
        return Result(self._cut(out.select("asset_type", "json_pointer", "declared_type", "n_containers").orderBy("asset_type", "json_pointer"), limit, c), c)

    def identify(self, tokens: DataFrame) -> DataFrame:
        """What each of tokens (token) is: (token, n_assets, types, n_values, n_value_assets, n_files, lang_key, station, category)."""
        t = tokens.select("token").where("token is not null").distinct()
        a = self.assets.groupBy(F.col("logical_id").alias("token")).agg(F.countDistinct("id").alias("n_assets"), F.array_join(F.array_sort(F.collect_set(F.coalesce("type", F.lit("untyped")))), ",").alias("types"))
        v = self.candidates.groupBy(F.col("raw_value").alias("token")).agg(F.countDistinct("id").alias("n_values"), F.countDistinct("asset_id").alias("n_value_assets"))
        parts = F.split("path", "/")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        f = self.files.select("id", F.explode(ends).alias("token")).groupBy("token").agg(F.countDistinct("id").alias("n_files"))
        k = self.lang_keys.select(F.col("key").alias("lang_key")).distinct()
        s = self._stations()
        here, cats = s.stations.select(F.col("station").alias("token"), F.lit(True).alias("station")), s.categories.select(F.col("category").alias("token"), F.lit(True).alias("category")).distinct()
        plain = t.join(k.select(F.col("lang_key").alias("token"), F.col("lang_key").alias("as_is")), "token", "left").withColumn("bare", translation_key(F.col("token"))).join(k.select(F.col("lang_key").alias("bare"), "lang_key"), "bare", "left")
        out = plain.select("token", F.coalesce("as_is", "lang_key").alias("lang_key"))
        for side in (a, v, f, here, cats):
            out = out.join(side, "token", "left")
        no = F.lit(False)
        return out.fillna(0, ["n_assets", "n_values", "n_value_assets", "n_files"]).withColumns({"station": F.coalesce("station", no), "category": F.coalesce("category", no)})
