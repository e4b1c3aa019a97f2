"""Documents with what they inherit, and where each field came from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.align import MOST_FIELDS
from lattica.sources.lenient_json import dumps, parse

#: Documents of a chain, the document itself included.
LONGEST_CHAIN = 16


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


class MergeRules:
    """Which rules a document is merged by, and which of its objects merge: those whose type merges, and maps."""

    def __init__(self, fields: list[dict]):
        self.known = {(f["asset_type"], f["json_pointer"]) for f in fields}
        self.target = {(f["asset_type"], f["json_pointer"]): f["ref_scope"][0] for f in fields if len(f.get("ref_scope") or []) == 1}
        self.merges = {f["asset_type"] for f in fields if f["json_pointer"] == "" and f.get("merges_properties")}
        self.unions: dict[str, tuple[str, dict[str, str]]] = {}
        for f in fields:
            branches, values = list(f.get("ref_scope") or []), list(f.get("discriminator_values") or [])
            if f["json_pointer"] == "" and len(branches) > 1 and len(values) == len(branches):
                self.unions[f["asset_type"]] = (f.get("discriminator_property") or "Type", dict(zip(reversed(values), reversed(branches))))

    def scope(self, kind: str, chain: list) -> str:
        """The branch of a type that is a union at its root, by the discriminator of the nearest document of the chain that names one; else the type."""
        if kind not in self.unions:
            return kind
        name, branches = self.unions[kind]
        for doc in chain:
            if isinstance(doc, dict) and isinstance(doc.get(name), str) and doc[name] in branches:
                return branches[doc[name]]
        return kind

    def _target(self, scope: str, pointer: str) -> str | None:
        """The one type that a field crosses into: by its own rule, or without one by its parent's wildcard."""
        at = (scope, pointer)
        return self.target.get(at if at in self.known else (scope, pointer.rpartition("/")[0] + "/*"))

    def merge(self, old, new, scope: str, origins: dict | None = None, source: str = "", ancestor: str = "", before: dict | None = None):
        """new over old. origins gets (how, source id) for each pointer decided here: what is carried comes from the ancestor, or from where the ancestor had it."""
        if not (isinstance(old, dict) and isinstance(new, dict)):
            return new
        origins, before = {} if origins is None else origins, before or {}
        result: dict = {}
        stack = [(old, new, scope, "", "", result)]
        while stack:
            was, now, rules, pointer, path, out = stack.pop()
            for k, v in was.items():
                if k not in now:
                    out[k] = v
                    at = f"{path}/{_escaped(k)}"
                    how, by = before.get(at, ("", ""))
                    origins[at] = ("inherited", by if how == "inherited" else ancestor)
            for k, v in now.items():
                here, at = f"{pointer}/{_escaped(k)}", f"{path}/{_escaped(k)}"
                target = self._target(rules, here)
                is_map = target is None and (rules, f"{here}/*") in self.known
                if isinstance(v, dict) and isinstance(was.get(k), dict) and (is_map or target in self.merges):
                    out[k] = {}
                    stack.append((was[k], v, rules if is_map else target, here if is_map else "", at, out[k]))
                    origins[at] = ("merged", source)
                else:
                    out[k] = v
                    origins[at] = ("declared", source)
        return result


def chains(ids: DataFrame, parents: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(asset_id, chain, truncated, missing_parent) of ids (asset_id): the asset and its parents, the nearest first, `longest` at most.

    parents: (child, parent[, name]); of several parents the smallest id holds. A link with a name and no parent names a parent that is not
    there. truncated tells that the chain runs into a ring or goes on beyond the bound.
    Parents are looked up over doubling distances, so a bound of 16 takes four joins of bounded arrays.
    """
    name = F.col("name") if "name" in parents.columns else F.lit(None).cast("string")
    link = parents.select(F.col("child").cast("long").alias("node"), F.col("parent").cast("long").alias("up"), name.alias("name")).where("node is not null and (up is not null or name is not null)")
    link = link.groupBy("node").agg(F.min("up").alias("up"), F.min("name").alias("name"))
    ways = link.where("up is not null").select("node", F.array("up").alias("way"))
    reach = 1
    while reach < longest:
        ahead = ways.select(F.col("node").alias("last"), F.col("way").alias("more"))
        far = ways.withColumn("last", F.element_at("way", -1)).join(ahead, "last", "left")
        ways = far.select("node", F.when(F.size("way") < reach, F.col("way")).otherwise(F.concat("way", F.coalesce("more", F.array().cast("array<bigint>")))).alias("way"))
        reach *= 2
    full = ids.select(F.col("asset_id").cast("long").alias("asset_id")).distinct().join(ways.withColumnRenamed("node", "asset_id"), "asset_id", "left")
    full = full.withColumn("full", F.concat(F.array("asset_id"), F.coalesce("way", F.array().cast("array<bigint>"))))
    cut = full.select("asset_id", F.slice(F.array_distinct("full"), 1, longest).alias("chain"), (F.size(F.array_distinct("full")) < F.size("full")).alias("ring"))
    goes_on = link.select(F.col("node").alias("last"), "up", "name")
    done = cut.withColumn("last", F.element_at("chain", -1)).join(goes_on, "last", "left")
    more = F.col("up").isNotNull() | F.col("name").isNotNull()
    at_bound = (F.size("chain") >= longest) & more
    return done.select("asset_id", "chain", (F.col("ring") | F.coalesce(at_bound, F.lit(False))).alias("truncated"), F.when(F.col("up").isNull() & (F.size("chain") < longest), F.col("name")).alias("missing_parent"))


def resolve_documents(docs: DataFrame, parents: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(asset_id, depth, truncated, missing_parent, scope, doc, origins) of each document with its chain of parents folded in.

    docs: (asset_id, type, doc); parents: (child, parent[, name]) within a type, as for chains(). A chain
    ends before a ring, and before a parent without a readable document, which is then missing_parent (its
    id, or its name if there is no such asset). depth counts the parents folded in. Parent-only keys come
    first, then the child's; objects merge only where the rules say so; lists and scalars are replaced;
    documents of no type replace their parents' wholly. The rules are those of the type, or of the branch of
    its root union that the nearest discriminator names (scope). origins: pointer -> [how, source id], how
    being declared, inherited or merged; documents without parents and of no type have none.
    Defined cases: unreadable documents stay null; of several documents of an asset the greatest text holds.

    Scale: a chain is at most LONGEST_CHAIN ids, looked up in four joins; each document meets the texts of
    its chain in one join whose right side is unique, so adaptive execution can split a parent of very many,
    and is folded by a vectorised function over one bounded array.
    """
    if schema_fields.limit(MOST_FIELDS + 1).count() > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} declared fields")
    wanted = [c for c in ("asset_type", "json_pointer", "ref_scope", "merges_properties", "discriminator_property", "discriminator_values") if c in schema_fields.columns]
    rules = MergeRules([r.asDict() for r in schema_fields.select(*wanted).collect()])
    d = docs.groupBy(F.col("asset_id").cast("long").alias("asset_id")).agg(F.max(F.struct("doc", "type")).alias("m")).select("asset_id", "m.type", "m.doc")
    placed = d.select("asset_id", "type").join(chains(d, parents), "asset_id")
    steps = placed.select("asset_id", "type", "truncated", "missing_parent", F.posexplode("chain").alias("hop", "layer"))
    layers = steps.join(d.select(F.col("asset_id").alias("layer"), F.col("doc").alias("text")), "layer", "left")
    grouped = layers.groupBy("asset_id", "type", "truncated", "missing_parent").agg(F.array_sort(F.collect_list(F.struct("hop", "layer", "text"))).alias("layers"))

    @F.pandas_udf("depth int, missing string, scope string, doc string, origins string")
    def fold(kinds: pd.Series, layered: pd.Series) -> pd.DataFrame:
        out = []
        for kind, layers_ in zip(kinds, layered):
            chain, missing = [], None
            for x in layers_:
                try:
                    chain.append((str(x["layer"]), parse(x["text"])[0]))
                except (AttributeError, ValueError):
                    missing = str(x["layer"])
                    break
            if not chain:
                out.append((None, None, None, None, None))
                continue
            scope = None if kind is None else rules.scope(kind, [doc for _, doc in chain])
            now, origins = chain[-1][1], {}
            for i in range(len(chain) - 2, -1, -1):
                source, doc = chain[i]
                fresh: dict = {}
                now = doc if scope is None else rules.merge(now, doc, scope, fresh, source, chain[i + 1][0], origins)
                origins = fresh
            out.append((len(chain) - 1, missing, scope, dumps(now), json.dumps(origins)))
        return pd.DataFrame(out, columns=["depth", "missing", "scope", "doc", "origins"])

    done = grouped.select("asset_id", "truncated", "missing_parent", fold("type", "layers").alias("r"))
    return done.select("asset_id", F.col("r.depth").alias("depth"), (F.col("truncated") & F.col("r.missing").isNull()).alias("truncated"), F.coalesce("r.missing", "missing_parent").alias("missing_parent"), "r.scope", "r.doc", "r.origins")


def origin_tallies(resolved: DataFrame) -> DataFrame:
    """(asset_id, declared, inherited, merged): how many top-level fields of each document that has parents came how."""
    each = resolved.select("asset_id", F.explode(F.from_json("origins", "map<string,array<string>>")).alias("pointer", "origin")).where(~F.col("pointer").substr(2, 1 << 30).contains("/"))
    return each.groupBy("asset_id").agg(*[F.count(F.when(F.col("origin")[0] == how, 1)).alias(how) for how in ("declared", "inherited", "merged")])
