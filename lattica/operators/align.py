"""Aligning the pointers of leaves with declared fields, across references and unions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.canonical import schema_pointer

#: Declared fields that a rule book may hold; it is parameters, not data, and is refused beyond.
MOST_FIELDS = 1_000_000
HOPS = 8
#: Pointers whose alignment a task remembers.
MOST_REMEMBERED = 200_000


class _State:
    """A place among a scope's declared pointers: where each segment leads, whether a field is declared here, and into which scopes it continues."""

    __slots__ = ("declared", "leads", "property", "targets")

    def __init__(self) -> None:
        self.leads: dict[str, _State] = {}
        self.declared = False
        self.targets: list[tuple[str, str, str | None]] = []
        self.property = "Type"

    def after(self, segment: str) -> _State:
        return self.leads.setdefault(segment, _State())

    def into(self, told) -> str | None:
        """The scope that the field continues in: its only target, or the one that the discriminator names, by its constant, else by the shortest name it begins."""
        if len(self.targets) < 2:
            return self.targets[0][1] if self.targets else None
        value = told(self.property)
        if value is None:
            return None
        exact = [t for _, t, constant in self.targets if constant == value]
        return (exact or [t for name, t, _ in self.targets if name.startswith(value)] or [None])[0]


class Rules:
    """An automaton over the segments of pointers, one for each scope, out of the declared fields."""

    def __init__(self, fields: list[dict]):
        self.start: dict[str, _State] = {}
        constants = {f["asset_type"]: f.get("type_constant") for f in fields if f["json_pointer"] == "/Type"}
        for f in fields:
            state = self.start.setdefault(f["asset_type"], _State())
            for segment in f["json_pointer"].split("/")[1:]:
                state = state.after(segment)
            state.declared = True
            targets, values = list(f.get("ref_scope") or []), list(f.get("discriminator_values") or [])
            if targets:
                told = values if len(values) == len(targets) else [constants.get(t) for t in targets]
                state.targets = sorted(((t.rpartition(":")[2], t, v) for t, v in zip(targets, told)), key=lambda x: (len(x[0]), x[0]))
                state.property = f.get("discriminator_property") or "Type"
        self.remembered: dict[tuple[str, str], tuple[str, str]] = {}

    def properties(self) -> set[str]:
        found, waiting = set(), list(self.start.values())
        while waiting:
            state = waiting.pop()
            waiting += state.leads.values()
            if len(state.targets) > 1:
                found.add(state.property)
        return found

    def align(self, kind: str, pointer: str, raw: str, told) -> tuple[str, str]:
        """(scope, pointer) of a leaf; told(raw pointer, property) gives the discriminator there, or None.

        A declared segment is taken as it is, else as the wildcard if that is declared, else as the pointer
        has it. A field that is not the leaf's own may lead into another scope, where the pointer starts anew.
        Results that no discriminator took part in are remembered.
        """
        key = (kind, raw)
        if key in self.remembered:
            return self.remembered[key]
        asked = False

        def ask(at: str):
            def f(name: str):
                nonlocal asked
                asked = True
                return told(at, name)

            return f

        def entered(scope: str, at: str) -> str:
            """The scope, or the branch of it if it is a union at its root."""
            root = self.start[scope]
            branch = root.into(ask(at)) if len(root.targets) > 1 else None
            return branch if branch in self.start else scope

        scope = entered(kind, "")
        state: _State | None = self.start[scope]
        way: list[str] = []
        segments, raws = pointer.split("/")[1:], raw.split("/")[1:]
        for i, (segment, literal) in enumerate(zip(segments, raws)):
            nexts = state.leads if state is not None else {}
            for choice in (literal, "*"):
                if choice in nexts and nexts[choice].declared:
                    segment = choice
                    break
            state = nexts.get(segment)
            at = "/" + "/".join(raws[: i + 1])
            target = state.into(ask(at)) if state is not None and i < len(segments) - 1 else None
            if target in self.start:
                scope, way = entered(target, at), []
                state = self.start[scope]
            else:
                way.append(segment)
        out = (scope, "".join("/" + x for x in way))
        if not asked:
            if len(self.remembered) >= MOST_REMEMBERED:
                self.remembered.clear()
            self.remembered[key] = out
        return out


def rule_book(schema_fields: DataFrame) -> Rules:
    wanted = ["asset_type", "json_pointer", "ref_scope", "discriminator_property", "discriminator_values", "type_constant"]
    rows = schema_fields.select(*[c for c in wanted if c in schema_fields.columns]).limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} declared fields")
    return Rules([r.asDict() for r in rows])


def align(leaves: DataFrame, assets: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """leaves (asset_id, json_pointer, raw_value, value_kind) with schema_scope and schema_pointer.

    assets: (id, type, parent_id). Unions are decided by the string leaf at the discriminator, the asset's own
    or the nearest of its ancestors' up to HOPS steps. Assets of no or an undeclared type keep a null scope.
    Defined cases: null pointers stay as they are; repeated leaves are repeated; empty tables are fine.

    Scale: each asset's discriminators, a few strings, meet its leaves in a join; the walk itself is a map
    over batches. Only the declared fields reach every task, and their number is checked.
    """
    rules = rule_book(schema_fields)
    props = sorted(rules.properties())
    tells = leaves.where((F.col("value_kind") == "string") & F.regexp_extract("json_pointer", "([^/]*)$", 1).isin(*props)) if props else leaves.limit(0)
    own = tells.groupBy(F.col("asset_id").alias("owner"), "json_pointer").agg(F.min("raw_value").alias("told"))
    a = assets.select(F.col("id"), F.col("type"), F.col("parent_id")).distinct()
    lineage = a.select("id", F.col("id").alias("owner"), F.lit(0).alias("hop"))
    reach, up = lineage, a.where("parent_id is not null").select(F.col("id").alias("owner"), F.col("parent_id").alias("next"))
    for hop in range(1, HOPS + 1) if props else ():
        reach = reach.join(up, "owner").select("id", F.col("next").alias("owner"), F.lit(hop).alias("hop"))
        lineage = lineage.unionByName(reach)
    nearest = lineage.join(own, "owner").groupBy("id", "json_pointer").agg(F.min_by("told", "hop").alias("told"))
    told = nearest.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("json_pointer", "told"))).alias("told"))
    kinds = a.groupBy("id").agg(F.min("type").alias("type")).join(told, "id", "left").select(F.col("id").alias("asset_id"), F.col("type").alias("_type"), F.to_json("told").alias("_told"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        parsed: dict[str, dict] = {}
        for pdf in batches:
            scopes, pointers = [], []
            for kind, told_, raw, pointer in zip(pdf["_type"], pdf["_told"], pdf["json_pointer"], pdf["schema_pointer"]):
                if kind is None or kind not in rules.start or raw is None:
                    scopes.append(None)
                    pointers.append(pointer)
                    continue
                if told_ not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[told_] = json.loads(told_) if told_ else {}
                here = parsed[told_]
                s, p = rules.align(kind, pointer, raw, lambda at, prop, here=here: here.get(f"{at}/{prop}"))
                scopes.append(s)
                pointers.append(p)
            yield pdf.drop(columns=["_type", "_told"]).assign(schema_scope=scopes, schema_pointer=pointers)

    rows = leaves.select("asset_id", "json_pointer", "raw_value", "value_kind", schema_pointer(F.col("json_pointer")).alias("schema_pointer")).join(kinds, "asset_id", "left")
    return rows.mapInPandas(run, "asset_id long, json_pointer string, raw_value string, value_kind string, schema_pointer string, schema_scope string")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n, changed, without_scope): how many leaves (asset_id, json_pointer, schema_scope, schema_pointer) of after there are, and how many before has not with the same scope and pointer."""
    key = ["asset_id", "json_pointer", "schema_scope", "schema_pointer"]
    same = before.select(*key).distinct().withColumn("same", F.lit(True))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    j = after.select(*key).distinct().alias("l").join(same.alias("r"), on, "left")
    return j.agg(F.count("*").alias("n"), F.count(F.when(F.col("same").isNull(), 1)).alias("changed"), F.count(F.when(F.col("l.schema_scope").isNull(), 1)).alias("without_scope"))
