"""Where a pointer goes on that its own scope does not declare, and which branches a union has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.align import MOST_FIELDS

#: Scopes entered one after another at most, and near fields looked at.
HOPS, NEAR = 8, 8


class Declared:
    """The declared pointers of each scope, the scopes that single-target fields lead into, and which fields are known at all."""

    def __init__(self, fields: list[dict], observed: list[tuple[str, str]] = ()):
        self.pointers: dict[str, list[str]] = {}
        self.into: dict[tuple[str, str], str] = {}
        self.known = set(observed)
        for f in fields:
            at = (f["asset_type"], f["json_pointer"])
            self.known.add(at)
            if at[1]:
                self.pointers.setdefault(at[0], []).append(at[1])
            if len(f["ref_scope"] or []) == 1:
                self.into[at] = f["ref_scope"][0]
        for p in self.pointers.values():
            p.sort(key=lambda x: (len(x), x))

    def nearest(self, scope: str, pointer: str) -> list[str]:
        """Declared pointers that begin like the pointer, the shortest first; without any, like what is left of it without its last segments."""
        while len(pointer) > 1:
            found = [p for p in self.pointers.get(scope, []) if p.startswith(pointer)][:NEAR]
            if found:
                return found
            pointer = pointer[: pointer.rfind("/")] or "/"
        return []

    @staticmethod
    def rest(pointer: str, prefix: str) -> str | None:
        """What is left of a pointer behind a declared prefix, whose wildcards may stand for nothing; None if it doesn't begin like that."""
        have, i = pointer.split("/"), 0
        for segment in prefix.split("/"):
            if i < len(have) and have[i] == segment:
                i += 1
            elif segment != "*":
                return None
        return "".join("/" + x for x in have[i:])

    def crossings(self, scope: str, pointer: str) -> list[tuple[str, str, str]]:
        """(at, into, continue_at): fields near a pointer that lead into another scope, and where the pointer goes on there; empty if nowhere."""
        out = []
        for at in self.nearest(scope, pointer):
            into = self.into.get((scope, at))
            if into is None:
                continue
            left = self.rest(pointer, at)
            for _ in range(HOPS):
                if not left or (into, left) in self.known:
                    break
                step = next(((p, self.into[into, p]) for p in self.nearest(into, left) if (into, p) in self.into), None)
                further = self.rest(left, step[0]) if step else None
                if further is None:
                    break
                left, into = further, step[1]
            out.append((at, into, left if left and (into, left) in self.known else ""))
        return out


def crossings(asked: DataFrame, schema_fields: DataFrame, field_stats: DataFrame) -> DataFrame:
    """(asset_type, json_pointer, at, into, continue_at) of the asked fields (asset_type, json_pointer); those that cross nowhere have no row.

    Declared fields and the profile of fields are parameters, refused beyond MOST_FIELDS; the asked ones are a table of any size.
    """
    fields = [r.asDict() for r in schema_fields.select("asset_type", "json_pointer", "ref_scope").limit(MOST_FIELDS + 1).collect()]
    seen = [tuple(r) for r in field_stats.select("asset_type", "json_pointer").limit(MOST_FIELDS + 1).collect()]
    if max(len(fields), len(seen)) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    declared = Declared(fields, seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, p, *c) for s, p in zip(pdf["asset_type"], pdf["json_pointer"]) for c in declared.crossings(s, p)]
            yield pd.DataFrame(rows, columns=["asset_type", "json_pointer", "at", "into", "continue_at"])

    return asked.select("asset_type", "json_pointer").where("asset_type is not null and json_pointer is not null").mapInPandas(run, "asset_type string, json_pointer string, at string, into string, continue_at string")


def unions(schema_fields: DataFrame) -> DataFrame:
    """(asset_type, json_pointer, property, branch, value) of each branch of each declared union; value, of its discriminator, is null where the declaration doesn't pair them."""
    s = schema_fields
    for c, kind in (("discriminator_property", "string"), ("discriminator_values", "array<string>")):
        s = s if c in s.columns else s.withColumn(c, F.lit(None).cast(kind))
    paired = F.size("discriminator_values") == F.size("ref_scope")
    each = s.where(F.size("ref_scope") > 1).select("asset_type", "json_pointer", F.coalesce("discriminator_property", F.lit("Type")).alias("property"), F.posexplode("ref_scope").alias("i", "branch"), "discriminator_values", paired.alias("paired"))
    return each.select("asset_type", "json_pointer", "property", "branch", F.when(F.col("paired"), F.get("discriminator_values", F.col("i"))).alias("value"))
