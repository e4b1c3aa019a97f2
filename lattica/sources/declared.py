"""Declared fields out of JSON-Schema files: a small driver-side walk (a hundred files, tens of thousands of fields)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lattica.sources.lenient_json import parse

# Bounds of the walk
NODE_DEPTH, POINTER_DEPTH, MOST_FIELDS, MOST_VISITS = 64, 8, 12_000, 400_000

FIELDS = (
    "asset_type string, json_pointer string, declared_type string, optional boolean, reference_target string, ref_scope array<string>, "
    "enum_values array<string>, discriminator_property string, discriminator_values array<string>, title string, description string, merges_properties boolean, "
    "inherits_property boolean, type_constant string, default_value string, default_unset boolean"
)
# Fixed value: the sentence by which a branch names its own discriminator value
CONSTANT = re.compile(r'must be set to the constant value "([^"]+)"')


def scope_of(ref: str) -> str | None:
    """The namespace that a $ref names: a shared definition file:Name or an asset type; null for anything deeper."""
    m = re.fullmatch(r"(?:.*/)?([^/#]+)\.json#?(?:/definitions/([^/]+))?/?", ref)
    return None if not m else f"{m[1]}:{m[2]}" if m[2] else m[1]


def _branches(node: dict) -> list[dict]:
    return [b for k in ("anyOf", "oneOf", "allOf") for b in node.get(k, []) if isinstance(b, dict)]


def _type(node: dict) -> str:
    if "$ref" in node:
        return "$ref"
    kind = node.get("type")
    if isinstance(kind, list):
        return "|".join(kind)
    return kind or next((k for k in ("anyOf", "oneOf", "allOf") if k in node), "any")


def _marker(node: dict, name: str, vendor: str):
    """A marker on the node itself or in one of its branches, under any vendor block."""
    for n in [node, *_branches(node)]:
        block = n.get(vendor)
        if isinstance(block, dict) and name in block:
            return block[name]
        if name in n:
            return n[name]
    return None


def flatten(namespace: str, root: dict, vendor: str = "x-asset", unset: frozenset[str] = frozenset(), notes: list[str] | None = None) -> list[dict]:
    """One row for each declared field of a namespace. Properties, maps and lists (`/*`) are walked; $refs are recorded, not followed.

    unset: source pointers of defaults that were no finite number, which mean "no default". notes gets a
    line if the bounds of the walk cut the namespace short.

    The first declaration of a pointer holds; later ones only add to its reference scopes. vendor names the
    block that holds the generator's markers: reference, merges, inherits, union {property, values}.
    """
    rows: dict[str, dict] = {}
    visits = 0
    cut: dict[str, int] = {}
    stack = [(root, "", 0, False, "")]
    while stack:
        node, pointer, depth, required, source = stack.pop()
        visits += 1
        bound = "visits" if visits > MOST_VISITS else "fields" if len(rows) >= MOST_FIELDS else "depth" if depth > NODE_DEPTH else "pointer depth" if pointer.count("/") > POINTER_DEPTH else None
        if bound:
            cut[bound] = cut.get(bound, 0) + 1
            continue
        scopes = [s for n in [node, *_branches(node)] if "$ref" in n and (s := scope_of(n["$ref"]))]
        union = _marker(node, "union", vendor) or {}
        if pointer or len(scopes) > 1 or _marker(node, "merges", vendor):
            row = rows.get(pointer)
            if row is None:
                rows[pointer] = {
                    "asset_type": namespace, "json_pointer": pointer, "declared_type": _type(node), "optional": not required, "reference_target": _marker(node, "reference", vendor),
                    "ref_scope": scopes or None, "enum_values": [str(x) for x in node["enum"]] if "enum" in node else None, "discriminator_property": union.get("property"),
                    "discriminator_values": union.get("values"), "title": node.get("title"), "description": node.get("description"), "merges_properties": bool(_marker(node, "merges", vendor)),
                    "inherits_property": bool(_marker(node, "inherits", vendor)), "type_constant": m[1] if (m := CONSTANT.search(node.get("description") or "")) else None,
                    "default_value": json.dumps(node["default"]) if node.get("default") is not None else None,
                    "default_unset": any(u == f"{source}/default" or u.startswith(f"{source}/default/") for u in unset),
                }
            elif new := [s for s in scopes if s not in (row["ref_scope"] or [])]:
                row["ref_scope"] = (row["ref_scope"] or []) + new
        inner: list[tuple] = []
        for name, child in node.get("properties", {}).items():
            if isinstance(child, dict) and not name.startswith("$"):
                step = name.replace("~", "~0").replace("/", "~1")
                inner.append((child, f"{pointer}/{step}", depth + 1, name in node.get("required", []), f"{source}/properties/{step}"))
        for key in ("additionalProperties", "items"):
            if isinstance(node.get(key), dict):
                inner.append((node[key], f"{pointer}/*", depth + 1, False, f"{source}/{key}"))
        for key in ("anyOf", "oneOf", "allOf"):
            inner += [(b, pointer, depth + 1, required, f"{source}/{key}/{i}") for i, b in enumerate(node.get(key, [])) if isinstance(b, dict)]
        stack += reversed(inner)
    if cut and notes is not None:
        notes.append(f"{namespace}: fields are missing beyond the bounds of the walk: " + ", ".join(f"{k} ({n} nodes)" for k, n in sorted(cut.items())))
    return list(rows.values())


def resolve(ref: str, documents: dict[str, dict]) -> dict | None:
    """The node that a $ref `file.json#/a/b` names in documents (file -> root); null if there is none."""
    file, _, pointer = ref.partition("#")
    node = documents.get(file.rpartition("/")[2])
    for step in pointer.strip("/").split("/") if pointer.strip("/") else ():
        step = step.replace("~1", "/").replace("~0", "~")
        node = node.get(step) if isinstance(node, dict) else node[int(step)] if isinstance(node, list) and step.isdigit() and int(step) < len(node) else None
    return node if isinstance(node, dict) else None


def bindings(settings: str) -> list[tuple[str, str]]:
    """(type, glob) from an editor's settings, whose json.schemas bind files to schemas; nothing if they can't be read."""
    try:
        doc, _ = parse(settings)
        return [(e["url"].rpartition("/")[2].removesuffix(".json"), g) for e in doc.get("json.schemas", []) if isinstance(e.get("url"), str) for g in e.get("fileMatch", [])]
    except (ValueError, AttributeError, TypeError):
        return []


@dataclass
class Declared:
    fields: DataFrame
    definitions: DataFrame
    types: DataFrame
    warnings: list[str]


def read_all(spark: SparkSession, folder: str, vendor: str = "x-asset", settings: str | None = None) -> Declared:
    """The declared fields, shared definitions (file, name, body) and types (id, schema_path, file_extension, globs) of the schema files in a folder.

    Warnings name what was repaired, what was cut short and which types no path leads to.
    """
    rows, definitions, types, warnings = [], [], [], []
    bound = bindings(settings) if settings else []
    for path in sorted(Path(folder).glob("*.json")):
        doc, repairs = parse(path.read_text("utf-8"), path.name)
        unset = frozenset(p for p, _ in repairs if "/default" in p)
        if repairs:
            warnings.append(f"{path.name}: {len(repairs)} numbers that are not finite, {len(unset)} of them in defaults")
        if "properties" in doc or _branches(doc):
            rows += flatten(path.stem, doc, vendor, unset, warnings)
            block = doc.get(vendor) if isinstance(doc.get(vendor), dict) else {}
            types.append((path.stem, block.get("path"), block.get("extension"), [g for t, g in bound if t == path.stem]))
            if not block.get("path"):
                warnings.append(f"{path.name}: no path, so no files are of this type by it")
        for name, body in doc.get("definitions", {}).items():
            below = frozenset(u.removeprefix(f"/definitions/{name}") for u in unset if u.startswith(f"/definitions/{name}/"))
            rows += flatten(f"{path.stem}:{name}", body, vendor, below, warnings)
            definitions.append((path.name, name, json.dumps(body)))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return Declared(
        spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FIELDS), spark.createDataFrame(definitions, "file string, name string, body string"),
        spark.createDataFrame(types, "id string, schema_path string, file_extension string, globs array<string>"), warnings,
    )


def read(spark: SparkSession, folder: str, vendor: str = "x-asset") -> DataFrame:
    """The declared fields of the schema files in a folder: each file's type, and its shared definitions."""
    return read_all(spark, folder, vendor).fields


def type_rules(types: DataFrame) -> list[tuple[str, str, str]]:
    """(prefix, suffix, type) rules for plans.build.typed: from each glob the folders before its first wildcard and what follows its last; without globs the type's own path below Server/ and Common/. Types are few."""
    out = []
    for t in types.orderBy("id").collect():
        for g in t["globs"] or []:
            literal = re.match(r"(?:[^*?/]*/)*", g)[0]
            last = re.split(r"[*?]", g)[-1]
            out.append((literal, last if last not in ("", ".json") and "/" not in last else "", t["id"]))
        if not t["globs"] and t["schema_path"]:
            out += [(f"{root}/{t['schema_path'].strip('/')}/", "", t["id"]) for root in ("Server", "Common")]
    return out


def suffixes(types: DataFrame) -> tuple[str, ...]:
    """The endings of asset files: .json and what types declare."""
    found = types.where("file_extension is not null").select("file_extension").distinct().collect()
    return tuple(sorted({".json", *(r[0] for r in found)}))
