"""Deeply nested semi-structured records into related flat tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.lenient_json import LongNumber, loads

#: Path steps and rows of a batch of nodes, at most about.
BATCH_STEPS, BATCH_ROWS = 1_000_000, 50_000
_BOM = "﻿"
_NODES = "rid long, label array<int>, keys array<string>, in_list array<boolean>, kind string, value string"


def read_object(doc: str | None) -> dict | None:
    """A JSON object, bare NaN and Infinity allowed, after a byte order mark or not, or within a JSON string; else None."""
    for _ in range(2):
        if not isinstance(doc, str):
            return None
        try:
            doc = loads(doc.lstrip(_BOM))
        except ValueError:
            return None
        if isinstance(doc, dict):
            return doc
    return None


def readable(doc: Column) -> Column:
    """Whether read_object() can read a document."""

    @F.pandas_udf("boolean")
    def check(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: read_object(d) is not None).astype(bool)

    return check(doc)


def _scalar(x) -> tuple[str, str | None]:
    if x is None:
        return "null", None
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    if isinstance(x, str):
        return "string", x.encode("utf-8", "replace").decode()
    return "number", repr(x) if isinstance(x, LongNumber) else json.dumps(x)


def _shred(doc: dict, skip: str, rows_only: bool) -> Iterator[tuple]:
    """(way, kind, value) of the nodes in document order. A way is (way before, ordinal, key, in list) or None: it is spelt out only where it is needed."""
    stack: list[tuple] = [(None, doc)]
    while stack:
        way, x = stack.pop()
        if not isinstance(x, (dict, list)):
            yield way, *_scalar(x)
            continue
        is_list = isinstance(x, list)
        if not rows_only or (not is_list and way is not None and way[3]):
            yield way, "array" if is_list else "object", None
        if is_list:
            inner = [((way, i, str(i), True), v) for i, v in enumerate(x) if not rows_only or isinstance(v, (dict, list))]
        else:
            inner = [((way, i, k, False), v) for i, (k, v) in enumerate(x.items()) if not (skip and k.startswith(skip)) and (not rows_only or isinstance(v, (dict, list)))]
        inner.reverse()
        stack += inner


class _Nodes:
    """Nodes as flat columns of an Arrow batch."""

    def __init__(self) -> None:
        self.rid, self.kind, self.value = [], [], []
        self.ends, self.label, self.keys, self.flags = [0], [], [], []

    def add(self, rid: int, way: tuple | None, kind: str, value: str | None) -> None:
        label, keys, flags = [], [], []
        while way is not None:
            way, i, k, in_list = way
            label.append(i)
            keys.append(k if in_list else k.encode("utf-8", "replace").decode().replace("~", "~0").replace("/", "~1"))
            flags.append(in_list)
        self.label += label[::-1]
        self.keys += keys[::-1]
        self.flags += flags[::-1]
        self.ends.append(len(self.label))
        self.rid.append(rid)
        self.kind.append(kind)
        self.value.append(value)

    def full(self) -> bool:
        return len(self.rid) >= BATCH_ROWS or len(self.label) >= BATCH_STEPS

    def batch(self) -> pa.RecordBatch:
        ends = pa.array(self.ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((self.label, pa.int32()), (self.keys, pa.string()), (self.flags, pa.bool_()))]
        columns = [pa.array(self.rid, pa.int64()), *lists, pa.array(self.kind, pa.string()), pa.array(self.value, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["rid", "label", "keys", "in_list", "kind", "value"])


def shred(docs: DataFrame, skip: str = "$", rows_only: bool = False) -> DataFrame:
    """Every node of every record, Dewey-labelled.

    docs: (rid long, doc string). Result, one row for each object, list and scalar, the root with empty
    labels: rid; label array<int>, the ordinals of the nodes on the way down; keys array<string>, their
    escaped keys or positions; in_list array<boolean>, whether each of them is an element of a list; kind
    (object, array, string, number, boolean, null); value, of scalars. Keys that start with `skip` are left
    out with all below them. Ordinals of an object count its keys as written. With rows_only, objects that
    are elements of lists come out alone, which is all that elements() asks for.
    Defined cases: null, empty and unreadable documents yield nothing (unreadable() names them); of a key
    given twice the last holds; lone surrogates become `?`; repeated records yield their nodes again; very
    long and very deep documents go through a stack, and come out in batches of bounded size; whole numbers
    of any length keep their digits; an empty table yields no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _Nodes()
        for batch in batches:
            for rid, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (x := read_object(doc)) is not None:
                    for way, kind, value in _shred(x, skip, rows_only):
                        nodes.add(rid, way, kind, value)
                        if nodes.full():
                            yield nodes.batch()
                            nodes = _Nodes()
        yield nodes.batch()

    return docs.select(F.col("rid").cast("long").alias("rid"), "doc").mapInArrow(run, _NODES)


def unreadable(docs: DataFrame, key: list[str]) -> DataFrame:
    """key of the documents (key..., doc) that shred() leaves out although they are not null."""
    return docs.where(F.col("doc").isNotNull() & ~readable(F.col("doc"))).select(*key)


def pointer(keys: Column) -> Column:
    """The JSON pointer (RFC 6901) of a node with these keys."""
    return F.when(F.size(keys) == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(keys, "/")))


def schema_path(keys: Column, in_list: Column) -> Column:
    """The pointer with list positions shown as `*`: it names the flat table or column of a node."""
    return pointer(F.zip_with(keys, in_list, lambda k, e: F.when(e, F.lit("*")).otherwise(k)))


def elements(nodes: DataFrame) -> DataFrame:
    """The rows of the flat tables: objects that are elements of lists, each with the row it belongs to.

    Result: (rid, table, label, parent_label, element_pointer, parent_pointer). The parent, the nearest
    enclosing object that is itself an element of a list, is found by truncating the label to the last
    earlier step at which an object stands in a list; none leaves the root, an empty label. A step into a
    list that holds lists is no such object, which the next step's being in a list shows.
    """
    # a step stands for an object in a list if it goes into a list and the next step doesn't go on from a list
    size = F.size("keys")
    cut = F.expr("coalesce(array_max(transform(sequence(1, size(keys)), i -> case when i < size(keys) and in_list[i - 1] and not in_list[i] then i end)), 0)")
    return (
        nodes.where((F.col("kind") == "object") & (size > 0) & F.element_at("in_list", -1))
        .withColumn("cut", cut)
        .select(
            "rid", schema_path(F.col("keys"), F.col("in_list")).alias("table"), "label", F.slice("label", 1, F.col("cut")).alias("parent_label"),
            pointer(F.col("keys")).alias("element_pointer"), pointer(F.slice("keys", 1, F.col("cut"))).alias("parent_pointer"),
        )
    )


def leaves(nodes: DataFrame) -> DataFrame:
    """The columns' values: scalars with the table row they belong to (rid, table, row_label, column, kind, value).

    A scalar belongs to the nearest enclosing object in a list, or to the record's root row (table "").
    """
    cut = F.expr("coalesce(array_max(transform(sequence(1, greatest(size(keys), 1)), i -> case when i < size(keys) and in_list[i - 1] and not in_list[i] then i end)), 0)")
    rest = F.slice("keys", F.col("cut") + 1, F.lit(1 << 30))
    rest_in = F.slice("in_list", F.col("cut") + 1, F.lit(1 << 30))
    return (
        nodes.where(~F.col("kind").isin("object", "array"))
        .withColumn("cut", cut)
        .select(
            "rid", schema_path(F.slice("keys", 1, F.col("cut")), F.slice("in_list", 1, F.col("cut"))).alias("table"),
            F.slice("label", 1, F.col("cut")).alias("row_label"), schema_path(rest, rest_in).alias("column"), "kind", "value",
        )
    )
