"""JSON in which numbers may be NaN or infinite, of any depth and with numbers of any length."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")
_WORDS = {"true": True, "false": False, "null": None}
#: Digits up to which int() reads text; longer whole numbers keep their text.
LONGEST_INT = 4300


class LongNumber:
    """A whole number of more digits than int() reads, as its text."""

    def __init__(self, text: str):
        self.text = text

    def __repr__(self) -> str:
        return self.text

    def __eq__(self, other) -> bool:
        return isinstance(other, LongNumber) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)


def _whole(text: str) -> int | LongNumber:
    return int(text) if len(text) <= LONGEST_INT else LongNumber(text)


def _deep(text: str, constant: Callable) -> object:
    """json.loads with a stack of its own, so that depth doesn't matter."""
    skip = lambda i: _SPACE.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise json.JSONDecodeError("Expecting property name enclosed in double quotes", text, i)
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise json.JSONDecodeError("Expecting ':' delimiter", text, i)
        return name, skip(i + 1)

    open_: list = []
    keys: list = []
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            value = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                i += 1
            else:
                open_.append(value)
                keys.append(None)
                if c == "{":
                    keys[-1], i = key(i)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        else:
            m = _ATOM.match(text, i)
            if m is None:
                raise json.JSONDecodeError("Expecting value", text, i)
            i, atom = m.end(), m.group()
            value = _WORDS[atom] if atom in _WORDS else constant(atom) if m[1] is None else float(atom) if m[2] or m[3] else _whole(atom)
        while True:  # the value belongs to the innermost open container, which may end with it
            i = skip(i)
            if not open_:
                if i != len(text):
                    raise json.JSONDecodeError("Extra data", text, i)
                return value
            top, c = open_[-1], text[i : i + 1]
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if c == ",":
                i = skip(i + 1)
                if isinstance(top, dict):
                    keys[-1], i = key(i)
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise json.JSONDecodeError("Expecting ',' delimiter", text, i)
            i, value = i + 1, open_.pop()
            keys.pop()


def loads(text: str, constant: Callable = float) -> object:
    """json.loads for documents of any depth and whole numbers of any length (LongNumber beyond LONGEST_INT digits). ValueError if the text is no JSON."""
    try:
        return json.loads(text, parse_constant=constant)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):
        return _deep(text, constant)


def dumps(x: object) -> str:
    """json.dumps of what loads() gives, of any depth."""
    try:
        return json.dumps(x, ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        pass
    out: list[str] = []
    stack: list = [x]
    while stack:
        x = stack.pop()
        if isinstance(x, _Mark):
            out.append(x.text)
        elif isinstance(x, dict):
            stack.append(_Mark("}"))
            for i, (k, v) in enumerate(reversed(x.items())):
                stack += [v, _Mark(("" if i == len(x) - 1 else ", ") + json.dumps(k, ensure_ascii=False) + ": ")]
            out.append("{")
        elif isinstance(x, list):
            stack.append(_Mark("]"))
            for i, v in enumerate(reversed(x)):
                stack += [v, _Mark("" if i == len(x) - 1 else ", ")]
            out.append("[")
        else:
            out.append(x.text if isinstance(x, LongNumber) else json.dumps(x, ensure_ascii=False))
    return "".join(out)


class _Mark:
    def __init__(self, text: str):
        self.text = text


class _Unset:
    """Stands for a bare NaN or Infinity until the walk finds out where it was."""

    def __init__(self, token: str):
        self.token = token


def parse(text: str, source: str = "document") -> tuple[object, list[tuple[str, str]]]:
    """A document with its non-finite numbers as None, and (pointer, token) for each of them.

    Strings that look like such tokens stay strings. ValueError names the source if the text is no JSON.
    """
    found: list[_Unset] = []

    def constant(token: str) -> _Unset:
        found.append(_Unset(token))
        return found[-1]

    try:
        doc = loads(text.lstrip("\ufeff"), constant)
    except ValueError as e:
        raise ValueError(f"{source}: {e}") from e
    if not found:
        return doc, []
    repairs: list[tuple[str, str]] = []
    box = [doc]
    stack: list[tuple[tuple | None, object, object]] = [(None, box, 0)]
    while stack:
        at, holder, key = stack.pop()
        x = holder[key]
        if isinstance(x, _Unset):
            steps = []
            while at:
                at, step = at
                steps.append(str(step).replace("~", "~0").replace("/", "~1"))
            repairs.append(("".join("/" + k for k in reversed(steps)), x.token))
            holder[key] = None
        elif isinstance(x, dict):
            stack += [((at, k), x, k) for k in reversed(x)]
        elif isinstance(x, list):
            stack += [((at, i), x, i) for i in reversed(range(len(x)))]
    return box[0], repairs


def repaired(doc: Column) -> Column:
    """struct(json, repairs, error) of a JSON text: strict JSON, what was repaired in it, or why it can't be read. Null stays null."""

    @F.pandas_udf("json string, repairs array<struct<pointer:string,token:string>>, error string")
    def run(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for d in docs:
            try:
                x, fixes = parse(d) if d is not None else (None, [])
                rows.append((dumps(x) if d is not None else None, [{"pointer": p, "token": t} for p, t in fixes], None))
            except ValueError as e:
                rows.append((None, [], str(e)))
        return pd.DataFrame(rows, columns=["json", "repairs", "error"])

    return run(doc)


def number_text(x: int | float | LongNumber) -> str:
    """A number's shortest form that reads back the same: whole ones below 1e21 without a point, an exponent only beyond 1e21 or below 1e-6."""
    if not isinstance(x, float):
        return repr(x)
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    if 1e-6 <= abs(x) < 1e-4:
        return format(Decimal(repr(x)), "f")
    return re.sub(r"e([+-])0", r"e\1", repr(x))


def leaves(docs: DataFrame) -> DataFrame:
    """(asset_id, json_pointer, schema_pointer, raw_value, value_kind) of the scalar leaves of documents (asset_id, doc).

    Numbers are written by number_text; nulls and non-finite numbers are no leaves; keys that begin with $ are
    left out with all below them; strings are trimmed and kept up to the length of a value or a path.
    Documents that cannot be read have no leaves; unreadable() names them.
    """
    from lattica.functions.text import LONGEST_PATH, LONGEST_VALUE

    names = ["asset_id", "json_pointer", "schema_pointer", "raw_value", "value_kind"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for asset, doc in zip(pdf["asset_id"].tolist(), pdf["doc"].tolist()):
                try:
                    stack = [("", "", parse(doc)[0])]
                except (ValueError, AttributeError):
                    continue
                while stack:
                    p, s, x = stack.pop()
                    if isinstance(x, dict):
                        for k in reversed([k for k in x if not k.startswith("$")]):
                            e = k.replace("~", "~0").replace("/", "~1")
                            stack.append((f"{p}/{e}", f"{s}/{'*' if e.isascii() and e.isdigit() else e}", x[k]))
                    elif isinstance(x, list):
                        stack += [(f"{p}/{i}", f"{s}/*", x[i]) for i in reversed(range(len(x)))]
                    elif isinstance(x, bool):
                        out.append((asset, p, s, "true" if x else "false", "boolean"))
                    elif isinstance(x, str):
                        x = x.strip()
                        path = "/" in x and "." in x and " " not in x
                        if 1 <= len(x) <= (LONGEST_PATH if path else LONGEST_VALUE):
                            out.append((asset, p, s, x.encode("utf-8", "replace").decode(), "string"))
                    elif x is not None and not (isinstance(x, float) and not math.isfinite(x)):
                        out.append((asset, p, s, number_text(x), "number"))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return docs.select(F.col("asset_id").cast("long"), "doc").mapInPandas(run, "asset_id long, json_pointer string, schema_pointer string, raw_value string, value_kind string")


def text_references(docs: DataFrame) -> DataFrame:
    """(asset_id, json_pointer, role, reference) of the strings in documents (asset_id, doc) that are shaped like a reference to a text.

    Unlike leaves(), keys that begin with $ and strings of any length are walked. role is the last segment of
    the pointer. The strings are as written, without trimming.
    """
    shape = re.compile(r"(?:server|common)\.[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for asset, doc in zip(pdf["asset_id"].tolist(), pdf["doc"].tolist()):
                try:
                    stack: list[tuple[str, str, object]] = [("", "", parse(doc)[0])]
                except (ValueError, AttributeError):
                    continue
                while stack:
                    p, role, x = stack.pop()
                    if isinstance(x, dict):
                        for k in reversed(x):
                            e = k.replace("~", "~0").replace("/", "~1")
                            stack.append((f"{p}/{e}", e, x[k]))
                    elif isinstance(x, list):
                        stack += [(f"{p}/{i}", str(i), x[i]) for i in reversed(range(len(x)))]
                    elif isinstance(x, str) and shape.fullmatch(x):
                        out.append((asset, p, role, x))
            yield pd.DataFrame(out, columns=["asset_id", "json_pointer", "role", "reference"])

    return docs.select(F.col("asset_id").cast("long"), "doc").mapInPandas(run, "asset_id long, json_pointer string, role string, reference string")


def unreadable(docs: DataFrame, key: list[str], doc: str = "doc") -> DataFrame:
    """key and error of the documents that are no JSON. Null documents are left out."""
    checked = docs.where(F.col(doc).isNotNull()).select(*key, repaired(F.col(doc)).alias("r"))
    return checked.where("r.error is not null").select(*key, F.col("r.error").alias("error"))
