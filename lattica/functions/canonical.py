"""Canonical forms of paths, digests, pointers and values, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind at either end, the separators 1C to 1F among it.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(c, _ENDS, "")


def canonical_path(c: Column) -> Column:
    """Relative, with forward slashes and without empty or `.` segments; case is kept."""
    parts = F.split(F.translate(c, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/")


def canonical_digest(c: Column) -> Column:
    """Lower case, trimmed, without the name of the algorithm before a colon; nothing left is null."""
    bare = F.regexp_replace(F.lower(trimmed(c)), r"^[a-z0-9_-]*:\s*", "")
    return F.when(bare != "", bare)


def canonical_pointer(c: Column) -> Column:
    """With one leading slash and no trailing one; the empty pointer stays empty."""
    bare = F.regexp_replace(trimmed(c), r"^/+|/+$", "")
    return F.when(bare == "", bare).otherwise(F.concat(F.lit("/"), bare))


def canonical_kind(c: Column) -> Column:
    """Letters and digits in upper case: one spelling for `INHERITS_FROM`, `inherits from` and the like."""
    return F.upper(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]", ""))


def schema_pointer(c: Column) -> Column:
    """List positions of a pointer shown as `*`."""
    return F.regexp_replace(c, r"/\d+(?=/|$)", "/*")


def row_hash(*cols: Column) -> Column:
    """64-bit hash of a tuple of strings in which nulls have a place of their own."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))])


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$"


def decimal_value(c: Column) -> Column:
    """A number written in any usual way (sign, leading zeros, decimals, exponent), else null."""
    bare = trimmed(c)
    return F.when(bare.rlike(_NUMBER), bare.try_cast("decimal(38,12)"))


def whole_value(c: Column) -> Column:
    """A whole number (also 5.0 or 5e0) as long, else null."""
    n = decimal_value(c)
    return F.when(n == F.floor(n), n.try_cast("bigint"))


def flag_value(c: Column) -> Column:
    """`true` for true, yes, 1, `false` for false, no, 0, in any case, else null."""
    low = F.lower(trimmed(c))
    return F.when(low.isin("true", "yes", "1"), F.lit("true")).when(low.isin("false", "no", "0"), F.lit("false"))
