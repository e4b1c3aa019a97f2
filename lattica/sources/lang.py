"""Language files: `key = value` lines, comments, continued lines; and fallbacks between locales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(files: DataFrame) -> DataFrame:
    """(path, key, value) of language files (path, content).

    A backslash at a line's end joins the next line to it; lines that begin with # are comments; a line is
    cut at its first =, both sides trimmed; lines without a key are left out; the last value of a key holds.
    """
    joined = F.regexp_replace("content", r"\\[ \t]*(?:\r?\n|\z)", "")
    lines = files.select("path", F.posexplode(F.split(joined, r"\r?\n")).alias("pos", "line")).where(~F.ltrim("line").startswith("#") & F.col("line").contains("="))
    at = F.instr("line", "=")
    pairs = lines.select("path", "pos", F.trim(F.substring("line", F.lit(1), at - 1)).alias("key"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("value"))
    return pairs.where("key != ''").groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))


def read(spark, folder: str) -> DataFrame:
    """entries() of the .lang files below a folder, with their locale (the folder below Languages)."""
    from lattica.functions.text import locale_from_path

    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.lang").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return entries(files).withColumn("locale", locale_from_path(F.col("path")))


def fallbacks(files: DataFrame) -> dict[str, str]:
    """The locale each locale falls back to, from fallback files (path, content) in the syntax of language files. A handful of lines."""
    return {r["key"]: r["value"] for r in entries(files).where("value != ''").orderBy("path").collect()}


def chain(locale: str, fallbacks: dict[str, str], default: str = "en-US") -> list[str]:
    """The locales to look in, in order: as the fallbacks say, then the locale's language, then the default. Rings end."""
    out: list[str] = []
    now: str | None = locale
    while now and now not in out:
        out.append(now)
        now = fallbacks.get(now)
    return list(dict.fromkeys([*out, locale.split("-")[0], default]))


def resolve(keys: DataFrame, locale: str, fallbacks: dict[str, str], default: str = "en-US") -> DataFrame:
    """(key, value, locale) as seen from a locale, of keys (key, locale, value): the first locale of the chain that has the key holds."""
    places: Column = F.array_position(F.array(*[F.lit(x) for x in chain(locale, fallbacks, default)]), F.col("locale"))
    ranked = keys.withColumn("_place", places).where("_place > 0")
    return ranked.groupBy("key").agg(F.min_by(F.struct("value", "locale"), F.struct("_place", "value")).alias("b")).select("key", "b.value", "b.locale")
