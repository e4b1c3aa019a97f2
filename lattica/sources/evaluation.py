"""Evaluation sets of search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASE = "struct<phrase:string,tier:string,locale:string,overlap:string,expected_any:array<string>,expected_also:array<string>,must_not_rank_first:array<string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, tier, locale, overlap, expected_any, expected_also, must_not_rank_first) of JSON files that hold {"cases": [...]}; missing lists are empty."""
    cases = spark.read.schema(f"cases array<{_CASE}>").json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    none = F.array().cast("array<string>")
    return cases.withColumns({c: F.coalesce(c, none) for c in ("expected_any", "expected_also", "must_not_rank_first")})
