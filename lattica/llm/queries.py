"""Queries p7 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.canonical import canonical_pointer, trimmed
from lattica.llm import frequency, language, packing, winnow
from lattica.session import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    values = (
        table(spark, d, "candidates")
        .select(F.col("schema_scope").alias("scope"), canonical_pointer(F.col("schema_pointer")).alias("field"), trimmed(F.col("raw_value")).alias("value"), F.col("asset_id").alias("record"), F.col("id").alias("row"))
        .where("scope is not null and value != ''")
    )
    found = frequency.marked_values(values)
    return found.select(F.col("scope").alias("asset_type"), F.col("field").alias("json_pointer"), F.col("value").alias("raw_value"), "n_rows", F.col("n_records").alias("n_assets"), "mark")


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, d, "documents")).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size"))
    windows = table(spark, d, "token_windows").select("window_name", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(sizes, windows).select("window_name", "window_no", F.col("item").alias("doc_id"), "part", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return winnow.leaks(table(spark, d, "eval_items"), table(spark, d, "documents")).select("item_id", "doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and how much of them at most."""
    found = winnow.leaks(table(spark, d, "eval_items"), table(spark, d, "documents"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("most_words"), F.first("of_words").alias("of_words"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"), "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(language.identify(_labelled(spark, d)))


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(_labelled(spark, d)).select("doc_id", "stretch", "lang", F.round("confidence", 4).alias("confidence"), "sentences", "words")


QUERIES = {f.__name__: f for f in (p7_found, p8_windows, p9_found, p9_report, p10_found, p10_stretches)}

_WS = r"[\s\x1c-\x1f\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _words(c: str) -> str:
    """The words of a text as a list, by the rules of TESTDATA.md."""
    bare = rf"regexp_replace(regexp_replace({c}, '</?(?:a|b|code|em|i|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>]*)?>', '', 'gi'), '</?[A-Za-z][^<>]*>', ' ', 'g')"
    bare = f"replace(replace({bare}, '&nbsp;', ' '), '&#x27;', chr(39))"
    lines = rf"regexp_replace({bare}, '(^|\s)\d+\)\s', ' ', 'g')"
    seen = rf"regexp_replace({lines}, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g')"
    folded = rf"replace(lower(strip_accents({seen})), 'ß', 'ss')"
    return rf"regexp_extract_all(regexp_replace({folded}, '(\p{{Han}})', ' \1 ', 'g'), '[\pL\pN]+')"


_P9 = f"""
WITH iw AS (SELECT item_id, {_words('text')} w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, {_words('text')} w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, len(w) n, i, hash(w[i:i + 7]) g FROM (SELECT *, unnest(range(1, len(w) - 6)) i FROM iw)),
dg AS (SELECT DISTINCT doc_id, hash(w[i:i + 7]) g FROM (SELECT *, unnest(range(1, len(w) - 6)) i FROM dw)),
c AS (SELECT DISTINCT item_id, doc_id, n, unnest(range(i, i + 8)) place FROM ig JOIN dg USING (g)),
l AS (SELECT item_id, doc_id, n, count(*) k FROM c GROUP BY ALL HAVING count(*) >= 20 AND count(*) * 5 >= n * 2)
"""

ORACLE = {
    "p9_found": _P9 + "SELECT DISTINCT item_id, doc_id FROM l",
    "p9_report": _P9 + "SELECT item_id, count(DISTINCT doc_id) n_docs, max(k) most_words, any_value(n) of_words FROM l GROUP BY 1",
    "p7_found": f"""
WITH c AS (SELECT DISTINCT id, asset_id, schema_scope s, '/' || regexp_replace({_trim('schema_pointer')}, '^/+|/+$', '', 'g') p, {_trim('raw_value')} v FROM candidates WHERE schema_scope IS NOT NULL),
k AS (SELECT * FROM c WHERE v <> ''),
f AS (SELECT s, p, count(DISTINCT asset_id) n FROM k GROUP BY ALL),
t AS (SELECT s, p, v, count(DISTINCT id) r, count(DISTINCT asset_id) a FROM k GROUP BY ALL)
SELECT s asset_type, p json_pointer, v raw_value, r n_rows, a n_assets, CASE WHEN a = 1 THEN 'rare' WHEN a >= 20 AND 5 * a >= 2 * f.n THEN 'common' ELSE 'kept' END mark FROM t JOIN f USING (s, p)""",
}
