"""Full-text search over names, texts and declared fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.session import settle

LEVELS = 4
LONGEST_RUN = 3
SHORTEST_BEGIN = T.SHORTEST_STEM - 1
K1, B = 1.2, 0.75


def search_docs(assets: DataFrame, edges: DataFrame, lang_keys: DataFrame) -> DataFrame:
    """(asset_id, logical_id, type, locale, display_name, description): a row for each asset and locale, and one of the identifier's own words with an empty locale.

    An edge to one locale's row of a key stands for the key in all locales; a role or pointer that speaks of a
    description goes there, all others to the name; texts are joined in the order of pointers.
    """
    a = assets.select(F.col("id").alias("asset_id"), "logical_id", "type").distinct()
    keys = lang_keys.select("id", "key", "root")
    role = F.lower(F.element_at(F.split("json_pointer", "/"), -1)).contains("desc")
    e = edges.where("dst_kind = 'lang_key'").select(F.col("src").alias("asset_id"), F.col("dst").alias("id"), "json_pointer").distinct()
    named = e.join(keys, "id").select("asset_id", "json_pointer", "key", F.coalesce("root", F.lit("")).alias("root")).distinct()
    texts = lang_keys.select("key", F.coalesce("root", F.lit("")).alias("root"), "locale", "value").distinct()
    each = named.join(texts, ["key", "root"]).select("asset_id", "locale", role.alias("desc"), F.struct("json_pointer", "value").alias("x"))
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("x")))), lambda x: x["value"]), " ")
    by_locale = each.groupBy("asset_id", "locale").agg(text(~F.col("desc")).alias("display_name"), text(F.col("desc")).alias("description"))
    own = a.select("asset_id", "logical_id", "type", F.lit("").alias("locale"), F.array_join(T.expand_identifier(F.col("logical_id")), " ").alias("display_name"), F.lit("").alias("description"))
    return by_locale.join(a, "asset_id").select("asset_id", "logical_id", "type", "locale", "display_name", "description").unionByName(own)


def postings(docs: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., field, term, pos, prefix) of the words of a table's columns: the index to write, partitioned by prefix, for repeated searches."""
    each = [docs.select(*key, F.lit(c).alias("field"), F.posexplode(T.terms(F.col(c))).alias("pos", "term")) for c in columns]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.withColumn("prefix", F.substring("term", 1, 2))


def query_terms(spark, query: str) -> list[str]:
    """The words of a query; neighbouring ideographs are one phrase, joined by spaces."""
    words = spark.createDataFrame([(query,)], "q string").select(T.terms(F.col("q")).alias("t")).first()["t"]
    out: list[str] = []
    phrase = False
    for w in words:
        ideograph = len(w) == 1 and "㐀" <= w <= "鿿"
        if ideograph and phrase:
            out[-1] += " " + w
        else:
            out.append(w)
        phrase = ideograph
    return out


def _begins(stem: str):
    return lambda w: w.startswith(stem)


def _level(words: Column, term: str) -> Column:
    """How many letters must be cut off a term's end until some word begins with it; null beyond LEVELS - 1."""
    if " " in term or "㐀" <= term <= "鿿":
        return F.when(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {term} "), 0)
    out = None
    for level in range(LEVELS):
        stem = term[: max(T.SHORTEST_STEM - 1, len(term) - level)] if len(term) >= T.SHORTEST_STEM else term
        test = F.exists(words, _begins(stem))
        out = F.when(test, level) if out is None else out.when(test, level)
    return out


def matches(docs: DataFrame, columns: list[str], terms: list[str], widen: bool = False) -> DataFrame:
    """docs in which all terms occur (with widen: any), with level, the letters cut off at most, and a bm25 score.

    The terms may stand in different columns of a row. One scan without a shuffle, whose matches are settled
    and which counts as it goes; equal scores are the caller's to order.
    """
    words = docs.withColumn("_words", F.concat(*[T.terms(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    levels = [_level(F.col("_words"), t) for t in terms]
    hit = words.withColumn("_levels", F.array(*levels) if levels else F.array().cast("array<int>"))
    some = F.exists("_levels", lambda x: x.isNotNull())
    every = ~F.exists("_levels", lambda x: x.isNull())
    stats = Observation()  # the collection's numbers are taken while its rows pass by
    seen = hit.observe(stats, F.count(F.lit(1)).alias("n"), F.avg(F.size("_words")).alias("avg"), *[F.count(F.col("_levels")[i]).alias(f"df{i}") for i in range(len(terms))])
    found = settle(seen.where(some if widen else every & (F.size("_levels") > 0)))
    stats = stats.get
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        stem = t[: max(T.SHORTEST_STEM - 1, len(t) - LEVELS + 1)] if len(t) >= T.SHORTEST_STEM and " " not in t else t.split(" ")[0]
        tf = F.size(F.filter("_words", _begins(stem))).cast("double")
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_words") / F.lit(float(stats["avg"] or 1))))
    return found.withColumn("level", F.array_max("_levels")).withColumn("score", score).drop("_words", "_levels")


def search(docs: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """The best assets for a query: (rank, logical_id, type, level, score).

    The strictest level at which an identity is found holds; identifiers' own words rank behind texts,
    scaffolding behind content, and no family of names runs on for more than LONGEST_RUN hits.
    """
    terms = query_terms(docs.sparkSession, query)
    found = matches(docs if kind is None else docs.where(F.col("type") == kind), ["display_name", "description"], terms)
    return _ranked(found, limit)


def search_index(docs: DataFrame, postings_: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """search() over a written index: docs (doc, and search_docs()' columns), postings_ (doc, field, term, pos) ordered by term.

    Only postings whose word lies between a term's shortest beginning and the next one are read, which the
    stored table's statistics prune; texts are fetched for the documents that hold all terms alone. Scores
    are those of search().
    """
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    empty = "rank int, logical_id string, type string, level int, score double"
    if not terms:
        return spark.createDataFrame([], empty)
    first = [t.split(" ")[0] for t in terms]
    stems = [f[: max(SHORTEST_BEGIN, len(f) - LEVELS + 1)] if len(f) >= T.SHORTEST_STEM and " " not in t else f for t, f in zip(terms, first)]
    near = F.lit(False)
    for x in stems:
        near = near | ((F.col("term") >= x) & (F.col("term") < x + chr(0x10FFFF)))
    level = lambda t: _level(F.array("term"), t) if " " not in t else F.when(F.col("term") == t.split(" ")[0], 0)
    each = postings_.where(near).groupBy("doc").agg(*[c for i, (t, x) in enumerate(zip(terms, stems)) for c in (F.min(level(t)).alias(f"l{i}"), F.count(F.when(F.col("term").startswith(x), 1)).cast("double").alias(f"tf{i}"))])
    each = settle(each)
    totals = {"words": postings_.count(), "n": docs.count()}
    spaced = F.concat(F.lit(" "), F.array_join(F.concat(T.terms(F.coalesce("display_name", F.lit(""))), T.terms(F.coalesce("description", F.lit("")))), " "), F.lit(" "))
    phrases = [i for i, t in enumerate(terms) if " " in t]
    if phrases:  # a phrase counts where its ideographs follow one another
        texts = each.join(docs.select("doc", spaced.alias("_text")), "doc")
        each = settle(texts.select("doc", *[c for i in range(len(terms)) for c in (F.when(F.col("_text").contains(f" {terms[i]} "), F.col(f"l{i}")).alias(f"l{i}") if i in phrases else F.col(f"l{i}"), F.col(f"tf{i}"))]))
    found = each.agg(*[F.count(f"l{i}").alias(f"df{i}") for i in range(len(terms))]).first()
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & F.col(f"l{i}").isNotNull()
    held = each.where(every).join(docs if kind is None else docs.where(F.col("type") == kind), "doc")
    size = F.size(T.terms(F.coalesce("display_name", F.lit("")))) + F.size(T.terms(F.coalesce("description", F.lit(""))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (totals["n"] - found[f"df{i}"] + 0.5) / (found[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(totals["words"] / max(1, totals["n"]) or 1.0)))
    ranked = held.withColumn("level", F.greatest(*[F.col(f"l{i}") for i in range(len(terms))], F.lit(0))).withColumn("score", score)
    return _ranked(ranked, limit)


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    """(rank, logical_id, type, level, score) of matches: the strictest level of each identity, own words behind texts, scaffolding last, families interleaved."""
    best = found.groupBy("logical_id", "type").agg(F.min(F.struct("level", (F.col("locale") == "").alias("own"), (-F.col("score")).alias("less"))).alias("b"))
    top = best.orderBy(T.is_scaffolding(F.col("logical_id")), "b", "logical_id", "type").limit(max(10 * limit, 100))
    rows = [r.asDict() for r in top.select("logical_id", "type", F.col("b.level").alias("level"), (-F.col("b.less")).alias("score")).collect()]
    data = [(i, r["logical_id"], r["type"], r["level"], r["score"]) for i, r in enumerate(interleave(rows, _family)[:limit])]
    return found.sparkSession.createDataFrame(data, "rank int, logical_id string, type string, level int, score double")


def _family(r: dict) -> str:
    return r["logical_id"].split("_")[0] if r["logical_id"].find("_") > 0 else r["logical_id"]


def matches_batch(docs: DataFrame, columns: list[str], queries: DataFrame) -> DataFrame:
    """matches for all rows of queries (query, text) at once: docs' columns with query, level and score, a row for each query and row of docs that holds all its terms.

    The queries' terms meet the words of the postings by their first letters, and the rows that hold a query's rarest
    term are looked up for its others. Queries of the same words are answered once.
    """
    words = F.concat(*[T.terms(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    d = settle(docs.withColumn("_words", words).withColumn("_size", F.size("_words")).withColumn("_doc", F.monotonically_increasing_id()))
    stats = d.agg(F.count("*").alias("n"), F.avg("_size").alias("avg")).first()
    counts = postings(d.select("_doc", "_size", *columns), ["_doc", "_size"], columns).groupBy("_doc", "_size", F.col("term").alias("word")).agg(F.count("*").alias("n"))
    counts = settle(counts)

    phrases = F.split(F.regexp_replace(F.array_join(T.terms(F.col("text")), "\n"), "([㐀-鿿])\n(?=[㐀-鿿])", "$1 "), "\n")
    asked = settle(queries.select("query", phrases.alias("terms")).where("terms is not null and terms != array('')").distinct())
    sets = settle(asked.select("terms").distinct().withColumn("_set", F.monotonically_increasing_id()))
    terms = sets.select("_set", F.posexplode("terms").alias("pos", "term"))

    stem = F.split(T.relax(F.col("term"), LEVELS - 1), " ")[0]
    stems = terms.select("term").distinct().withColumn("stem", stem).withColumn("begin", F.substring("stem", 1, SHORTEST_BEGIN))
    begins = F.transform(F.sequence(F.lit(1), F.least(F.lit(SHORTEST_BEGIN), F.length("word"))), lambda i: F.substring(F.col("word"), F.lit(1), i))
    vocabulary = counts.select("word").distinct().withColumn("begin", F.explode(begins))
    level = F.coalesce(*[F.when(F.col("word").startswith(T.relax(F.col("term"), n)), n) for n in range(LEVELS)], F.lit(0))
    pairs = stems.join(vocabulary, "begin").where(F.col("word").startswith(F.col("stem"))).select("term", "word", level.alias("level"))

    hits = settle(counts.join(pairs, "word").groupBy("_doc", "_size", "term").agg(F.min("level").alias("level"), F.sum("n").cast("double").alias("tf")))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    several = hits.where(F.col("term").contains(" ")).join(d.select("_doc", "_words"), "_doc").where(spaced(F.array_join("_words", " ")).contains(spaced(F.col("term")))).drop("_words")
    hits = hits.where(~F.col("term").contains(" ")).unionByName(several)

    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(stats["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = settle(terms.join(df, "term").withColumn("idf", idf))
    rarest = weighed.groupBy("_set").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("_found")).join(sets.select("_set", F.size("terms").alias("_asked")), "_set").where("_found = _asked")
    near = rarest.join(hits.select("_doc", "term"), "term").select("_set", "_asked", "_doc")
    each = near.join(weighed.select("_set", "pos", "term", "idf"), "_set").join(hits, ["_doc", "term"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_size") / F.lit(float(stats["avg"] or 1))))
    held = each.groupBy("_set", "_doc", "_asked").agg(F.count("*").alias("_n"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", part.alias("s")))).alias("_parts")).where("_n = _asked")
    score = F.aggregate("_parts", F.lit(0.0), lambda total, x: total + x["s"])
    found = held.select("_set", "_doc", "level", score.alias("score")).join(d.drop("_words", "_size"), "_doc").drop("_doc")
    return asked.join(sets, "terms").select("query", "_set").join(found, "_set").drop("_set")


def search_batch(docs: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """search for all rows of queries (query, text) at once: (query, rank, logical_id, type, level, score). A query's few best rows are ranked by one Python call."""
    same = queries.groupBy("text").agg(F.collect_set("query").alias("queries"), F.min("query").alias("query"))
    found = matches_batch(docs, ["display_name", "description"], same.select("query", "text"))
    best = found.groupBy("query", "logical_id", "type").agg(F.min(F.struct("level", (F.col("locale") == "").alias("own"), (-F.col("score")).alias("less"))).alias("b"))
    order = Window.partitionBy("query").orderBy(T.is_scaffolding(F.col("logical_id")), "b", "logical_id", "type")
    top = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(10 * limit, 100)).select("query", "_n", "logical_id", "type", F.col("b.level").alias("level"), (-F.col("b.less")).alias("score"))

    def ranked(rows):
        import pandas as pd

        out = interleave(rows.sort_values("_n").to_dict("records"), _family)[:limit]
        return pd.DataFrame({"query": [r["query"] for r in out], "rank": range(len(out)), **{c: [r[c] for r in out] for c in ("logical_id", "type", "level", "score")}})

    kind = queries.schema["query"].dataType.simpleString()
    answers = top.groupBy("query").applyInPandas(ranked, f"query {kind}, rank int, logical_id string, type string, level int, score double")
    return same.select("query", F.explode("queries").alias("_each")).join(answers, "query").drop("query").withColumnRenamed("_each", "query").select("query", "rank", "logical_id", "type", "level", "score")


def interleave(rows: list, family, longest: int = LONGEST_RUN) -> list:
    """Rows in order, but a family that has run on for `longest` lets the next row of another family go first. For the few rows of an answer."""
    from collections import deque

    waiting, out, run = deque(rows), [], 0
    last = object()
    while waiting:
        skipped = []
        if run >= longest:
            while waiting and family(waiting[0]) == last:
                skipped.append(waiting.popleft())
            if not waiting:
                return out + skipped
        row = waiting.popleft()
        run = run + 1 if family(row) == last else 1
        last = family(row)
        out.append(row)
        waiting.extendleft(reversed(skipped))
    return out


def search_fields(schema_fields: DataFrame, query: str) -> DataFrame:
    """Declared fields whose words hold all terms of a query, at the first level that finds any; if none does, fields that hold some."""
    docs = schema_fields.select("asset_type", "json_pointer", F.array_join(T.expand_identifier(F.concat_ws(" ", "asset_type", "json_pointer")), " ").alias("words"))
    terms = query_terms(schema_fields.sparkSession, query)
    for widen in (False, True):
        found = matches(docs, ["words"], terms, widen)
        least = found.agg(F.min("level").alias("l")).first()["l"]
        if least is not None:
            return found.where(F.col("level") == least).select("asset_type", "json_pointer", "level", F.lit(widen).alias("widened"))
    return found.select("asset_type", "json_pointer", "level", F.lit(True).alias("widened"))


def literal(assets: DataFrame, query: str) -> DataFrame:
    """Assets whose name equals or holds the text, whatever the case; _ and % are wildcards, as in LIKE."""
    return assets.where(F.col("logical_id").ilike(f"%{query}%")).select("logical_id", "type", (F.lower("logical_id") == query.lower()).alias("exact")).distinct()


def search_texts(lang_keys: DataFrame, query: str) -> DataFrame:
    """Language keys that are, hold or mean the text: (key, locale, value, how)."""
    bare = query.split(".", 1)[1] if query.startswith(("server.", "common.")) else query
    how = F.when(F.col("key").isin(query, bare), "key").when(F.concat_ws(".", "root", "key") == query, "reference").when(F.col("key").ilike(f"%{bare}%"), "in key").when(F.col("value").ilike(f"%{query}%"), "in value")
    return lang_keys.select("key", "locale", "value", how.alias("how")).where("how is not null").distinct()


def recall(results: DataFrame, cases: DataFrame, at: int = 5) -> DataFrame:
    """(tier, n, passed) of search results (phrase, rank, logical_id) held against cases (phrase, tier, expected_any[, expected_also, must_not_rank_first]).

    A case passes if one of the expected names is among the first `at`, one of expected_also too where there
    are any, and none of must_not_rank_first is the first. Cases that expect nothing are no cases.
    """
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) if c in cases.columns else none for c in ("expected_also", "must_not_rank_first")}
    top = results.where(F.col("rank") < at).groupBy("phrase").agg(F.collect_set("logical_id").alias("ids"), F.min_by("logical_id", "rank").alias("first"))
    j = cases.withColumns(lists).where(F.size("expected_any") > 0).join(top, "phrase", "left").withColumn("ids", F.coalesce("ids", none))
    ok = F.arrays_overlap("ids", "expected_any") & ((F.size("expected_also") == 0) | F.arrays_overlap("ids", "expected_also")) & ~F.coalesce(F.array_contains("must_not_rank_first", F.col("first")), F.lit(False))
    return j.groupBy("tier").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("passed"))


def evaluate(docs: DataFrame, cases: DataFrame, at: int = 5) -> DataFrame:
    """recall() of search_batch() over evaluation cases (phrase, tier, ...)."""
    asked = cases.select("phrase").distinct().select(F.col("phrase").alias("query"), F.col("phrase").alias("text"))
    return recall(search_batch(docs, asked, at).withColumnRenamed("query", "phrase"), cases, at)
