"""Frequency of every distinct value or term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import settle

#: Identifiers of one count array.
BLOCK = 4096
#: Terms that hold more than one row in HOT are encoded by a broadcast of at most HOT terms.
HOT = 256


def _mark(key: list[str], salt: int) -> Column:
    """A 64-bit hash of a tuple in which nulls have a place of their own."""
    return F.xxhash64(F.lit(salt), *[x for k in key for x in (F.col(k).isNull(), F.col(k))])


def _same(c: str, kinds: dict[str, str]) -> Column:
    """A column that tells records or rows apart, without nulls: whole numbers as such, all else as text."""
    whole = kinds[c] in ("bigint", "int", "smallint", "tinyint")
    return F.coalesce(F.col(c).cast("long"), F.lit(0)) if whole else F.coalesce(F.col(c).cast("string"), F.lit(""))


def _prepared(rows: DataFrame, key: list[str], record: str, row: str) -> DataFrame:
    """(k0..., h1, h2, record, named, row, numbered): the keys, 128 bits to tell them by, and record and row with whether they are null."""
    kinds = dict(rows.dtypes)
    return rows.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], _mark(key, 1).alias("h1"), _mark(key, 2).alias("h2"),
        _same(record, kinds).alias("record"), F.col(record).isNotNull().alias("named"), _same(row, kinds).alias("row"), F.col(row).isNotNull().alias("numbered"),
    )


def dictionary(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each distinct tuple of key with a dense integer: (key..., n, term_id), n rows before copies are dropped.

    Identifiers count up through the partitions of the settled distinct tuples, so giving them takes one
    number per partition and no global sort.
    """
    found = settle(rows.groupBy(*key).agg(F.count("*").alias("n")))
    place = F.monotonically_increasing_id()
    numbered = found.select(*key, "n", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = {r["part"]: r["c"] for r in numbered.groupBy("part").agg(F.count("*").alias("c")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append((p, at))
        at += sizes.get(p, 0)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    return numbered.join(offsets, "part").select(*key, "n", (F.col("start") + F.col("at")).alias("term_id"))


def encode(rows: DataFrame, words: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """(term_id, keep...) for each row of a settled table. Keys hold no nulls. Hot terms, at most HOT of them, are looked up in a broadcast, so their rows aren't shuffled by term."""
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = words.where(F.col("n") * HOT > total).select(*key, F.col("term_id").alias("hot_id"))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.where("hot_id is null").select(*key, *keep).join(words.where(F.col("n") * HOT <= total).select(*key, "term_id"), key)
    return marked.where("hot_id is not null").select(F.col("hot_id").alias("term_id"), *keep).unionByName(cold.select("term_id", *keep))


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sparse count arrays of each block of rows sorted by (term_id, named, record, numbered, row)."""
    now, occ, pres = None, None, None
    last = (None,) * 5

    def flush() -> pd.DataFrame:
        at = np.flatnonzero(occ)
        return pd.DataFrame({"block": [now], "at": [at.astype(np.int32)], "rows": [occ[at]], "records": [pres[at]]})

    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[c].to_numpy() for c in ("term_id", "named", "record", "numbered", "row")]
        same = np.ones(len(pdf), dtype=bool)
        for i, c in enumerate(columns):
            same = same & np.concatenate([[c[0] == last[i]], c[1:] == c[:-1]])
            if i == 2:
                same_record = same
        last = tuple(c[-1] for c in columns)
        term, named = columns[0], columns[1].astype(bool)
        block = term // BLOCK
        cuts = (np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if now != block[a]:
                if now is not None:
                    yield flush()
                now, occ, pres = int(block[a]), np.zeros(BLOCK, dtype=np.int64), np.zeros(BLOCK, dtype=np.int64)
            at = term[a:b] - now * BLOCK
            occ += np.bincount(at[~same[a:b]], minlength=BLOCK)
            pres += np.bincount(at[~same_record[a:b] & named[a:b]], minlength=BLOCK)
    if now is not None:
        yield flush()


def _sum_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of the count arrays of each range of identifiers, of arrays sorted by block: one range is held at a time."""
    now, occ, pres = None, None, None

    def flush() -> pd.DataFrame:
        at = np.flatnonzero(occ)
        return pd.DataFrame({"term_id": at + now * BLOCK, "n_rows": occ[at], "n_records": pres[at]})

    for pdf in batches:
        for block, at, rows, records in zip(pdf["block"].tolist(), pdf["at"], pdf["rows"], pdf["records"]):
            if block != now:
                if now is not None:
                    yield flush()
                now, occ, pres = block, np.zeros(BLOCK, dtype=np.int64), np.zeros(BLOCK, dtype=np.int64)
            occ[at] += rows
            pres[at] += records
    if now is not None:
        yield flush()


def _counted(there: DataFrame, n_keys: int) -> DataFrame:
    """(k0..., n_rows, n_records) of a settled table of _prepared()."""
    marks, keys = ["h1", "h2"], [f"k{i}" for i in range(n_keys)]
    words = settle(dictionary(there, [*marks, *keys]))
    order = ["term_id", "named", "record", "numbered", "row"]
    coded = encode(there, words, marks, order[1:])
    parts = coded.repartition(F.col("term_id"), F.col("record")).sortWithinPartitions(*order).mapInPandas(_accumulate, "block long, at array<int>, rows array<long>, records array<long>")
    sums = parts.repartition("block").sortWithinPartitions("block").mapInPandas(_sum_blocks, "term_id long, n_rows long, n_records long")
    return sums.join(words, "term_id").select(*keys, "n_rows", "n_records")


def frequencies(rows: DataFrame, key: list[str], record: str, row: str) -> DataFrame:
    """(key..., n_rows, n_records) for each distinct tuple of key: its rows and the records they are in.

    Defined cases: nulls in a key are a value of their own (the caller drops what is no value); copies of a
    row (equal key, record and row) count once; a null record is no record; null rows of one term and record
    count once; an empty table yields no rows. Only the named columns are read.

    Method: a global integer dictionary encodes the terms; encoded rows are dealt by term and record, where
    count arrays of occurrences and record presence are filled block by block from a sorted stream; the
    arrays are summed by identifier range and decoded.
    Scale: the rows are read and settled once; terms are told apart by 128 bits, so no text is shuffled but
    the dictionary's, which is reduced on the map side. No task holds more than one array of each kind; a
    term with a third of all rows is encoded by broadcast and dealt over all tasks by record, and a record
    with as many over all tasks by term. Records and rows are compared as they are, so counts are exact.
    """
    found = _counted(settle(_prepared(rows, key, record, row)), len(key))
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], "n_rows", "n_records")


def marked_values(values: DataFrame, least_common: int = 20, share: tuple[int, int] = (2, 5)) -> DataFrame:
    """Frequencies of the values of fields (scope, field, value, record, row), marked rare, common or kept.

    rare: in one record; common: in at least least_common records and at least share of the records that
    have a value in the field; both bounds are exact fractions. The fields' own records are counted from the
    same settled rows.
    """
    there = settle(_prepared(values, ["scope", "field", "value"], "record", "row"))
    terms = _counted(there, 3).select(F.col("k0").alias("scope"), F.col("k1").alias("field"), F.col("k2").alias("value"), "n_rows", "n_records")
    fields = there.where("named").select("k0", "k1", "record").distinct().groupBy("k0", "k1").agg(F.count("*").alias("of"))
    mark = F.when(F.col("n_records") == 1, "rare").when((F.col("n_records") >= least_common) & (F.col("n_records") * share[1] >= F.col("of") * share[0]), "common").otherwise("kept")
    same = F.col("scope").eqNullSafe(F.col("k0")) & F.col("field").eqNullSafe(F.col("k1"))
    return terms.join(fields, same, "left").withColumn("of", F.coalesce("of", F.lit(0))).select("scope", "field", "value", "n_rows", "n_records", mark.alias("mark"))
