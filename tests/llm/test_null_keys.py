"""Nulls in keys of any type are values of their own."""

import datetime as dt

from lattica.llm import frequency


def test_null_in_a_key_that_is_no_string(spark):
    day = dt.date(2025, 1, 1)
    keys = [(None, "a", day), (None, "a", day), (0, "a", day), (7, None, None), (7, "", None)] + [(None, None, None)] * 3 + [(i, "b", day) for i in range(10, 310)]
    rows = [(*k, n % 2, n) for n, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "x long, y string, z date, record long, row long")
    expected = {}
    for *k, record, row in rows:
        expected.setdefault(tuple(k), []).append(record)
    got = frequency.frequencies(df, ["x", "y", "z"], "record", "row").collect()
    assert len(got) == len(expected)
    assert {(r.x, r.y, r.z): (r.n_rows, r.n_records) for r in got} == {k: (len(v), len(set(v))) for k, v in expected.items()}
