"""Problems 1 to 6 against brute force and on awkward input."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import canonical
from lattica.operators import hierarchy, incremental, intervals, nested, orphans, snapshots, wide

DAY = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (canonical.canonical_path, "\\Server//a/./B.json", "Server/a/B.json"),
        (canonical.canonical_path, "./x", "x"),
        (canonical.canonical_path, None, None),
        (canonical.canonical_digest, " SHA256:ABCDEF ", "abcdef"),
        (canonical.canonical_digest, "", None),
        (canonical.canonical_pointer, "Quality/", "/Quality"),
        (canonical.canonical_pointer, "", ""),
        (canonical.canonical_kind, "inherits from", "INHERITSFROM"),
        (canonical.trimmed, "\t\u00a0x y\u3000\n", "x y"),
        (canonical.whole_value, " +5e0\t", 5),
        (canonical.whole_value, "007.00", 7),
        (canonical.whole_value, "1.5", None),
        (canonical.whole_value, "NaN", None),
        (canonical.whole_value, "", None),
        (canonical.whole_value, "9" * 60, None),
        (canonical.flag_value, " YES", "true"),
        (canonical.flag_value, "0", "false"),
        (canonical.flag_value, "-", None),
        (canonical.schema_pointer, "/a/0/1/b2/3", "/a/*/*/b2/*"),
    ],
)
def test_canonical(spark, f, value, want):
    assert one(spark, value, f) == want


def changes(spark, data):
    df = spark.createDataFrame(data, "v int, s int, k string, l string, h string, t timestamp_ntz, id long, change string, hi string")
    got = snapshots.snapshot_changes(df, version=F.col("v"), scope=F.col("s"), key=F.col("k"), identity=[F.col("l")], digest=F.col("h"), delivered=F.col("t"), ties=[F.col("id")])
    return rows(got)


def test_snapshots_against_brute_force(spark):
    rng = random.Random(1)
    data = []
    for v in range(1, 5):
        for s in (1, 2, 3):
            if rng.random() < 0.3:
                continue
            for k in "abcdefgh":
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    data.append((v, s, k, rng.choice("xy"), rng.choice(["1", "2", None]), DAY + dt.timedelta(minutes=rng.randrange(5)), len(data), "clash", "clash"))
    data += data[:5]  # repeated rows
    want = []
    for s in (1, 2, 3):
        seen = sorted({d[0] for d in data if d[1] == s})
        state = {v: {} for v in seen}
        for d in sorted(data, key=lambda d: (d[5], d[6])):
            if d[1] == s:
                state[d[0]][d[2]] = (d[3], d[4])
        for a, b in zip(seen, seen[1:]):
            for k in set(state[a]) | set(state[b]):
                x, y = state[a].get(k), state[b].get(k)
                change = "added" if x is None else "removed" if y is None else "changed" if x[0] != y[0] or (x[1] and y[1] and x[1] != y[1]) else None
                if change:
                    want.append((b, s, k, change))
    assert changes(spark, data) == sorted(want, key=str)


def test_snapshots_awkward(spark):
    assert changes(spark, []) == []
    one_ = (1, 1, "a", None, None, None, 1, None, None)
    assert changes(spark, [one_, (2, 1, "a", "x", None, None, 2, None, None), (2, None, "a", "x", "1", DAY, 3, None, None), (2, 1, None, "x", "1", DAY, 4, None, None)]) == [(2, 1, "a", "changed")]
    long = "p" * 100_000
    assert changes(spark, [one_, (2, 1, long, "x", "1", DAY, 2, None, None)]) == sorted([(2, 1, "a", "removed"), (2, 1, long, "added")], key=str)


def numbers(df):
    return {x for lo, hi in map(tuple, df.collect()) for x in range(lo, hi + 1)}


def test_intervals_against_sets(spark):
    rng = random.Random(2)
    for width in (7, 64):
        a = [(lo, lo + rng.randrange(-1, 30)) for lo in (rng.randrange(-50, 200) for _ in range(20))]
        p = [(lo, lo + rng.randrange(-1, 20)) for lo in (rng.randrange(-50, 200) for _ in range(12))]
        da, dp = (spark.createDataFrame(x, "lo long, hi long") for x in (a, p))
        sa, sp = ({n for lo, hi in x for n in range(lo, hi + 1)} for x in (a, p))
        assert numbers(intervals.subtract(da, dp, width)) == sa - sp
        merged = intervals.merge(da, dp, width=width)
        assert numbers(merged) == sa | sp
        assert sum(hi - lo + 1 for lo, hi in map(tuple, merged.collect())) == len(sa | sp)
    points = spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "n long")
    assert rows(intervals.islands(points, "n")) == [(1, 2), (9, 9)]
    none = spark.createDataFrame([], "lo long, hi long")
    assert rows(intervals.subtract(none, none)) == []


def test_ledger_survives_failure(spark, tmp_path):
    ledger = intervals.Ledger(spark, str(tmp_path / "ledger"))
    available = spark.createDataFrame([(0, 9)], "lo long, hi long")
    gaps = ledger.gaps(available)
    assert numbers(gaps.intervals) == set(range(10))
    first = spark.createDataFrame([(0, 3), (6, 6)], "lo long, hi long")
    ledger.commit(intervals.numbers(first, "n"), gaps, first)
    # a run that wrote its output but never published it does not count
    intervals.numbers(available, "n").write.parquet(str(tmp_path / "ledger/run-lost/output"))
    later = spark.createDataFrame([(0, 11)], "lo long, hi long")
    gaps = intervals.Ledger(spark, str(tmp_path / "ledger")).gaps(later)
    assert numbers(gaps.intervals) == {4, 5, 7, 8, 9, 10, 11}
    with pytest.raises(ValueError, match="processed before"):
        ledger.commit(intervals.numbers(later, "n"), gaps, later)
    ledger.commit(intervals.numbers(gaps.intervals, "n"), gaps)
    assert sorted(r[0] for r in ledger.outputs().collect()) == list(range(12))
    assert rows(ledger.gaps(later).intervals) == []


def test_ledger_refuses_overlapping_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    available = spark.createDataFrame([(0, 9)], "lo long, hi long")
    one, two = intervals.Ledger(spark, path), intervals.Ledger(spark, path)
    a, b = one.gaps(available), two.gaps(available)
    one.commit(intervals.numbers(a.intervals, "n"), a)
    with pytest.raises(RuntimeError, match="take the gaps anew"):
        two.commit(intervals.numbers(b.intervals, "n"), b)
    # both may pass the first look and meet only at the marker
    more = spark.createDataFrame([(0, 19)], "lo long, hi long")
    a, b = one.gaps(more), two.gaps(more)
    publish = intervals.Ledger._publish

    def late(self, run, number):
        if self is two:
            one.commit(intervals.numbers(a.intervals, "n"), a)
        publish(self, run, number)

    monkeypatch.setattr(intervals.Ledger, "_publish", late)
    with pytest.raises(RuntimeError, match="take the gaps anew"):
        two.commit(intervals.numbers(b.intervals, "n"), b)
    assert sorted(r[0] for r in one.outputs().collect()) == list(range(20)) and len(one.runs()) == 2

    def crash(self, run, number):
        raise OSError("the machine is gone")

    # a crash between output and marker leaves the numbers to the next run
    monkeypatch.setattr(intervals.Ledger, "_publish", crash)
    last = spark.createDataFrame([(0, 24)], "lo long, hi long")
    gaps = two.gaps(last)
    with pytest.raises(OSError):
        two.commit(intervals.numbers(gaps.intervals, "n"), gaps)
    monkeypatch.setattr(intervals.Ledger, "_publish", publish)
    gaps = one.gaps(last)
    assert numbers(gaps.intervals) == set(range(20, 25))
    one.commit(intervals.numbers(gaps.intervals, "n"), gaps)
    assert sorted(r[0] for r in two.outputs().collect()) == list(range(25))


def test_markers_of_a_shared_store_are_never_replaced(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = intervals.Ledger(spark, path)

    class Store:  # a file system that isn't of this machine, by its scheme
        def __getattr__(self, name):
            return getattr(ledger_fs, name)

        def getUri(self):  # noqa: N802
            return type("U", (), {"getScheme": staticmethod(lambda: "shared")})()

    ledger_fs, ledger._fs = ledger._fs, Store()
    ledger._publish("run-a", 0)
    with pytest.raises(RuntimeError):
        ledger._publish("run-b", 0)
    assert [r["run"] for r in ledger.runs()] == ["run-a"]


def test_unprocessed_rules(spark):
    there = [(1, "a", 5), (2, "b", 5), (3, None, 5), (4, "d", 9), (5, None, 9), (6, "f", 1), (7, None, None), (None, "x", 1), (1, "a", 5)]
    done = [(1, 1, "a", 1), (2, 1, "b", 9), (2, 3, "z", 9), (3, 2, "c", 5), (4, 2, None, 8), (5, 2, None, 9), (7, 1, None, 3), (6, None, "f", 1), (None, 1, "q", 1)]
    a = spark.createDataFrame([(*r, "clash") for r in there], "seq long, digest string, epoch long, d string")
    b = spark.createDataFrame(done, "seq long, run int, digest string, epoch long")
    assert rows(incremental.unprocessed(a, b)) == [(2,), (4,), (6,), (7,)]
    assert rows(incremental.unprocessed(a.limit(0), b)) == []
    assert rows(incremental.unprocessed(a, b.limit(0))) == [(i,) for i in range(1, 8)]


def brute_roots(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = []
    for n in set(up) | set(up.values()):
        seen, x = [], n
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        out.append((n, min(seen[seen.index(x):]), -1) if x in seen else (n, x, len(seen)))
    return sorted(out)


@pytest.mark.parametrize("links_per_forest", [500_000, 9])
def test_hierarchy_against_brute_force(spark, monkeypatch, links_per_forest):
    monkeypatch.setattr(hierarchy, "LINKS_PER_FOREST", links_per_forest)
    rng = random.Random(3)
    cases = [
        [(i, i - 1) for i in range(1, 40)],
        [(i, 0) for i in range(1, 50)],
        [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 6), (8, 9)],
        [(i, rng.randrange(60)) for i in range(60)],
        [(i, rng.randrange(i)) for i in range(1, 80)],
        [(1, None), (None, 2), (3, 4), (3, 4), (3, 9)],
        # rings across partitions with tails, beside a tree
        [(i, (i + 7) % 40) for i in range(40)] + [(100 + i, i) for i in range(20)] + [(200, 201), (201, 202)],
        [],
    ]
    for links in cases:
        df = spark.createDataFrame(links, "child long, parent long").withColumn("root", F.lit("clash"))
        assert sorted(map(tuple, hierarchy.roots(df).collect())) == brute_roots(links)
    up = dict(cases[4])
    for r in hierarchy.paths(spark.createDataFrame(cases[4], "child long, parent long")).collect():
        way = [r["node"]]
        while way[-1] in up:
            way.append(up[way[-1]])
        assert list(r["path"]) == way[::-1]


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (6, 3), (8, 9), (9, 8), (10, 8)], "child long, parent long")
    p = hierarchy.paths(df)
    got = {r["node"]: list(r["path"]) for r in p.collect()}
    assert got[5] == [1, 2, 3, 4, 5] and got[6] == [1, 2, 3, 6] and got[1] == [1] and got[10] == []
    assert {tuple(r) for r in hierarchy.descendants(p).where("ancestor = 2").collect()} == {(2, 3, 1), (2, 4, 2), (2, 5, 3), (2, 6, 2)}


@pytest.mark.parametrize("most_stays", [0, 2, 64])
def test_orphans_against_brute_force(spark, monkeypatch, most_stays):
    monkeypatch.setattr(orphans, "MOST_STAYS", most_stays)
    rng = random.Random(4 + most_stays)
    at = lambda: DAY + dt.timedelta(hours=rng.randrange(24 * 6))
    parents = [(rng.choice("ab"), rng.choice("klm"), rng.choice([at(), at(), None]), rng.choice([at(), at(), None])) for _ in range(30)]
    refs = [(i, rng.choice("ab"), rng.choice("klmn"), at()) for i in range(80)] + [(90, None, "k", at()), (91, "a", None, at()), (92, "a", "zzz", None)]
    want = []
    for i, t, k, x in refs:
        if t is None or k is None:
            continue
        same = [p for p in parents if p[:2] == (t, k)]
        if not same:
            want.append((i, "missing"))
        elif x is not None and not any(a and a <= x and (z is None or z > x) for _, _, a, z in same):
            want.append((i, "late" if any(a and a > x for _, _, a, _ in same) else "deleted"))
    r = spark.createDataFrame([(*x, "clash") for x in refs], "ref_id long, target string, key string, at timestamp_ntz, day string")
    p = spark.createDataFrame(parents, "target string, key string, added_at timestamp_ntz, removed_at timestamp_ntz")
    found = orphans.orphans(r, p)
    assert sorted((x["ref_id"], x["reason"]) for x in found.collect()) == sorted(want)
    assert orphans.orphans(r.limit(0), p).count() == 0
    assert {x["reason"] for x in orphans.orphans(r, p.limit(0)).collect()} == {"missing"}
    assert orphans.report(found).agg(F.sum("n")).first()[0] == len(want)


def test_missing_without_times(spark):
    r = spark.createDataFrame([(1, 5), (2, 6), (2, 6), (3, None), (4, 7)], "id long, edge long")
    assert rows(orphans.missing(r, spark.createDataFrame([(5,), (5,), (None,)], "edge long"), "edge")) == [(2, 6), (2, 6), (4, 7)]
    assert rows(orphans.missing(r.limit(0), r, "edge")) == []


def plan_of(spark, query):
    """The plan of a query over the small tables, where nothing is broadcast, as on large ones."""
    import __spark_entry__

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_tables_meet_without_a_shuffle(spark):
    plan = plan_of(spark, "p5_found")
    assert plan.count("SortMergeJoin") == 7 and plan.count("Exchange") == 0, plan


def test_widen(spark):
    data = [
        (1, "/A", "5", DAY, 1), (1, "/A", "x", DAY + dt.timedelta(1), 2), (1, "/B", " t ", DAY, 3), (2, "/A", "7", None, 4), (2, "/A", "8", None, 5),
        (3, "/A", "no", DAY, 6), (4, "/C", "9", DAY, 7), (None, "/A", "1", DAY, 8), (5, None, "1", DAY, 9), (6, "/A", None, DAY, 10), (1, "/A", "5", DAY, 1),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in data], "entity long, attribute string, value string, seen timestamp_ntz, tie long, m string")
    readers = {"a": ("/A", canonical.whole_value), "b": ("/B", canonical.trimmed), "c": ("/Z", canonical.trimmed)}
    assert rows(wide.widen(df, readers)) == [(1, 5, "t", None), (2, 8, None, None)]
    assert rows(wide.widen(df.limit(0), readers)) == []


def brute_elements(doc):
    out = []

    def walk(x, pointer, nearest, in_list):
        if isinstance(x, dict):
            if in_list:
                out.append((pointer, nearest))
                nearest = pointer
            for k, v in x.items():
                if not k.startswith("$"):
                    walk(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", nearest, False)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{pointer}/{i}", nearest, True)

    walk(doc, "", "", False)
    return out


def test_nested_against_brute_force(spark):
    rng = random.Random(5)

    def make(depth):
        kind = rng.choice("dddllls") if depth else "d"
        if kind == "s" or depth > 5:
            return rng.choice([1, 2.5, None, True, "x", "é" * 3])
        if kind == "l":
            return [make(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b/c", "~d", "$e", "7", ""]) + str(i): make(depth + 1) for i in range(rng.randrange(4))}

    docs = [make(0) for _ in range(60)]
    texts = [json.dumps(x) for x in docs]
    texts[0] = "﻿" + texts[0]
    texts[1] = json.dumps(texts[1])
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, doc string").withColumn("label", F.lit(1))
    got = sorted((r["rid"], r["element_pointer"], r["parent_pointer"]) for r in nested.elements(nested.shred(df)).collect())
    assert got == sorted((i, *e) for i, x in enumerate(docs) for e in brute_elements(x))
    assert got == sorted((r["rid"], r["element_pointer"], r["parent_pointer"]) for r in nested.elements(nested.shred(df, rows_only=True)).collect())


def test_nested_awkward(spark):
    deep = "[" * 3000 + "]" * 3000
    texts = [None, "", "{", "[1]", '"{', json.dumps('{"a": [{"b": NaN}]}'), '{"a": [{"x": -Infinity, "s": "\\ud800"}], "k": ' + deep + "}", '{"t": "' + "y" * 300_000 + '"}']
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, doc string")
    assert [r[0] for r in df.select("rid").where(nested.readable(F.col("doc"))).collect()][0] == 5
    nodes = nested.shred(df)
    assert {r[0] for r in nodes.select("rid").distinct().collect()} >= {5, 7}
    cells = [tuple(r) for r in nested.leaves(nodes.where("rid = 5")).select("table", "column", "kind", "value").collect()]
    assert cells == [("/a/*", "/b", "number", "NaN")]
    assert nested.elements(nested.shred(df.limit(0))).count() == 0
    assert sorted(r[0] for r in nested.unreadable(df, ["rid"]).collect()) == [1, 2, 3, 4]
    very = spark.createDataFrame([(1, '{"a": ' * 50_000 + '[{"b": [{}]}]' + "}" * 50_000), (2, '{"n": ' + "7" * 5000 + "}")], "rid long, doc string")
    got = [tuple(r) for r in nested.elements(nested.shred(very, rows_only=True)).select("rid", F.length("element_pointer"), F.length("parent_pointer")).collect()]
    assert sorted(got) == [(1, 100_002, 0), (1, 100_006, 100_002)]
    assert nested.shred(very.where("rid = 2")).where("kind = 'number'").first()["value"] == "7" * 5000
