"""Problems 7 to 10 against brute force and on awkward input."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import frequency, language, packing, winnow
from lattica.llm.sentences import is_end, tokens

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frequencies_against_brute_force(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else rng.choice("abcdefghij") + str(rng.randrange(900)), rng.choice(["f", "g", None]), rng.choice([None, *range(40)]), i) for i in range(6000)]
    data += data[:500]  # repeated rows
    df = spark.createDataFrame([(*r, "clash") for r in data], "v string, f string, rec long, id long, n string")
    want = collections.defaultdict(lambda: (set(), set()))
    for v, f, rec, i in data:
        want[f, v][0].add(i)
        if rec is not None:
            want[f, v][1].add(rec)
    got = frequency.frequencies(df, ["f", "v"], "rec", "id")
    assert rows(got) == sorted(((f, v, len(a), len(b)) for (f, v), (a, b) in want.items()), key=str)
    assert rows(frequency.frequencies(df.limit(0), ["f", "v"], "rec", "id")) == []


def test_dictionary_is_dense(spark):
    df = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("v"))
    ids = sorted(r.term_id for r in frequency.dictionary(df, ["v"]).collect())
    assert ids == list(range(1000))


def test_marks(spark):
    data = [("s", "p", "x", i, i) for i in range(20)] + [("s", "p", "y", i, 100 + i) for i in range(19)] + [("s", "p", "z", 1, 200), ("s", "p", "w", 60, 300)] + [("s", "p", f"k{i}", 100 + i, 400 + i) for i in range(10)]
    df = spark.createDataFrame(data, "scope string, field string, value string, record long, row long")
    marks = {r.value: r.mark for r in frequency.marked_values(df).collect()}
    assert (marks["x"], marks["y"], marks["z"], marks["k1"]) == ("common", "kept", "rare", "rare")


def test_differencing():
    part = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(part, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]
    assert packing.differencing(np.array([5]), 3).tolist() == [0]


@pytest.mark.parametrize("seed", range(4))
def test_fill_keeps_capacity(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(5, 1, 300).astype(int) + 1, 1000)
    part = packing.fill(sizes, 1000)
    load = np.bincount(part, weights=sizes)
    assert load.max() <= 1000 and (load > 0).all()
    assert len(load) <= 1.04 * math.ceil(sizes.sum() / 1000) + 1


def test_pack(spark):
    data = [(1, 2500), (2, 0), (3, None), (4, 1000), (5, 999), (5, 10), (None, 7)] + [(i, 300) for i in range(10, 40)]
    sizes = spark.createDataFrame([(*r, "clash") for r in data], "item long, size long, part string")
    windows = spark.createDataFrame([("a", 1000), ("b", 400), ("c", 0), (None, 5), ("d", None)], "window_name string, capacity long")
    got = packing.pack(sizes, windows).collect()
    for name, capacity in (("a", 1000), ("b", 400)):
        mine = [r for r in got if r.window_name == name]
        load = collections.Counter()
        for r in mine:
            if r.window_no is not None:
                load[r.window_no] += r.size
        assert max(load.values()) <= capacity
        by = collections.defaultdict(list)
        for r in sorted(mine, key=lambda r: (r.item, r.part)):
            by[r.item].append(r)
        assert set(by) == {1, 2, 3, 4, 5, *range(10, 40)}
        for item, parts in by.items():
            size = {1: 2500, 2: 0, 3: 0, 4: 1000, 5: 999}.get(item, 300)
            assert sum(p.size for p in parts) == size and [p.start for p in parts] == [capacity * i for i in range(len(parts))]
            assert len(parts) == max(1, -(-size // capacity))
    assert {r.window_name for r in got} == {"a", "b"}
    assert packing.pack(sizes.limit(0), windows).count() == 0 and packing.pack(sizes, windows.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100


def test_words():
    assert winnow.words("<b>O</b>&nbsp;Bár-​CAFÉ,\nx­y…z<br>w") == ["o", "bar", "cafe", "xy", "z", "w"]
    assert winnow.words("蜘蛛a") == ["蜘", "蛛", "a"]
    assert winnow.words(None) == winnow.words("") == winnow.words(" \n") == []


def test_words_whatever_the_line_layout():
    plain = "the quick brown fox jumps over the lazy dog and runs away"
    w = plain.split()
    lines = [" ".join(w[i : i + 3]) for i in range(0, 12, 3)]
    layouts = [
        "\n".join(f"{i + 1}) {x}" for i, x in enumerate(lines)),
        "1) " + " \n2) ".join(lines[:2]) + "\n 3) " + lines[2] + "\n4)\t" + lines[3],
        "\n".join(f"{i + 1}. {x}" for i, x in enumerate(lines)),
        "\n".join(f"{i + 118}: {x}" for i, x in enumerate(lines)),
        "\n".join(f" {i + 9} {x}" for i, x in enumerate(lines)),
        "\n".join(f"({i + 1}) {x}" for i, x in enumerate(lines)),
        "\n".join(f"[{i + 1}] {x}" for i, x in enumerate(lines)),
        "\n".join(f"{'abcd'[i]}) {x}" for i, x in enumerate(lines)),
        "\n".join(f"* {x}" for x in lines),
        "\n".join(f"- {x}" for x in lines),
        "> " + "\n> ".join(lines),
        "| " + " |\n| ".join(lines) + " |",
        "<ol><li>" + "</li>\n<li>".join(lines) + "</li></ol>",
        "  \r\n\t".join(lines),
    ]
    for text in layouts:
        assert winnow.words(text) == w, text
    assert winnow.words("so. 1. the quick\n2. brown fox") == ["so", "the", "quick", "brown", "fox"]
    # numbers that are words stay
    assert winnow.words("in 1999\n3 of 4 (see page 3) came") == "in 1999 3 of 4 see page 3 came".split()
    assert winnow.words("version 2.5) is\n7. old") == "version 2 5 is 7 old".split()


def brute(items, docs, run=8, least=20, share=0.4):
    found = set()
    for i, t in items:
        w = winnow.words(t)
        for d, x in docs:
            y = winnow.words(x)
            there = {tuple(y[p : p + run]) for p in range(len(y) - run + 1)}
            cover = {q for p in range(len(w) - run + 1) if tuple(w[p : p + run]) in there for q in range(p, p + run)}
            if len(cover) >= least and len(cover) >= share * len(w):
                found.add((i, d))
    return found


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for d in range(150):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(w))
            cut = w[a : a + rng.randrange(4, 40)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() + rng.choice(["", ",", "­"]) for x in cut]
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, ""), (902, items[3][1] + " end")]
    di = spark.createDataFrame(items + items[:3], "item_id long, text string")
    dd = spark.createDataFrame([(*x, "clash") for x in docs + docs[:5]], "doc_id long, text string, item_id string")
    got = {(r.item_id, r.doc_id) for r in winnow.leaks(di, dd).collect()}
    assert got == brute([x for x in items if x[1]], [x for x in docs if x[1]]) and got
    assert winnow.leaks(di.limit(0), dd).count() == 0 and winnow.leaks(di, dd.limit(0)).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        g = rng.integers(0, 5, 40).astype(np.uint64)  # many ties
        at = winnow.winnowed(g, 4)
        assert all(((at >= s) & (at < s + 4)).any() for s in range(len(g) - 3))


def test_tokens_leave_out_code_and_names():
    text = "items.Bow.desc = The lever overrides the loom (Toy_Oak_1). ```\n{\"a\": 1}\n```\nThe «die warme Leiter» hall, #12 /States/5/Id."
    words = [t for t in tokens(text) if not is_end(t)]
    assert words == ["the", "lever", "overrides", "the", "loom", "the", "hall"]
    assert [t for t in tokens("明亮的。Bow_Oak箱子") if not is_end(t)] == list("明亮的箱子")


def test_labels(spark):
    labels = ["en", "EN", "en-US", "eng", "English", "pt_BR", "ger", " de ", "und", "??", "", None, "it", "zh-Hans-CN", "Portuguese (Brazil)"]
    df = spark.createDataFrame([(x,) for x in labels], "c string")
    got = [r[0] for r in df.select(language.label_language(F.col("c"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "pt", "de", "de", None, None, None, None, None, "zh", "pt"]


def _sentences():
    """Sentences of the tables' own documents, by language of a right label."""
    import duckdb

    out = collections.defaultdict(list)
    docs = duckdb.sql(f"select lang, text from '{D}/documents.parquet' where text is not null").fetchall()
    for lang, text in docs:
        if lang in language.CODES and "\n" not in text and not any(c in text for c in "«/_[`"):
            out[lang] += [s.strip() + "." for s in text.split(". ") if len(s.split()) > 9][:3]
    return out


def test_identify_mixed_and_awkward(spark):
    s = _sentences()
    a, b = s["en"][0], s["de"][0]
    made = [
        (1000, f"{a} {s['en'][1]}", "de", "x/y"), (1001, f"{a} {b} {a}", "en", None), (1002, b, "deu", "x/y"), (1003, None, "en", "x"), (1004, " \n\t", None, None), (1005, "Toy_Oak_1 /a/b", "en", "x"),
        (1006, f"{a} «{' '.join(b.split()[:3])}» x.", "English", "x"), (1007, f"{a} " * 3000, None, "x"),
    ]
    base = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"), "source")
    df = base.unionByName(spark.createDataFrame(made, base.schema))
    found = language.identify(df.withColumn("lang", F.lit("clash")))
    langs = collections.defaultdict(list)
    for r in found.where("doc_id >= 1000").orderBy("stretch").collect():
        langs[r.doc_id].append(r.lang)
        assert 0 < r.confidence <= 1.0 + 1e-9
    assert langs == {1000: ["en"], 1001: ["en", "de", "en"], 1002: ["de"], 1006: ["en"], 1007: ["en"]}
    wrong = {(r.doc_id, r.lang) for r in language.mislabelled(found).where("doc_id >= 1000").collect()}
    assert wrong == {(1000, "en"), (1001, "en"), (1001, "de"), (1007, "en")}
    assert language.identify(df.limit(0)).count() == 0


def test_fit_samples_by_the_whole_hash(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"))
    for share in (1.0, 0.25, 1e-3):
        n = docs.where(language._below(share)).count()
        assert abs(n - share * 200_000) <= 5 * (share * 200_000) ** 0.5
    assert docs.where(language._below(1e-8)).count() <= 3  # neither all nor, by rounding, a fixed part
    assert "-9223371852387" in str(language._below(1e-8))  # 1e-8 of the numbers lie below, not none
    one = spark.createDataFrame([(1, "The lever is here.", "en")], "doc_id long, text string, label string")
    with pytest.raises(ValueError):
        language.fit(one, sample_documents=0)
    assert language.fit(one, most_chars=1000).total[0] == 4
    assert sum(language.fit(one.limit(0)).total) == len(language.CODES)


def test_held_out_accuracy(spark):
    """Fitted on one half of the labelled documents, whole labels of the other half are told by the likelihood."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"), "source")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = language.fit(base.where(half == 0))
    rest = base.where((half == 1) & language.label_language(F.col("label")).isNotNull())
    main = language.stretches(rest, model).where("size(stretches) = 1").select(language.label_language(F.col("label")).alias("l"), F.col("stretches")[0]["best"].alias("b"))
    pairs = [(r.l, language.CODES[r.b]) for r in main.collect()]
    # about one label in fourteen is wrong in these tables
    assert len(pairs) > 200 and sum(a == b for a, b in pairs) >= 0.88 * len(pairs)


def test_entry_has_the_queries(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert {"p7_found", "p8_windows", "p9_found", "p10_found"} <= set(q) and "p7_found" in sql
    assert q["p9_found"](spark, D).columns == ["item_id", "doc_id"]
    assert q["p10_found"](spark, D).columns == ["doc_id", "lang"]
    assert q["p7_found"](spark, D).columns == ["asset_type", "json_pointer", "raw_value", "n_rows", "n_assets", "mark"]
