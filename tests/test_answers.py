"""Registered answers on small tables, against brute force."""

import re
import unicodedata

from lattica.operators import search
from lattica.queries import answers, index


def write(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_matches_reads_all_locales(spark, tmp_path):
    texts = [("en-US", "Two lanterns"), ("pt-BR", "A lanterna pesada"), ("pt-BR", "A pedra"), ("fr-FR", "La lanterne"), ("ru-RU", "Лантерн lanterns"), ("uk-UA", "Ґніт ламп"), ("zh-CN", "灯笼lantern"), ("xx-XX", "LÁNTÉRNS, old"), ("it-IT", "lante")]
    rows = [(i, f"k{i}", locale, value) for i, (locale, value) in enumerate(texts)]
    write(spark.createDataFrame(rows + rows[:2], "id long, key string, locale string, value string"), tmp_path, "lang_keys")

    def level(value):
        plain = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c)).lower()
        words = re.findall(r"[a-z]+|[^\W\d_a-z]+", plain)
        return next((n for n in range(4) if any(w.startswith("lanterns"[: 8 - n]) for w in words)), None)

    expected = {(key, locale, level(value)) for _, key, locale, value in rows if level(value) is not None}
    assert {locale for _, locale, _ in expected} == {"en-US", "pt-BR", "fr-FR", "ru-RU", "zh-CN", "xx-XX", "it-IT"}
    got = answers.fts05_matches(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_upsert_merges_all_deliveries(spark, tmp_path):
    rows = [(1, "a", "T", "a1"), (5, "a", "T", "a5"), (6, "a", "T", "a6"), (2, "gone", "T", "g2"), (3, "gone", "T", "g3"), (6, "new", "T", "n6"), (4, "x", None, "x4"), (9, "x", None, "x9"), (9, "x", None, "x8"), (9, "x", "T", "t9"), (10, "a", "T", "a10")]
    write(spark.createDataFrame(rows + rows[:1], "snapshot_no int, logical_id string, type string, path string"), tmp_path, "asset_snapshots")
    expected = {}
    for _, name, kind, _ in rows:
        last = {n: p for n, i, t, p in sorted(rows, key=lambda r: (r[0], r[3])) if (i, t) == (name, kind)}
        expected[name, kind] = (last[min(last)], last[max(last)])
    got = {(r.logical_id, r.type): (r.first_path, r.last_path) for r in index.snk02_upsert(spark, str(tmp_path)).collect()}
    assert got == expected and got["x", None] == ("x4", "x9") and got["gone", "T"] == ("g2", "g3") and got["a", "T"] == ("a1", "a10")


def test_search_batch_answers_as_search_does(spark, tmp_path):
    names = ["Bow_Oak", "Bow_Ash", "Bow_Elm", "Bow_Fir", "Bow_Yew", "Lantern_Old", "Test_Lantern", "Spider_Web"]
    rows = [(i, n, "Item" if i % 3 else None, "", " ".join(n.split("_")), "") for i, n in enumerate(names)]
    rows += [(i, n, "Item" if i % 3 else None, "en-US", f"The {n.lower().replace('_', ' ')} lanterns lantern", "an old bow" * (i % 2)) for i, n in enumerate(names)]
    rows += [(7, "Spider_Web", "Item", "zh-CN", "洞穴蜘蛛网", "蜘 lantern"), (6, "Test_Lantern", None, "zh-CN", "蛛蜘网", "蜘蛛"), (5, "Lantern_Old", "Item", "pt-BR", "A lanterna antiga", "")]
    docs = spark.createDataFrame(rows, "asset_id long, logical_id string, type string, locale string, display_name string, description string").cache()
    texts = ["lantern", "lanternas", "bow", "old bow bow", "蜘蛛", "网 lanterna", "BÓW oa", "no such lantern", "...", None, "lantern"]
    queries = spark.createDataFrame([(100 * i, t) for i, t in enumerate(texts)], "query long, text string")
    plain = lambda r: (r.rank, r.logical_id, r.type, r.level, round(r.score, 9))
    got = {}
    for r in search.search_batch(docs, queries, 6).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(plain(r))
    expected = {100 * i: [plain(r) for r in search.search(docs, t, 6).orderBy("rank").collect()] for i, t in enumerate(texts) if t}
    assert got == {q: rows for q, rows in expected.items() if rows}
    assert len(expected[200]) == 6 and len(expected[400]) == 2 and not expected[700] and got[0] == got[1000]


def test_search_batch_takes_texts_of_every_hundredth_key(spark, tmp_path):
    keys = [(100, "a", "en-US", "oak bow"), (101, "b", "en-US", "lantern"), (200, "c", "ru-RU", "фонарь")]
    write(spark.createDataFrame([(*k, None) for k in keys], "id long, key string, locale string, value string, root string"), tmp_path, "lang_keys")
    write(spark.createDataFrame([(1, "Bow_Oak", "Item"), (2, "Lantern", "Item"), (3, "Lamp", "Item")], "id long, logical_id string, type string"), tmp_path, "assets")
    write(spark.createDataFrame([(3, 200, "lang_key", "/Name")], "src long, dst long, dst_kind string, json_pointer string"), tmp_path, "edges")
    got = answers.fts05_search_batch(spark, str(tmp_path)).collect()
    assert sorted((r.query, r.rank, r.logical_id) for r in got) == [(100, 0, "Bow_Oak"), (200, 0, "Lamp")]
