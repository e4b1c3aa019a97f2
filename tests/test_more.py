"""Sources, stations, drafts, crossings and the pieces of answers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import align, crossings, graph, stations
from lattica.plans import answers, build, drafts
from lattica.sources import archives, config, declared, evaluation, lang

LEAF = "asset_id long, json_pointer string, schema_scope string, schema_pointer string, raw_value string, value_kind string"


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"Server/{i}.json", f"{{}}{i}" * (i + 1)) for i in range(40)] + [("a/é.txt", "")], "path string, content string")
    paths = archives.write(rows.repartition(3, "path"), str(tmp_path / "z"))
    assert len(paths) == 3 and all(zipfile.is_zipfile(p) for p in paths)
    got = {r.path: bytes(r.content).decode() for r in archives.entries(spark, paths, content=True).collect()}
    assert got == {r.path: r.content for r in rows.collect()}
    assert archives.entries(spark, paths, prefix="a/").count() == 1 and archives.entries(spark, []).count() == 0
    assert archives.write(rows.limit(0), str(tmp_path / "none")) == []


def test_tree_stamp(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_text("a")
    (tmp_path / "t/sub/b.txt").write_text("b")
    first = archives.tree_stamp(spark, str(tmp_path / "t"))
    assert len(first) == 16 and first == archives.tree_stamp(spark, str(tmp_path / "t"))
    (tmp_path / "t/sub/b.txt").write_text("bb")
    assert archives.tree_stamp(spark, str(tmp_path / "t")) != first


def test_manifests(spark):
    files = spark.createDataFrame([(1, '{"Group": "g", "Name": "n", "Version": "1"}'), (2, '{"Name": 5, "Version": ""}'), (3, "{"), (4, None)], "id long, content string")
    assert {tuple(r) for r in archives.manifests(files).collect()} == {(1, "g", "n", "1"), (2, None, None, None), (3, None, None, None), (4, None, None, None)}


def test_schema_files(spark, tmp_path, monkeypatch):
    item = {
        "x-asset": {"path": "Item/Items", "extension": ".item"}, "properties": {
            "Kind": {"type": "string", "description": 'It must be set to the constant value "bow".'}, "Speed": {"type": "number", "default": 5}, "Deep": {"properties": {"A": {"properties": {"B": {"type": "string"}}}}},
            "Opt": {"anyOf": [{"$ref": "common.json#/definitions/Box", "x-asset": {"inherits": True}}, {"type": "null"}]},
        },
    }
    (tmp_path / "Item.json").write_text(json.dumps(item).replace('"default": 5', '"default": NaN'))
    (tmp_path / "common.json").write_text(json.dumps({"definitions": {"Box": {"properties": {"x": {"type": "string"}}}}}))
    (tmp_path / "Odd.json").write_text(json.dumps({"properties": {}}))
    monkeypatch.setattr(declared, "POINTER_DEPTH", 2)
    settings = json.dumps({"json.schemas": [{"fileMatch": ["Server/Item/Items/**/*.json", "Server/Odd/*.odd.json"], "url": "./Schema/Item.json"}]})
    got = declared.read_all(spark, str(tmp_path), settings=settings)
    f = {(r.asset_type, r.json_pointer): r for r in got.fields.collect()}
    assert f["Item", "/Kind"].type_constant == "bow" and f["Item", "/Speed"].default_unset and f["Item", "/Speed"].default_value is None and not f["Item", "/Kind"].default_unset
    assert f["Item", "/Opt"].inherits_property and f["Item", "/Opt"].ref_scope == ["common:Box"] and ("Item", "/Deep/A/B") not in f and ("common:Box", "/x") in f
    assert any("not finite" in w for w in got.warnings) and any(w.startswith("Item: fields are missing") for w in got.warnings) and any("Odd.json: no path" in w for w in got.warnings)
    assert [tuple(r)[:2] for r in got.definitions.collect()] == [("common.json", "Box")]
    assert declared.suffixes(got.types) == (".item", ".json")
    rules = declared.type_rules(got.types)
    assert ("Server/Item/Items/", "", "Item") in rules and ("Server/Odd/", ".odd.json", "Item") in rules
    typed = build.typed(spark.createDataFrame([("Server/Odd/a.odd.json",), ("Server/Item/Items/b.json",), ("x",)], "path string"), rules)
    assert [r.type for r in typed.collect()] == ["Item", "Item", None]
    docs = {"common.json": {"definitions": {"a/b": {"type": "string"}}, "l": [{"k": 1}]}}
    assert declared.resolve("common.json#/definitions/a~1b", docs) == {"type": "string"} and declared.resolve("x/common.json#/l/0", docs) == {"k": 1}
    assert declared.resolve("common.json#/nope/a", docs) is None and declared.resolve("other.json#", docs) is None
    assert declared.bindings("{") == [] and declared.bindings('{"json.schemas": [{"fileMatch": ["a"]}]}') == []


def test_configuration_can_be_switched_off(tmp_path, monkeypatch):
    (tmp_path / "lattica.json").write_text("{}")
    assert config.find(str(tmp_path)) is not None
    monkeypatch.setenv("LATTICA_NO_CONFIG", "1")
    assert config.find(str(tmp_path)) is None


def test_fallbacks_and_evaluation_sets(spark, tmp_path):
    files = spark.createDataFrame([("f", "# c\na = b\nb = a\nc =\n")], "path string, content string")
    assert lang.fallbacks(files) == {"a": "b", "b": "a"}
    assert lang.chain("a", {"a": "b", "b": "a"}) == ["a", "b", "en-US"]
    (tmp_path / "set.json").write_text(json.dumps({"cases": [{"phrase": "p", "tier": "t", "expected_any": ["x"]}, {"phrase": "q", "tier": "u", "expected_any": [], "must_not_rank_first": ["z"]}]}, indent=1))
    got = [(r.phrase, r.expected_any, r.expected_also, r.must_not_rank_first) for r in evaluation.read(spark, str(tmp_path / "set.json")).collect()]
    assert got == [("p", ["x"], [], []), ("q", [], [], ["z"])]


def test_stations(spark):
    B, C, N, R = "common:Bench", "common:BenchCategory", "common:BenchItemCategory", "common:BenchRequirement"  # noqa: N806
    rows = [
        (1, "/Bench/Id", B, "/Id", "Forge"), (1, "/Bench/Type", B, "/Type", "Crafting"), (1, "/Bench/Categories/0/Id", C, "/Id", "Metal"), (1, "/Bench/Categories/0/Name", C, "/Name", "server.cat.metal"),
        (1, "/Bench/Categories/0/ItemCategories/0/Id", N, "/Id", "Swords"), (1, "/Bench/Categories/0/ItemCategories/0/Icon", N, "/Icon", "i.png"), (2, "/Bench/Id", B, "/Id", "Forge"), (2, "/Bench/Categories/0", B, "/Categories/*", "Metal"),
        (3, "/Lost/Categories/0", B, "/Categories/*", "Nowhere"), (4, "/Recipe/Req/0/Id", R, "/Id", "Forge"), (4, "/Recipe/Req/0/Categories/0", R, "/Categories/*", "Swords"), (5, "/Req/0/Id", R, "/Id", "TODO"), (6, "/Req/0/Id", R, "/Id", "Forge"),
    ]
    c = spark.createDataFrame([(*r, "string") for r in rows] * 2, LEAF)
    s = stations.extract(c, stations.Spec((B,)))
    assert {tuple(r) for r in s.stations.collect()} == {("Forge", "Crafting")} and {(r.asset_id, r.n) for r in s.declarations.collect()} == {(1, 1), (2, 1)}
    assert {tuple(r) for r in s.categories.collect()} == {("Forge", "Metal", None, "cat.metal", None), ("Forge", "Swords", "Metal", None, "i.png")}
    a = spark.createDataFrame([(i, f"A{i}", i != 6) for i in range(1, 7)], "id long, logical_id string, is_effective boolean")
    assert {tuple(r) for r in stations.craftable_at(s, a).collect()} == {("Forge", "A4", "Swords"), ("TODO", "A5", None)}
    table = {r.station: r for r in stations.listing(s, a).collect()}
    assert (table["Forge"].n_declarers, table["Forge"].declarers, table["Forge"].n_crafted, table["Forge"].n_requirements, table["Forge"].n_categories) == (2, "A1, A2", 1, 2, 2)
    assert not table["TODO"].declared and table["TODO"].n_crafted == 1
    told = [tuple(r) for r in stations.summary(s).collect()]
    assert ("resolved", "2") in told and ("never declared", "TODO") in told and ("declared more than once", "Forge") in told
    keys = spark.createDataFrame([("cat.metal", "en-US", "Metalwork", 1, 1)], "key string, locale string, value string, pack_id long, id long")
    assert [(r.category, r.english) for r in stations.category_tree(s, keys).orderBy("place").collect()] == [("Metal", "Metalwork"), ("Swords", None)]
    none = stations.extract(c.limit(0), stations.Spec((B,)))
    assert stations.listing(none, a).count() == 0 and stations.craftable_at(none, a).count() == 0


def test_drafts(spark):
    assets = spark.createDataFrame([(1, 1, "Base", "Item", "Server/Item/a/Base.json", True), (2, 1, "Old", "Item", "Server/Item/a/Old.json", False)], "id long, pack_id long, logical_id string, type string, path string, is_effective boolean")
    fields = spark.createDataFrame([("Item", "/Made", "string", True, "Item", None)], "asset_type string, json_pointer string, declared_type string, optional boolean, reference_target string, ref_scope array<string>")
    mine = spark.createDataFrame([(-1, 9, "New", None, "Server/Item/a/New.json"), (-2, 9, "Free", None, "Elsewhere/Free.json")], "id long, pack_id long, logical_id string, type string, path string")
    docs = spark.createDataFrame([(-1, '{"Parent": "Base", "Made": "Old", "UseId": "New", "Any": "None"}'), (-2, "{"), (5, '{"x": 1}')], "asset_id long, doc string")
    layer = drafts.lay(docs, mine, assets, fields)
    assert {(r.id, r.type) for r in layer["assets"].collect()} == {(-1, "Item"), (-2, None)}
    assert {(r.dst, r.kind, r.confidence) for r in layer["edges"].collect()} == {(1, "INHERITS_FROM", "high"), (2, "REFERENCES", "high")}
    assert {(r.schema_pointer, r.raw_value) for r in layer["candidates"].where("schema_scope = 'Item'").collect()} == {("/Parent", "Base"), ("/Made", "Old"), ("/UseId", "New"), ("/Any", "None")}
    assert {r.json_pointer: list(r["values"]) for r in drafts.values(layer["candidates"]).collect()}["/Made"] == ["Old"]


def test_crossings_and_unions(spark):
    fields = [
        {"asset_type": "Item", "json_pointer": "/Tool", "ref_scope": ["Tool"]}, {"asset_type": "Tool", "json_pointer": "/Specs/*", "ref_scope": ["Spec"]}, {"asset_type": "Spec", "json_pointer": "/Power", "ref_scope": None},
        {"asset_type": "Item", "json_pointer": "/Both", "ref_scope": ["A", "B"]},
    ]
    d = crossings.Declared(fields)
    assert d.crossings("Item", "/Tool/Specs/*/Power") == [("/Tool", "Spec", "/Power")] == d.crossings("Item", "/Tool/Specs/Power")
    assert d.crossings("Item", "/Tool/Nothing") == [("/Tool", "Tool", "")] and d.crossings("Item", "/Both/x") == [] and d.crossings("None", "/x") == []
    df = spark.createDataFrame([("Item", "/Both", ["A", "B"], "Op", ["a", "b"]), ("Item", "/U", ["A", "B"], None, ["a"]), ("Item", "/One", ["A"], None, None)], "asset_type string, json_pointer string, ref_scope array<string>, discriminator_property string, discriminator_values array<string>")
    assert {tuple(r)[1:] for r in crossings.unions(df).collect()} == {("/Both", "Op", "A", "a"), ("/Both", "Op", "B", "b"), ("/U", "Type", "A", None), ("/U", "Type", "B", None)}


def test_overlap(spark):
    a = spark.createDataFrame([(1, "X", "P"), (2, "X", "Q"), (3, "Y", "P")], "id long, logical_id string, type string")
    e = spark.createDataFrame([(9, 1, "/a"), (9, 2, "/a"), (9, 3, "/a"), (8, 1, None), (8, 2, None), (7, 1, "/b")], "src long, dst long, json_pointer string").withColumn("dst_kind", F.lit("asset"))
    assert {tuple(r) for r in graph.overlap(e, a).collect()} == {("X", "P", 2), ("X", "Q", 2)}


def test_alignment_changes(spark):
    before = spark.createDataFrame([(1, "/a", "S", "/a"), (2, "/b", None, "/b")], "asset_id long, json_pointer string, schema_scope string, schema_pointer string")
    after = spark.createDataFrame([(1, "/a", "S", "/a"), (2, "/b", "S", "/b"), (3, "/c", None, "/c")], before.schema)
    assert tuple(align.changes(before, after).first()) == (3, 2, 1)


@pytest.mark.parametrize(("given", "want", "mangled"), [("a/b/", "/a/b", False), ("/a", "/a", False), ("C:/Program Files/Git/Tool/Specs", "/Tool/Specs", True), ("D:\\Tool", "/Tool", True), ("", "/", False)])
def test_repaired_pointer(given, want, mangled):
    assert answers.repaired_pointer(given) == (want, mangled)


def test_orders_and_folders(spark):
    df = spark.createDataFrame([(["10", "9", " 1e1\t"], "a/b/c.x", "a/b/d.x"), (["10", "9", "x"], "a/b", "c/d"), ([], "a/b/c", "a/b/c")], "v array<string>, f string, l string")
    got = [(list(r[0]), r[1]) for r in df.select(answers.numeric_order(F.col("v")), answers.shared_folder_of(F.col("f"), F.col("l"))).collect()]
    assert got == [(["9", " 1e1\t", "10"], "a/b/"), (["10", "9", "x"], ""), ([], "a/b/")]


def test_search_reads_its_index_as_it_reads_texts(spark, tmp_path):
    from lattica.operators import search
    from lattica.session import numbered

    d = "/root/testdata/sf0.001"
    a, e, k = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("assets", "edges", "lang_keys"))
    docs = numbered(search.search_docs(a, e, k), "doc")
    search.postings(docs, ["doc"], ["display_name", "description"]).repartitionByRange("term").sortWithinPartitions("term", "doc").write.parquet(str(tmp_path / "postings"))
    p = spark.read.parquet(str(tmp_path / "postings"))
    texts = [r[0] for r in k.where("locale in ('en-US', 'zh-CN', 'uk-UA')").select("value").distinct().orderBy("value").limit(6).collect()]
    for query in ["lantern", "crooked lanterns", "", "zzzz", *texts]:
        want = [(r.rank, r.logical_id, r.type, r.level, round(r.score, 6)) for r in search.search(docs.drop("doc"), query).collect()]
        got = [(r.rank, r.logical_id, r.type, r.level, round(r.score, 6)) for r in search.search_index(docs, p, query).collect()]
        assert got == want, query
    plan = search.postings(docs, ["doc"], ["display_name"])  # the written table's filter reaches its scan
    assert plan.count() > 0
    assert "GreaterThanOrEqual(term,lant)" in p.where("term >= 'lant' and term < 'lanu'")._jdf.queryExecution().executedPlan().toString()


def test_recall_rules(spark):
    from lattica.operators import search

    results = spark.createDataFrame([("p", 0, "A"), ("p", 1, "B"), ("q", 0, "Noise"), ("q", 1, "C"), ("r", 5, "D")], "phrase string, rank int, logical_id string")
    cases = spark.createDataFrame([("p", "t", ["B"], ["A"], None), ("p", "t", ["B"], ["Z"], None), ("q", "u", ["C"], None, ["Noise"]), ("r", "v", ["D"], None, None), ("s", "w", [], None, None)], "phrase string, tier string, expected_any array<string>, expected_also array<string>, must_not_rank_first array<string>")
    assert {tuple(r) for r in search.recall(results, cases).collect()} == {("t", 2, 1), ("u", 1, 0), ("v", 1, 0)}


def test_render(spark):
    from lattica.plans.render import render

    rows = spark.createDataFrame([("a\nb", 1234, True, None), ("x" * 80, 5, False, ["p", "q"])], "name string, n long, ok boolean, l array<string>")
    text = render(answers.Result(rows, ["shadowed"]))
    assert text.splitlines()[0].split() == ["name", "n", "ok", "l"] and "a b" in text and "1,234  yes  -" in text and "…" in text and "p, q" in text and "! shadowed: several" in text
    assert "! truncated" in render(answers.Result(rows), 1) and render(answers.Result(rows.limit(0))) == "(nothing)\n"
