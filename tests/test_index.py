"""Operators of the asset index on small fixtures."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import align, graph, inherit, links, profile, search
from lattica.plans import answers, build
from lattica.sources import archives, config, declared, lang, lenient_json
from lattica.streaming import refresh

T0 = dt.datetime(2025, 1, 1)
CANDIDATE = "asset_id long, json_pointer string, schema_pointer string, schema_scope string, raw_value string, value_kind string"


def leaf(asset, pointer, value, scope=None, kind="string"):
    return (asset, pointer, "/".join("*" if p.isdigit() else p for p in pointer.split("/")), scope, value, kind)


def assets(spark, *rows):
    return spark.createDataFrame([(i, 1, n, t, f"Server/{n}.json", True) for i, n, t in rows], "id long, pack_id long, logical_id string, type string, path string, is_effective boolean")


def test_text_functions(spark):
    df = spark.createDataFrame([("Armor_IronUIElementID x",)], "c string")
    assert df.select(T.expand_identifier(F.col("c"))).first()[0] == ["Armor", "IronUIElementID", "Iron", "UI", "Element", "ID", "x"]
    one = lambda v, f: spark.createDataFrame([(v,)], "c string").select(f(F.col("c"))).first()[0]
    assert one("Couraça 蜘蛛 Ґоблін", T.terms) == ["couraca", "蜘", "蛛", "гоблін"]
    assert one("кірасу", lambda c: T.relax(c, 1)) == "кірас"
    assert one("abcd", lambda c: T.relax(c, 3)) == "abcd"
    assert one("Common/Icons/A.PNG", T.file_kind) == "texture"
    assert one("Common/readme", T.file_kind) == "other"
    assert one("/Material/Solid", T.follows_convention) is False
    assert one("/ItemId", T.follows_convention) is True
    assert one("A", T.is_identifier) is False
    assert one("Server/Languages/pt-BR/x.lang", T.locale_from_path) == "pt-BR"
    assert one("Server/a.b/x.y.json", T.asset_id_from_path) == "x.y"
    assert one("Server/Item/*/x*.json", T.glob_prefix) == "Server/Item/"
    assert one("a \n b" + "c" * 30, lambda c: T.clip(c, 6)) == "a bcc…"


def test_lenient_json():
    doc, fixes = lenient_json.parse('{"a": NaN, "b/c": [1, -Infinity, "NaN"], "~": {"x": Infinity}}')
    assert doc == {"a": None, "b/c": [1, None, "NaN"], "~": {"x": None}}
    assert sorted(fixes) == [("/a", "NaN"), ("/b~1c/1", "-Infinity"), ("/~0/x", "Infinity")]
    with pytest.raises(ValueError, match="here"):
        lenient_json.parse("{", "here")


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x\\u00e9"}, []], "c": {}, "d": -1.5e3, "e": null, "f": [true, false]}', "[]", "{}", '"s"', " 12 ", '{"a": 1, "a": {"b": 2}}', "[[1,2],[3]]", "[1,]", "[1 2]", '{"a" 1}', '{"a": 1} x', "", "nul", "[", '{"a":', '{a: 1}', "[1", "[NaN, -Infinity]"])
def test_deep_reader_agrees(text):
    try:
        want = json.loads(text, parse_constant=str)
    except ValueError:
        with pytest.raises(ValueError):
            lenient_json._deep(text, str)
    else:
        got = lenient_json._deep(text, str)
        assert got == want and json.dumps(got) == json.dumps(want)


def test_depth_and_length_without_bounds(spark):
    n = 50_000
    deep, digits = '{"k": ' * n + "[NaN, 1]" + "}" * n, "9" * 6000
    doc, fixes = lenient_json.parse(deep)
    assert fixes == [("/k" * n + "/0", "NaN")] and lenient_json.dumps(doc) == deep.replace("NaN", "null")
    doc, _ = lenient_json.parse(f'{{"n": [{digits}, 7], "s": "\u00e9"}}')
    assert lenient_json.dumps(doc) == f'{{"n": [{digits}, 7], "s": "\u00e9"}}' and doc["n"][1] == 7
    df = spark.createDataFrame([(1, '{"a": ' * 20_000 + '[{"x": 5}]' + "}" * 20_000), (2, f'{{"n": {digits}, "t": " padded "}}'), (3, "{"), (4, None), (5, '{"v": [NaN]}')], "asset_id long, doc string")
    got = {(r.asset_id, len(r.json_pointer), r.raw_value) for r in lenient_json.leaves(df).collect()}
    assert got == {(1, 40_000 + 4, "5"), (2, 2, digits), (2, 2, "padded")}
    assert [tuple(r)[0] for r in lenient_json.unreadable(df, ["asset_id"]).collect()] == [3]
    fixed = {r.asset_id: r.r for r in df.select("asset_id", lenient_json.repaired(F.col("doc")).alias("r")).collect()}
    assert fixed[5].json == '{"v": [null]}' and fixed[4] is None or fixed[4].json is None and len(fixed[1].json) > 100_000 and digits in fixed[2].json


def test_number_text():
    for x, want in ((1.0, "1"), (1.5, "1.5"), (1e16, "10000000000000000"), (1e21, "1e+21"), (1e-5, "0.00001"), (1.5e-7, "1.5e-7"), (7, "7")):
        assert lenient_json.number_text(x) == want


def test_text_references(spark):
    doc = {"$c": {"N": "server.items.apple.name"}, "l": ["common.ui.ok", "server.a"], "long": "server.x." + "y" * 300, "t": " server.a.b"}
    got = {tuple(r)[1:] for r in lenient_json.text_references(spark.createDataFrame([(1, json.dumps(doc)), (2, "["), (3, None)], "asset_id long, doc string")).collect()}
    assert got == {("/$c/N", "N", "server.items.apple.name"), ("/l/0", "0", "common.ui.ok"), ("/long", "long", "server.x." + "y" * 300)}


def test_leaves(spark):
    doc = {"ItemId": "Plant_Fruit_Apple", "L": 40, "H": True, "S": 1.5, "N": None, "$c": "no", "One": 1.0, "p": "x" * 97, "q": "a/" + "x" * 150 + ".png", "l": [{"k": "Default"}], "e": " "}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "asset_id long, doc string")
    got = {(r.json_pointer, r.schema_pointer, r.raw_value[:20], r.value_kind) for r in lenient_json.leaves(df).collect()}
    assert got == {
        ("/ItemId", "/ItemId", "Plant_Fruit_Apple", "string"), ("/L", "/L", "40", "number"), ("/H", "/H", "true", "boolean"), ("/S", "/S", "1.5", "number"), ("/One", "/One", "1", "number"),
        ("/q", "/q", "a/" + "x" * 18, "string"), ("/l/0/k", "/l/*/k", "Default", "string"),
    }


def test_lang_files(spark):
    text = "# c\na.b = x = y\n c = 1 \\\n2\nc2=\n=none\na.b = last\nend = z\\"
    df = spark.createDataFrame([("f", text)], "path string, content string")
    assert {r.key: r.value for r in lang.entries(df).collect()} == {"a.b": "last", "c": "1 2", "c2": "", "end": "z"}
    assert lang.chain("uk-UA", {"uk-UA": "ru-RU", "ru-RU": "uk-UA"}) == ["uk-UA", "ru-RU", "uk", "en-US"]
    keys = spark.createDataFrame([("k", "en-US", "e"), ("k", "es", "s"), ("j", "en-US", "f")], "key string, locale string, value string")
    assert {tuple(r) for r in lang.resolve(keys, "es-MX", {}).collect()} == {("k", "s", "es"), ("j", "f", "en-US")}


def test_effective_and_ties(spark):
    a = spark.createDataFrame([(1, 1, "X", "T"), (2, 2, "X", "T"), (3, 3, "X", "T"), (4, 1, "Y", None), (5, 2, "Y", None), (6, 2, "Y", None)], "id long, pack_id long, logical_id string, type string")
    p = spark.createDataFrame([(1, 3), (2, 2), (3, 2)], "id long, priority int")
    assert {r.id for r in graph.effective(a, p).where("effective").collect()} == {3, 5, 6}


def test_edges_and_dangling(spark):
    a = assets(spark, (1, "Entry", None), (2, "Entry", None), (3, "Stone", "Sound"), (4, "Stone", "Sound"), (5, "Stone", "Block"), (6, "Bow", "Item"))
    c = spark.createDataFrame(
        [
            leaf(1, "/Parent", "Entry"), leaf(3, "/Parent", "Stone"), leaf(6, "/Icon", "Sounds/A.ogg"), leaf(6, "/Nowhere", "Sounds/B.ogg"), leaf(6, "/Name", "items.bow.name"),
            leaf(6, "/BlockId", "Stone"), leaf(6, "/Odd", "Stone"), leaf(6, "/None", "None"), leaf(6, "/Sound", "Missing"),
        ],
        CANDIDATE,
    )
    files = spark.createDataFrame([(1, "Common/Sounds/A.ogg")], "id long, path string")
    keys = spark.createDataFrame([(1, "bow.name", "en-US", "items"), (2, "bow.name", "fr-FR", "items")], "id long, key string, locale string, root string")
    fields = spark.createDataFrame([("Item", "/Sound", "Sound")], "asset_type string, json_pointer string, reference_target string")
    e = graph.resolve(c, a, files, keys, fields)
    got = {(r.src, r.dst, r.kind, r.confidence) for r in e.collect()}
    assert (3, 4, "INHERITS_FROM", "high") in got and not any(k == "INHERITS_FROM" and s == 1 for s, _, k, _ in got)
    assert (6, 1, "REFERENCES_FILE", "high") in got and (6, 1, "LOCALIZED_BY", "high") in got
    assert {(r.json_pointer, r.confidence) for r in e.where("src = 6 and kind = 'REFERENCES'").collect()} == {("/BlockId", "medium"), ("/Odd", "low")}
    broken = graph.broken_references(c, a, fields)
    assert [tuple(r)[2:] for r in broken.collect()] == [("Missing", "Sound")]
    assert {r.json_pointer for r in graph.dangling(c, a, keys, e, broken).collect()} == {"/Nowhere"}


def test_promotion_and_contradiction(spark):
    a = assets(spark, (1, "Host", "Item"), (2, "Wood", "Block"), (3, "Wood", "Sound"))
    c = spark.createDataFrame([leaf(1, "/S", "Wood", "Item"), leaf(1, "/X/Parent", "Wood", "Branch")], CANDIDATE)
    fields = spark.createDataFrame([("Item", "/S", "Sound", None), ("Block", "", None, ["Branch"])], "asset_type string, json_pointer string, reference_target string, ref_scope array<string>")
    e = spark.createDataFrame([(1, 2, "asset", "REFERENCES", "/S", "low"), (1, 3, "asset", "REFERENCES", "/S", "low"), (1, 2, "asset", "REFERENCES", "/X/Parent", "low")], "src long, dst long, dst_kind string, kind string, json_pointer string, confidence string")
    got = {(r.dst, r.json_pointer): (r.kind, r.confidence) for r in graph.promote(e, c, a, fields).collect()}
    assert got == {(2, "/S"): ("REFERENCES", "medium"), (3, "/S"): ("REFERENCES", "high"), (2, "/X/Parent"): ("INHERITS_FROM", "high")}
    assert [tuple(r) for r in graph.contradicted(e, c, a, fields).collect()] == [(1, 2, "/S")]
    assert {r.target_type for r in graph.inbound(e, c, a, fields).where("json_pointer = '/S'").collect()} == {"Sound"}


FIELDS = "asset_type string, json_pointer string, ref_scope array<string>, discriminator_property string, discriminator_values array<string>, type_constant string"


def test_alignment(spark):
    single, multi = "common:SingleDrop", "common:MultiDrop"
    rows = [("Table", "/Container", [single, multi], "Type", None, None), ("Table", "/Map/*", [single], None, None, None), ("Table", "/Plain", None, None, None, None)]
    rows += [(single, p, None, None, None, None) for p in ("/Type", "/Item", "/Item/ItemId")] + [(multi, p, None, None, None, None) for p in ("/Type", "/Rolls")] + [(multi, "/Kids/*", [single, multi], "Type", ["Single", "Multi"], None)]
    fields = spark.createDataFrame(rows, FIELDS)
    a = spark.createDataFrame([(1, "Table", None), (2, "Table", 3), (3, "Table", None), (4, None, None), (5, "Table", None)], "id long, type string, parent_id long")
    data = [
        (1, "/Container/Type", "Single", "string"), (1, "/Container/Item/ItemId", "A", "string"), (2, "/Container/Rolls", "2", "number"), (3, "/Container/Type", "Multi", "string"), (3, "/Container/Kids/0/Type", "Single", "string"),
        (3, "/Container/Kids/0/Item/ItemId", "B", "string"), (4, "/Container/Type", "Single", "string"), (5, "/Container/Type", "Odd", "string"), (5, "/Container/Rolls", "1", "number"), (1, "/Map/k/Item", "C", "string"), (1, "/Plain", "x", "string"),
    ]
    got = {(r.asset_id, r.json_pointer): (r.schema_scope, r.schema_pointer) for r in align.align(spark.createDataFrame(data, "asset_id long, json_pointer string, raw_value string, value_kind string"), a, fields).collect()}
    assert got[1, "/Container/Item/ItemId"] == (single, "/Item/ItemId")
    assert got[2, "/Container/Rolls"] == (multi, "/Rolls")  # the parent tells
    assert got[3, "/Container/Kids/0/Item/ItemId"] == (single, "/Item/ItemId")
    assert got[4, "/Container/Type"] == (None, "/Container/Type")
    assert got[5, "/Container/Rolls"] == ("Table", "/Container/Rolls")
    assert got[1, "/Map/k/Item"] == (single, "/Item")
    assert got[1, "/Plain"] == ("Table", "/Plain")


def test_alignment_agrees_with_the_tables(spark):
    from lattica.queries.answers import nst10_align

    d = "/root/testdata/sf0.001"
    a = nst10_align(spark, d).select("asset_id", "json_pointer", F.col("schema_scope").alias("s"), F.col("schema_pointer").alias("p")).distinct()
    c = spark.read.parquet(f"{d}/candidates.parquet").where("schema_scope is not null and json_pointer like '/%' and json_pointer not like '%/'").select("asset_id", "json_pointer", "schema_scope", "schema_pointer").distinct()
    j = a.join(c.where("schema_pointer like '/%' and schema_pointer not like '%/'"), ["asset_id", "json_pointer"])
    # where a list of one entry was written as an object, no declared field fits the tables' pointer
    off = j.where("s != schema_scope or p != schema_pointer").count()
    assert j.count() > 500 and off <= 0.05 * j.count()


def test_inheritance(spark):
    fields = spark.createDataFrame(
        [("Item", "", None, True), ("Item", "/Map", None, None), ("Item", "/Map/*", None, None), ("Item", "/Box", ["Box"], None), ("Item", "/Opaque", ["Opaque"], None), ("Box", "", None, True), ("Opaque", "", None, False)],
        "asset_type string, json_pointer string, ref_scope array<string>, merges_properties boolean",
    )
    docs = [
        (1, "Item", {"A": 1, "Map": {"x": 1, "y": 2}, "Box": {"p": 1, "q": 1}, "Opaque": {"u": 1}, "L": [1, 2]}),
        (2, "Item", {"A": 2, "Map": {"y": 3}, "Box": {"q": 2}, "Opaque": {"v": 1}, "L": [3]}),
        (3, "Item", {"B": 1}),
        (4, "Item", {"C": 1}),
        (5, None, {"D": 1}),
    ]
    d = spark.createDataFrame([(i, t, json.dumps(x)) for i, t, x in docs], "asset_id long, type string, doc string")
    parents = spark.createDataFrame([(2, 1), (3, 2), (4, 4), (5, 1)], "child long, parent long")
    got = {r.asset_id: (json.loads(r.doc), json.loads(r.origins), r.truncated) for r in inherit.resolve_documents(d, parents, fields).collect()}
    assert got[2][0] == {"A": 2, "Map": {"x": 1, "y": 3}, "Box": {"p": 1, "q": 2}, "Opaque": {"v": 1}, "L": [3]}
    assert got[3][0]["B"] == 1 and got[3][0]["Map"] == {"x": 1, "y": 3}
    assert got[3][1]["/B"] == ["declared", "3"] and got[3][1]["/A"] == ["inherited", "2"] and got[2][1]["/Map"] == ["merged", "2"]
    assert got[4][0] == {"C": 1} and got[4][2]
    assert got[5][0] == {"D": 1}


def test_inheritance_of_unions_and_broken_chains(spark):
    fields = spark.createDataFrame(
        [
            ("Act", "", ["Act:Run", "Act:Jump"], None, "Op", ["run", "jump"]), ("Act:Run", "/Map/*", None, None, None, None), ("Act:Run", "/Box", ["Box"], None, None, None),
            ("Act:Run", "/M2", None, None, None, None), ("Act:Run", "/M2/*", ["Box"], None, None, None), ("Box", "", None, True, None, None),
        ],
        "asset_type string, json_pointer string, ref_scope array<string>, merges_properties boolean, discriminator_property string, discriminator_values array<string>",
    )
    docs = {
        1: {"Op": "run", "Map": {"a~/b": 1, "c": 1}, "Box": {"p": 1}, "M2": {"x": {"q": 1}}}, 2: {"Parent": "one", "Map": {"c": 2}, "Box": {"r": [1]}, "M2": {"x": {"z": 2}}}, 3: {"Op": "jump", "Parent": "two", "Map": {"d": 3}},
        4: {"Parent": "lost"}, 5: {"Parent": "six"}, 6: {"Parent": "five", "K": 6}, 8: {"Parent": "seven"}, 20: {"n": 20}, **{i: {"n": i} for i in range(21, 41)},
    }
    d = spark.createDataFrame([(i, "Act", json.dumps(x)) for i, x in docs.items()] + [(7, "Act", "{"), (9, "Act", None)], "asset_id long, type string, doc string")
    links = [(2, 1, "one"), (3, 2, "two"), (4, None, "lost"), (5, 6, "six"), (6, 5, "five"), (8, 7, "seven")] + [(i, i - 1, "x") for i in range(21, 41)]
    got = {r.asset_id: r for r in inherit.resolve_documents(d, spark.createDataFrame(links, "child long, parent long, name string"), fields).collect()}
    two, three = (json.loads(got[i].doc) for i in (2, 3))
    assert got[2].scope == "Act:Run" and two["Map"] == {"a~/b": 1, "c": 2} and two["Box"] == {"p": 1, "r": [1]} and two["M2"] == {"x": {"q": 1, "z": 2}} and two["Op"] == "run"
    assert json.loads(got[2].origins)["/Map/a~0~1b"] == ["inherited", "1"] and json.loads(got[2].origins)["/M2/x/q"] == ["inherited", "1"]
    assert got[3].scope == "Act:Jump" and three["Map"] == {"d": 3} and three["Box"] == {"r": [1]} and json.loads(got[3].origins)["/Box"] == ["inherited", "2"]
    assert got[4].missing_parent == "lost" and not got[4].truncated and got[8].missing_parent == "7" and got[7].doc is None and got[9].doc is None
    assert got[5].truncated and json.loads(got[5].doc)["K"] == 6 and got[5].depth == 1 and got[6].depth == 1
    assert got[40].depth == 15 and got[40].truncated and not got[35].truncated and got[35].depth == 15 and json.loads(got[40].doc)["n"] == 40
    tallies = {r.asset_id: (r.declared, r.inherited, r.merged) for r in inherit.origin_tallies(spark.createDataFrame([(2, got[2].origins)], "asset_id long, origins string")).collect()}
    assert tallies == {2: (1, 1, 3)}


def test_links_and_prefixes(spark):
    c = spark.createDataFrame([leaf(1, "/Id", "Furnace", "Bench"), leaf(2, "/Req", "Furnace", "Need"), leaf(3, "/Req", "Nothing", "Need")], CANDIDATE)
    got = links.value_links(c, [links.ValueLink("bench", (("Bench", "/Id"),), (("Need", "/Req"),))])
    assert {(r.value, r.role, r.resolved) for r in got.collect()} == {("Furnace", "declared", True), ("Furnace", "referenced", True), ("Nothing", "referenced", False)}
    assert tuple(links.summary(got).first()) == ("bench", 1, 1, 2, 1, ["Nothing"])
    owners = spark.createDataFrame([(1, "Oven", "B"), (2, "Pie", "I"), (3, "Pot", None)], "id long, logical_id string, type string")
    assert [tuple(r) for r in links.who_uses(got, owners, "bench", "Nothing", "referenced").collect()] == [("Pot", None, "/Req")]
    assert [tuple(r) for r in links.sites(got.where("role = 'referenced'"), c).collect()] == [("Need", "/Req", 2, "/Req")]
    leaves = spark.createDataFrame([(1, "/a/b/c"), (1, "/ab/c"), (2, "/a/b")], "asset_id long, json_pointer string")
    holders = spark.createDataFrame([(1, "/a", "outer"), (1, "/a/b", "inner")], "asset_id long, at string, holder string")
    assert {(r.asset_id, r.json_pointer): r.holder for r in links.enclosing(leaves, holders).collect()} == {(1, "/a/b/c"): "inner", (1, "/ab/c"): None, (2, "/a/b"): None}


def test_profile(spark):
    rows = [leaf(i % 3, "/Q", "abc"[i % 3], "Item") for i in range(9)] + [leaf(i, "/N", str(i), "Item", "number") for i in range(50)]
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + CANDIDATE)
    s = {r.json_pointer: r for r in profile.field_stats(c).collect()}
    assert (s["/Q"].n, s["/Q"].cardinality, s["/Q"].observed_values) == (9, 3, ["a", "b", "c"]) and s["/N"].observed_values is None and s["/N"].cardinality == 50
    fields = spark.createDataFrame([("Item", "/Q", None), ("Item", "/N", None)], "asset_type string, json_pointer string, enum_values array<string>")
    assert [r.json_pointer for r in profile.inferred_enums(profile.field_stats(c), fields).collect()] == ["/Q"]
    declared_ = spark.createDataFrame([("Item", "/Q", ["a"])], "asset_type string, json_pointer string, enum_values array<string>")
    assert profile.inferred_enums(profile.field_stats(c), declared_).count() == 0 and profile.inferred_enums(profile.field_stats(c), fields.where("json_pointer = '/N'")).count() == 0
    assert profile.field_stats(c.limit(0)).count() == 0


def test_search(spark):
    docs = spark.createDataFrame(
        [(1, "Spider_Cave", "NPC", "zh-CN", "洞穴蜘蛛", ""), (2, "Spider_Back", "NPC", "zh-CN", "蛛蜘", ""), (3, "Armor_Chest", "Item", "uk-UA", "Адамантитова кіраса", ""), (4, "Deco_Chair", "Item", "uk-UA", "Ґоблінський трон", ""), (5, "Debug_Chair", "Item", "en-US", "Goblin chair", "wooden"), (6, "Deco_Chair2", "Item", "en-US", "Goblin chair", "wooden")],
        "asset_id long, logical_id string, type string, locale string, display_name string, description string",
    )
    ids = lambda q: [r.logical_id for r in search.search(docs, q).orderBy("rank").collect()]
    assert ids("蜘蛛") == ["Spider_Cave"]
    assert ids("гоблін") == ["Deco_Chair"]
    assert ids("кірасу") == ["Armor_Chest"]
    assert ids("goblin wood") == ["Deco_Chair2", "Debug_Chair"]
    assert ids("goblin nothing") == [] and ids("") == []
    fam = lambda x: x[0]
    assert search.interleave(["a1", "a2", "a3", "a4", "a5", "b1"], fam) == ["a1", "a2", "a3", "b1", "a4", "a5"]
    cases = spark.createDataFrame([("p", "t", ["x"], ["y"]), ("q", "t", ["z"], [])], "phrase string, tier string, expected_any array<string>, must_not_rank_first array<string>")
    results = spark.createDataFrame([("p", 0, "x"), ("q", 7, "z")], "phrase string, rank int, logical_id string")
    assert tuple(search.recall(results, cases).first()) == ("t", 2, 1)
    assert search.postings(docs, ["asset_id"], ["display_name"]).where("term = '蜘'").count() == 2


SCHEMA = {
    "properties": {"Drops": {"anyOf": [{"$ref": "./common.json#/definitions/Box"}, {"type": "null"}], "x-asset": {"reference": "Table"}}, "Map": {"additionalProperties": {"$ref": "Other.json#"}}, "L": {"type": "array", "items": {"enum": ["a", 1]}}, "$hid": {}},
    "required": ["L"],
    "definitions": {"Inner": {"properties": {"u": {"oneOf": [{"$ref": "A.json#"}, {"$ref": "B.json#"}], "x-asset": {"union": {"property": "Kind", "values": ["a", "b"]}}}}}},
}


def test_declared_fields(spark, tmp_path):
    (tmp_path / "Item.json").write_text(json.dumps(SCHEMA))
    got = {(r.asset_type, r.json_pointer): r for r in declared.read(spark, str(tmp_path)).collect()}
    assert got["Item", "/Drops"].ref_scope == ["common:Box"] and got["Item", "/Drops"].reference_target == "Table"
    assert got["Item", "/Map/*"].ref_scope == ["Other"] and got["Item", "/L/*"].enum_values == ["a", "1"] and got["Item", "/L"].optional is False
    assert got["Item:Inner", "/u"].ref_scope == ["A", "B"] and got["Item:Inner", "/u"].discriminator_property == "Kind" and ("Item", "/$hid") not in got
    assert declared.scope_of("x.json#/properties/a") is None


def test_config(tmp_path):
    for n in ("b.jar", "a.zip", "Old.zip", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    s = config.select(str(tmp_path), exclude=["old*", "zzz*"], include=[str(tmp_path / "Old.zip"), "/no/such.zip"])
    assert [a.rsplit("/", 1)[1] for a in s.archives] == ["a.zip", "b.jar", "Old.zip"] and s.unused_excludes == ["zzz*"] and s.missing == ["/no/such.zip"]
    assert config.stamp(s.archives) == config.stamp(s.archives[::-1])
    (tmp_path / "lattica.json").write_text('{"folder": "mods", "odd": 1}')
    (tmp_path / "in").mkdir()
    found, unknown = config.find(str(tmp_path / "in"))
    assert found["folder"] == str(tmp_path.resolve() / "mods") and unknown == ["odd"]


def test_build_and_answers(spark, tmp_path):
    base, mod = str(tmp_path / "base.zip"), str(tmp_path / "mod.zip")
    with zipfile.ZipFile(base, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Server/Item/Bow_Oak.json", '{"Icon": "Icons/Bow.png", "Name": "items.bow.name", "Weight": NaN, "Parent": "Bow_Base"}')
        z.writestr("Server/Item/Bow_Base.json", '{"Level": 3}')
        z.writestr("Common/Icons/Bow.png", b"png")
        z.writestr("Server/Languages/en-US/items.lang", "bow.name = Oaken bow\n")
    with zipfile.ZipFile(mod, "w") as z:
        z.writestr("Server/Item/Bow_Oak.json", '{"Icon": "Icons/Bow.png"}')
        z.writestr("Server/Prefabs/Big.json", '{"Icon": "x"}')
    listed = archives.entries(spark, [base, mod])
    assert listed.count() == 6 and archives.admitted(listed).count() == 2
    at = listed.where("path like '%Bow_Base%'").first()
    assert archives.read_at(base, at.header_offset, at.compressed) == b'{"Level": 3}'
    with pytest.raises(ValueError, match="no entry"):
        archives.read_at(base, 1, 3)
    fields = spark.createDataFrame([("Item", "/Icon", "string", True, "file", None), ("Item", "/Never", "string", True, None, None)], "asset_type string, json_pointer string, declared_type string, optional boolean, reference_target string, ref_scope array<string>")
    out = str(tmp_path / "index")
    assert build.state(spark, out) == "incomplete"
    for _ in range(2):  # a build may be repeated
        build.build(spark, [(base, "vanilla", 3), (mod, "archive", 2)], fields, [("Server/Item/", "", "Item")], out)
    assert build.state(spark, out) == "ready"
    with pytest.raises(Exception):  # a build that fails half-way leaves no index that looks ready
        build.build(spark, [(base, "vanilla", 3), (str(tmp_path / "gone.zip"), "archive", 2)], fields, [("Server/Item/", "", "Item")], out)
    assert build.state(spark, out) == "incomplete"
    build.build(spark, [(base, "vanilla", 3), (mod, "archive", 2)], fields, [("Server/Item/", "", "Item")], out)
    assert build.state(spark, out) == "ready"
    ix = answers.Index(spark, out)
    assert {(r.kind, r.confidence) for r in ix.edges.collect()} == {("REFERENCES_FILE", "high"), ("LOCALIZED_BY", "high"), ("INHERITS_FROM", "high")}
    assert ix.assets.where("logical_id = 'Bow_Oak' and is_effective").count() == 1 and ix.candidates.where("raw_value = 'x'").count() == 0
    got = ix.get("Bow_Oak")
    assert got.rows.count() == 2 and "shadowed" in got.caveats and "third-party" in got.caveats
    assert [r.logical_id for r in ix.search("oaken").rows.collect()] == ["Bow_Oak"]
    assert "names-not-values" in ix.search("zzzz").caveats
    assert ix.refs("Bow_Base").rows.first().logical_id == "Bow_Oak"
    assert ix.refs("Icons/Bow.png").rows.first().n_assets == 2
    assert [r.json_pointer for r in ix.undocumented("Item").rows.collect()] == ["/Never"]
    assert ix.describe("Item", "Icon/").caveats[:2] == ["pre-inheritance", "pointer-repaired"]
    assert ix.types().rows.first().n == 2 and {r.what: r.n for r in ix.status().rows.collect()}["assets"] == 4
    assert ix.search_lang("bow").rows.count() == 1 and ix.search_schema("icon").rows.count() == 1 and ix.bench().rows.count() == 0
    drafts = answers.Index(spark, out, {"assets": spark.createDataFrame([(99, "Draft", "Item")], "id long, logical_id string, type string")})
    assert drafts.types().rows.first().n == 3
    (tmp_path / "loose/a").mkdir(parents=True)
    (tmp_path / "loose/a/x.json").write_text("{}")
    assert archives.folder(spark, str(tmp_path / "loose")).first().path == "a/x.json"


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "asset_id long, doc string, read_at timestamp_ntz"
    spark.createDataFrame([(1, '{"a": 1}', T0), (1, '{"a": 2}', None), (2, None, None)], schema).write.parquet(src)
    for _ in range(2):
        refresh.watch(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    spark.createDataFrame([(3, '{"a": 1, "b": "x"}', T0)], schema).write.mode("append").parquet(src)
    refresh.watch(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    assert refresh.values_per_hour(spark.read.parquet(out)).where("schema_pointer = '/a'").first().n == 2


def test_entry_queries_match_sql(spark):
    """Every query runs on the smallest tables; those with SQL agree with it."""
    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    import os

    for f in os.listdir(d):
        con.sql(f"create view {f[:-8]} as select * from '{d}/{f}'")
    sql = entry.oracle_sql()
    text = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    for name, q in entry.queries().items():
        if name not in sql or ".llm." in q.__module__:
            continue
        df = q(spark, d)
        cols = sorted(df.columns)
        got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
        rel = con.sql(sql[name])
        assert sorted(rel.columns) == cols, name
        want = sorted(tuple(text(v) for v in (dict(zip(rel.columns, r))[c] for c in cols)) for r in rel.fetchall())
        assert got == want, name
