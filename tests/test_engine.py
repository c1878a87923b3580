"""Lookups, pivots, sources, streams, tooling, and the shape of plans."""

import json
import re

import pytest
from pyspark.sql import functions as F

from specloom import queries
from specloom.cli import main
from specloom.errors import InversionError, JoinError, SpecError
from specloom.plans.derive import derive_schema
from specloom.plans.invert import invert
from specloom.plans.mapper import Mapper
from specloom.plans.schema import Schema, patch
from specloom.plans.validate import validate
from specloom.sources import io


def slots(source, slot_derivations, **more):
    return {"class_derivations": {"Out": {"populated_from": source, "slot_derivations": slot_derivations, **more}}}


def rows(df):
    return sorted((r.asDict(True) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "pid long, ref string")
    items = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", None, "x"), (None, 9, "z")], "ref string, n long, t string").coalesce(1)
    return {"people": people, "items": items}


def test_first_match_and_all_matches(tables):
    joins = {"items": {"source_key": "ref", "lookup_key": "ref"}}
    over = lambda f, o, **k: {"populated_from": f"items.{f}", "aggregation_operation": {"operator": o, **k}}
    spec = slots("people", {"pid": None, "first": {"populated_from": "items.t"}, "plus": {"expr": "{items.n} + 1"}, "c": over("n", "COUNT"), "s": over("n", "SUM"), "l": over("t", "LIST"), "m": over("n", "MAX"), "z": over("n", "AVERAGE", null_handling="TREAT_AS_ZERO")}, joins=joins)
    assert rows(Mapper(spec).transform(tables, "people")) == [
        {"pid": 1, "first": "x", "plus": 6, "c": 2, "s": 12, "l": ["x", "y"], "m": 7, "z": 6.0},
        {"pid": 2, "first": "x", "plus": None, "c": 1, "s": 0, "l": ["x"], "m": None, "z": 0.0},
        {"pid": 3, "first": None, "plus": None, "c": None, "s": None, "l": None, "m": None, "z": None},
    ]


def test_implicit_join_and_its_failures(tables, spark):
    spec = slots("people", {"pid": None, "t": {"expr": "{items.t}"}})
    assert [r["t"] for r in rows(Mapper(spec).transform(tables, "people"))] == ["x", "x", None]
    both = {"people": tables["people"], "items": tables["items"].withColumnRenamed("n", "pid")}
    with pytest.raises(JoinError):
        Mapper(spec).transform(both, "people")
    with pytest.raises(SpecError):
        Mapper(slots("people", {"t": {"expr": "{nowhere.t}"}})).transform(tables, "people")
    with pytest.raises(JoinError):
        Mapper(slots("people", {"t": {"expr": "{items.absent}"}})).transform(tables, "people")


def test_a_lookup_costs_one_exchange_a_side_and_no_python(tables):
    joins = {"items": {"source_key": "ref", "lookup_key": "ref"}}
    plan = Mapper(slots("people", {"t": {"populated_from": "items.t"}}, joins=joins)).transform(tables, "people")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Cartesian|NestedLoop", plan)
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 2


def test_columns_are_pruned(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = Mapper(slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "v": {"expr": "l_quantity * 2"}})).transform(df, "lineitem")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_nested_objects_on_another_table(tables):
    joins = {"items": {"source_key": "ref", "lookup_key": "ref"}}
    spec = slots("people", {"pid": None, "item": {"class_derivations": {"Item": {"populated_from": "items", "slot_derivations": {"t": None, "owner": {"populated_from": "pid"}}}}}}, joins=joins)
    assert rows(Mapper(spec).transform(tables, "people"))[0] == {"pid": 1, "item": {"t": "x", "owner": 1}}
    assert rows(Mapper(spec).transform(tables, "people"))[2]["item"] is None


def test_unmelt_keeps_the_last(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, "c", 4.0)], "id long, variable string, value double").coalesce(1)
    spec = slots("long", {"a": None, "b": None}, pivot_operation={"direction": "UNMELT", "id_slots": ["id"]})
    assert rows(Mapper(spec).transform(long, "long")) == [{"id": 1, "a": 2.0, "b": 3.0}, {"id": 2, "a": None, "b": None}]


SCHEMA = {"classes": {"P": {"attributes": {"id": {"identifier": True}, "age": {"range": "integer"}, "w": {"range": "float"}, "tags": {"multivalued": True}}}}}


@pytest.mark.parametrize("kind", ["jsonl", "json", "yaml", "csv", "tsv", "parquet"])
def test_write_and_read(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", 1, 2.5, ["x"]), ("b", None, None, [])], Schema(SCHEMA).struct_type("P")).coalesce(1)
    path = str(tmp_path / f"out.{kind}")
    io.write(df, path)
    if kind in ("csv", "tsv"):
        got = rows(io.read(spark, path, Schema({"classes": {"P": {"attributes": {k: v for k, v in SCHEMA["classes"]["P"]["attributes"].items() if k != "tags"}}}}), "P"))
        assert [(r["id"], r["age"], r["w"], r["tags"]) for r in got] == [("a", 1, 2.5, '["x"]'), ("b", None, None, "[]")]
    else:
        assert rows(io.read(spark, path, Schema(SCHEMA), "P")) == rows(df)


def test_bad_cells_and_unknown_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,age,w\na,x,1e3\nb,,nan\n")
    got = rows(io.read(spark, str(tmp_path / "t.csv"), Schema(SCHEMA), "P", raw=True))
    assert [(r["age"], r["age__raw"], r["w"]) for r in got] == [(None, "x", 1000.0), (None, "", None)]
    with pytest.raises(SpecError):
        io.format_of("x.xml")


def test_non_finite_numbers_do_not_become_json(spark, tmp_path):
    with pytest.raises(Exception):
        io.write(spark.sql("SELECT double('NaN') AS x"), str(tmp_path / "x.jsonl"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "P.jsonl").write_text('{"id": "a", "age": 3}\n{"id": "b", "age": null}\n')
    (tmp_path / "s.yaml").write_text(json.dumps(SCHEMA))
    (tmp_path / "t.yaml").write_text(json.dumps({"class_derivations": {"Q": {"populated_from": "P", "slot_derivations": {"id": None, "next": {"expr": "age + 1"}}}}}))
    t, s = str(tmp_path / "t.yaml"), str(tmp_path / "s.yaml")
    assert main(["map-data", str(tmp_path / "P.jsonl"), "-T", t, "-s", s, "-f", "jsonl"], spark) == 0
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"id": "a", "next": 4}, {"id": "b", "next": None}]
    assert main(["map-data", str(tmp_path), "-T", t, "-s", s, "-f", "csv"], spark) == 0
    assert capsys.readouterr().out == "id,next\na,4\nb,\n"
    assert main(["derive-schema", "-T", t, "-s", s]) == 0 and "next" in capsys.readouterr().out
    assert main(["validate", t, "-s", s]) == 0
    (tmp_path / "bad.yaml").write_text(json.dumps({"class_derivations": {"Q": {"populated_from": "Nope"}}}))
    assert main(["validate-spec", str(tmp_path / "bad.yaml"), "-s", s]) == 1


def test_validate_messages():
    spec = {"class_derivations": {"Q": {"populated_from": "P", "is_a": "Z", "slot_derivations": {"x": {"populated_from": "nope"}, "y": {"expr": "agee + 1"}, "z": {"expr": "who.x"}, "w": {"expr": "1 +"}}}}}
    found = [str(m) for m in validate(spec, SCHEMA, {"classes": {"Q": {"attributes": {"r": {"required": True}}}}})]
    for text in ("no class derivation Z", "populated_from nope", "agee is not a slot", "who.x: no such", "cannot parse", "slot x is not in target class"):
        assert any(text in m for m in found), text
    assert validate({"class_derivations": {"Q": {"populated_from": "P", "slot_derivations": {"id": None}}}}, SCHEMA) == []


def test_invert():
    spec = {"class_derivations": {"Q": {"populated_from": "P", "slot_derivations": {"key": {"populated_from": "id"}, "years": {"expr": "{age}"}, "t": {"populated_from": "tags", "stringification": {"delimiter": "|"}}, "m": {"populated_from": "w", "unit_conversion": {"source_unit": "m", "target_unit": "cm"}}}}}, "enum_derivations": {"E2": {"populated_from": "E", "permissible_value_derivations": {"B": {"sources": ["A", "C"]}}}}}
    back = invert(spec)
    c = back["class_derivations"][0]
    assert (c["name"], c["populated_from"]) == ("P", "Q") and c["slot_derivations"]["id"]["populated_from"] == "key" and c["slot_derivations"]["age"]["populated_from"] == "years"
    assert c["slot_derivations"]["tags"]["stringification"]["reversed"] and c["slot_derivations"]["w"]["unit_conversion"] == {"source_unit": "cm", "target_unit": "m"}
    assert back["enum_derivations"]["E"]["permissible_value_derivations"]["A"]["populated_from"] == "B"
    hard = {"class_derivations": {"Q": {"populated_from": "P", "slot_derivations": {"x": {"expr": "age + 1"}}}}}
    with pytest.raises(InversionError):
        invert(hard)
    assert invert(hard, strict=False)["class_derivations"][0]["slot_derivations"] == {}


def test_derive_and_patch():
    spec = {"class_derivations": {"Q": {"populated_from": "P", "slot_derivations": {"key": {"populated_from": "id"}, "n": {"populated_from": "tags", "aggregation_operation": {"operator": "COUNT"}}, "h": {"expr": "1", "hide": True}, "o": {"class_derivations": {"O": {"slot_derivations": {"age": None}}}}}}}}
    got = derive_schema(spec, SCHEMA)["classes"]
    assert got["Q"]["attributes"] == {"key": {"identifier": True}, "n": {"range": "integer"}, "o": {"range": "O", "inlined": True}} and got["O"]["attributes"]["age"] in ({"range": "integer"}, {})
    more = patch(SCHEMA, {"classes": {"P": {"attributes": {"age": {"range": "Age"}, "boss": {"range": "P"}}}}, "prefixes": {"e": "https://e.org/"}})
    assert more["classes"]["P"]["attributes"]["boss"] == {"range": "P"} and SCHEMA["classes"]["P"]["attributes"]["age"]["range"] == "integer"


def test_stream(spark):
    assert queries.stream_stateless_map(spark, "/root/testdata/sf0.001").count() == 1000


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(queries.ORACLES) | {"uuid5_key"} == set(queries.queries())
    assert set(queries.queries()) <= set(entry.queries())


def test_hot_key_aggregates(spark):
    """SET and MODE of one key's many matches take work per distinct value, in order of first sight."""
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.range(200_000).selectExpr("1L AS k", "(id * 7) % 100 AS v").unionByName(spark.createDataFrame([(1, 5)], "k long, v long")).coalesce(1)
    slots = {o: {"populated_from": "r.v", "aggregation_operation": {"operator": o}} for o in ("SET", "MODE", "COUNT")}
    spec = {"class_derivations": {"Out": {"populated_from": "l", "joins": {"r": {"source_key": "k", "lookup_key": "k"}}, "slot_derivations": slots}}}
    got = Mapper(spec).transform({"l": left, "r": right}, "l").collect()
    assert got[0].SET == [i * 7 % 100 for i in range(100)] and got[0].MODE == 5 and got[0].COUNT == 200_001
    assert (got[1].SET, got[1].MODE, got[1].COUNT) == ([], None, 0) and got[2].SET is None


def test_long_lists_in_a_row(spark):
    rows = spark.range(1).selectExpr("transform(sequence(0, 20000), i -> i % 5000) AS l", "transform(sequence(0, 20000), i -> named_struct('id', cast(i % 5000 AS string), 'n', i)) AS t")
    slots = {"s": {"populated_from": "l", "aggregation_operation": {"operator": "SET"}}, "m": {"populated_from": "l", "aggregation_operation": {"operator": "MODE"}}}
    got = Mapper({"class_derivations": {"Out": {"populated_from": "x", "slot_derivations": slots}}}).transform(rows, "x").first()
    assert got.s == list(range(5000)) and got.m == 0
    from specloom.functions.typed import Typed
    from specloom.operators import coerce

    made = coerce.reshape(Typed(rows["t"], rows.schema["t"].dataType), "MultiValuedDict", "id")
    kept, keys = rows.select(made.col.alias("d"), F.map_keys(made.col)).first()
    assert keys == [str(i) for i in range(5000)] and kept["0"].n == 20000 and kept["7"].n == 15007


def test_round_and_power_from_the_tree(spark):
    rows = spark.createDataFrame([(1.23456, 3, 10)], "x double, d1 long, n long")
    texts = {"a": "round(x, d1)", "b": "round(x, 1 + 1)", "c": "round(x, -1)", "d": "2 ** n", "e": "n ** 3", "f": "7 ** 22", "g": "int('99999999999999999999')"}
    run = lambda *names: Mapper({"class_derivations": {"Out": {"populated_from": "t", "slot_derivations": {k: {"expr": texts[k]} for k in names}}}}).transform(rows, "t").first()
    assert tuple(run("a", "b", "c", "d", "e", "f")) == (1.235, 1.23, 0.0, 1024.0, 1000, 7**22)
    with pytest.raises(Exception):
        run("g")


def test_ordered_rows_through_joins(spark):
    left = spark.range(500).selectExpr("(id * 37) % 500 AS k").coalesce(1)
    right = spark.range(500).selectExpr("id AS k", "id * 2 AS v")
    spec = {"class_derivations": {"Out": {"populated_from": "l", "joins": {"r": {"source_key": "k", "lookup_key": "k"}}, "slot_derivations": {"k": None, "v": {"populated_from": "r.v"}}}}}
    out = Mapper(spec, ordered=True).transform({"l": left, "r": right}, "l")
    assert out.columns == ["k", "v"] and [r.k for r in out.collect()] == [i * 37 % 500 for i in range(500)]


def test_directory_with_an_implied_join(spark, tmp_path):
    import json as j

    (tmp_path / "in").mkdir()
    (tmp_path / "in/Pet.csv").write_text("id,owner\np1,o2\np2,o1\np3,o9\n")
    (tmp_path / "in/Owner.csv").write_text("owner,town\no1,Ulm\no2,Jena\n")
    schema = {"classes": {"Pet": {"attributes": {"id": {"identifier": True}, "owner": {}}}, "Owner": {"attributes": {"owner": {"identifier": True}, "town": {}}}}}
    spec = {"class_derivations": {"Card": {"populated_from": "Pet", "slot_derivations": {"id": {"populated_from": "id"}, "town": {"populated_from": "Owner.town"}}}}}
    (tmp_path / "s.yaml").write_text(j.dumps(schema))
    (tmp_path / "t.yaml").write_text(j.dumps(spec))
    assert main(["map-data", str(tmp_path / "in"), "-T", str(tmp_path / "t.yaml"), "-s", str(tmp_path / "s.yaml"), "-o", str(tmp_path / "out.json")], spark) == 0
    assert j.loads((tmp_path / "out.json").read_text()) == [{"id": "p1", "town": "Jena"}, {"id": "p2", "town": "Ulm"}, {"id": "p3", "town": None}]


def test_finite_numbers_at_any_depth(spark):
    good = spark.sql("SELECT 1.5D AS a, array(named_struct('x', 2.5D)) AS b, map('k', 1D) AS c, 'NaN' AS d")
    assert io.finite(good).count() == 1 and io.finite(good).first().b[0].x == 2.5
    for bad in ("array(named_struct('x', double('NaN')))", "map('k', double('Infinity'))", "named_struct('y', array(double('-Infinity')))"):
        with pytest.raises(Exception):
            io.finite(spark.sql(f"SELECT {bad} AS a")).collect()


def test_views(spark):
    io.views({"some_view": spark.range(3)})
    assert spark.sql("SELECT sum(id) AS s FROM some_view").first().s == 3


def test_groups(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "x"), (None, 5, "x"), (None, 6, "x")], "g string, n long, t string").coalesce(1)
    over = lambda f, o: {"populated_from": f, "aggregation_operation": {"operator": o}}
    slot = {"g": None, "c": {"value": "k"}, "s": over("n", "SUM"), "n": over("n", "COUNT"), "l": over("n", "LIST"), "m": over("t", "MODE"), "u": over("t", "SET")}
    assert rows(Mapper(slots("t", slot), grouped=True).transform(df, "t")) == sorted([
        {"g": "a", "c": "k", "s": 4, "n": 2, "l": [1, 3], "m": "y", "u": ["x", "y"]},
        {"g": "b", "c": "k", "s": 0, "n": 1, "l": [None], "m": "x", "u": ["x"]},
        {"g": None, "c": "k", "s": 11, "n": 2, "l": [5, 6], "m": "x", "u": ["x"]},
    ], key=str)
    whole = {"s": over("n", "MAX"), "u": over("t", "SET")}
    assert rows(Mapper(slots("t", whole), grouped=True).transform(df, "t")) == [{"s": 6, "u": ["x", "y"]}]
    assert rows(Mapper(slots("t", whole), grouped=True).transform(df.limit(0), "t")) == [{"s": None, "u": []}]
    hidden = {"up": {"expr": "upper(g)", "hide": True}, "h": {"expr": "slot('up')"}, "n": over("n", "COUNT")}
    assert [r["n"] for r in rows(Mapper(slots("t", hidden), grouped=True).transform(df, "t"))] == [2, 1, 2]


def test_references_to_objects_of_tables(spark):
    people = spark.createDataFrame([(1, "Ann", 2, [2, 3]), (2, "Bob", 9, []), (3, "Cid", None, None), (4, "Dan", 2, [9, 1])], "id long, name string, boss long, friends array<long>")
    pets = spark.createDataFrame([("p", 1), ("q", 4), ("r", 9)], "pet string, owner long")
    schema = {"classes": {"Person": {"attributes": {"id": {"identifier": True, "range": "integer"}, "name": {}, "boss": {"range": "Person"}, "friends": {"range": "Person", "multivalued": True}}}, "Pet": {"attributes": {"pet": {}, "owner": {"range": "Person"}}}}}
    spec = {"class_derivations": {"Out": {"populated_from": "Person", "slot_derivations": {"id": None, "boss": {"expr": "boss.name"}, "raw": {"expr": "boss"}, "friends": {"expr": "friends.name"}}}, "Pet": {"slot_derivations": {"pet": None, "of": {"expr": "{owner.name} + '!'"}}}}}
    out = Mapper(spec, schema).transform({"Person": people, "Pet": pets})
    assert rows(out["Out"]) == [{"id": 1, "boss": "Bob", "raw": 2, "friends": ["Bob", "Cid"]}, {"id": 2, "boss": None, "raw": 9, "friends": None}, {"id": 3, "boss": None, "raw": None, "friends": None}, {"id": 4, "boss": "Bob", "raw": 2, "friends": [None, "Ann"]}]
    assert rows(out["Pet"]) == [{"pet": "p", "of": "Ann!"}, {"pet": "q", "of": "Dan!"}, {"pet": "r", "of": None}]


def test_values_as_root(spark):
    df = spark.createDataFrame([("A",), ("Z",), (None,)], "v string")
    schema = {"enums": {"E": {"permissible_values": {"A": {}}}}, "types": {"Code": {"typeof": "string"}}}
    spec = {"class_derivations": {}, "enum_derivations": {"F": {"populated_from": "E", "permissible_value_derivations": {"alpha": {"populated_from": "A"}}}}}
    assert [r["v"] for r in Mapper(spec, schema).transform(df, "E").collect()] == ["alpha", None, None]
    assert [r["v"] for r in Mapper(spec, schema).transform(df, "Code").collect()] == ["A", "Z", None]
    with pytest.raises(SpecError):
        Mapper(spec, schema).transform(df.withColumn("w", F.lit(1)), "E")


@pytest.mark.parametrize("text, want", [
    ("sum([1, 2, 3])", 6), ("sum([1.5, 2])", 3.5), ("sorted([3, 1, 2])", [1, 2, 3]), ("any([0, 1])", True), ("all([0, 1])", False), ("any([])", False), ("all([])", True),
    ("reversed([1, 2])", [2, 1]), ("first([7, 8])", 7), ("last([7, 8])", 8), ("first([])", None), ("floor(-1.5)", -2), ("ceil(-1.5)", -1), ("floor([1.5, 2.5])", [1, 2]),
    ("substr('hello', 1, 3)", "el"), ("substr('hello', 2)", "llo"), ("substr('hello', -3, -1)", "ll"), ("substr('hello', 4, 2)", ""), ("substr('hello', 9)", ""), ("substr('a', -5, 1)", "a"),
    ("strip(' \\t a b \\u00a0')", "a b"), ("lstrip('  a ')", "a "), ("rstrip('  a ')", "  a"), ("strip('xxaxx', 'x')", "a"), ("replace('a.b.c', '.', '-')", "a-b-c"),
    ("startswith('abc', 'ab')", True), ("endswith('abc', 'b')", False), ("contains('abc', 'b')", True), ("split(' a  b ')", ["a", "b"]), ("split('')", []), ("split('a.b.', '.')", ["a", "b", ""]), ("split('a\\\\Eb', '\\\\E')", ["a", "b"]),
    ("join('-', ['a', 'b'])", "a-b"), ("to_snake('HTTPResponseCode-x')", "http_response_code_x"), ("to_camel('http_response')", "httpResponse"), ("to_pascal('http_response')", "HttpResponse"),
    ("is_str('a')", True), ("is_int(True)", False), ("is_float(1.0)", True), ("is_bool(1 == 1)", True), ("is_list([1])", True), ("is_str(nothing)", False), ("coalesce(nothing, 'x', 1)", "x"), ("coalesce(nothing, NULL)", None), ("sum(NULL)", None), ("strip(nothing)", None),
])
def test_additional_functions(spark, text, want):
    spec = slots("t", {"v": {"expr": text}})
    one = spark.createDataFrame([(1, None)], "k long, nothing string")
    assert rows(Mapper(spec, extensions=True).transform(one, "t"))[0]["v"] == want
    with pytest.raises(SpecError):
        Mapper(spec).transform(one, "t")


def test_additional_functions_fail_on_null_elements(spark):
    one = spark.createDataFrame([([1, None],)], "l array<long>")
    for text in ("sum(l)", "sorted(l)", "join(',', l)"):
        with pytest.raises(Exception, match="null element"):
            Mapper(slots("t", {"v": {"expr": text}}), extensions=True).transform(one, "t").collect()
    for text in ("sum(1)", "strip(1)", "substr('a')"):
        with pytest.raises(SpecError):
            Mapper(slots("t", {"v": {"expr": text}}), extensions=True).transform(one, "t")


def test_failing_rows_are_collected(spark, tmp_path, capsys):
    schema = {"classes": {"Reading": {"slots": ["id", "raw", "parts"]}}, "slots": {"id": {"range": "integer"}, "raw": {"range": "string"}, "parts": {"range": "integer", "multivalued": True}}}
    spec = slots("Reading", {"id": None, "n": {"expr": "int(raw) + 1"}, "again": {"expr": "int(raw) + 1"}, "next": {"expr": "slot('n') * 2"}, "safe": {"expr": "case((raw == 'x', 0), (True, int(raw)))"}, "low": {"expr": "min(parts)"}})
    data = [(3, "7", [4, 2]), (1, "x", [1]), (2, "5", []), (0, None, [9]), (4, "11", [6])]
    df = spark.createDataFrame(data, "id long, raw string, parts array<long>").repartition(3)
    with pytest.raises(Exception):
        Mapper(spec, schema).transform(df, "Reading").collect()
    mapper = Mapper(spec, schema, on_error="collect")
    good = rows(mapper.transform(df, "Reading"))
    assert [r["id"] for r in good] == [0, 3, 4]
    assert good[1] == {"id": 3, "n": 8, "again": 8, "next": 16, "safe": 7, "low": 2}
    assert rows(mapper.rejected["Reading"]) == [{"id": 1, "raw": "x", "parts": [1]}, {"id": 2, "raw": "5", "parts": []}]
    assert mapper.observed["Reading"].get == {"rejected": 2}
    lazy = Mapper(slots("Reading", {"id": None, "safe": {"expr": "case((raw == 'x', 0), (True, int(raw)))"}}), schema, on_error="collect")
    assert len(rows(lazy.transform(df, "Reading"))) == 5 and lazy.rejected["Reading"].count() == 0
    assert Mapper(spec, schema, on_error="collect", ordered=True).transform(df.limit(0), "Reading").collect() == []
    with pytest.raises(SpecError):
        Mapper(spec, schema, on_error="ignore")
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(dict(zip(("id", "raw", "parts"), r))) for r in data))
    (tmp_path / "t.yaml").write_text(json.dumps(spec))
    (tmp_path / "s.yaml").write_text(json.dumps(schema))
    call = ["map-data", str(tmp_path / "in.jsonl"), "-T", str(tmp_path / "t.yaml"), "-s", str(tmp_path / "s.yaml"), "--source-type", "Reading", "--continue-on-error"]
    for name in ("out.jsonl", "out.json"):
        assert main([*call, "-o", str(tmp_path / name)], spark) == 1
        assert "2 rows of Reading failed" in capsys.readouterr().err
        assert [r["id"] for r in io.read(spark, str(tmp_path / name)).collect()] == [3, 0, 4]
    (tmp_path / "in.jsonl").write_text(json.dumps({"id": 1, "raw": "2", "parts": [3]}))
    assert main([*call, "-o", str(tmp_path / "out.jsonl")], spark) == 0
