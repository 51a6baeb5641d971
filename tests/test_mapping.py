"""Field mapping: the row-driven and the compiled form must agree."""

import json

import pytest
from pyspark.sql import functions as F

from changesync.functions.transforms import Transforms
from changesync.operators import mapping
from changesync.schema import FIELD_MAP
from changesync.sources.maps import parse_maps


def document(fields, **more):
    return json.dumps({"name": "m", "sourceSystem": "s", "sourceEntity": "e", "targetSystem": "t", "targetEntity": "f",
                       "integrationKey": ["no"], "fields": fields, **more})


def run(spark, fields, data, transforms=None):
    """(mapped, error) of both forms, asserted equal."""
    transforms = transforms or Transforms()
    maps = parse_maps(spark.createDataFrame([(document(fields),)], "document STRING")).withColumn("map_name", F.col("name"))
    one = maps.first()
    rows = spark.createDataFrame([("m", data)], "map_name STRING, data MAP<STRING,STRING>")
    with_fields = rows.join(maps.select("map_name", "fields"), "map_name")
    slow = mapping.map_fields(with_fields, transforms=transforms).first()
    compiled = mapping.CompiledMaps.load(maps, transforms)
    if compiled is not None:
        fast = compiled.map_fields(rows).first()
        assert (fast["mapped"], fast["map_error"]) == (slow["mapped"], slow["map_error"]), one
    return slow["mapped"], slow["map_error"]


def f(source, target, **more):
    return {"source": source, "target": target, **more}


@pytest.mark.parametrize("fields, data, want", [
    ([f("a", "x")], {"a": "1"}, {"x": "1"}),
    ([f("a", "x")], {}, {}),
    ([f("a", "x", defaultValue="d")], {}, {"x": '"d"'}),
    ([f("a", "x", defaultValue=7)], {"a": "null"}, {"x": "null"}),
    ([f("a", "x", defaultValue=None)], {}, {}),
    ([f("A", "x")], {"a": "1"}, {}),
    ([f("a", "x", valueMap={"1": "one"})], {"a": "1"}, {"x": '"one"'}),
    ([f("a", "x", valueMap={"1": "one"})], {"a": '"1"'}, {"x": '"one"'}),
    ([f("a", "x", valueMap={"True": 'y"es'})], {"a": "true"}, {"x": '"y\\"es"'}),
    ([f("a", "x", valueMap={"1": "one"}, defaultValue="other")], {"a": "2"}, {"x": '"other"'}),
    ([f("a", "x", valueMap={"1": "one"})], {"a": "null"}, {"x": "null"}),
    ([f("a", "x", valueMap={"1": " One "}, transform="TRIM")], {"a": "1"}, {"x": '"One"'}),
    ([f("a", "x", transform="trim", defaultValue=" d ")], {}, {"x": '" d "'}),
    ([f("a", "x", transform="toUpper")], {"a": "12"}, {"x": "12"}),
    ([f("a", "x", transform="toLower")], {"a": '"Ä\\tB\\"\\u0041"'}, {"x": '"ä\\tb\\"a"'}),
    ([f("a", "x", transform="trim")], {"a": '"\\t x \\n"'}, {"x": '"x"'}),
    ([f("a", "x"), f("b", "x")], {"a": "1", "b": "2"}, {"x": "2"}),
    ([f("a", "x"), f("b", "x")], {"a": "1"}, {"x": "1"}),
    ([f("a", "x", transform="nope")], {}, {}),
])
def test_values(spark, fields, data, want):
    assert run(spark, fields, data) == (want, None)


@pytest.mark.parametrize("fields, data, word", [
    ([f("a", "x", valueMap={"1": "one"})], {"a": "2"}, "no translation"),
    ([f("a", "x", transform="nope")], {"a": "2"}, "not registered"),
    ([f("a", "x", transform="nope")], {"a": "null"}, "not registered"),
    ([f("b", "y"), f("a", "x", valueMap={}), f("c", "z", transform="nope")], {"a": "2", "b": "1", "c": "3"}, "no translation"),
])
def test_errors(spark, fields, data, word):
    mapped, error = run(spark, fields, data)
    assert mapped is None and word in error


def test_own_transforms(spark):
    t = Transforms()
    t.register("Bang", lambda v: F.concat(F.lit('"'), v, F.lit('!"')))
    assert "Bang" in t.names
    assert run(spark, [f("a", "x", transform="BANG")], {"a": "1"}, t) == ({"x": '"1!"'}, None)
    t.register_python("bang", lambda v: json.dumps(json.loads(v) * 2))
    fields = [f("a", "x", transform="bang"), f("b", "y"), f("c", "z", transform="bang")]
    assert run(spark, fields, {"a": "4", "b": "5", "c": "6"}, t) == ({"x": "8", "y": "5", "z": "12"}, None)


def test_both_forms_agree_on_nulls_and_control_characters(spark):
    translations = {"1": None, "2": "a\u001fb\n", "3": "x"}
    field = [("a", "t", None, translations, None), ("a", "u", None, translations, '"d"')]
    row = spark.createDataFrame([("m", f, {"a": v}, ["k"]) for f in (field[:1], field) for v in ("1", "2", "3", "4", "null")],
                                f"map_name STRING, fields ARRAY<{FIELD_MAP}>, data MAP<STRING,STRING>, integration_key ARRAY<STRING>")
    for width in (1, 2):
        part = row.filter(F.size("fields") == width)
        compiled = mapping.CompiledMaps.load(part.limit(1), Transforms())
        by_row = sorted(map(str, mapping.map_fields(part).select("data", "mapped", "map_error").collect()))
        by_plan = sorted(map(str, compiled.map_fields(part).select("data", "mapped", "map_error").collect()))
        assert by_row == by_plan
    written = {r["data"]["a"]: r["mapped"] for r in mapping.map_fields(row.filter(F.size("fields") == 1)).collect()}
    assert written == {"1": {"t": "null"}, "2": {"t": '"a\\u001Fb\\n"'}, "3": {"t": '"x"'}, "4": None, "null": {"t": "null"}}
