import json

import pytest
from pyspark.sql import functions as F

from framelake.functions import schema as s
from framelake.functions.schema import DataType, Schema, layout_table, width_expr


def names(declaration):
    return [f.name for f in Schema.from_json("t", declaration).fields]


def test_nested_names_are_flattened_in_key_order():
    assert names({"where": {"lon": "Float", "lat": "Float", "site": {"code": "String 8"}}, "at": "Int"}) == ["at", "where.lat", "where.lon", "where.site.code"]


def test_each_level_is_ordered_by_itself():
    assert names({"a-b": "Int", "a": {"z": "Int"}}) == ["a.z", "a-b"]
    assert names({"é": "Int", "z": "Int", "Z": "Int"}) == ["Z", "z", "é"]


@pytest.mark.parametrize(("kind", "size", "plain", "nullable"), [("Int", 8, 8, 9), ("Float", 8, 8, 9), ("Bool", 1, 1, 2), ("String 7", 7, 12, 12), ("Blob 900", 900, 905, 905)])
def test_sizes_and_widths(kind, size, plain, nullable):
    """Content, and what lies on disk: a flag where there may be nulls, flag and length before content of any size."""
    word, *rest = kind.split()
    for text, width, null in ((kind, plain, False), (" ".join([f"{word}?", *rest]), nullable, True)):
        (f,) = Schema.from_json("t", {"x": text}).fields
        assert (f.type.size, f.width, f.type.nullable) == (size, width, null)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("String", s.MissingSize), ("String?", s.MissingSize), ("String 0", s.InvalidSize), ("Int 64", s.UnexpectedSize), ("Float 32", s.UnexpectedSize), ("Bool 1", s.UnexpectedSize), ("TimeStamp", s.UnknownType), ("Int ?", s.UnexpectedSize),
        ("Int??", s.UnknownType), ("?", s.UnknownType), ("", s.UnknownType), ("String -5", s.InvalidSize), ("String x", s.InvalidSize), ("String 5 6", s.InvalidSize), ("String 50?", s.InvalidSize), ("String 4294967296", s.InvalidSize), ("String ٣", s.InvalidSize), ("String ++5", s.InvalidSize),
    ],
)
def test_rejected_declarations(text, error):
    with pytest.raises(error):
        DataType.parse(text)


@pytest.mark.parametrize(("text", "size", "nullable"), [("Int", 8, False), ("int", 8, False), ("INT?", 8, True), ("String? 50", 50, True), ("String +5", 5, False), ("blob 4294967295", 2**32 - 1, False)])
def test_accepted_declarations(text, size, nullable):
    t = DataType.parse(text)
    assert (t.size, t.nullable) == (size, nullable)


def test_offsets_run_over_the_whole_list():
    """Nested fields and those beside them never overlap, however deep."""
    for tree in ({"b": "Blob 3", "a": "Float", "c": "Bool?"}, {"m": {"x": "Int?", "k": {"z": "String 2", "y": "Bool"}}, "n": "Int", "l": {"w": "Float"}}):
        fields = Schema.from_json("t", tree).fields
        assert [f.offset for f in fields] == [sum(g.width for g in fields[:i]) for i in range(len(fields))]


@pytest.mark.parametrize("bad", ["[1]", '"Int"', '{"a": 1}', '{"a": {"b": null}}'])
def test_not_an_object(bad):
    with pytest.raises(s.NotAnObject):
        Schema.from_json("t", bad)


def test_names():
    assert len(s.encode_name("")) == len(s.encode_name("é" * 32)) == 64
    for name, declaration in (("é" * 33, {}), ("t", {"a" * 32: {"b" * 32: "Int"}})):
        with pytest.raises(s.NameTooLong):
            Schema.from_json(name, declaration)
    assert Schema.from_json("t", {"a": {}}).fields == ()
    with pytest.raises(s.DuplicateName):
        Schema.from_json("t", {"a.b": "Int", "a": {"b": "Int"}})


def test_too_wide_a_record_is_rejected():
    with pytest.raises(s.InvalidSize):
        Schema.from_json("t", {"a": "Blob 4294967295", "b": "Int"})


def test_columns(spark):
    sch = Schema.from_json("t", json.dumps({"name": {"first": "String 2", "last": "String? 4"}, "id": "Int"}))
    df = spark.createDataFrame([(1, "Ω", None), (None, "abc", "abcde"), (2, "ab", "")], "id long, `name.first` string, `name.last` string")
    got = [sorted(r[0]) for r in df.select(sch.violations()).collect()]
    assert got == [[], ["id", "name.first", "name.last"], []]
    assert sch.nested(df).select("name.last").collect()[1][0] == "abcde"
    assert sch.struct()["name.first"].metadata == {"offset": 8, "size": 2, "width": 7}
    table = layout_table(spark, [sch])
    assert table.where(width_expr(F.col("type"), F.col("size"), F.col("nullable")) != F.col("width")).count() == 0
