import pytest
from pyspark.sql import functions as F

from satchel.operators import hierarchy, items
from satchel.sources.tables import list_objects, read_items, write_items


def test_union_and_presence(spark):
    a = items.items_of(spark.createDataFrame([(1, "x")], "k int, name string"), "a", F.concat(F.lit("a/"), F.col("k")))
    b = items.items_of(spark.createDataFrame([(1, None)], "k int, size int"), "b", F.concat(F.lit("b/"), F.col("k")), unindexed=["size"])
    both = items.union_items(a, b)
    assert [r[0] for r in both.filter(items.has_property("size")).select("__ID__").collect()] == ["b/1"]
    assert both.filter(items.is_indexed("size")).count() == 0
    changed = items.set_property(items.remove_property(both, "name"), "flag", F.lit(True), indexed=False)
    assert changed.filter(items.has_property("name")).count() == 0 and changed.filter(items.has_property("flag")).count() == 2
    wrong = items.items_of(spark.createDataFrame([("1", "x")], "k string, name string"), "c", F.col("k"))
    with pytest.raises(TypeError):
        items.union_items(a, wrong)


def test_reference_join(spark):
    parents = spark.createDataFrame([("p", ["c", "d"]), ("q", ["e"]), ("r", None)], "__ID__ string, members array<string>")

    got = items.reference_join(parents, "members", spark.createDataFrame([("c",), ("d",)], "__ID__ string")).select("__ID__").collect()
    assert [r[0] for r in got] == ["p"]


def test_hierarchy(spark):
    df = spark.createDataFrame([(p,) for p in ("a", "a/b", "a/b/c", "a/d", "ab", "ab/x")], "__ID__ string")
    ids = lambda x: sorted(r["__ID__"] for r in x.collect())
    assert ids(hierarchy.list_children(df, "/a/")) == ["a/b", "a/d"] and ids(hierarchy.fetch_descendants(df, "a")) == ["a/b", "a/b/c", "a/d"]
    assert ids(hierarchy.fetch_ancestors(df, "a/b/zz")) == ["a", "a/b"] and ids(hierarchy.delete_children(df, "a")) == ["a", "a/b/c", "ab", "ab/x"]
    many = {r.path: r.children for r in hierarchy.list_children_of(df, ["a", "zz"]).collect()}
    assert many == {"a": ["a/b", "a/d"], "zz": []}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "k1"), ("b", "k2")], "__ID__ string, __KIND__ string")
    write_items(df, str(tmp_path / "items"))
    assert read_items(spark, str(tmp_path / "items")).filter("__KIND__ = 'k1'").count() == 1
    assert list_objects(spark, str(tmp_path / "items"), 1).count() == 1
