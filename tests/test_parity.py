"""Expected counts on the item fixture, and order."""

import pytest

import satchel as s
from satchel import Direction, Query
from tests.fixtures import frame

PERSON, POSSE = s.eq("type", "Person"), s.eq("type", "Posse")
BETWEEN = s.and_(s.gt("profession", "carpenter"), s.lt("profession", "politician"))
COUNTS = [
    (PERSON, 5),
    (PERSON & s.eq("profession", "lawyer"), 1),
    (PERSON & s.eq("profession", "politician"), 2),
    (PERSON & s.gt("profession", "lawyer"), 3),
    (s.lt("profession", "lawyer"), 1),
    (PERSON & s.lt("profession", "lawyer"), 1),
    (BETWEEN, 2),
    (PERSON & BETWEEN, 2),
    (s.eq("profession", "politician"), 2),
    (s.ne("profession", "politician"), 3),
    (s.or_(s.eq("profession", "carpenter"), s.eq("profession", "politician")), 3),
    (s.gt("profession", "carpenter"), 4),
    (s.lt("profession", "politician"), 3),
    (s.or_(BETWEEN, s.eq("profession", "carpenter")), 3),
    (PERSON & s.or_(BETWEEN, s.eq("profession", "carpenter")), 3),
    (POSSE & s.eq("members", "Hitler"), 2),
    (POSSE & s.eq("members", "Hitler") & s.eq("members", "Churchill"), 1),
    (POSSE & s.any_("members", "Hitler", "Churchill"), 3),
    (POSSE & s.all_("members", "Hitler", "Churchill"), 1),
    (POSSE & s.none("members", "Hitler"), 1),
    (s.is_null("profession"), 4),
    (s.not_null("profession"), 5),
    (s.all_("members", "Hitler", "nobody"), 0),
    (s.any_("members"), 0),
    (s.all_("members"), 0),
    (s.id_("Jesus"), 1),
    (s.kind("Item"), 9),
]


@pytest.mark.parametrize(("predicate", "n"), COUNTS, ids=lambda x: str(x))
def test_counts(spark, predicate, n):
    assert Query().where(predicate).prepare(frame(spark)).count() == n


def test_no_filter_is_everything(spark):
    assert Query().prepare(frame(spark)).count() == 9


@pytest.mark.parametrize("name", ["profession", "salary", "married"])
@pytest.mark.parametrize("direction", list(Direction))
def test_sort(spark, name, direction):
    rows = [r[name] for r in Query().where(PERSON).order_by(name, direction).prepare(frame(spark)).list()]
    assert rows == sorted(rows, reverse=direction is Direction.DESCENDING)


def test_null_is_the_smallest(spark):
    q = Query().order_by("salary")
    assert q.prepare(frame(spark)).item()["salary"] is None
    assert Query().order_by("salary", Direction.DESCENDING).prepare(frame(spark)).list()[-1]["salary"] is None


def test_terminals(spark):
    q = Query().where(PERSON & s.eq("profession", "lawyer")).prepare(frame(spark))
    assert q.item()["__ID__"] == "Gandhi"
    assert [r["__ID__"] for r in q.identifiers().collect()] == ["Gandhi"] == [r["__ID__"] for r in q.iterate()]
    assert Query().where(s.id_("nobody")).prepare(frame(spark)).item() is None


def test_builder():
    q = Query().where(PERSON)
    more = q.add_filter("salary", s.operators.predicates.Op.GREATER, 1.0)
    assert q.filter_predicates() == (PERSON,) and len(more.filter_predicates()) == 2
    assert more.where(POSSE).filter_predicates() == (POSSE,)
    assert s.and_(PERSON) is PERSON and str(PERSON) == "type = 'Person'"


@pytest.mark.parametrize("make", [lambda: s.and_(), lambda: s.or_(), lambda: s.eq("", 1), lambda: s.eq("a", None)])
def test_wrong_arguments(make):
    with pytest.raises((ValueError, IndexError)):
        make()


def test_unknown_property(spark):
    with pytest.raises(s.UnknownPropertyError):
        Query().where(s.eq("nothing", 1)).prepare(frame(spark)).df()
    with pytest.raises(s.UnknownPropertyError):
        Query().order_by("nothing").prepare(frame(spark)).df()


def test_elements_may_differ(spark):
    df = spark.createDataFrame([("a", [1, 9]), ("b", [4]), ("c", [1, None]), ("d", None)], "__ID__ string, p array<int>")
    ids = lambda p: [r[0] for r in Query().where(p).prepare(df).identifiers().collect()]
    assert ids(s.gt("p", 3) & s.lt("p", 5)) == ["a", "b"]
    assert ids(s.ne("p", 1)) == ["a", "b"]


def test_pushdown(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "x"))
    plan = Query().where(PERSON & s.gt("salary", 1.0)).prepare(spark.read.parquet(str(tmp_path / "x"))).identifiers()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(type), IsNotNull(salary), EqualTo(type,Person), GreaterThan(salary,1.0)]" in plan
    assert "ReadSchema: struct<__ID__:string,type:string,salary:double>" in plan
