"""Random filter trees against a plain evaluation."""

import random

import satchel as s
from satchel.operators.predicates import Op, Quantifier
from satchel.operators.query import Query

_TEST = {
    Op.EQUAL: lambda a, b: a == b,
    Op.NOT_EQUAL: lambda a, b: a != b,
    Op.GREATER: lambda a, b: a > b,
    Op.GREATER_OR_EQUAL: lambda a, b: a >= b,
    Op.LESS: lambda a, b: a < b,
    Op.LESS_OR_EQUAL: lambda a, b: a <= b,
}


def holds(p, row):
    if p.op in (Op.AND, Op.OR):
        return (all if p.op is Op.AND else any)(holds(c, row) for c in p.clauses)
    value = row[p.property]
    if p.op in (Op.IS_NULL, Op.NOT_NULL):
        return (value is None) == (p.op is Op.IS_NULL)
    have = [] if value is None else value if isinstance(value, list) else [value]
    if not p.values.values or value is None:
        return False
    values = p.values.values if p.op in (Op.EQUAL, Op.NOT_EQUAL) else p.values.values[:1]
    some = [any(_TEST[p.op](h, v) for h in have) for v in values]
    return all(some) if p.values.quantifier is Quantifier.ALL else any(some)


def tree(rng, depth):
    if depth and rng.random() < 0.6:
        return (s.and_ if rng.random() < 0.5 else s.or_)(*(tree(rng, depth - 1) for _ in range(rng.randint(1, 3))))
    name, v = rng.choice("ab"), rng.randint(0, 4)
    more = [rng.randint(0, 4) for _ in range(rng.randint(0, 3))]
    return rng.choice([s.eq, s.ne, s.gt, s.ge, s.lt, s.le])(name, v) if rng.random() < 0.5 else rng.choice([lambda: s.any_(name, *more), lambda: s.all_(name, *more), lambda: s.xor(name, *more), lambda: s.is_null(name), lambda: s.not_null(name)])()


def test_random_trees(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, [], [1], [2, 3], [0, 4], [1, 2, 3]])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a int, b array<int>").cache()
    for _ in range(25):
        p = tree(rng, 3)
        got = {r.i for r in Query().where(p).prepare(df).df().collect()}
        assert got == {i for i, a, b in rows if holds(p, {"a": a, "b": b})}, str(p)
