import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, TimestampType

from satchel.functions import convert as c
from satchel.functions import numbers, paths, strings

# fixed values: number text and its code, in ascending order
CODES = [
    ("-100.5", "**6899:4?"),
    ("-10.5", "**789:4?"),
    ("-3.145", "*6:854?"),
    ("-3.14", "*6:85?"),
    ("-1.01", "*8:98?"),
    ("-1", "*8?"),
    ("-0.0001233", "*9:9998766?"),
    ("-0.000123", "*9:999876?"),
    ("0", "?0*"),
    ("0.000123", "?0.000123*"),
    ("0.0001233", "?0.0001233*"),
    ("1", "?1*"),
    ("1.01", "?1.01*"),
    ("3.14", "?3.14*"),
    ("3.145", "?3.145*"),
    ("10.5", "??210.5*"),
    ("100.5", "??3100.5*"),
]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


def test_number_codes(spark):
    df = spark.createDataFrame(CODES, "plain string, code string")
    rows = df.select("plain", "code", numbers.encode("plain").alias("e"), numbers.decode("code").alias("d")).collect()
    assert all(r.e == r.code and r.d == r.plain for r in rows)
    assert [x for _, x in CODES] == sorted(x for _, x in CODES)
    assert one(spark, "", numbers.encode("v")) == "" and one(spark, None, numbers.encode("v")) is None
    assert one(spark, "??210.5*", numbers.decode_decimal("v", 2)) == Decimal("10.50")


def test_number_order(spark):
    rng = random.Random(3)
    plain = [f"{rng.choice(['', '-'])}{rng.randint(0, 10 ** rng.randint(1, 20))}.{rng.randint(0, 999):03d}1" for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in plain], "p string").select("p", numbers.encode("p").alias("e"), numbers.decode(numbers.encode("p")).alias("d")).collect()
    assert all(r.d == r.p for r in rows)
    by_code = [Decimal(r.p) for r in sorted(rows, key=lambda r: r.e)]
    assert by_code == sorted(by_code)


def test_number_refused(spark):
    with pytest.raises(Exception, match="not a plain decimal"):
        one(spark, "1e5", numbers.encode("v"))


def test_whole_numbers(spark):
    s, b, d = StringType(), BooleanType(), DoubleType()
    assert one(spark, "1,234", c.to_integer("v", s)) == 1234 and one(spark, "x", c.to_integer("v", s)) is None
    assert one(spark, True, c.to_integer("v", b), "boolean") == -1 and one(spark, -2.9, c.to_integer("v", d), "double") == -2
    assert one(spark, 300, c.to_byte("v", LongType()), "long") == 44 and one(spark, "1,0", c.to_short("v", s)) is None
    assert one(spark, "x", c.to_safe_int("v", s, 5)) == 5 and one(spark, dt.datetime(1970, 1, 1, 0, 0, 1), c.to_long("v", TimestampType()), "timestamp") == 1000
    assert one(spark, "7.5", c.to_big_integer("v", s)) is None and one(spark, "1,5", c.to_decimal("v", s)) == Decimal("15.00")
    assert one(spark, "", c.to_safe_decimal("v", s)) == Decimal("0.00")


def test_booleans(spark):
    s = StringType()
    assert [one(spark, v, c.to_boolean("v", s)) for v in ("yes", "True", "no", "7", "0", "?", None)] == [True, True, False, True, False, False, None]
    assert [one(spark, v, c.to_safe_boolean("v", s, True)) for v in ("yes", "true", "7", None)] == [False, True, True, True]


def test_dates(spark):
    s = StringType()
    day = lambda v: one(spark, v, c.to_date("v", s).cast("string"))
    assert day("12/31/1999") == "1999-12-31 00:00:00" and day("12/31/99") == "1999-12-31 00:00:00"
    assert day("2001-02-03") == "2001-02-03 00:00:00" and day("020301") == "2001-02-03 00:00:00"
    assert day("Sat Feb 03 04:05:06 UTC 2001") == "2001-02-03 04:05:06"
    assert day("1000") == "1970-01-01 00:00:01" and day("soon") is None and day(None) is None


def test_strings(spark):
    assert one(spark, "a.b.c", strings.replace_all("v", ".", "$1")) == "a$1b$1c" and one(spark, "x", strings.replace_all("v", "", "y")) == "x"
    for text, pattern, hit in [("hello", "h*o", True), ("hello", "h?llo", True), ("hello", "[a-h]ello", True), ("hello", "[^a-h]ello", False), ("a*b", r"a\*b", True), ("axb", r"a\*b", False), ("hello\n", "hello", False), ("a.c", "a.c", True), ("abc", "a.c", False)]:
        assert one(spark, text, strings.wildmat("v", pattern)) is hit, (text, pattern)
    assert one(spark, "HELLO", strings.wildmat("v", "h*", True)) and one(spark, "hello", strings.starts_with_wild("v", "h?l"))
    for text, pattern, want in [
        ("/kjh/kllkjh/x.jsp", "*.jsp", (True, 17, 4, 0)),
        ("/kjh/kllkjh/x.jsp", "/kjh/*.jsp", (True, 17, 9, 5)),
        ("hello", "h*l", (False, -1, -1, 0)),
        ("hello", "hel", (True, 3, 3, 3)),
        ("hello", "*", (True, 5, 0, 0)),
        (".x", "[.*]x", (True, 2, 2, 2)),
        ("?x", "[.*]x", (False, -1, -1, 0)),
        ("h", "h**", (True, 1, 1, 1)),
        ("h", "hello", (False, -1, -1, 0)),
    ]:
        assert tuple(one(spark, text, strings.wild_start("v", pattern))) == want, (text, pattern)
    assert one(spark, "abcdefgh ij", strings.break_large_words("v", " ", "-", 3)) == "abc-def-gh ij" and one(spark, "abcdef", strings.break_large_words("v", " ", "-", 3)) == "abc-def"
    assert one(spark, "abc", strings.prepad("v", 2, "0")) == "abc" and one(spark, None, strings.prepad("v", 2, "0")) == "00" and one(spark, "a", strings.pad("v", 3, ".")) == "a.."
    assert one(spark, "one two", strings.last_word_break("v", " ", 6)) == 4 and one(spark, "one", strings.last_word_break("v", " ", 9)) == -1
    assert one(spark, " \t", strings.is_blank("v")) and one(spark, None, strings.is_blank("v")) and not one(spark, "a", strings.is_blank("v"))
    assert one(spark, "http://h/p?a=1&b=x%20y", strings.query_components("v")) == {"a": "1", "b": "x y"}
    with pytest.raises(ValueError):
        strings.wild_to_regex("[ab")


def test_paths(spark):
    assert one(spark, "//a/b/", paths.normalise("v")) == "a/b" and one(spark, "a/b", paths.parent("v")) == "a" and one(spark, "a", paths.parent("v")) is None
    assert one(spark, "a/b/c", paths.ancestors("v")) == ["a", "a/b"] and one(spark, "a", paths.ancestors("v")) == []
    assert one(spark, "x/store-12", paths.revision_number("v")) == 12 and one(spark, "x/store", paths.revision_number("v")) == -1
    df = spark.createDataFrame([(p,) for p in ("b/a", "a/b/c", "a/c", "z", "a", "a/b/a", "a/b")], "v string")
    assert [r.v for r in df.orderBy(*paths.order_key(F.col("v"))).collect()] == ["a", "z", "a/b", "a/c", "a/b/a", "a/b/c", "b/a"]
