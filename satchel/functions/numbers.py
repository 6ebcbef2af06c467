"""Decimal text as strings whose byte order is numeric order, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.functions.paths import _c

NUMBER = r"^-?[0-9]+([.][0-9]+)?$"
# fixed values: each digit's complement, and the marks of the code
_DIGITS, _COMPLEMENT = "0123456789", "9876543210"


def encode(value: Column | str) -> Column:
    """NULL stays NULL, '' stays ''; anything else that is no plain decimal raises.

    The length of the integer part stands before it, so longer numbers sort later; negative numbers
    have their digits complemented.
    """
    v = _c(value)
    negative = F.startswith(v, F.lit("-"))
    whole = F.regexp_extract(v, "^-?([0-9]+)", 1)
    fraction = F.regexp_extract(v, "[.]([0-9]+)$", 1)
    n = F.length(whole)
    count = F.when(n == 1, "").when(n < 10, n.cast("string")).otherwise(F.concat(F.length(n.cast("string")).cast("string"), n.cast("string")))
    marks = F.when(n == 1, 1).when(n < 10, 2).otherwise(3)
    turned = lambda c: F.translate(c, _DIGITS, _COMPLEMENT)
    has = F.length(fraction) > 0
    up = F.concat(F.repeat(F.lit("?"), marks), count, whole, F.when(has, F.concat(F.lit("."), fraction)).otherwise(""), F.lit("*"))
    down = F.concat(F.repeat(F.lit("*"), marks), turned(F.concat(count, whole)), F.when(has, F.concat(F.lit(":"), turned(fraction))).otherwise(""), F.lit("?"))
    wrong = F.raise_error(F.concat(F.lit("not a plain decimal: "), v)).cast("string")
    return F.when(v.isNull() | (v == ""), v).when(~v.rlike(NUMBER), wrong).when(negative, down).otherwise(up)


def decode(code: Column | str) -> Column:
    """The text that was encoded."""
    c = _c(code)
    negative = F.startswith(c, F.lit("*"))
    body = F.regexp_extract(c, r"^[*?]+(.*)[*?]$", 1)
    plain = F.when(negative, F.translate(F.regexp_replace(body, ":", "."), _DIGITS, _COMPLEMENT)).otherwise(body)
    marks = F.length(F.regexp_extract(c, r"^([*?]+)", 1))
    # one mark: no length; two: one digit of length; three: a digit that says how many the length has
    skip = F.when(marks == 1, 0).when(marks == 2, 1).otherwise(1 + F.substring(plain, 1, 1).try_cast("int"))
    digits = F.substr(plain, skip + 1)
    return F.when(c.isNull() | (c == ""), c).otherwise(F.concat(F.when(negative, "-").otherwise(""), digits))


def decode_decimal(code: Column | str, scale: int = 10) -> Column:
    return decode(code).try_cast(f"decimal(38,{scale})")
