"""Forgiving conversions: what can't be converted is NULL, or a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType, TimestampNTZType, TimestampType

from satchel.functions.paths import _c

_WRAP = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def _whole(value: Column | str, of: DataType, to: str, commas: bool = True, flags: bool = True) -> Column:
    """Numbers are cut off and wrap around like machine integers; text must be an integer."""
    c = _c(value)
    if isinstance(of, BooleanType):
        return F.when(c, F.lit(-1)).when(~c, F.lit(0)).cast(to) if flags else F.lit(None).cast(to)
    if isinstance(of, NumericType):
        span = 1 << _WRAP[to]
        wide = c.try_cast("bigint")
        return (F.pmod(wide + F.lit(span // 2), F.lit(span)) - F.lit(span // 2)).cast(to) if to != "bigint" else c.try_cast("bigint")
    if isinstance(of, StringType):
        text = F.trim(_plain(c) if commas else c)
        return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast(to))
    return F.lit(None).cast(to)


def to_integer(value: Column | str, of: DataType) -> Column:
    """True is -1, False 0; thousands separators are dropped."""
    return _whole(value, of, "int")


def to_safe_int(value: Column | str, of: DataType, default: int = 0) -> Column:
    return F.coalesce(_whole(value, of, "int", flags=False), F.lit(default))


def to_long(value: Column | str, of: DataType) -> Column:
    """Times become milliseconds since 1970; booleans are not converted."""
    if isinstance(of, TimestampType | TimestampNTZType):
        return F.unix_millis(_c(value).cast("timestamp"))
    return _whole(value, of, "bigint", flags=False)


def to_safe_long(value: Column | str, of: DataType, default: int = 0) -> Column:
    return F.coalesce(to_long(value, of), F.lit(default).cast("bigint"))


def to_short(value: Column | str, of: DataType) -> Column:
    return _whole(value, of, "smallint", commas=False)


def to_byte(value: Column | str, of: DataType) -> Column:
    return _whole(value, of, "tinyint", commas=False, flags=False)


def to_safe_byte(value: Column | str, of: DataType, default: int = 0) -> Column:
    return F.coalesce(to_byte(value, of), F.lit(default).cast("tinyint"))


def _real(value: Column | str, of: DataType, to: str, flags: bool) -> Column:
    c = _c(value)
    if isinstance(of, BooleanType):
        return F.when(c, F.lit(-1)).when(~c, F.lit(0)).cast(to) if flags else F.lit(None).cast(to)
    if isinstance(of, NumericType):
        return c.try_cast(to)
    return F.trim(_plain(c)).try_cast(to) if isinstance(of, StringType) else F.lit(None).cast(to)


def to_double(value: Column | str, of: DataType) -> Column:
    return _real(value, of, "double", True)


def to_safe_double(value: Column | str, of: DataType, default: float = 0.0) -> Column:
    return F.coalesce(_real(value, of, "double", False), F.lit(float(default)))


def to_float(value: Column | str, of: DataType) -> Column:
    return to_double(value, of).cast("float")


def to_decimal(value: Column | str, of: DataType, scale: int = 2) -> Column:
    return _real(value, of, f"decimal(38,{scale})", True)


def to_safe_decimal(value: Column | str, of: DataType, scale: int = 2) -> Column:
    return F.coalesce(_real(value, of, f"decimal(38,{scale})", False), F.lit(0).cast(f"decimal(38,{scale})"))


def to_big_integer(value: Column | str, of: DataType) -> Column:
    """Text with a fraction is not converted."""
    c = _c(value)
    if isinstance(of, StringType):
        text = F.trim(_plain(c))
        return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return _real(value, of, "decimal(38,0)", True)


def _integer_text(c: Column) -> Column:
    text = F.trim(_plain(c))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def to_boolean(value: Column | str, of: DataType) -> Column:
    """Numbers: not 0 once cut off.  Text: by its first letter t, y, f or n, else an integer that is
    not 0, else False."""
    c = _c(value)
    if isinstance(of, BooleanType):
        return c
    if isinstance(of, NumericType):
        return c.try_cast("int") != 0
    if isinstance(of, StringType):
        first = F.lower(F.left(F.trim(c), F.lit(1)))
        return F.when(c.isNull(), F.lit(None).cast("boolean")).when(first.isin("t", "y"), True).when(first.isin("f", "n"), False).otherwise(F.coalesce(_integer_text(c) != 0, F.lit(False)))
    return F.lit(None).cast("boolean")


def to_safe_boolean(value: Column | str, of: DataType, default: bool | None = False) -> Column:
    """Only the words true and false, else an integer that is not 0, else False; NULL is the default."""
    c = _c(value)
    if isinstance(of, StringType):
        word = F.lower(F.trim(c))
        return F.when(c.isNull(), F.lit(default)).when(word == "true", True).when(word == "false", False).otherwise(F.coalesce(_integer_text(c) != 0, F.lit(False)))
    return F.coalesce(to_boolean(value, of), F.lit(default))


def to_string(value: Column | str) -> Column:
    return _c(value).cast("string")


def to_safe_string(value: Column | str) -> Column:
    return F.coalesce(to_string(value), F.lit(""))


def to_character(value: Column | str, of: DataType) -> Column:
    """The first character, or the one with a number below 256."""
    c = _c(value)
    return F.when((c >= 0) & (c < 256), F.char(c.cast("bigint"))) if isinstance(of, NumericType) else F.left(to_string(c), F.lit(1))


# Date patterns in the order in which they are tried, fixed values.
_DATES = ("MMM dd HH:mm:ss zzz yyyy", "MM/dd/yy", "MM/dd/yyyy", "yyyy-MM-dd", "MMddyy")


def to_date(value: Column | str, of: DataType) -> Column:
    """Times stay, numbers are milliseconds; text is tried by each pattern (a week-day before it is
    dropped), then as milliseconds.  Two-digit years lie up to 20 years ahead."""
    c = _c(value)
    if isinstance(of, TimestampType | TimestampNTZType):
        return c.cast("timestamp")
    if isinstance(of, NumericType):
        return F.timestamp_millis(c.try_cast("bigint"))
    if not isinstance(of, StringType):
        return F.lit(None).cast("timestamp")
    text = F.trim(F.regexp_replace(c, "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ", ""))
    shape = {"MM/dd/yy": "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "MMddyy": "^[0-9]{6}$"}

    def one(pattern: str) -> Column:
        t = F.try_to_timestamp(text, F.lit(pattern))
        if pattern not in shape:
            return t
        late = F.year(t) > F.year(F.current_date()) + 20
        return F.when(text.rlike(shape[pattern]), F.when(late, t - F.expr("interval 100 years")).otherwise(t))

    millis = F.when(text.rlike("^[0-9]+$"), F.timestamp_millis(text.try_cast("bigint")))
    return F.coalesce(*(one(p) for p in _DATES), millis)


def to_timestamp(value: Column | str, of: DataType) -> Column:
    return F.timestamp_millis(to_long(value, of))


#: The code of each type that has one; every other type, decimals too, is 0.
TYPE_CODES = {
    "string": 1,
    "int": 2,
    "tinyint": 3,
    "boolean": 4,
    "bigint": 5,
    "double": 7,
    "float": 8,
    "smallint": 9,
    "date": 12,
    "timestamp": 12,
    "timestamp_ntz": 12,
}


def type_code(value: Column | str) -> Column:
    """The code of the column's type.  Characters (6) and time zones (13) are no types of Spark."""
    kind, code = F.typeof(_c(value)), F.lit(0)
    for name, number in TYPE_CODES.items():
        code = F.when(kind == name, number).otherwise(code)
    return code


def to_list(value: Column | str, of: DataType) -> Column:
    c = _c(value)
    return c if of.typeName() == "array" else F.when(c.isNotNull(), F.array(c))


def to_map(*pairs: Column) -> Column:
    return F.create_map(*pairs)


def format_money(value: Column | str) -> Column:
    return F.call_function("format_number", _c(value), F.lit("###,###,###.00"))


def format_plain(value: Column | str) -> Column:
    """Three decimals and no separators."""
    return F.call_function("format_number", _c(value), F.lit("##########.000"))
