"""String helpers as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.functions.paths import _c


def replace_all(s: Column | str, old: str, new: str) -> Column:
    """Literal replacement; an empty ``old`` changes nothing."""
    return F.replace(_c(s), F.lit(old), F.lit(new)) if old else _c(s)


def _wild_parts(pattern: str) -> list[str | None]:
    """The pattern in regular expressions of one character each; None stands for a star."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(None)
        elif c == "?":
            out.append(".")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                raise ValueError("a pattern can't end in a backslash")
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                raise ValueError("a character class is not closed")
            body = pattern[i + 1 : end]
            sign, body = ("^", body[1:]) if body.startswith("^") else ("", body)
            out.append(f"[{sign}{re.sub(r'([\\[\\]&~^])', r'\\\1', body)}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return out


def wild_to_regex(pattern: str) -> str:
    """A glob of ``*``, ``?``, ``[a-z]``, ``[^..]`` and backslash escapes as a regular expression."""
    return "".join(".*" if p is None else p for p in _wild_parts(pattern))


def wildmat(s: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    return _c(s).rlike(("(?is)" if ignore_case else "(?s)") + f"^(?:{wild_to_regex(pattern)})\\z")


def starts_with_wild(s: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    return _c(s).rlike(("(?is)" if ignore_case else "(?s)") + f"^(?:{wild_to_regex(pattern)})")


def wild_start(s: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Struct of found, last_matched, exactly_matched and last_consecutive.

    A pattern without stars has to match a prefix, and the numbers are its length.  With stars it has to
    match the whole text: last_matched is the text's length, exactly_matched the characters that no star
    stands for, last_consecutive those before the first star.  A miss is (false, -1, -1, 0).
    """
    parts = _wild_parts(pattern)
    fixed = len(parts) - parts.count(None)
    starred = None in parts
    lead = parts.index(None) if starred else fixed
    found = F.coalesce(wildmat(s, pattern, ignore_case) if starred else starts_with_wild(s, pattern, ignore_case), F.lit(False))
    number = lambda value, miss: F.when(found, value).otherwise(miss).cast("int")
    return F.struct(
        found.alias("found"),
        number(F.length(_c(s)) if starred else F.lit(fixed), -1).alias("last_matched"),
        number(F.lit(fixed), -1).alias("exactly_matched"),
        number(F.lit(lead), 0).alias("last_consecutive"),
    )


def break_large_words(s: Column | str, delimiters: str, separator: str, most: int) -> Column:
    """Inserts ``separator`` after every ``most`` characters of a longer word."""
    inside = f"[^{re.escape(delimiters)}]"
    return F.regexp_replace(_c(s), f"({inside}{{{most}}})(?={inside})", "$1" + re.sub(r"([\\$])", r"\\\1", separator))


def prepad(s: Column | str, size: int, pad: str = " ") -> Column:
    """Pads on the left; longer strings stay whole; NULL counts as ''."""
    v = F.coalesce(_c(s), F.lit(""))
    return F.when(F.length(v) >= size, v).otherwise(F.lpad(v, size, pad))


def pad(s: Column | str, size: int, pad: str = " ") -> Column:
    v = F.coalesce(_c(s), F.lit(""))
    return F.when(F.length(v) >= size, v).otherwise(F.rpad(v, size, pad))


def tail(s: Column | str, n: int) -> Column:
    return F.right(_c(s), F.lit(n))


def head(s: Column | str, n: int) -> Column:
    return F.left(_c(s), F.lit(n))


def last_word_break(s: Column | str, delimiters: str, end: int) -> Column:
    """Place after the last delimiter before ``end``, -1 if there is none."""
    n = F.length(F.regexp_extract(F.left(_c(s), F.lit(end)), f"(?s)^(.*[{re.escape(delimiters)}])", 1))
    return F.when(n == 0, -1).otherwise(n)


def is_blank(s: Column | str) -> Column:
    """NULL, or characters up to U+0020 only."""
    return F.coalesce(F.regexp_replace(_c(s), "[\\x00-\\x20]+", "") == "", F.lit(True))


def is_not_blank(s: Column | str) -> Column:
    return ~is_blank(s)


def query_components(url: Column | str) -> Column:
    """Map of a URL's query parameters, decoded; NULL without a query."""
    pairs = F.str_to_map(F.regexp_extract(_c(url), r"^[^?#]*[?]([^#]*)", 1), F.lit("&"), F.lit("="))
    return F.when(_c(url).contains("?"), F.transform_values(pairs, lambda k, v: F.try_url_decode(v)))
