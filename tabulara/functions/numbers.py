"""The lenient integer rule of the source files.

A text is missing when blank; readable when it is a whole number in the grammar of Python's int (sign, underscores between digits, digits of any
script) or a float notation whose value is integral (12.0, 1e3); anything else, with fractions, nan and inf, is unreadable. Whole numbers from int notation
are exact at any length up to 4300 digits; those from float notation are the value of the IEEE double.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulara.functions.text import trimmed

#: Decimal digits of all scripts beyond ASCII, and what they stand for; made from the Unicode tables.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)

_RUN = "[0-9]+(?:_[0-9]+)*"
SHORT_INT = "^[+-]?[0-9]{1,18}$"
LONG_INT = f"^[+-]?{_RUN}$"
FLOAT = f"^[+-]?(?:{_RUN}(?:\\.(?:{_RUN})?)?|\\.{_RUN})(?:[eE][+-]?{_RUN})?$"
LONG_MAX = (1 << 63) - 1


def number_key(c: Column) -> Column:
    """Null for a missing text, '!' and the trimmed text for an unreadable one, else the number in plain digits. Equal numbers have equal keys."""
    t = trimmed(c)
    u = F.when(t.rlike(r"^[\x00-\x7F]*$"), t).otherwise(F.translate(t, "".join(_DIGITS), _VALUES))
    bare = F.replace(u, F.lit("_"), F.lit(""))
    long_key = F.regexp_replace(F.regexp_replace(bare, r"^(-?)\+?0*(?=[0-9])", "$1"), "^-0$", "0")
    x = bare.try_cast("double")
    whole = (
        F.when(F.abs(x) < 1e18, x.try_cast("bigint").cast("string"))
        .when(F.abs(x) < 1e38, x.try_cast("decimal(38,0)").cast("string"))
        .otherwise(x.cast("string"))
    )
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
        .when(t.rlike("^(?:0|[1-9][0-9]{0,17})$"), t)
        .when(t.rlike(SHORT_INT), t.try_cast("bigint").cast("string"))
        .when(u.rlike(LONG_INT) & (F.length(u) <= 4300), long_key)
        .when(u.rlike(FLOAT) & (F.abs(x) < float("inf")) & ((F.abs(x) >= 2.0**53) | (x == F.floor(x).cast("double"))), whole)
        .otherwise(F.concat(F.lit("!"), t))
    )


def unreadable(key: Column) -> Column:
    """Of a number_key; null for a missing one."""
    return key.startswith("!")


def number_value(key: Column) -> Column:
    """The number of a readable number_key as BIGINT; numbers beyond BIGINT become its ends, other keys null."""
    beyond = F.when(key.startswith("-"), F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    return F.when(~unreadable(key), F.coalesce(key.try_cast("bigint"), beyond))


def parse_int(c: Column) -> Column:
    """(value, malformed) as a struct: blank and unreadable texts have the value 0; a fraction is cut off and malformed."""
    key = number_key(c)
    t = F.translate(trimmed(c), "".join(_DIGITS), _VALUES)
    cut_off = F.when(t.rlike(FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double").try_cast("bigint"))
    return F.struct(
        F.coalesce(F.when(unreadable(key), cut_off).otherwise(number_value(key)), F.lit(0).cast("bigint")).alias("value"),
        F.coalesce(unreadable(key), F.lit(False)).alias("malformed"),
    )
