"""Delivered records that fail to parse, told apart by regular expressions made from the schema.

One anchored pattern for the whole row accepts a record with all its fields well quoted and the typed ones valid. Only the rows it refuses meet the incremental prefix patterns: pattern k
accepts the first k fields, so the first pattern that fails names the first broken field, and what stands there and after it is the reason. All quantifiers are possessive: no backtracking, no recursion on long quoted texts.

Nulls and edge cases: null, empty and white-space records are `empty`, header lines (with or without a byte order mark, quoted or not) are `header`; neither is a failure. One line end
closing a record is not part of it. A bare line break inside a record outside quotes makes it more than one record: `column_count`. Repeated records are judged each by itself. Texts of
any length are parsed whole. An empty table gives empty results; columns other than those named are kept or ignored as the caller selects, clashing names included.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulara.functions.numbers import number_key, unreadable
from tabulara.functions.text import SPACE_CLASS, SPACE_INLINE, trimmed

QUOTED = '"(?:[^"]++|"")*+"'
FIELD = f'(?:{QUOTED}|[^",\\r\\n]*+)'
#: As FIELD, but line breaks may stand outside quotes.
LOOSE = f'(?:{QUOTED}|[^",]*+)'
DIGITS = "[0-9]++"
TPS = f"(?:(?:[Tt][Pp][Ss])[{SPACE_CLASS}]*+)?[0-9]++"
#: The usual readable numbers; the others are read by number_key where the whole-row pattern refuses them.
COUNT = "(?:[+-]?[0-9]{1,18})?"


@dataclass(frozen=True)
class RowSchema:
    """Columns in order, and patterns of the inner text of typed ones; loose_numbers names those that may hold any readable number or nothing."""

    columns: list[str]
    types: dict[str, str] = field(default_factory=dict)
    loose_numbers: frozenset[str] = frozenset()

    def pattern(self, column: str) -> str:
        if column not in self.types:
            return FIELD
        inner = self.types[column]
        return f'(?:"[{SPACE_CLASS}]*+{inner}[{SPACE_CLASS}]*+"|[{SPACE_INLINE}]*+{inner}[{SPACE_INLINE}]*+)'

    def whole(self) -> str:
        """The anchored pattern of a valid row."""
        return f"\\A{','.join(map(self.pattern, self.columns))}\\z"

    def prefixes(self) -> list[str]:
        """Pattern k accepts a row whose first k+1 fields are valid."""
        parts = [self.pattern(c) for c in self.columns]
        return [f"\\A{','.join(parts[: k + 1])}(?=,|\\z)" for k in range(len(parts))]

    def header(self) -> str:
        s = f"[{SPACE_INLINE}]*+"
        return "\\A\ufeff?" + ",".join(f'{s}(?:"{c}"|{c}){s}' for c in self.columns) + "\\z"


#: What follows the fields before the broken one: fields, each after a comma; with line breaks only inside quotes.
STRUCTURE = f"\\A(?:,{LOOSE})*+\\z"
ONE_RECORD = f"\\A(?:,{FIELD})*+\\z"


def _fields(rest: Column) -> Column:
    """The fields of well quoted text, each after a comma, unquoted."""
    raw = F.regexp_extract_all(rest, F.lit(f",({LOOSE})"), 1)
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(x))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once per row, however often it is read: a generator of one row is not merged into its readers."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_rows(df: DataFrame, line: str, schema: RowSchema) -> DataFrame:
    """df with `parsed` (replacing a column of that name): a struct of status, fields, reason, bad_fields and first_broken.

    status is valid, header, empty or failed; fields (array of strings) is set for valid rows; reason is broken_quoting, column_count or invalid_value; bad_fields names the fields with
    an invalid value; first_broken is the first field that a prefix pattern refuses, null where the row goes on after the last field.

    A row that the whole-row pattern refuses takes the prefix patterns one after another up to the first that fails. The fields before that one are valid; what follows them gives the reason: quotes out of place there,
    a wrong number of fields, or invalid values in the broken field and the typed ones after it. Only readable numbers that COUNT doesn't know turn out to be none, and the row loads.
    """
    columns, kept = schema.columns, [c for c in df.columns if c != "parsed"]
    text = F.regexp_replace(F.col(line), "(?:\\r\\n|\\n|\\r)\\z", "")
    df = _once(df.select(*(F.col(f"`{c}`") for c in kept)), "_text", text)
    text = F.col("_text")
    kind = F.when(F.coalesce(trimmed(text), F.lit("")) == "", "empty").when(text.rlike(schema.whole()), "valid").when(text.rlike(schema.header()), "header").otherwise("refused")
    df = _once(df, "_kind", kind)
    at = reduce(lambda e, k: F.when(~text.rlike(k[1]), k[0]).otherwise(e), reversed([*enumerate(schema.prefixes())]), F.lit(len(columns)))
    df = _once(df, "_at", F.when(F.col("_kind") == "refused", at))
    before = F.concat(F.lit(f"\\A{FIELD}(?:,{FIELD}){{"), (F.col("_at") - 1).cast("string"), F.lit("}"))
    df = _once(df, "_rest", F.when(F.col("_at") == 0, F.concat(F.lit(","), text)).when(F.col("_at") > 0, F.regexp_replace(text, before, F.lit(""))))
    rest, fields = F.col("_rest"), _fields(F.col("_rest"))

    def bad(column: str) -> Column:
        place = F.lit(columns.index(column)) - F.col("_at")
        value = F.when(place >= 0, F.get(fields, F.greatest(place, F.lit(0))))
        if column in schema.loose_numbers:
            return F.coalesce(unreadable(number_key(value)), F.lit(False))
        return (place >= 0) & ~F.coalesce(trimmed(value).rlike(f"\\A{schema.types[column]}\\z"), F.lit(False))

    bad_fields = F.array_compact(F.array(*(F.when(bad(c), F.lit(c)) for c in columns if c in schema.types)))
    reason = F.when(~rest.rlike(STRUCTURE), "broken_quoting").when(~rest.rlike(ONE_RECORD) | (F.col("_at") + F.size(fields) != len(columns)), "column_count")
    df = _once(df, "_why", F.when(rest.isNotNull(), F.struct(reason.alias("whole"), F.when(reason.isNull(), bad_fields).alias("bad"))))
    whole, wrong = F.col("_why.whole"), F.col("_why.bad")
    invalid = F.coalesce(F.size(wrong) > 0, F.lit(False))
    failed = whole.isNotNull() | invalid
    status = F.when(failed, "failed").when(F.col("_kind") == "refused", "valid").otherwise(F.col("_kind"))
    parts = {
        "status": status,
        "fields": F.when(status == "valid", _fields(F.concat(F.lit(","), text))),
        "reason": F.coalesce(whole, F.when(invalid, "invalid_value")),
        "bad_fields": F.when(invalid, wrong),
        "first_broken": F.when(failed, F.get(F.array(*map(F.lit, columns)), F.col("_at"))),
    }
    return df.select(*(F.col(f"`{c}`") for c in kept), F.struct(*(c.alias(k) for k, c in parts.items())).alias("parsed"))


def failures(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per failed record, or per bad field where values are invalid: keep…, reason, field."""
    p = F.col("parsed")
    names = F.when(p["reason"] == "invalid_value", p["bad_fields"]).otherwise(F.array(F.lit("")))
    return parsed.where(p["status"] == "failed").select(*keep, p["reason"].alias("reason"), F.explode(names).alias("field"))


def loaded(parsed: DataFrame, schema: RowSchema, *keep: str) -> DataFrame:
    """The valid records as rows of the schema, all strings, empty fields as empty strings. A kept column with the name of a schema column becomes kept_<name>."""
    fields = F.col("parsed.fields")
    kept = [F.col(f"`{c}`").alias(f"kept_{c}" if c in schema.columns else c) for c in keep]
    return parsed.where("parsed.status = 'valid'").select(*kept, *(F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(schema.columns)))
