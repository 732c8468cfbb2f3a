"""Text functions as Column expressions (JVM side)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip() sees it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as the inside of a Java or RE2 character class, without and with line breaks.
SPACE_INLINE = r"\t\x0B\x0C\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CLASS = r"\r\n" + SPACE_INLINE


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """True for null, empty and white space only; never null."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def clean_name(c: Column) -> Column:
    """Trimmed, upper-cased, inner white space collapsed; null becomes the empty string."""
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.upper(F.when(t.rlike(f"[{SPACE_CLASS}][{SPACE_CLASS}]|[^\\S ]|[^\\x00-\\x7F]"), F.regexp_replace(t, f"[{SPACE_CLASS}]+", " ")).otherwise(t))


def preview(c: Column, limit: int = 80) -> Column:
    """Printable ASCII of a text for audits: other characters as \\uXXXX of their UTF-16 units, cut at limit with three dots."""
    units = F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: F.when(x.rlike(r"^[\x20-\x7E]?\z"), x).otherwise(F.concat(F.lit("\\u"), F.lower(F.regexp_replace(F.hex(F.encode(x, "UTF-16BE")), "(?<=^.{4})(?=.)", "\\\\u")))))
    text = F.array_join(units, "")
    return F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, "...").otherwise(""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def tps_digits(c: Column) -> Column:
    """The number written in a polling-place label (`TPS 01` is 1); null if it has no digit."""
    return F.when(digits_only(c) != "", digits_only(c)).try_cast("bigint")


def tps_plain(c: Column) -> Column:
    """The label as a number where it is nothing but digits, else null."""
    return F.when(trimmed(c).rlike("^[0-9]+$"), trimmed(c)).try_cast("bigint")


def latest_year(c: Column) -> Column:
    """The greatest 19xx or 20xx standing by itself, null if there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1), lambda y: y.cast("int")))


def path_key(*codes: Column) -> Column:
    """P<prov>.<kab>… of the codes."""
    return F.concat(F.lit("P"), F.concat_ws(".", *codes))


def parent_key(key: Column, up: int = 1) -> Column:
    """The key without its last parts; null above the top."""
    parts = F.split(key, r"\.")
    return F.when(F.size(parts) > up, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "."))


def column_key(c: Column) -> Column:
    """A party column's name in the spelling of the files."""
    k = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(k == "gerindra", "gerinda").otherwise(k)


def csv_cell(c: Column) -> Column:
    """A CSV cell, quoted only where it must be; null becomes empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_escape(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def grouped_count(c: Column) -> Column:
    """A whole number with dots between thousands, a dash for null."""
    return F.coalesce(F.translate(F.format_number(F.round(c.cast("double")), 0), ",", "."), F.lit("—"))


def percent(c: Column, digits: int = 1) -> Column:
    """A share as a percentage with a decimal comma, a dash for null."""
    return F.coalesce(F.concat(F.translate(F.format_number(c.cast("double") * 100, digits), ",.", ".,"), F.lit("%")), F.lit("—"))


def non_negative(c: Column) -> Column:
    """Null, NaN, infinite and negative numbers become 0."""
    x = c.cast("double")
    return F.when((x >= 0) & (x < float("inf")), c).otherwise(F.lit(0).cast("bigint"))


@F.pandas_udf(StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without what is not ASCII; null becomes empty. Arrow batches, as Spark has no NFKD."""
    return texts.map(lambda t: "" if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


#: Spellings that the comparison form unifies, and how.
SPELLINGS = (
    (r"\bKOTA\s+ADMINISTRASI\b", "ADMINISTRASI"),
    (r"\bADM(?:INISTRASI)?\.?\s+KEP(?:ULAUAN)?\.?\b", "ADMINISTRASI KEPULAUAN"),
    (r"[^A-Z0-9]+", " "),
)


def canonical(c: Column) -> Column:
    """The form in which names of areas are compared across catalogues: ASCII upper case, & as DAN, one spelling of ADMINISTRASI and KEPULAUAN, words by single spaces."""
    t = F.replace(F.upper(ascii_fold(c)), F.lit("&"), F.lit(" DAN "))
    for pattern, spelling in SPELLINGS:
        t = F.regexp_replace(t, pattern, spelling)
    return F.trim(t)


def compact(canonical_name: Column) -> Column:
    """A canonical name without spaces."""
    return F.replace(canonical_name, F.lit(" "), F.lit(""))
