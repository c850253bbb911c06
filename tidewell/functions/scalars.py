"""Column functions shared by the operators; all run inside the JVM unless they say so."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NULL instead of NaN: Spark orders NaN above every number, so it must not get in."""
    return F.when(~F.isnan(x), x)


def log10(x: Column) -> Column:
    """The decimal logarithm, minus infinity for zero; Spark's own has NULL there. NULL below zero."""
    return F.when(x == 0, float("-inf")).otherwise(F.log10(x))


def to_int(x: Column) -> Column:
    """A whole number from API text; blanks, None, null, NULL, - and anything else give NULL."""
    text = F.regexp_replace(F.trim(x.cast("string")), ",", "")
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def to_date(x: Column) -> Column:
    return x.try_cast("date")


def to_double(x: Column) -> Column:
    return no_nan(x.try_cast("double"))


def clean_text(x: Column) -> Column:
    """No-break spaces become spaces, runs of white space one space."""
    return F.trim(F.regexp_replace(x, "[\\s\\u00a0]+", " "))


def normalise_header(x: Column, known: Mapping[str, str]) -> Column:
    """Lower-cased header without footnote marks: the known name, else words by underscores."""
    plain = F.trim(F.lower(F.regexp_replace(x, "\\[[0-9]+\\]", "")))
    named = F.lit(None).cast("string")
    for label, name in known.items():
        named = F.when(plain == label, name).otherwise(named)
    return F.coalesce(named, F.regexp_replace(plain, "[ -]", "_"))


def normalise_symbol(x: Column) -> Column:
    """Upper-cased ticker with - for .; NULL if blank."""
    text = F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("-"))
    return F.when(F.length(text) > 0, text)


def is_quota_error(message: Column) -> Column:
    text = F.lower(message)
    return text.contains("quota reached") | text.contains("rate limited") | text.contains("api call frequency")


def backoff_minutes(attempts: Column, base: int) -> Column:
    """Delay before a retry: doubled with each attempt made before, at most 16 times the base."""
    return (F.lit(base) * F.pow(F.lit(2), F.least(attempts, F.lit(4)))).cast("bigint")


def after_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def label_map(x: Column, mapping: Mapping[str, float]) -> Column:
    """The mapped number, NULL for other labels."""
    out = F.lit(None).cast("double")
    for label, value in mapping.items():
        out = F.when(x == label, F.lit(float(value))).otherwise(out)
    return out


def ascii_json(text: Column) -> Column:
    """JSON text with characters beyond ASCII as \\u escapes of their UTF-16 units."""
    escaped = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")).otherwise(c))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(escaped, "")).otherwise(text)


def canonical_json(x: Column) -> Column:
    """JSON text with sorted keys, no blanks and ASCII escapes; what isn't JSON stays.

    By way of a VARIANT, so numbers come in their shortest decimal form (1.0 as 1) and an
    object that repeats a key isn't JSON.
    """
    return F.coalesce(ascii_json(F.to_json(F.try_parse_json(x))), x)


def scalar_text(value: object) -> object:
    """API scalars pass; anything else becomes text."""
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)
