"""Text helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# HTML entities, the ampersand first.
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clip(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def clean(c: Column, length: int) -> Column:
    """Missing becomes empty, outer white space goes, the rest is cut to `length` characters."""
    return clip(strip(F.coalesce(c, F.lit(""))), length)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def html_escape(c: Column) -> Column:
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), HTML_ENTITIES, c)


def json_quote(c: Column) -> Column:
    """A JSON string literal."""
    boxed = F.to_json(F.array(c))
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def json_string_array(c: Column) -> Column:
    """`["a", "b"]` with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, json_quote), ", "), F.lit("]"))


def datetime_text(c: Column, separator: str = " ") -> Column:
    """Seconds, and six digits of fraction only when there is one."""
    day_and_time = f"yyyy-MM-dd'{separator}'HH:mm:ss"
    whole = F.unix_micros(c) % 1000000 == 0
    return F.when(whole, F.date_format(c, day_and_time)).otherwise(
        F.date_format(c, day_and_time + ".SSSSSS")
    )
