"""Keyword lists: reading, cleaning, writing, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import json_string_array, strip

MAX_KEYWORDS = 3


def keywords_parse(c: Column) -> Column:
    """Strings of a JSON list, or of the `keywords` list of a JSON object.

    Stripped, blanks dropped, repeats dropped case-sensitively in order. Anything else is empty.
    """
    doc = F.try_parse_json(c)
    found = F.coalesce(
        F.try_variant_get(doc, "$", "array<variant>"),
        F.try_variant_get(doc, "$.keywords", "array<variant>"),
    )
    strings = F.filter(found, lambda v: F.schema_of_variant(v) == "STRING")
    stripped = F.transform(strings, lambda v: strip(v.cast("string")))
    return F.coalesce(
        F.array_distinct(F.filter(stripped, lambda k: k != "")),
        F.array().cast("array<string>"),
    )


def keywords_normalize(c: Column) -> Column:
    return F.transform(F.filter(c, lambda k: strip(k) != ""), lambda k: F.lower(strip(k)))


def keywords_from_list(c: Column, limit: int = MAX_KEYWORDS) -> Column:
    return F.slice(F.filter(F.transform(c, strip), lambda k: k != ""), 1, limit)


def keywords_from_text(c: Column, limit: int = MAX_KEYWORDS) -> Column:
    """Split at plain and full-width commas."""
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("，"), F.lit(",")), ",")
    return keywords_from_list(parts, limit)


def keywords_to_json(c: Column) -> Column:
    return json_string_array(c)


def keywords_to_csv(c: Column) -> Column:
    return F.array_join(c, ", ")


def keywords_to_cell(c: Column) -> Column:
    return F.array_join(c, ";")


def has_keyword(c: Column, keyword: str) -> Column:
    """Any element equal to `keyword`, upper and lower case alike."""
    wanted = keyword.strip().lower()
    return F.exists(c, lambda k: F.lower(k) == F.lit(wanted))


def contains_any(text: Column, normalized: Column) -> Column:
    """`text` holds one of the (already lower-cased) keywords as a substring."""
    return F.exists(normalized, lambda k: F.contains(F.lower(text), k))
