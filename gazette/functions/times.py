"""Entry times as feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import strip

# The date shapes of RSS and Atom feeds, the weekday taken off.
DATE_FORMATS = [
    "d MMM yyyy HH:mm[:ss] z",
    "d MMM yyyy HH:mm[:ss] Z",
    "d MMM yyyy HH:mm[:ss]",
]


def parse_time(c: Column) -> Column:
    """UTC time, or null when no known shape fits."""
    plain = F.regexp_replace(strip(c), r"^[A-Za-z]{3,9},\s*", "")
    shapes = [F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*shapes, F.try_to_timestamp(plain))


def entry_time(published: Column, updated: Column) -> Column:
    return F.coalesce(parse_time(published), parse_time(updated))
