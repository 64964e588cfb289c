"""Keys that identify entries, deliveries and issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import datetime_text, strip

ISSUE_ZONE = "Asia/Shanghai"


def entry_key(link: Column, title: Column) -> Column:
    return F.sha2(F.concat(link, F.lit("|"), title), 256)


def address(email: Column) -> Column:
    """The form of an address used for comparing."""
    return F.lower(strip(email))


def delivery_key(base: Column, email: Column) -> Column:
    return F.concat(base, F.lit(":"), F.substring(F.sha2(address(email), 256), 1, 16))


def issue_key(period_start: Column, ready_at: Column) -> Column:
    return F.coalesce(period_start.cast("string"), datetime_text(ready_at, "T"), F.lit("unknown"))


def period_monday(ts: Column, zone: str = ISSUE_ZONE) -> Column:
    """Monday of the week a UTC time falls in, by the calendar of `zone`."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(ts, zone)))


def heat_score(idx: Column) -> Column:
    return F.greatest(F.lit(1000) - idx * 10, F.lit(0))
