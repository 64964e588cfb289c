"""Feed entries: cap per feed, cleaning, de-dup, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.keys import entry_key, heat_score
from gazette.functions.text import clean
from gazette.operators.common import first_per, once

# Limits of a weekly issue; each is a parameter of its operator.
PER_FEED, PER_ISSUE = 15, 80
TITLE_LENGTH, SUMMARY_LENGTH, LINK_LENGTH = 500, 4000, 1000
HEAT_POSITIONS = 100  # from here on the heat is 0


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """All entries; `list_ord` is the place of their feed list."""
    placed = [f.withColumn("list_ord", F.lit(i)) for i, f in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def feed_positions(entries: DataFrame, most: int) -> DataFrame:
    """`entry_id, idx` of the first `most` entries of each feed, blank ones counted.

    Only the two key columns are ranked; the wide rows are fetched by id afterwards.
    """
    first = first_per(
        entries.select("feed_url", "entry_id"), ["feed_url"], [F.col("entry_id")], most, "_rank"
    )
    return first.select("entry_id", (F.col("_rank") - 1).alias("idx"))


def cap_feeds(entries: DataFrame, per_feed: int = PER_FEED) -> DataFrame:
    """The first entries of each feed with their position `idx`."""
    return entries.join(feed_positions(entries, per_feed), "entry_id")


def with_heat(entries: DataFrame) -> DataFrame:
    """Position heat of every entry. Only the first positions of a feed have any."""
    warm = feed_positions(entries, HEAT_POSITIONS).select(
        "entry_id", heat_score(F.col("idx")).alias("heat_score")
    )
    return entries.join(warm, "entry_id", "left").withColumn(
        "heat_score", F.coalesce("heat_score", F.lit(0))
    )


def clean_entries(entries: DataFrame) -> DataFrame:
    """Title, summary and link stripped and cut. Title and link, which later filters and keys use,
    are worked out once; the summary only where it is read."""
    cleaned = once(
        entries.withColumnsRenamed({"title": "_title", "link": "_link"}),
        title=clean(F.col("_title"), TITLE_LENGTH),
        link=clean(F.col("_link"), LINK_LENGTH),
    )
    return cleaned.withColumn("summary", clean(F.col("summary"), SUMMARY_LENGTH)).drop("_title", "_link")


def drop_blank(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter((F.col("title") != "") | (F.col("link") != ""))


def dedup_entries(cleaned: DataFrame) -> DataFrame:
    """The first entry of each link and title, in order of feed, then place in the feed."""
    keyed = cleaned.withColumn("entry_key", entry_key(F.col("link"), F.col("title")))
    return first_per(keyed, ["entry_key"], [F.col("feed_ord"), F.col("entry_id")])


def leaderboard(entries: DataFrame, per_feed: int = PER_FEED, most: int = PER_ISSUE) -> DataFrame:
    """The hottest entries of all feeds; equal heat keeps feed order."""
    capped = drop_blank(clean_entries(cap_feeds(entries, per_feed)))
    return top_entries(
        dedup_entries(capped.withColumn("heat_score", heat_score(F.col("idx")))), most
    )


def top_entries(entries: DataFrame, most: int = PER_ISSUE) -> DataFrame:
    return entries.orderBy(F.desc("heat_score"), "feed_ord", "entry_id").limit(most)
