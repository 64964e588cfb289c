"""Landed feeds and raw pages as entry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import blank_to_null
from gazette.functions.times import entry_time

RSS_ITEM = (
    "title string, link string, summary string, description string, "
    "pubDate string, published string, updated string"
)
ATOM_ENTRY = (
    "title string, link struct<_href: string>, summary string, content string, "
    "published string, updated string"
)


def read_feed_xml(spark: SparkSession, path: str, dialect: str = "rss") -> DataFrame:
    """Entries of XML feed files; the feed is the file, the entry order is the order in the file.

    XML files are read whole, one task each, so `entry_id` rises within a feed. Land the result as
    a table before using it twice: the ids belong to one read.
    """
    if dialect == "atom":
        reader = spark.read.schema(ATOM_ENTRY).option("rowTag", "entry")
        link, body, stamp = F.col("link._href"), F.col("content"), F.col("published")
    else:
        reader = spark.read.schema(RSS_ITEM).option("rowTag", "item")
        link, body = F.col("link"), F.col("description")
        stamp = F.coalesce(F.col("pubDate"), F.col("published"))
    rows = reader.format("xml").load(path)
    return rows.select(
        F.monotonically_increasing_id().alias("entry_id"),
        F.col("_metadata.file_path").alias("feed_url"),
        F.col("title"),
        link.alias("link"),
        F.coalesce(blank_to_null(F.col("summary")), body).alias("summary"),
        entry_time(stamp, F.col("updated")).alias("published_at"),
    )


def page_entries(pages: DataFrame) -> DataFrame:
    """Raw pages as entries: the title tag, the address, and its host as the feed."""
    host = F.split_part(F.split_part(F.col("url"), F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return pages.select(
        F.col("page_id").alias("entry_id"),
        host.alias("feed_url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.col("html").alias("summary"),
    )
