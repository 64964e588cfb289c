"""Queries over feed entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions.keys import entry_key, period_monday
from gazette.functions.times import entry_time
from gazette.operators import entries as E
from gazette.plans import weekly_issue
from gazette.registry.base import STEPS, query, sql_strip, sql_time, time_text
from gazette.registry.fixtures import table, view
from gazette.session import shared_dir
from gazette.sources.feeds import page_entries, read_feed_xml
from gazette.sources.tables import IssueItems

STEPS["clean"] = f"""
SELECT entry_id, feed_url, feed_ord, published_at,
  substr({sql_strip("coalesce(title, '')")}, 1, 500) AS title,
  substr({sql_strip("coalesce(summary, '')")}, 1, 4000) AS summary,
  substr({sql_strip("coalesce(link, '')")}, 1, 1000) AS link
FROM v_entries"""
STEPS["nonblank"] = "SELECT * FROM v_clean WHERE title <> '' OR link <> ''"
STEPS["positions"] = """
SELECT entry_id, feed_url, row_number() OVER (PARTITION BY feed_url ORDER BY entry_id) - 1 AS idx
FROM v_entries"""
STEPS["keyed"] = "SELECT *, sha256(link || '|' || title) AS entry_key FROM v_nonblank"
STEPS["leaders"] = """
SELECT k.*, CAST(greatest(1000 - 10 * p.idx, 0) AS INT) AS heat_score
FROM v_keyed k JOIN v_positions p USING (entry_id)
WHERE p.idx < 15
QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY feed_ord, entry_id) = 1
ORDER BY heat_score DESC, feed_ord, entry_id LIMIT 80"""


@query(
    "page_entries_scan",
    """SELECT page_id AS entry_id, split_part(split_part(url, '//', 2), '/', 1) AS feed_url,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS link, html AS summary FROM pages""",
)
def page_entries_scan(spark, sf):
    return page_entries(table(spark, sf, "pages"))


PER_FILE = 1000  # entries by id that one fetch brings at most


# The feeds are written from the entries as XML, then read: one file holds a feed as fetched, at most
# 1000 entries by id.
@query(
    "feed_xml_scan",
    f"""SELECT feed_url || '/' || CAST(entry_id // 1000 AS VARCHAR) AS feed_url,
    CAST(row_number() OVER (PARTITION BY feed_url, entry_id // 1000 ORDER BY entry_id) - 1 AS BIGINT) AS place,
    {sql_strip("title")} AS title, {sql_strip("link")} AS link,
    md5(regexp_replace({sql_strip("summary")}, '[\\x00-\\x20]+', ' ', 'g')) AS summary_md5,
    {sql_time("published_at")} AS published_at
    FROM v_clean""",
)
def feed_xml_scan(spark, sf):
    rows = E.clean_entries(view(spark, sf, "entries")).withColumn("fetch", F.floor(F.col("entry_id") / 1000))
    path = shared_dir(spark, "feeds")
    stamp = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    (
        rows.select(
            "feed_url", "fetch", "entry_id", "title", "link",
            F.col("summary").alias("description"), stamp.alias("pubDate"),
        )
        .repartition("feed_url", "fetch")
        .sortWithinPartitions("feed_url", "fetch", "entry_id")
        .drop("entry_id")
        .write.format("xml").option("rootTag", "rss").option("rowTag", "item")
        .partitionBy("feed_url", "fetch").save(path)
    )
    landed = shared_dir(spark, "landed")
    place = r"feed_url=([^/]+)/fetch=([^/]+)"
    read_feed_xml(spark, path).withColumn(
        "feed_url",
        F.concat_ws("/", F.regexp_extract("feed_url", place, 1), F.regexp_extract("feed_url", place, 2)),
    ).write.parquet(landed)
    found = E.clean_entries(E.cap_feeds(spark.read.parquet(landed), PER_FILE))
    return found.select(
        "feed_url",
        F.col("idx").cast("long").alias("place"),
        "title",
        "link",
        F.md5(F.regexp_replace("summary", r"[\x00-\x20]+", " ")).alias("summary_md5"),
        time_text("published_at").alias("published_at"),
    )


@query("entry_clean", "SELECT entry_id, title, summary, link FROM v_clean")
def entry_clean(spark, sf):
    return E.clean_entries(view(spark, sf, "entries")).select("entry_id", "title", "summary", "link")


@query("entries_nonblank", "SELECT entry_id, title, link FROM v_nonblank")
def entries_nonblank(spark, sf):
    return E.drop_blank(E.clean_entries(view(spark, sf, "entries"))).select("entry_id", "title", "link")


@query("heat_score", "SELECT entry_id, CAST(greatest(1000 - 10 * idx, 0) AS INT) AS heat_score FROM v_positions")
def heat_score(spark, sf):
    return E.with_heat(view(spark, sf, "entries").select("entry_id", "feed_url")).select("entry_id", "heat_score")


@query("entry_key", "SELECT entry_id, sha256(link || '|' || title) AS entry_key FROM v_clean")
def entry_key_(spark, sf):
    rows = E.clean_entries(view(spark, sf, "entries"))
    return rows.select("entry_id", entry_key(F.col("link"), F.col("title")).alias("entry_key"))


# Six spellings of the time by entry: GMT, offset, ISO, and three that need the second field.
@query(
    "entry_time",
    f"""SELECT entry_id, {sql_time('''CASE entry_id % 6 WHEN 1 THEN published_at - INTERVAL '8' HOUR
    WHEN 5 THEN NULL ELSE published_at END''')} AS published_at FROM v_entries""",
)
def entry_time_(spark, sf):
    t = F.col("published_at")
    mail = F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    offset = F.date_format(t, "EEE, d MMM yyyy HH:mm:ss '+0800'")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.col("entry_id") % 6
    published = F.when(n == 0, mail).when(n == 1, offset).when(n == 2, iso).when(n == 3, "last week").when(n == 5, "")
    updated = F.when(n == 3, iso).when(n == 4, mail).when(n == 5, "32 Foo 2024")
    return view(spark, sf, "entries").select(
        "entry_id", time_text(entry_time(published, updated)).alias("published_at")
    )


@query("feed_top15", "SELECT entry_id, feed_url, CAST(idx AS INT) AS idx FROM v_positions WHERE idx < 15")
def feed_top15(spark, sf):
    return E.cap_feeds(view(spark, sf, "entries").select("entry_id", "feed_url")).select("entry_id", "feed_url", "idx")


@query(
    "entries_dedup",
    """SELECT entry_id, feed_url, entry_key FROM v_keyed
    QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY feed_ord, entry_id) = 1""",
)
def entries_dedup(spark, sf):
    rows = E.drop_blank(E.clean_entries(view(spark, sf, "entries").drop("summary").withColumn("summary", F.lit(""))))
    return E.dedup_entries(rows).select("entry_id", "feed_url", "entry_key")


@query(
    "leaderboard",
    f"SELECT entry_id, feed_url, title, link, heat_score, {sql_time('published_at')} AS published_at FROM v_leaders",
)
def leaderboard(spark, sf):
    return E.leaderboard(view(spark, sf, "entries")).select(
        "entry_id", "feed_url", "title", "link", "heat_score", time_text("published_at").alias("published_at")
    )


@query(
    "entries_union",
    """SELECT 0 AS list_ord, feed_url, entry_id, title, link FROM v_entries UNION ALL
    SELECT 1, split_part(split_part(url, '//', 2), '/', 1), page_id,
    regexp_extract(html, '<title>([^<]*)</title>', 1), url FROM pages""",
)
def entries_union(spark, sf):
    both = E.union_feeds([view(spark, sf, "entries"), page_entries(table(spark, sf, "pages"))])
    return both.select("list_ord", "feed_url", "entry_id", "title", "link")


# Every entry is stored under its week; then the even weeks are rebuilt, and
# every other one of them finds nothing.
@query(
    "raw_items_replace",
    """SELECT entry_id AS id, CAST(entry_id // 168 AS BIGINT) AS issue_id, 0 AS heat_score FROM v_clean
    WHERE (entry_id // 168) % 2 = 1
    UNION ALL SELECT entry_id, CAST(entry_id // 168 AS BIGINT), 1 FROM v_nonblank WHERE (entry_id // 168) % 4 = 0""",
)
def raw_items_replace(spark, sf):
    table = IssueItems(spark, shared_dir(spark, "raw_items"))
    issue = F.floor(F.col("entry_id") / 168).alias("issue_id")
    rows = E.clean_entries(view(spark, sf, "entries"))
    shape = [F.col("entry_id").alias("id"), issue]
    table.replace(rows.select(*shape, F.lit(0).alias("heat_score")))
    again = E.drop_blank(rows).select(*shape, F.lit(1).alias("heat_score")).filter("issue_id % 4 = 0")
    table.replace(again, rows.select(issue).filter("issue_id % 2 = 0"))
    return table.read().select("id", "issue_id", "heat_score")


@query(
    "prompt_corpus",
    """SELECT 12 AS issue_id, count(*) AS n_items, string_agg(concat(CAST(rn AS VARCHAR), '. [', feed_url, '] ', title, chr(10),
    '   摘要: ', substr(summary, 1, 500), chr(10), '   链接: ', link, chr(10), '   热度分: ', CAST(heat_score AS VARCHAR)),
    chr(10) ORDER BY rn) AS corpus
    FROM (SELECT *, row_number() OVER (ORDER BY heat_score DESC, feed_ord, entry_id) AS rn FROM v_leaders) t WHERE rn <= 60""",
)
def prompt_corpus(spark, sf):
    return weekly_issue.prompt(weekly_issue.raw_items(view(spark, sf, "entries"), F.lit(12)))
