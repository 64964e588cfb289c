from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gazette.functions.keys import heat_score, period_monday
from gazette.functions.times import entry_time
from gazette.operators import entries as E
from gazette.sources.feeds import read_feed_xml

SHAPE = "entry_id long, feed_url string, feed_ord int, title string, summary string, link string, published_at timestamp"


def feed(spark, rows):
    return spark.createDataFrame([(i, f"f{o}", o, t, "s", u, None) for i, o, t, u in rows], SHAPE)


def test_cap_and_position_count_blank_entries(spark):
    rows = [(i, 0, "  " if i < 3 else f"t{i}", "" if i < 3 else f"u{i}") for i in range(40)]
    kept = E.drop_blank(E.clean_entries(E.cap_feeds(feed(spark, rows))))
    assert sorted((r.entry_id, r.idx) for r in kept.collect()) == [(i, i) for i in range(3, 15)]


def test_heat_is_position_only_and_never_negative(spark):
    df = spark.range(0, 200, 1).select(F.col("id"), heat_score(F.col("id")).alias("h"))
    assert {r.id: r.h for r in df.collect()} == {i: max(1000 - 10 * i, 0) for i in range(200)}
    rows = [(i, 0, f"t{i}", f"u{i}") for i in range(130)]
    warm = E.with_heat(feed(spark, rows).repartition(7))
    assert {r.entry_id: r.heat_score for r in warm.collect()} == {i: max(1000 - 10 * i, 0) for i in range(130)}


def test_dedup_keeps_first_feed_and_cuts_before_comparing(spark):
    long = "x" * 500
    rows = [(7, 1, "a", "u"), (3, 2, "a", "u"), (9, 0, long + "1", "v"), (1, 1, long + "2", "v")]
    kept = E.dedup_entries(E.clean_entries(feed(spark, rows)))
    assert {r.entry_id for r in kept.collect()} == {7, 9}


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_dedup_and_board_do_not_depend_on_partitions(spark, parts):
    # A third of all rows are copies of one entry, and one feed holds most rows.
    rows = [(i, 0 if i % 3 else i % 7, "hot" if i % 3 == 0 else f"t{i % 50}", "u") for i in range(600)]
    df = feed(spark, rows).repartition(parts)
    first: dict = {}
    for i, o, t, u in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault((t, u), i)
    assert {r.entry_id for r in E.dedup_entries(E.clean_entries(df)).collect()} == set(first.values())
    board = [(r.heat_score, r.feed_ord, r.entry_id) for r in E.leaderboard(df).collect()]
    assert board == sorted(board, key=lambda r: (-r[0], r[1], r[2]))


def test_strip_knows_wide_blanks(spark):
    df = feed(spark, [(1, 0, "　\x1c t  \n", "\xa0u\x85")])
    row = E.clean_entries(df).first()
    assert (row.title, row.link) == ("t", "u")


def test_times(spark):
    rows = [
        ("Mon, 01 Jan 2024 10:00:00 GMT", None, datetime(2024, 1, 1, 10)),
        ("1 Jan 2024 10:00 +0800", None, datetime(2024, 1, 1, 2)),
        ("2024-01-01T10:00:00Z", None, datetime(2024, 1, 1, 10)),
        ("soon", "Tuesday, 02 Jan 2024 00:00:00 GMT", datetime(2024, 1, 2)),
        (None, "never", None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    got = [r[0] for r in df.coalesce(1).select(entry_time(F.col("a"), F.col("b"))).collect()]
    assert got == [w for _, _, w in rows]


def test_period_changes_at_beijing_midnight(spark):
    df = spark.createDataFrame([("2024-01-07 15:59:59",), ("2024-01-07 16:00:00",)], "t string")
    got = [str(r[0]) for r in df.coalesce(1).select(period_monday(F.col("t").cast("timestamp"))).collect()]
    assert got == ["2024-01-01", "2024-01-08"]


RSS = """<rss><channel><title>feed</title>
<item><title>One</title><link>http://x/1</link><description>first</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Two &amp; more</title><link>http://x/2</link><summary>own</summary><description>other</description></item>
</channel></rss>"""
ATOM = """<feed><title>feed</title>
<entry><title>A</title><link href="http://y/1"/><content>body</content><updated>2024-01-03T00:00:00Z</updated></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "one.xml").write_text(RSS)
    (tmp_path / "atom.xml").write_text(ATOM)
    rows = read_feed_xml(spark, str(tmp_path / "rss")).orderBy("entry_id").collect()
    assert [(r.title, r.link, r.summary, r.published_at) for r in rows] == [
        ("One", "http://x/1", "first", datetime(2024, 1, 1, 10)),
        ("Two & more", "http://x/2", "own", None),
    ]
    row = read_feed_xml(spark, str(tmp_path / "atom.xml"), "atom").first()
    assert (row.title, row.link, row.summary, row.published_at) == ("A", "http://y/1", "body", datetime(2024, 1, 3))
