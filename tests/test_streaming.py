"""Several micro-batches against the batch operators over the same rows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators.audience import eligible
from gazette.operators.delivery import sent_keys
from gazette.operators.issues import ready_issue_for
from gazette.operators.lifecycle import lifecycle_fold
from gazette.operators.reporting import audience_metrics
from gazette.plans.mailings import weekly_delivery
from gazette.schemas import ACTIONS
from gazette.sources.tables import read_table, write_log
from gazette.streaming import delivery, entries, lifecycle, runs
from test_lifecycle import histories, replay
from test_mailing import PERIOD, URL, issues, log, people  # noqa: F401

T0 = datetime(2024, 1, 1)


def arriving(spark, df, path, order, parts=3):
    """`df` written as `parts` files one after another in order, then read as a stream, one per batch."""
    rows = [r for r in df.orderBy(*order.split(",")).collect()]
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.mark.parametrize("check", [True, False])
def test_lifecycle_stream_equals_fold(spark, tmp_path, check):
    rows = histories(seed=11, users=25, most=40)
    df = spark.createDataFrame(rows, ACTIONS)
    stream = arriving(spark, df, tmp_path / "in", "ts,event_id")
    versions = lifecycle.lifecycle_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), check)
    got = lifecycle.current_states(versions)
    assert versions.select("batch_id").distinct().count() == 3
    columns = ["email", "status", "mode", "keywords", "confirmed_at", "token", "rejects"]
    a = {str(tuple(r)) for r in got.select(columns).collect()}
    assert a == {str(tuple(r)) for r in lifecycle_fold(df, check).select(columns).collect()}
    assert len(a) == len(replay(rows, check)[0])


def test_running_metrics(spark, tmp_path):
    df = spark.createDataFrame(histories(seed=5, users=30, most=30), ACTIONS)
    stream = arriving(spark, df, tmp_path / "in", "ts,event_id")
    got = lifecycle.metrics_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).first()
    people = lifecycle_fold(df).filter("status is not null").withColumn("id", F.lit(1))
    assert got.asDict() == audience_metrics(people).first().asDict()


def test_dedup_stream(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}", "u", T0 + timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "entry_id long, title string, link string, published_at timestamp")
    stream = arriving(spark, df, tmp_path / "in", "entry_id")
    kept = runs.run_to_table(entries.dedup_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    titles = sorted(r.title for r in kept.collect())
    assert titles == sorted({r[1] for r in rows})


def test_weekly_stats_drop_late_rows(spark, tmp_path):
    # Files arrive by id; the last one brings a row from long before the watermark.
    rows = [(i, "f", T0 + timedelta(days=i), 1000 - 10 * i) for i in range(20)] + [(99, "f", T0, 5000)]
    df = spark.createDataFrame(rows, "entry_id long, feed_url string, published_at timestamp, heat_score int")
    stream = arriving(spark, df, tmp_path / "in", "entry_id", parts=7)
    table = runs.run_to_table(
        entries.weekly_feed_stats(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update"
    )
    got = {str(r.week_start): (r.n_entries, r.best_heat) for r in runs.newest_version(table, ["week_start", "feed_url"]).collect()}
    assert got == {"2024-01-01": (7, 1000), "2024-01-08": (7, 930), "2024-01-15": (6, 860)}


def weekly_rows():
    """Rows of 60 days, each day up to two days behind its place, and one that is far too late."""
    rows = [(i, f"f{i % 3}", T0 + timedelta(days=i // 2 - (i % 3) * 0.5), 1000 - i % 40) for i in range(120)]
    return [*rows, (999, "f0", T0, 5000)]


@pytest.mark.parametrize("parts,most", [(11, 1), (25, 3), (5, 8)])
def test_weeks_close_once(spark, tmp_path, parts, most):
    df = spark.createDataFrame(weekly_rows(), "entry_id long, feed_url string, published_at timestamp, heat_score int")
    stream = arriving(spark, df, tmp_path / "in", "entry_id", parts=parts)
    got = entries.weekly_feed_table(stream, str(tmp_path / "out"), str(tmp_path / "state"), most=most)
    versions = runs.run_to_table(entries.weekly_feed_stats(stream), str(tmp_path / "all"), str(tmp_path / "all-state"), "update")
    want = runs.newest_version(versions, ["week_start", "feed_url"])
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.select(*got.columns).collect())) and len(rows) > 20
    table = entries.WeeklyTable(spark, str(tmp_path / "out"), entries._weekly(df, "published_at", "2 days").schema, "2 days", most)
    closed, held = table.closed.read(), table.open.read()
    assert closed.count() == closed.select(*table.KEY).distinct().count()
    assert len(table.open.parts()) <= most + 1
    if most < parts:
        assert 0 < closed.count() < len(rows) and held.count() < versions.count()
        assert closed.join(held, "week_start", "left_semi").count() == 0


def test_closing_may_be_repeated(spark, tmp_path):
    shape = "week_start date, feed_url string, n_entries long, best_heat int, week_end timestamp, latest timestamp"
    table = entries.WeeklyTable(spark, str(tmp_path / "t"), shape, "2 days", most=1)

    def week(n, count):
        start = T0 + timedelta(days=7 * n)
        return (start.date(), "f", count, 1, start + timedelta(days=7), start + timedelta(days=6))

    for batch, rows in enumerate([[week(0, 1)], [week(0, 2), week(1, 1)], [week(3, 1)], []]):
        table.write(spark.createDataFrame(rows, shape), batch)
    want = sorted(r.n_entries for r in table.read().collect())
    # Batch 4 is lost after its weeks were closed and before the open rows were merged, then runs again.
    table.open.add(spark.createDataFrame([week(4, 7)], shape), 4)
    before = sorted(map(tuple, table.read().collect()))
    old = table.open.compact
    table.open.compact = lambda *a, **k: None
    table.settle(5)
    assert table.closed.read().count() > 0 and sorted(map(tuple, table.read().collect())) == before
    table.open.compact = old
    table.settle(5)
    table.settle(5)
    assert sorted(map(tuple, table.read().collect())) == before and want == [1, 1, 2]
    assert [p.number for p in table.open.parts()] == [4]


def test_delivery_stream_is_replay_safe(spark, tmp_path, people, issues, log):  # noqa: F811
    stream = arriving(spark, people, tmp_path / "in", "id")
    path, log_path = str(tmp_path / "mails"), str(tmp_path / "log")
    want = {r.kind for r in weekly_delivery(people, issues, log, F.lit(PERIOD), URL).collect()}
    write_log(log.select("subscriber_id", "issue_id", "kind", "sent_at"), log_path)
    ask = (issues, log_path, F.lit(PERIOD), URL, path)
    first = delivery.deliver_stream(stream, *ask, str(tmp_path / "s1"))
    kinds = sorted(r.kind for r in first.collect())
    assert kinds == sorted(want) and eligible(people).count() == 5  # one address twice, mailed once
    logged = read_table(spark, log_path, delivery.LOG)
    assert logged.count() == log.count() + len(want)
    assert weekly_delivery(people, issues, logged, F.lit(PERIOD), URL).count() == 0  # a run after the stream plans nothing
    # All batches again, their progress lost: every batch replaces its own rows, nothing is added.
    again = delivery.deliver_stream(stream, *ask, str(tmp_path / "s2"))
    assert sorted(r.kind for r in again.collect()) == kinds
    assert read_table(spark, log_path, delivery.LOG).count() == log.count() + len(want)


def test_delivery_opens_only_the_period_of_the_log(spark, tmp_path, issues):  # noqa: F811
    path = str(tmp_path / "log")
    write_log(spark.createDataFrame([(1, 1, "a", T0), (1, None, "b", T0)], "subscriber_id long, issue_id long, kind string, sent_at timestamp"), path)
    keys = sent_keys(read_table(spark, path, delivery.LOG), ready_issue_for(issues, F.lit(PERIOD)), "weekly", issues)
    text = keys._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[\(isnull\(issue_id#\d+L?\) OR array_contains", text)


def test_arriving_tables_keep_rows_without_a_key(spark, tmp_path):
    from gazette.registry import histories as registered

    ts = "IF(id % 5 = 0, NULL, timestamp_seconds(1704067200 + id * 60))"
    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("id", F.monotonically_increasing_id())
    given.withColumn("ts", F.expr(ts).cast(given.schema["ts"].dataType)).drop("id").write.parquet(f"{tmp_path}/events.parquet")
    stream = registered._arriving_view(spark, str(tmp_path), "actions")
    rows = runs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows.count() == given.count()
    assert {r[0] for r in rows.filter("ts is null").select("batch_id").distinct().collect()} == {0}
