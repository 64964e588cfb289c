"""Entries as they arrive: de-dup and weekly figures per feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.keys import entry_key
from gazette.operators.common import first_per
from gazette.sources.parts import MOST_PARTS, PartsTable
from gazette.streaming.runs import run_batches

# Fixed value: a week starts on Monday 00:00 in Beijing, which is Sunday 16:00 UTC.
WEEK, WEEK_OFFSET = "7 days", "88 hours"


def dedup_stream(entries: DataFrame, time: str = "published_at", lateness: str = "14 days", salts: int = 16) -> DataFrame:
    """One entry per link and title among those that arrive within `lateness` of each other.

    A first pass drops copies within `salts` parts of each key, so an entry copied very often does
    not pass one task; the second pass sees at most `salts` copies of it per batch.
    """
    keyed = entries.withColumn("entry_key", entry_key(F.col("link"), F.col("title")))
    spread = keyed.withColumn("_salt", F.pmod(F.xxhash64("entry_id"), F.lit(salts)))
    return (
        spread.withWatermark(time, lateness)
        .dropDuplicatesWithinWatermark(["entry_key", "_salt"])
        .dropDuplicatesWithinWatermark(["entry_key"])
        .drop("_salt")
    )


def _weekly(entries: DataFrame, time: str, lateness: str) -> DataFrame:
    week = F.window(time, WEEK, WEEK, WEEK_OFFSET)
    stats = entries.withWatermark(time, lateness).groupBy(week.alias("week"), "feed_url")
    return stats.agg(F.count("*").alias("n_entries"), F.max("heat_score").alias("best_heat"), F.max(time).alias("latest")).select(
        F.to_date(F.from_utc_timestamp("week.start", "Asia/Shanghai")).alias("week_start"),
        "feed_url",
        "n_entries",
        "best_heat",
        F.col("week.end").alias("week_end"),
        "latest",
    )


def weekly_feed_stats(entries: DataFrame, time: str = "published_at", lateness: str = "2 days") -> DataFrame:
    """Entries and best heat per feed and issue week; rows behind the watermark are left out."""
    return _weekly(entries, time, lateness).drop("week_end", "latest")


class WeeklyTable:
    """Figures per feed and week as a stream updates them: `open` holds versions, `closed` the rows of past weeks.

    Once `most` batches have written, the newest version of each open row stays, and weeks that no later entry can
    reach any more move to `closed`, each once. So reading costs the rows of the result and those of the last
    few batches, and no closed row is ranked or merged with open ones again.

    A week is closed by the times of the batches up to the one before the last: what the stream itself takes for late
    is never older. Weeks close in order; should a closed week get a row all the same, as when a stream is
    begun anew over an old table, the closed row stands.
    """

    KEY = ["week_start", "feed_url"]
    CLOSED_PARTS = 64  # a part of `closed` is written at most once a week closes

    def __init__(self, spark: SparkSession, path: str, schema, lateness: str, most: int = MOST_PARTS):
        self.open, self.closed = PartsTable(spark, f"{path}/open", schema), PartsTable(spark, f"{path}/closed", schema)
        self.lateness, self.most = lateness, most

    def _newest(self, rows: DataFrame) -> DataFrame:
        return first_per(rows, self.KEY, [F.desc("part")])

    def _unclosed(self, rows: DataFrame) -> DataFrame:
        last = self.closed.read().agg(F.max("week_start")).scalar()
        return rows.filter(last.isNull() | (F.col("week_start") > last))

    def settle(self, batch_id: int) -> None:
        """Closes weeks and merges the open rows, ahead of a batch's own write. May be repeated."""
        if sum(p.number < batch_id for p in self.open.parts()) <= self.most:
            return
        rows = self._newest(self._unclosed(self.open.read(before=batch_id))).checkpoint()
        seen = rows.filter(F.col("part") < batch_id - 1).agg(F.max("latest").alias("latest"))
        until = seen.select(F.unix_micros(F.col("latest") - F.expr(f"INTERVAL {self.lateness}"))).first()[0]
        over = F.lit(False) if until is None else F.unix_micros("week_end") <= until
        done = rows.filter(over)
        if not done.isEmpty():
            self.closed.compact(lambda old: old, before=batch_id, most=self.CLOSED_PARTS)
            self.closed.add(done.drop("part"), batch_id)
        self.open.compact(lambda old: rows.filter(~over), before=batch_id, most=self.most)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self.settle(batch_id)
        self.open.add(rows, batch_id)

    def read(self) -> DataFrame:
        now = self._newest(self._unclosed(self.open.read()))
        return self.closed.read().unionByName(now).drop("part", "week_end", "latest")


def weekly_feed_table(
    entries: DataFrame, path: str, checkpoint: str, time: str = "published_at", lateness: str = "2 days", most: int = MOST_PARTS
) -> DataFrame:
    """Runs the stream of entries; returns the figures of `weekly_feed_stats`, one row per feed and week."""
    stats = _weekly(entries, time, lateness)
    table = WeeklyTable(entries.sparkSession, path, stats.schema, lateness, most)
    run_batches(stats, table.write, checkpoint, "update")
    return table.read()
