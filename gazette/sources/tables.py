"""Reading and writing the four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.sources.parts import MOST_PARTS, PartsTable


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """A database table, read in parallel key ranges."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, numPartitions=partitions)
        .options(lowerBound=bounds[0], upperBound=bounds[1], **options)
        .load()
    )


class IssueItems:
    """The items of issues, replaced issue by issue and read as of the last replacement.

    A replacement is one write and one manifest: the new items and, in the same part, the ids of the issues that they
    replace. Whatever the number of issues, nothing is listed on the driver and no issue is rewritten that is not
    replaced; readers see all of a replacement or nothing. Of an issue only rows count that are as new as
    its last replacement. Rows without an issue belong to none, so they are only ever added.
    """

    ITEMS = "id long, heat_score int, issue_id long"

    def __init__(self, spark: SparkSession, path: str, schema: str = ITEMS):
        self.table = PartsTable(spark, path, f"{schema}, replaces boolean")

    def replace(self, items: DataFrame, rebuilt: DataFrame | None = None) -> None:
        """Replaces the rows of every issue in `items`, and empties those of `rebuilt` (`issue_id`) without items."""
        ids = items.select("issue_id")
        ids = ids if rebuilt is None else ids.unionByName(rebuilt.select("issue_id"))
        marks = ids.filter("issue_id IS NOT NULL").distinct().withColumn("replaces", F.lit(True))
        rows = items.withColumn("replaces", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        self.table.add(rows.hint("rebalance", "issue_id"))

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        last = rows.filter("replaces").groupBy("issue_id").agg(F.max("part").alias("last"))
        counted = rows.join(last, "issue_id", "left").filter(F.col("issue_id").isNull() | (F.col("part") == F.col("last")))
        return counted.select(*rows.columns)

    def read(self) -> DataFrame:
        rows = self._live(self.table.read())
        return rows.filter(~F.col("replaces")).drop("part", "replaces")

    def compact(self, most: int = MOST_PARTS) -> bool:
        """Merges the parts into one without the rows that no longer count once there are more than `most`."""
        return self.table.compact(self._live, most=most)


def write_log(rows: DataFrame, path: str, source: str | None = None) -> None:
    """Adds log rows, stored by issue; small issues make one file and a large one is split.

    Rows of a named `source` are a part of their own in each issue, which a second write replaces.
    """
    named = rows.withColumn("source", F.lit(source or "run")).hint("rebalance", "issue_id")
    out = named.write.mode("overwrite" if source else "append").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("issue_id", "source").parquet(path)


def append_log(plan: DataFrame, path: str, sent_at: str | None = None, source: str | None = None) -> None:
    """Adds one log row per planned delivery."""
    write_log(log_rows(plan, sent_at), path, source)


def log_rows(plan: DataFrame, sent_at: str | None = None) -> DataFrame:
    now = F.current_timestamp() if sent_at is None else F.lit(sent_at).cast("timestamp")
    return plan.select("subscriber_id", "issue_id", "kind", now.alias("sent_at"))


def write_snapshot(table: DataFrame, path: str) -> None:
    """A table written new; the caller points readers at `path` once it is complete."""
    table.write.mode("errorifexists").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """The `line` column as text files that read in order of their names."""
    lines.select("line").write.mode("errorifexists").text(path)
