"""References between the tables: audits and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators.common import split_join


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Keys of `child` rows whose parent is gone, with their row counts.

    Rows are counted per key first, so a key with very many rows is one row in the join.
    """
    counted = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref_id")).agg(
        F.count("*").alias("n_rows")
    )
    known = parent.select(F.col(parent_key).alias("ref_id"))
    return counted.join(known, "ref_id", "left_anti").select(F.lit(name).alias("reference"), "ref_id", "n_rows")


def fk_orphans(raw_items: DataFrame, send_log: DataFrame, issues: DataFrame, subscribers: DataFrame) -> DataFrame:
    return (
        orphans(raw_items, "issue_id", issues, "id", "raw_items.issue_id")
        .unionByName(orphans(send_log, "issue_id", issues, "id", "send_log.issue_id"))
        .unionByName(orphans(send_log, "subscriber_id", subscribers, "id", "send_log.subscriber_id"))
    )


def purge_children(child: DataFrame, key: str, gone: DataFrame, spread: list[str]) -> DataFrame:
    """`child` without the rows of deleted parents (ids in `gone.id`). Rows without a parent stay and
    go round the join."""
    ids = gone.select(F.col("id").alias(key)).distinct()
    kept = split_join(child.filter(F.col(key).isNotNull()), ids, [key], "left_anti", spread)
    return kept.select(*child.columns).unionByName(child.filter(F.col(key).isNull()))


def release_children(child: DataFrame, key: str, gone: DataFrame, spread: list[str]) -> DataFrame:
    """`child` with the reference to deleted parents set to null; rows without one go round the join."""
    ids = gone.select(F.col("id").alias(key), F.lit(True).alias("_gone")).distinct()
    marked = split_join(child.filter(F.col(key).isNotNull()), ids, [key], "left", spread)
    released = marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*child.columns)
    return released.unionByName(child.filter(F.col(key).isNull()))


def purge_subscribers(subscribers: DataFrame, send_log: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after deleting subscribers; their log rows go with them."""
    kept = subscribers.join(gone.select("id").distinct(), "id", "left_anti")
    return kept, purge_children(send_log, "subscriber_id", gone, ["id"])


def purge_issues(issues: DataFrame, raw_items: DataFrame, send_log: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after deleting issues; items and log rows stay, without the reference."""
    kept = issues.join(gone.select("id").distinct(), "id", "left_anti")
    return (
        kept,
        release_children(raw_items, "issue_id", gone, ["id"]),
        release_children(send_log, "issue_id", gone, ["id"]),
    )
