"""Subscriber state kept per address while actions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.common import first_per
from gazette.operators.lifecycle import STATE_FIELDS, lifecycle_fold
from gazette.schemas import ACTIVE, PENDING, UNSUBSCRIBED
from gazette.sources.parts import PartsTable
from gazette.streaming.runs import newest_version, run_batches

VERSION = (
    "email string, status string, mode string, keywords array<string>, confirmed_at timestamp, token string, "
    "created_at timestamp, rejects long, status_before string, confirmed_before boolean"
)


NAMES = [c.split()[0] for c in VERSION.split(", ")]
BUCKETS = 32  # of the state table, by hash of the address


def _state_table(spark: SparkSession, path: str, buckets: int) -> PartsTable:
    return PartsTable(spark, path, VERSION, "email", buckets)


def _newest(rows: DataFrame) -> DataFrame:
    return first_per(rows, ["email"], [F.desc("part")])


def _advance(rows: DataFrame, batch_id: int, states: PartsTable, check_tokens: bool) -> None:
    """Folds one micro-batch from the states that earlier batches left and writes the new states.

    Only the buckets that the batch's addresses fall in are read. States of finished batches are merged, the newest of each address
    stays; a batch that runs again starts from the same states.
    """
    states.compact(_newest, before=batch_id)
    asked = rows.select("email").distinct()
    hit = sorted(r[0] for r in asked.select(states.bucket("email")).distinct().collect())  # at most all buckets
    start = _newest(states.read(before=batch_id, buckets=hit).join(asked, "email", "left_semi")).select("email", *STATE_FIELDS)
    before = start.select("email", F.col("status").alias("status_before"), F.col("confirmed_at").isNotNull().alias("confirmed_before"))
    now = lifecycle_fold(rows, check_tokens, start=start).join(before, "email", "left")
    now = now.withColumn("confirmed_before", F.coalesce("confirmed_before", F.lit(False)))
    states.add(now.select(*NAMES), batch_id)


def lifecycle_stream(actions: DataFrame, path: str, checkpoint: str, check_tokens: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Runs the stream of actions; returns the table under `path`: states of addresses with the batch that left
    them, and the status before it. Of merged batches only the newest state of an address is there.

    Actions of one batch are applied by time and id, batches in order of arrival: the states are those of
    the batch fold if no action arrives in a later batch than a younger one of its address.
    """
    states = _state_table(actions.sparkSession, path, buckets)
    run_batches(actions, lambda rows, batch_id: _advance(rows, batch_id, states, check_tokens), checkpoint)
    return states.read().withColumnRenamed("part", "batch_id")


def current_states(versions: DataFrame) -> DataFrame:
    """The newest state of each address from the rows of all batches."""
    return newest_version(versions, ["email"]).select("email", *STATE_FIELDS)


def metric_changes(states: DataFrame) -> DataFrame:
    """What a batch of state rows adds to the audience metrics, as one row."""

    def change(now, before):
        return F.coalesce(F.sum(now.cast("long") - before.cast("long")), F.lit(0))

    def is_(name: str, status: str):
        return F.col(name).eqNullSafe(status)

    confirmed = F.col("confirmed_at").isNotNull()
    return states.agg(
        change(F.col("status").isNotNull(), F.col("status_before").isNotNull()).alias("total"),
        change(
            is_("status", ACTIVE) & confirmed, is_("status_before", ACTIVE) & F.col("confirmed_before")
        ).alias("active_confirmed"),
        change(is_("status", PENDING), is_("status_before", PENDING)).alias("pending"),
        change(is_("status", UNSUBSCRIBED), is_("status_before", UNSUBSCRIBED)).alias("unsubscribed"),
    )


def metrics_stream(actions: DataFrame, path: str, checkpoint: str, check_tokens: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Audience metrics kept up while actions arrive; returns them after the last batch.

    Each batch writes its states under `path/states` and one row of changes under `path/metrics`, so a
    batch costs what it brings, not what the audience holds. Rows of finished batches are added up.
    """
    spark = actions.sparkSession
    states = _state_table(spark, f"{path}/states", buckets)
    shape = metric_changes(spark.createDataFrame([], VERSION)).schema
    metrics = PartsTable(spark, f"{path}/metrics", shape)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in shape.names]

    def each(rows: DataFrame, batch_id: int) -> None:
        _advance(rows, batch_id, states, check_tokens)
        metrics.compact(lambda old: old.agg(*sums), before=batch_id)
        metrics.add(metric_changes(states.read().filter(F.col("part") == batch_id)), batch_id)

    run_batches(actions, each, checkpoint)
    return metrics.read().agg(*sums)
