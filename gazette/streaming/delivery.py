"""Deliveries planned while subscribers arrive, safe to replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.plans.mailings import weekly_delivery
from gazette.sources.tables import append_log, read_table
from gazette.streaming.runs import read_batches, run_batches, start_table, write_batch

LOG = "subscriber_id long, kind string, sent_at timestamp, issue_id long, source string"


def deliver_stream(
    subscribers: DataFrame,
    issues: DataFrame,
    log_path: str,
    period: Column,
    public_url: str,
    path: str,
    checkpoint: str,
    sent_at: str | None = None,
) -> DataFrame:
    """Plans the weekly mail for each micro-batch of subscribers; returns `subscriber_id, issue_id, kind`.

    The mails go to a table under `path`, then their rows to the send log under `log_path`, each as a
    part that bears the batch's name. A batch looks at the log of this period without its own part, so a
    batch that runs again plans the same mails and replaces both; a batch or a run by hand that comes
    later finds them in the log.
    """
    spark = subscribers.sparkSession
    shape = spark.createDataFrame([], "subscriber_id long, issue_id long, kind string")
    start_table(shape, path)

    def each(rows: DataFrame, batch_id: int) -> None:
        name = f"stream-{batch_id}"
        logged = read_table(spark, log_path, LOG).filter(F.col("source") != name)
        write_batch(weekly_delivery(rows, issues, logged, period, public_url), batch_id, path)
        written = read_batches(shape, path).filter(F.col("batch_id") == batch_id)
        append_log(written, log_path, sent_at, name)

    run_batches(subscribers, each, checkpoint)
    return read_batches(shape, path).drop("batch_id")
