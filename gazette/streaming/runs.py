"""Running streams to the end of what has arrived, and the tables they keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators.common import first_per


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch as its own partition; a repeated batch replaces itself."""
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Each micro-batch of `stream` under `path`, one partition per batch."""
    start_table(stream, path)
    run_batches(stream, lambda rows, batch_id: write_batch(rows, batch_id, path), checkpoint, mode)
    return read_batches(stream, path)


def start_table(like: DataFrame, path: str) -> None:
    """An empty table, so that a stream without rows can be read too."""
    empty = like.sparkSession.createDataFrame([], like.schema)
    empty.write.mode("append").parquet(f"{path}/batch_id=-1")


def read_batches(like: DataFrame, path: str) -> DataFrame:
    schema = like.select("*", F.lit(0).cast("long").alias("batch_id")).schema
    return like.sparkSession.read.schema(schema).parquet(path).filter(F.col("batch_id") >= 0)


def newest_version(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    return first_per(updates, keys, [F.desc("batch_id")]).drop("batch_id")
