"""Shared steps: reading tables, cutting lineage, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.session import shared_dir

#: Rows and bytes that meet in one Python batch.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: small batches for Python, so that long texts do not pile up."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Joins with a filtered table keep rows without a partner out of the shuffle, whatever the sizes:
    # Spark's Bloom filter has a fixed number of bits at most, beyond that it only lets more through.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1t")
    return spark


class Tables:
    """The folders that one run has made for itself, to be removed once its result is written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def remove(self, spark: SparkSession) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


#: Who owns what `stored` writes; nobody outside `owned`, so nothing is removed under a reader.
OWNER: ContextVar[Tables | None] = ContextVar("OWNER", default=None)


@contextmanager
def owned() -> Iterator[Tables]:
    """Within, `stored` notes its folders in the tables given; other runs' folders are never touched."""
    tables = Tables()
    token = OWNER.set(tables)
    try:
        yield tables
    finally:
        OWNER.reset(token)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later steps start from the files."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (tables := OWNER.get()) is not None:
        tables.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """The whole rows of `docs` as one column `given`, beside the named ones: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), *[v.alias(n) for n, v in named.items()])


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until no column bears it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The wanted columns only, a null text as an empty one. Other columns of `docs` never matter."""
    return docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(total: int, size: int) -> Iterator[slice]:
    for start in range(0, total, size):
        yield slice(start, min(total, start + size))
