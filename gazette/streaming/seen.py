"""Keys seen first, for de-duplication over the whole life of a stream.

The entries that were kept are a table in buckets of their key's hash; beside it stands a Bloom filter
for every bucket, `BITS` bits in bitmaps of `SEGMENT`. A batch asks the filters about its keys: a key they do not
know is new for certain. Only the others are looked up, in the buckets that they fall in and no others.
The size of the filters is fixed; one that fills up sends more keys to the look-up and loses none.

Both tables carry the number of the batch. A batch looks at earlier batches only and replaces its own part, so it can
run again. Bitmaps of finished batches are merged into one part, and so are the keys' small files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.functions.keys import entry_key
from gazette.operators.common import first_per
from gazette.sources.parts import PartsTable
from gazette.streaming.runs import run_batches

BUCKETS, BITS, HASHES, SEGMENT = 32, 1 << 20, 4, 1 << 15
FILTER = "bucket long, segment long, bits binary"


def _cells(keys: DataFrame, table: PartsTable, key: str) -> DataFrame:
    """The bits of each key: `bucket`, `segment`, `at`."""
    cell = lambda i: F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(BITS))
    each = keys.select(key, table.bucket(key).cast("long").alias("bucket"), F.explode(F.array(*[cell(i) for i in range(HASHES)])).alias("cell"))
    return each.select(key, "bucket", F.floor(F.col("cell") / SEGMENT).alias("segment"), (F.col("cell") % SEGMENT).alias("at"))


def _bit(bits: Column, at: Column) -> Column:
    """Bit `at` of a bitmap as Spark lays it out: the lowest bit of the first byte is bit 0."""
    byte = F.conv(F.hex(F.substr(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(bits.isNull(), F.lit(0)).otherwise(F.getbit(byte, (at % 8).cast("int")))


def merged_bits(filters: DataFrame) -> DataFrame:
    return filters.groupBy("bucket", "segment").agg(F.bitmap_or_agg("bits").alias("bits"))


class SeenKeys:
    """`rows` of the schema given, one per `key`, and the filters over the keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str = "entry_key", buckets: int = BUCKETS):
        self.key = key
        self.kept = PartsTable(spark, f"{path}/kept", schema, key, buckets)
        self.filters = PartsTable(spark, f"{path}/filters", FILTER)

    def maybe_seen(self, keys: DataFrame, before: int) -> DataFrame:
        """The keys whose bits are all set: all that were seen, and few others."""
        bits = merged_bits(self.filters.read(before=before))
        asked = _cells(keys, self.kept, self.key).join(bits, ["bucket", "segment"], "left")
        return asked.groupBy(self.key).agg(F.min(_bit(F.col("bits"), F.col("at"))).alias("set")).filter("set = 1").select(self.key)

    def unseen(self, rows: DataFrame, before: int) -> DataFrame:
        """The rows, one per key, whose key no batch before has kept."""
        maybe = self.maybe_seen(rows.select(self.key), before).persist()
        try:
            hit = sorted(r[0] for r in maybe.select(self.kept.bucket(self.key)).distinct().collect())  # at most all buckets
            known = self.kept.read(before=before, buckets=hit).select(self.key).join(maybe, self.key, "left_semi")
            return rows.join(known.checkpoint(), self.key, "left_anti")
        finally:
            maybe.unpersist()

    def keep(self, rows: DataFrame, batch_id: int) -> None:
        """Adds the rows of a batch whose keys are new; `rows` has each key once."""
        self.kept.compact(lambda old: old, before=batch_id)
        self.filters.compact(merged_bits, before=batch_id)
        self.kept.add(self.unseen(rows, batch_id), batch_id)
        own = self.kept.read().filter(F.col("part") == batch_id).select(self.key)
        cells = _cells(own, self.kept, self.key)
        self.filters.add(cells.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("at").alias("bits")), batch_id)


def first_entries(entries: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """Runs the stream of entries; returns the first one of each link and title, however far apart copies arrive.

    Within a batch the smallest `entry_id` stands; an entry copied very often is cut to one row per task
    ahead of the shuffle. Entries without any time count as well; a null link or title is an empty one.
    """
    blank = F.lit("")
    keyed = entries.withColumn("entry_key", entry_key(F.coalesce("link", blank), F.coalesce("title", blank)))
    seen = SeenKeys(entries.sparkSession, path, keyed.schema, buckets=buckets)

    def each(rows: DataFrame, batch_id: int) -> None:
        first = first_per(rows, ["entry_key"], [F.asc_nulls_last("entry_id")]).persist()
        try:
            seen.keep(first, batch_id)
        finally:
            first.unpersist()

    run_batches(keyed, each, checkpoint)
    return seen.kept.read().drop("part")
