"""Shared shapes: first rows per key, and joins that stay even on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
#: Keys that may be named as hot, those a sketch tracks to find them, and parts that a hot key is split into at most.
HOT, TRACKED, MOST_COPIES = 1024, 16_384, 1024


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that cost much to work out, in a form no later filter can repeat.

    Spark moves filters below projections by copying the projected expressions into them; it does
    not move them below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt out evenly over the shuffle's tasks, for work per row that costs far more than reading it.

    A file of few dense row groups is read by as few tasks. Rows are dealt by their position: no key can be hot
    and nothing is sorted. The number of tasks is named, so that small rows are not put together again.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.monotonically_increasing_id())


def first_per(df: DataFrame, keys: list[Column | str], order: list[Column], most: int = 1, rank: str | None = None) -> DataFrame:
    """The first `most` rows of each key.

    The rank is filtered in the form Spark turns into a limit per group ahead of the shuffle, so
    each task sends at most `most` rows per key, however many rows the key holds.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= most)
    return kept if rank else kept.drop(name)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str], salts: int = SALTS) -> DataFrame:
    """A join whose left side may hold very many rows of one key.

    Left rows of a key are spread over `salts` parts by `spread`; the right side, one row per key,
    is repeated once per part.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    joined = left.withColumn("_salt", salt).join(
        right.withColumn("_salt", parts), [*on, "_salt"], how
    )
    return joined.drop("_salt")


def hot_keys(rows: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """Keys that hold more than one of `tasks` equal shares of `rows`: `_key` (a hash) and `_copies`, the shares it holds.

    A sketch of fixed size per task finds them in one pass over the key columns, so there are at most `HOT` rows, and
    all copies together are at most `tasks + HOT`. A key that the sketch misses costs time only.
    """
    top = rows.select(F.xxhash64(*on).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {HOT}, {TRACKED})").alias("_top"), F.count("*").alias("_rows")
    )
    shares = F.ceil(F.col("count") * F.lit(tasks) / F.col("_rows")).cast("int")
    counted = top.select("_rows", F.inline("_top")).select(F.col("item").alias("_key"), shares.alias("_copies"))
    return counted.filter("_copies > 1")


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str], tasks: int | None = None) -> DataFrame:
    """A join whose left side may hold very many rows of some keys; only those keys are split.

    Left rows of a hot key are spread by `spread` over as many parts as the key holds shares of a task; the
    right side, one row per key, is repeated that often. Any other key has one copy, and without a hot key
    nothing is repeated. The left side is read twice, the first time its keys only.
    """
    parts = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, on, min(max(parts, 2), MOST_COPIES)))  # at most HOT rows
    types = {f.name: f.dataType for f in left.schema.fields}
    same = [F.col(c).try_cast(types[c]) for c in on]  # equal keys have equal hashes
    copies = F.coalesce("_copies", F.lit(1))
    salted = (
        left.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), copies).cast("int")).drop("_key", "_copies")
    )
    repeated = (
        right.withColumn("_key", F.xxhash64(*same)).join(hot, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_key", "_copies")
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with numbers from 0 in order of columns that tell its rows apart, without bringing it to one task.

    The sorted rows are stored once, so that both uses below see the same order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return rows.join(sizes, "_part").withColumn(name, F.col("_ahead") + F.col("_at")).drop("_part", "_at", "_ahead")
