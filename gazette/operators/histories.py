"""Folding the events of a key in order, whatever their number.

Ordinary histories are gathered per key and folded at once. A longer one is sorted over the cluster and
cut into runs of bounded size, so a row never holds more than one run. Where runs can be summed up
(`before`), the states before all of them are found in a tree and all runs are folded at once. Otherwise
they are folded one after the other, each from the stored state before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import shared_dir

GATHER_LIMIT = 16_384  # events of one key that may be gathered into one row
RUN = 16_384  # events per run of a longer history

Fold = Callable[[Column, Column], Column]
# From runs (key, nth, events) and the states at the start (key, s) to the states before each run: key, nth, s.
Before = Callable[[DataFrame, DataFrame], DataFrame]


def _runs(long: DataFrame, key: str, order: list[str], run: int, by_number: bool) -> DataFrame:
    """key, nth, events: histories cut into runs of at most `run` events, numbered from 1.

    The sort spreads one key over many tasks; only the runs' numbers meet per key.
    """
    ordered = long.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    cut = (
        ordered.withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_run", F.floor(place / run))
        .groupBy(key, "_part", "_run")
        .agg(F.array_sort(F.collect_list("x")).alias("events"))
        .checkpoint()
    )
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_part", "_run"))
    numbers = cut.select(key, "_part", "_run").withColumn("nth", nth)
    runs = cut.join(numbers, [key, "_part", "_run"]).select(key, "events", "nth")
    path = shared_dir(long.sparkSession, "runs")
    # Stored by number: a round opens its own runs and no others.
    runs.write.partitionBy(*["nth"] * by_number).parquet(path)
    return long.sparkSession.read.schema(runs.schema).parquet(path)


def fold_rounds(
    events: DataFrame,
    key: str,
    order: list[str],
    fold: Fold,
    start: DataFrame | None = None,
    nothing: Column | None = None,
    gather_limit: int = GATHER_LIMIT,
    run: int = RUN,
    before: Before | None = None,
) -> list[DataFrame]:
    """Results of folding, as frames of `key`, struct `r` and the run's number `nth`: the ordinary histories
    (run 0), then the longer ones, all runs at once or a frame per round.

    `events` has `key`, the `order` columns and struct `x`, which begins with these. `fold(events, state)`
    gives a struct with the state after as `s`. `start` has `key` and the state before, `s`; keys it lacks
    start from `nothing`, or drop out if that is not given. `before` sums runs up (with `nothing`
    given). Rounds are stored, so a lost executor costs one of them.
    """

    def begun(rows: DataFrame, states: DataFrame | None) -> DataFrame:
        if states is None:
            return rows.withColumn("s", nothing)
        joined = rows.join(states.select(key, "s"), key, "inner" if nothing is None else "left")
        return joined if nothing is None else joined.withColumn("s", F.coalesce("s", nothing))

    def folded(rows: DataFrame, nth: Column) -> DataFrame:
        return rows.select(key, fold(F.col("events"), F.col("s")).alias("r"), nth.cast("int").alias("nth"))

    long = events.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > gather_limit).select(key)
    some_long = long.limit(1).count() > 0
    ordinary = events.join(long, key, "left_anti") if some_long else events
    gathered = ordinary.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("events"))
    found = [folded(begun(gathered, start), F.lit(0))]
    if not some_long:
        return found
    runs = _runs(events.join(long, key, "left_semi"), key, order, run, before is None)
    if before is not None:
        states = before(runs, begun(runs.select(key).distinct(), start))
        return [*found, folded(runs.join(states, [key, "nth"]), F.col("nth")).checkpoint()]
    for nth in range(1, runs.agg(F.max("nth")).first()[0] + 1):
        here = runs.filter(F.col("nth") == nth).select(key, "events")
        found.append(folded(begun(here, start), F.lit(nth)).checkpoint())
        start = found[-1].select(key, "r.s")  # whoever has a next run has had this one
        nothing = None
    return found


def last_states(rounds: list[DataFrame], key: str) -> DataFrame:
    """`key` and the state after the last event, `s`: of a long history that of its last run."""
    first = rounds[0].select(key, "r.s")
    if not rounds[1:]:
        return first
    each = [done.select(key, "r.s", "nth") for done in rounds[1:]]
    later = each[0]
    for more in each[1:]:
        later = later.unionByName(more)
    return first.unionByName(later.groupBy(key).agg(F.max_by("s", "nth").alias("s")))
