"""Tables of parts with a manifest, and what stands on them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.functions.keys import entry_key
from gazette.operators.lifecycle import lifecycle_fold
from gazette.schemas import ACTIONS
from gazette.sources.parts import PartsTable, WriteConflict
from gazette.sources.tables import IssueItems
from gazette.streaming import lifecycle, seen
from test_lifecycle import histories

T0 = datetime(2024, 1, 1)


def numbers(rows):
    return sorted((r.k, r.part) for r in rows.collect())


def test_parts_are_added_replaced_and_merged(spark, tmp_path):
    table = PartsTable(spark, str(tmp_path / "t"), "k string, v int", "k", 4)
    rows = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k string, v int")
    assert table.read().count() == 0 and table.parts() == []
    assert [table.add(rows("a", "b")), table.add(rows("c")), table.add(rows())] == [0, 1, 2]
    table.add(rows("d", "e"), 1)  # a repeated write takes the place of its part
    assert numbers(table.read()) == [("a", 0), ("b", 0), ("d", 1), ("e", 1)]
    assert numbers(table.read(before=1)) == [("a", 0), ("b", 0)]
    hit = [r[0] for r in rows("d").select(table.bucket("k")).collect()]
    assert ("d", 1) in numbers(table.read(buckets=hit)) and len(numbers(table.read(buckets=hit))) < 4
    assert table.read(buckets=[]).count() == 0
    assert not table.compact(lambda old: old, most=3)
    assert table.compact(lambda old: old, before=2, most=1)
    assert [p.number for p in table.parts()] == [1, 2]
    assert numbers(table.read()) == [("a", 0), ("b", 0), ("d", 1), ("e", 1)]
    assert len(table.files.names(table.path + "/manifests")) <= 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    table = PartsTable(spark, str(tmp_path / "t"), "k string")
    table.add(spark.createDataFrame([("a",)], "k string"))
    version, parts = max(table.versions()), table.parts()
    table.add(spark.createDataFrame([("b",)], "k string"))
    with pytest.raises(WriteConflict):
        table.publish(parts, version)
    assert sorted(r.k for r in table.read().collect()) == ["a", "b"]


def test_any_number_of_issues_is_one_write(spark, tmp_path):
    schema = "id long, issue_id long"
    table = IssueItems(spark, str(tmp_path / "i"), schema)
    table.replace(spark.range(1000).select("id", (F.col("id") % 200).alias("issue_id")))
    table.replace(spark.createDataFrame([(5000, 7), (5001, None)], schema), spark.range(100).select(F.col("id").alias("issue_id")))
    want = sorted([(i, i % 200) for i in range(1000) if i % 200 >= 100] + [(5000, 7)])
    got = lambda: sorted((r.id, r.issue_id) for r in table.read().collect() if r.issue_id is not None)
    assert got() == want and table.read().filter("issue_id IS NULL").count() == 1
    assert [p.number for p in table.table.parts()] == [0, 1]
    table.replace(spark.createDataFrame([(6000, 150)], schema))
    want = sorted([x for x in want if x[1] != 150] + [(6000, 150)])
    assert table.compact(most=1) and len(table.table.parts()) == 1
    assert got() == want
    table.replace(spark.createDataFrame([], schema), spark.createDataFrame([(150,)], "issue_id long"))
    assert got() == [x for x in want if x[1] != 150]


def arriving(spark, batches, schema, path):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


ENTRY = "entry_id long, title string, link string, published_at timestamp"


def test_copies_however_far_apart_come_once(spark, tmp_path):
    rnd = random.Random(3)
    batches = [[(b * 100 + i, f"t{rnd.randrange(150)}", rnd.choice(["u", "v", None]), T0 + timedelta(days=40 * b) if i % 9 else None) for i in range(90)] for b in range(11)]
    stream = arriving(spark, batches, ENTRY, tmp_path / "in")
    kept = seen.first_entries(stream, str(tmp_path / "kept"), str(tmp_path / "s"), buckets=4)
    rows = [r for b in batches for r in b]
    given = spark.createDataFrame(rows, ENTRY).withColumn("entry_key", entry_key(F.coalesce("link", F.lit("")), F.col("title")))
    want = {r.entry_key: r.first for r in given.groupBy("entry_key").agg(F.min("entry_id").alias("first")).collect()}
    got = [(r.entry_key, r.entry_id) for r in kept.collect()]
    assert len(got) == len(want) and dict(got) == want
    # Eleven batches, yet few parts.
    table = PartsTable(spark, str(tmp_path / "kept/kept"), ENTRY + ", entry_key string", "entry_key", 4)
    assert len(table.parts()) <= 10


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    spark_rows = lambda *rows: spark.createDataFrame(list(rows), "entry_key string, n int")
    keys = seen.SeenKeys(spark, str(tmp_path / "k"), "entry_key string, n int")
    keys.keep(spark_rows(("a", 1), ("b", 1)), 0)
    keys.keep(spark_rows(("b", 2), ("c", 2)), 1)
    keys.keep(spark_rows(("b", 2), ("c", 2)), 1)
    assert sorted((r.entry_key, r.n) for r in keys.kept.read().collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_full_filters_lose_nothing(spark, tmp_path, monkeypatch):
    """Filters of eight bits say yes to nearly everything: slower, not wrong. New keys are told apart by wide ones."""
    monkeypatch.setattr(seen, "BITS", 8)
    rows = lambda start: spark.range(start, start + 40).select(F.col("id").cast("string").alias("entry_key"))
    keys = seen.SeenKeys(spark, str(tmp_path / "k"), "entry_key string")
    for batch, start in enumerate((0, 20, 200)):
        keys.keep(rows(start), batch)
    assert sorted(int(r[0]) for r in keys.kept.read().select("entry_key").collect()) == [*range(60), *range(200, 240)]
    monkeypatch.setattr(seen, "BITS", 1 << 16)
    wide = seen.SeenKeys(spark, str(tmp_path / "w"), "entry_key string")
    wide.keep(rows(0), 0)
    assert {r[0] for r in wide.maybe_seen(rows(20), 1).collect()} >= {str(i) for i in range(20, 40)}
    assert wide.maybe_seen(rows(5000), 1).count() < 5


def test_states_stay_few_over_many_batches(spark, tmp_path):
    rows = sorted(histories(seed=31, users=20, most=30), key=lambda r: (r[2], r[0]))
    times = sorted({r[2] for r in rows})
    batches = [[r for r in rows if r[2] in times[k::1][:1]] for k in range(len(times))][:10]
    used = [r for b in batches for r in b]
    stream = arriving(spark, [b for b in batches if b], ACTIONS, tmp_path / "in")
    versions = lifecycle.lifecycle_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), buckets=4)
    columns = ["email", "status", "mode", "keywords", "confirmed_at", "token", "rejects"]
    got = {str(tuple(r)) for r in lifecycle.current_states(versions).select(columns).collect()}
    assert got == {str(tuple(r)) for r in lifecycle_fold(spark.createDataFrame(used, ACTIONS)).select(columns).collect()}
    assert versions.select("batch_id").distinct().count() <= 10
    table = PartsTable(spark, str(tmp_path / "out"), lifecycle.VERSION, "email", 4)
    assert len(table.parts()) <= 10
