"""The edge rows of the subscriber table."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gazette.functions import keywords as K
from gazette.operators import audience as A
from gazette.operators import integrity as I
from gazette.operators import reporting as R
from gazette.operators.common import hot_keys, split_join
from gazette.operators.issues import upsert_issues
from gazette.schemas import SEND_LOG, SUBSCRIBERS, WEEKLY_ISSUES
from gazette.sources.tables import IssueItems, write_lines


def ts(text):
    return datetime.fromisoformat(text) if text else None


ROWS = [
    (1, "a@example.com", "active", "normal", '["ai","agent","model"]', "2026-04-08 20:00:48", "2026-04-08 14:00:48"),
    (2, "b@example.com", "active", "normal", '["AI","ai"," ai "]', "2026-04-07 21:10:45", "2026-04-08 09:51:21"),
    (3, "c+100@example.com", "pending", "normal", '["ai"]', "2026-04-13 22:36:20", None),
    (4, "d@example.com", "unsubscribed", "simple", '{"keywords":["x","x"]}', "2026-04-01 00:00:00", "2026-04-02 00:00:00"),
    (5, 'E%_"q@Example.com', "active", "simple", "not json", "2026-04-01 00:00:00", None),
    (6, "f@example.com", "active", "other", '[1,null,"",{"k":1}]', "2026-04-01 00:00:00", "2026-04-02 00:00:00.5"),
]


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (i, e, m, k, s, f"c{i}", f"u{i}", f"m{i}", ts(c), ts(d)) for i, e, s, m, k, c, d in ROWS
    ]
    return spark.createDataFrame(rows, SUBSCRIBERS)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, 1, 1, "weekly:x:1", ts("2026-04-09 01:00:00")), (2, 1, None, "manual_resend", ts("2026-04-10 01:00:00.25")),
            (3, 9, 1, "weekly:x:9", ts("2026-04-09 01:00:00"))]
    return spark.createDataFrame(rows, SEND_LOG)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_keywords(spark, people):
    got = {r.id: r.k for r in people.select("id", K.keywords_parse(F.col("keywords_json")).alias("k")).collect()}
    assert got == {1: ["ai", "agent", "model"], 2: ["AI", "ai"], 3: ["ai"], 4: ["x"], 5: [], 6: []}
    odd = spark.createDataFrame([("null",), ("",), (None,), ('{"keywords":"x"}',), ('"x"',), ('["　a "]',)], "j string")
    got = [r[0] for r in odd.coalesce(1).select(K.keywords_parse(F.col("j"))).collect()]
    assert got == [[], [], [], [], [], ["a"]]


def test_top_keywords_count_case_variants_twice_and_keep_first_seen_order(people):
    got = [(r.keyword, r.active_confirmed_count) for r in R.top_keywords(people).collect()]
    assert got == [("ai", 3), ("agent", 1), ("model", 1)]


def test_metrics(people):
    assert R.audience_metrics(people).first().asDict() == {
        "total": 6, "active_confirmed": 3, "pending": 1, "unsubscribed": 1,
    }
    assert ids(A.eligible(people)) == [1, 2, 6]


def test_filters(people):
    assert ids(A.by_status(people, " active ")) == [1, 2, 5, 6]
    assert ids(A.by_status(people, "gone")) == [1, 2, 3, 4, 5, 6]
    assert ids(A.by_email_text(people, "e%_")) == [1, 2, 3, 4, 5, 6]  # wildcards stay alive
    assert ids(A.by_email_text(people, "C+1")) == [3]
    assert ids(A.by_keyword(people, "AGENT ")) == [1]
    assert ids(A.target_email(people, " A@Example.com")) == [1]


def test_page_filters_keyword_after_the_cut(people, log):
    page = R.subscribers_page(people, log, keyword="agent", limit=1)
    assert page.count() == 0  # the newest row is id 3
    assert ids(R.subscribers_page(people, log, keyword="agent", limit=1, keyword_after_page=False)) == [1]
    rows = R.subscribers_page(people, log, limit=500, offset=-3).collect()
    assert [r.id for r in rows][:3] == [3, 1, 2] and len(rows) == 6
    second = R.subscribers_page(people, log, limit=2, after=(ts("2026-04-08 20:00:48"), 1)).collect()
    assert [r.id for r in second] == [r.id for r in rows][2:4]
    one = {r.id: r for r in rows}
    assert (one[1].send_count, one[1].last_sent_at) == (2, "2026-04-10 01:00:00.250000")
    assert (one[2].send_count, one[2].last_sent_at) == (0, None)
    assert one[6].confirmed_at == "2026-04-02 00:00:00.500000"


@pytest.mark.parametrize("skip", [0, 7, 900, 2000, 2590, 2995, 3000, 4000])
def test_pages_by_rank(spark, skip):
    # A third of all rows share one time, some have none; ids are far apart.
    rows = spark.range(3000).select(
        (F.xxhash64("id") % 10**15).alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("2026-01-01").cast("timestamp"))
        .when(F.col("id") % 50 > 0, F.timestamp_seconds(1767225600 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9_000_000))))
        .alias("created_at"),
    ).checkpoint()
    want = [r.id for r in rows.orderBy(F.desc("created_at"), "id").collect()][skip : skip + 20]
    keys = rows.withColumn("_t", F.coalesce(-F.unix_micros("created_at"), F.lit(1 << 62)))
    cut, rest = R.from_rank(keys, ["_t", "id"], skip, 20)
    assert rest < 20 or not want
    assert [r.id for r in cut.orderBy("_t", "id").offset(rest).limit(20).collect()] == want


def test_deep_pages_equal_shallow_ones(people, log):
    for skip in range(8):
        for extra in ({}, {"status": "active"}, {"keyword": "ai", "keyword_after_page": False}):
            plain, deep = (R.subscribers_page(people, log, limit=2, offset=skip, deep=d, **extra).collect() for d in (4096, 0))
            assert plain == deep


def test_only_hot_keys_are_split(spark):
    rows = spark.range(9000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("key"))
    found = hot_keys(rows, ["key"], 32).collect()
    assert [r["_copies"] for r in found] == [11]  # a third of 32 shares
    assert hot_keys(rows.filter("key <> 7"), ["key"], 32).count() == 0
    assert hot_keys(rows.limit(0), ["key"], 32).count() == 0
    # Keys of another type on the right, rows without a key on the left.
    left = rows.unionByName(spark.createDataFrame([(-1, None), (-2, None)], "n long, key int"))
    right = spark.createDataFrame([(7, "a"), (8, "b"), (None, "c"), (1 << 40, "d")], "key long, v string")
    for how in ("inner", "left", "left_anti"):
        got = split_join(left, right, ["key"], how, ["n"], tasks=32)
        want = left.join(right, "key", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_export(spark, people, tmp_path):
    out = str(tmp_path / "csv")
    write_lines(R.export_lines(people), out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("﻿id,email,status,mode,keywords,created_at,confirmed_at\n3,")
    assert '5,"E%_""q@Example.com",active,simple,"",2026-04-01 00:00:00,\n' in text
    assert '1,"a@example.com",active,normal,"ai;agent;model",2026-04-08 20:00:48,2026-04-08 14:00:48\n' in text
    kept = [r.line for r in R.export_lines(people, status="active", keyword="ai").collect()]
    assert [line.split(",")[0] for line in kept[1:]] == ["1", "2"]


def test_lookup_takes_the_newest_holder_and_survives_a_hot_key(spark, people):
    twice = people.unionByName(people.filter("id = 1").withColumn("id", F.lit(10).cast("long")).withColumn(
        "created_at", F.lit("2027-01-01").cast("timestamp")))
    asked = spark.range(500).select(F.col("id").alias("n"), F.when(F.col("id") < 400, "m1").otherwise("m2").alias("manage_token"))
    got = A.lookup(asked, twice, "manage_token").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {10: 400, 2: 100}


def test_integrity(spark, people, log):
    gone = spark.createDataFrame([(1,)], "id long")
    kept, rest = I.purge_subscribers(people, log, gone)
    assert ids(kept) == [2, 3, 4, 5, 6] and ids(rest) == [3]
    released = I.release_children(log, "issue_id", gone, ["id"])
    assert {r.id: r.issue_id for r in released.collect()} == {1: None, 2: None, 3: None}
    left = I.orphans(log, "subscriber_id", people, "id", "x").collect()
    assert [(r.ref_id, r.n_rows) for r in left] == [(9, 1)]


def test_changes_respect_their_guards(spark, people):
    shape = (
        "change_id long, email string, if_status string, token_kind string, if_token string, new_mode string, "
        "new_keywords_json string, new_status string, new_confirm_token string, new_unsubscribe_token string, "
        "new_manage_token string, new_confirmed_at timestamp, clear_confirmed boolean"
    )
    rows = [
        (1, "A@example.com", "active", None, None, "simple", None, None, None, None, None, None, False),
        (2, "b@example.com", None, "manage_token", "wrong", "simple", None, None, None, None, None, None, False),
        (3, "d@example.com", "unsubscribed", None, None, None, None, "pending", "c", "u", "m", None, True),
        (4, "c+100@example.com", None, "confirm_token", "c3", None, None, "active", None, None, None, ts("2026-05-01"), False),
        (5, "nobody@example.com", None, None, None, "simple", None, None, None, None, None, None, False),
    ]
    got = {r.id: r for r in A.apply_changes(people, spark.createDataFrame(rows, shape)).collect()}
    assert len(got) == 6 and got[1].mode == "simple" and got[2].mode == "normal"
    assert (got[4].status, got[4].confirmed_at, got[4].manage_token) == ("pending", None, "m")
    assert (got[3].status, got[3].confirmed_at) == ("active", ts("2026-05-01"))


CHANGE = (
    "change_id long, email string, if_status string, token_kind string, if_token string, new_mode string, "
    "new_keywords_json string, new_status string, new_confirm_token string, new_unsubscribe_token string, "
    "new_manage_token string, new_confirmed_at timestamp, clear_confirmed boolean"
)


@pytest.mark.parametrize("limit,run", [(16_384, 16_384), (2, 3)])
def test_changes_apply_one_after_the_other(spark, people, limit, run):
    none = (None,) * 4
    rows = [
        (1, "a@example.com", "active", None, None, None, None, "unsubscribed", *none, False),
        (2, "a@example.com", "active", None, None, "simple", None, None, *none, False),  # no longer active: refused
        (3, "a@example.com", "unsubscribed", None, None, "simple", None, "pending", "c9", "u9", "m9", None, True),
        (4, "A@example.com ", None, "confirm_token", "c1", None, None, "active", *none, False),  # an old token: refused
        (5, "a@example.com", "pending", "confirm_token", "c9", None, None, "active", None, None, None, ts("2026-05-01"), False),
        (6, "a@example.com", "active", "manage_token", "m9", None, '["x"]', None, *none, False),
        (7, "a@example.com", None, "manage_token", "wrong", "normal", None, None, *none, False),  # the last one: refused
        (8, "b@example.com", None, None, None, "simple", None, None, *none, False),
    ]
    changes = spark.createDataFrame(rows, CHANGE)
    got = {r.id: r for r in A.apply_changes(people, changes, limit, run).collect()}
    assert len(got) == 6 and got[2].mode == "simple" and got[3].mode == "normal"
    assert (got[1].status, got[1].mode, got[1].keywords_json, got[1].manage_token) == ("active", "simple", '["x"]', "m9")
    assert got[1].confirmed_at == ts("2026-05-01")
    refused = {tuple(r) for r in A.refused_changes(people, changes, limit, run).collect()}
    assert refused == {(1, 2), (1, 4), (1, 7)}


def test_a_build_touches_only_the_newest_row_of_a_period(spark):
    day, texts = datetime(2026, 4, 6).date(), ("s", "n", "[]", "{}")
    store = spark.createDataFrame(
        [(1, day, *texts, "draft", None, ts("2026-04-06")), (2, day, *texts, "draft", None, ts("2026-04-07"))], WEEKLY_ISSUES
    )
    later = [datetime(2026, 4, d).date() for d in (13, 14)]
    built = spark.createDataFrame([(d, True, "S", "N", "[]", "{}") for d in (day, *later)], "period_start date, has_items boolean, simple_text string, normal_text string, glossary_json string, payload_json string")
    got = {r.id: r for r in upsert_issues(store, built, F.lit("2026-04-08").cast("timestamp")).collect()}
    assert {i: (r.status, r.simple_text) for i, r in got.items()} == {1: ("draft", "s"), 2: ("ready", "S"), 3: ("ready", "S"), 4: ("ready", "S")}
    assert [got[3].period_start, got[4].period_start] == later


def test_a_rebuilt_issue_without_items_ends_empty(spark, tmp_path):
    schema = "id long, issue_id long"
    table = IssueItems(spark, str(tmp_path / "items"), schema)
    table.replace(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], schema))
    table.replace(spark.createDataFrame([(4, 1)], schema), spark.createDataFrame([(1,), (2,)], "issue_id long"))
    assert sorted(map(tuple, table.read().select("id", "issue_id").collect())) == [(3, 3), (4, 1)]
