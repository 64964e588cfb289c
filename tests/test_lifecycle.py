"""The fold against a plain Python replay, for short and for long histories."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators.lifecycle import lifecycle_fold, lifecycle_rejects, subscriber_rows
from gazette.schemas import ACTIONS, SUBSCRIBERS

KINDS = ["subscribe", "confirm", "unsubscribe", "manage", "resend_confirmation", "admin_unsubscribe"]
T0 = datetime(2024, 1, 1)


def histories(seed: int, users: int, most: int) -> list[tuple]:
    """Random actions, tokens mostly right, some stale, some made up; ids not in time order."""
    rnd = random.Random(seed)
    rows, event_id = [], 0
    for u in range(users):
        issued: list[str] = []
        n = rnd.randint(1, most)
        ids = rnd.sample(range(event_id, event_id + n), n)
        event_id += n
        for i in range(n):
            action = rnd.choice(KINDS)
            if action in ("subscribe", "resend_confirmation"):
                token = f"{u}-{i}"
                issued.append(token)
            elif issued and rnd.random() < 0.7:
                token = issued[-1]
            elif issued and rnd.random() < 0.6:
                token = rnd.choice(issued)
            else:
                token = rnd.choice([None, "made up"])
            # Equal times now and then: the id decides.
            ts = T0 + timedelta(seconds=i // 2)
            rows.append((ids[i], f"u{u}", ts, action, token, rnd.choice(["simple", "normal", "odd"]),
                         [f"k{i}"], rnd.random() < 0.8))
    return rows


def replay(rows: list[tuple], check: bool):
    states, refused = {}, []
    for eid, email, ts, action, token, mode, kws, mail_ok in sorted(rows, key=lambda r: (r[2], r[0])):
        s = states.setdefault(email, {"status": None, "mode": None, "kws": None, "conf": None, "token": None, "n": 0})
        match = s["status"] is not None and (not check or (token is not None and s["token"] == token))
        why = None
        if action == "subscribe":
            if s["status"] == "active":
                why = "already subscribed"
            elif s["status"] is None and not mail_ok:
                why = "mail failed"
            else:
                s.update(status="pending", mode=mode, kws=kws, conf=None, token=token)
        elif action == "confirm":
            if not match:
                why = "invalid token"
            elif s["status"] != "pending":
                why = "already confirmed"
            else:
                s.update(status="active", conf=ts)
        elif action == "unsubscribe":
            if match:
                s.update(status="unsubscribed")
            else:
                why = "unknown token"
        elif action == "admin_unsubscribe":
            if s["status"] is None:
                why = "not found"
            else:
                s.update(status="unsubscribed")
        elif action == "manage":
            if not match or s["status"] != "active":
                why = "invalid link"
            elif mode not in ("simple", "normal"):
                why = "invalid mode"
            else:
                s.update(mode=mode, kws=kws)
        elif s["status"] is None:
            why = "not found"
        elif s["status"] == "active":
            why = "already confirmed"
        else:
            s.update(status="pending", conf=None, token=token)
        if why:
            s["n"] += 1
            refused.append((email, eid, action, why))
    return {(e, s["status"], s["mode"], tuple(s["kws"] or ()), s["conf"], s["token"], s["n"]) for e, s in states.items()}, set(refused)


@pytest.mark.parametrize("check", [True, False])
@pytest.mark.parametrize("limit,run", [(50_000, 4096), (5, 4), (0, 2)])
def test_fold_equals_replay(spark, check, limit, run):
    rows = histories(seed=limit + run, users=40, most=60)
    df = spark.createDataFrame(rows, ACTIONS)
    want, refused = replay(rows, check)
    got = {
        (r.email, r.status, r.mode, tuple(r.keywords or ()), r.confirmed_at, r.token, r.rejects)
        for r in lifecycle_fold(df, check, limit, run).collect()
    }
    assert got == want
    out = {tuple(r) for r in lifecycle_rejects(df, check, limit, run).select("email", "event_id", "action", "reason").collect()}
    assert out == refused


def test_one_hot_address(spark):
    rows = histories(seed=7, users=1, most=3000) + [
        (r[0] + 10_000, "x" + r[1], *r[2:]) for r in histories(seed=8, users=30, most=20)
    ]
    df = spark.createDataFrame(rows, ACTIONS).repartition(6)
    want, _ = replay(rows, True)
    got = {
        (r.email, r.status, r.mode, tuple(r.keywords or ()), r.confirmed_at, r.token, r.rejects)
        for r in lifecycle_fold(df, True, gather_limit=100, run=64).collect()
    }
    assert got == want


def test_many_tokens_cost_no_more(spark):
    """A long history that shows a new token with every action: time is linear in its length."""
    rows = []
    for i in range(32_768):
        action = ["subscribe", "confirm", "manage", "unsubscribe", "manage", "resend_confirmation"][i % 6]
        rows.append((i, "u", T0 + timedelta(seconds=i), action, f"t{i - i % 6}" if i % 5 else f"x{i}", "simple", [f"k{i}"], True))
    df = spark.createDataFrame(rows, ACTIONS).repartition(4)
    want, refused = replay(rows, True)
    started = time.perf_counter()
    got = {
        (r.email, r.status, r.mode, tuple(r.keywords or ()), r.confirmed_at, r.token, r.rejects)
        for r in lifecycle_fold(df, gather_limit=0, run=8192).collect()
    }
    assert got == want and time.perf_counter() - started < 60
    assert lifecycle_rejects(df, gather_limit=0, run=8192).count() == len(refused)


@pytest.mark.parametrize("limit,run", [(50_000, 4096), (3, 4)])
def test_half_and_then_the_rest(spark, limit, run):
    rows = histories(seed=21, users=30, most=40)
    df = spark.createDataFrame(rows, ACTIONS)
    middle = F.lit(T0 + timedelta(seconds=9))
    first = lifecycle_fold(df.filter(F.col("ts") < middle), True, limit, run).checkpoint()
    whole = lifecycle_fold(df.filter(F.col("ts") >= middle), True, limit, run, start=first)
    columns = ["email", "status", "mode", "keywords", "confirmed_at", "token", "rejects", "created_at"]
    want = {str(tuple(r)) for r in lifecycle_fold(df).select(columns).collect()}
    assert {str(tuple(r)) for r in whole.select(columns).collect()} == want
    rest = lifecycle_rejects(df.filter(F.col("ts") >= middle), True, limit, run, start=first).count()
    assert rest + lifecycle_rejects(df.filter(F.col("ts") < middle), True, limit, run).count() == len(replay(rows, True)[1])


def test_folded_states_become_rows(spark):
    rows = [
        (1, "A@x", T0, "subscribe", "t1", "simple", ["k"], True), (2, "b@x", T0, "subscribe", "t2", "normal", [], True),
        (3, "b@x", T0 + timedelta(1), "confirm", "t2", None, None, True), (4, "c@x", T0, "subscribe", "t3", "simple", [], False),
    ]
    people = [(7, "a@X", "normal", "[]", "unsubscribed", "c", "u", "m", T0 - timedelta(9), None), (9, "z@x", "normal", "[]", "active", "c", "u", "m", T0, T0)]
    got = {r.id: r for r in subscriber_rows(lifecycle_fold(spark.createDataFrame(rows, ACTIONS)), spark.createDataFrame(people, SUBSCRIBERS)).collect()}
    assert sorted(got) == [7, 9, 10]
    assert (got[7].status, got[7].created_at, got[7].manage_token, got[7].email) == ("pending", T0 - timedelta(9), "t1", "a@X")
    assert (got[10].email, got[10].status, got[10].created_at, got[10].keywords_json) == ("b@x", "active", T0, "[]")
    assert got[9].confirm_token == "c"
