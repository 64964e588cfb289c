"""Subscription histories folded into the current subscriber state.

A fold may start from the states an earlier fold has left (`start`), so old actions need not be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.common import numbered
from gazette.operators.histories import GATHER_LIMIT, Fold, fold_rounds, last_states
from gazette.operators.runs import states_before
from gazette.schemas import ACTIVE, MODES, PENDING, UNSUBSCRIBED

RUN = 4096  # actions per run of a longer history
BLOCK = 1024  # refused actions are listed in blocks of so many actions

STATE = (
    "struct<status: string, mode: string, keywords: array<string>, confirmed_at: timestamp, "
    "token: string, created_at: timestamp, rejects: bigint>"
)
STATE_FIELDS = [f.split(":")[0].strip() for f in STATE[7:-1].split(", ")]
REJECTS = "array<struct<event_id: bigint, action: string, reason: string>>"


def _no_one() -> Column:
    return F.struct(*[F.lit(0 if c == "rejects" else None).alias(c) for c in STATE_FIELDS]).cast(STATE)


def _bind(value: Column, body) -> Column:
    """`body(value)` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# What an action did to a state.
SUBSCRIBED, REOPENED, CONFIRMED, LEFT, MANAGED = range(5)


def _outcome(s: Column, x: Column, check_tokens: bool) -> Column:
    """What action `x` does in state `s`, as one of the codes above; null when it is refused."""
    action, status = x["action"], s["status"]
    known = status.isNotNull()
    token_ok = s["token"] == x["token"] if check_tokens else F.lit(True)
    subscribed = F.when(known, status != ACTIVE).otherwise(x["mail_ok"])
    return (
        F.when(action == "subscribe", F.when(subscribed, F.lit(SUBSCRIBED)))
        .when(action == "confirm", F.when((status == PENDING) & token_ok, F.lit(CONFIRMED)))
        .when(action == "manage", F.when((status == ACTIVE) & token_ok & x["mode"].isin(*MODES), F.lit(MANAGED)))
        .when(action == "unsubscribe", F.when(known & token_ok, F.lit(LEFT)))
        .when(action == "admin_unsubscribe", F.when(known, F.lit(LEFT)))
        .when(action == "resend_confirmation", F.when(status != ACTIVE, F.lit(REOPENED)))
    )


def _after(s: Column, x: Column, did: Column) -> Column:
    """The state after an action, given what the action does (null: it is refused)."""
    opened, prefers = did.isin(SUBSCRIBED, REOPENED), did.isin(SUBSCRIBED, MANAGED)
    return F.struct(
        F.when(opened, F.lit(PENDING))
        .when(did == CONFIRMED, F.lit(ACTIVE))
        .when(did == LEFT, F.lit(UNSUBSCRIBED))
        .otherwise(s["status"])
        .alias("status"),
        F.when(prefers, x["mode"]).otherwise(s["mode"]).alias("mode"),
        F.when(prefers, x["keywords"]).otherwise(s["keywords"]).alias("keywords"),
        F.when(did == CONFIRMED, x["ts"])
        .when(opened, F.lit(None))
        .otherwise(s["confirmed_at"])
        .alias("confirmed_at"),
        F.when(opened, x["token"]).otherwise(s["token"]).alias("token"),
        F.when(s["status"].isNull(), x["ts"]).otherwise(s["created_at"]).alias("created_at"),
        s["rejects"].alias("rejects"),
    )


def _refuse(s: Column) -> Column:
    return F.struct(
        *[(s[c] + 1 if c == "rejects" else s[c]).alias(c) for c in STATE_FIELDS]
    )


def _step(s: Column, x: Column, check_tokens: bool) -> Column:
    return _bind(
        _outcome(s, x, check_tokens),
        lambda did: F.when(did.isNull(), _refuse(s)).otherwise(_after(s, x, did)),
    )


def _reason(s: Column, x: Column, check_tokens: bool) -> Column:
    """Why an action was refused."""
    action, known = x["action"], s["status"].isNotNull()
    token_ok = F.coalesce(s["token"] == x["token"], F.lit(False)) if check_tokens else F.lit(True)
    active = s["status"].eqNullSafe(ACTIVE)
    return (
        F.when(action == "subscribe", F.when(known, F.lit("already subscribed")).otherwise(F.lit("mail failed")))
        .when(action == "confirm", F.when(known & token_ok, F.lit("already confirmed")).otherwise(F.lit("invalid token")))
        .when(action == "unsubscribe", F.lit("unknown token"))
        .when(action == "manage", F.when(token_ok & active, F.lit("invalid mode")).otherwise(F.lit("invalid link")))
        .when(action == "resend_confirmation", F.when(known, F.lit("already confirmed")).otherwise(F.lit("not found")))
        .when(action == "admin_unsubscribe", F.lit("not found"))
        .otherwise(F.lit("unknown action"))
    )


def _fold(events: Column, start: Column, check_tokens: bool) -> Column:
    return F.aggregate(events, start, lambda s, x: _step(s, x, check_tokens))


def _event() -> Column:
    return F.struct("ts", "event_id", "action", "mode", "keywords", "token", "mail_ok")


def _effect(events: Column, status: Column, token: Column, check_tokens: bool) -> Column:
    """State after `events` from a state of which status and token are known (a null token equals none), what
    was never set being null, and which parts were set."""
    known = {"status": status, "token": token, "rejects": F.lit(0)}
    begin = F.struct(*[known.get(c, F.lit(None)).alias(c) for c in STATE_FIELDS]).cast(STATE)
    sets = {"opened": (SUBSCRIBED, REOPENED), "preferred": (SUBSCRIBED, MANAGED), "dated": (SUBSCRIBED, REOPENED, CONFIRMED)}

    def step(a: Column, x: Column) -> Column:
        return _bind(
            _outcome(a["s"], x, check_tokens),
            lambda did: F.struct(
                F.when(did.isNull(), _refuse(a["s"])).otherwise(_after(a["s"], x, did)).alias("s"),
                *[(a[flag] | F.coalesce(did.isin(*codes), F.lit(False))).alias(flag) for flag, codes in sets.items()],
            ),
        )

    return F.aggregate(events, F.struct(begin.alias("s"), *[F.lit(False).alias(flag) for flag in sets]), step)


def _rounds(
    actions: DataFrame, start: DataFrame | None, fold: Fold, check_tokens: bool, gather_limit: int, run: int
) -> list[DataFrame]:
    events = actions.select("email", "ts", "event_id", _event().alias("x"))
    held = None if start is None else start.select("email", F.struct(*STATE_FIELDS).cast(STATE).alias("s"))

    def before(runs: DataFrame, begun: DataFrame) -> DataFrame:
        effect = lambda events, status, token: _effect(events, status, token, check_tokens)
        return states_before(runs, "email", begun, effect, check_tokens)

    return fold_rounds(events, "email", ["ts", "event_id"], fold, held, _no_one(), gather_limit, run, before)


def _columns(state: Column) -> list[Column]:
    return [state[c].alias(c) for c in ("status", "mode", "keywords", "confirmed_at", "token", "rejects", "created_at")]


def lifecycle_fold(
    actions: DataFrame,
    check_tokens: bool = True,
    gather_limit: int = GATHER_LIMIT,
    run: int = RUN,
    start: DataFrame | None = None,
) -> DataFrame:
    """The state of each address after all its actions, by time, then event id.

    `actions`: `event_id, email, ts, action, token, mode, keywords, mail_ok`. On subscribe and
    resend_confirmation `token` is the one handed out, on confirm, unsubscribe and manage the one
    shown. `status` is null for an address that never got in; `rejects` counts refused actions.
    `start` is a result of this function over all earlier actions; its addresses come back as well.
    """
    fold = lambda events, s: F.struct(_fold(events, s, check_tokens).alias("s"))
    states = last_states(_rounds(actions, start, fold, check_tokens, gather_limit, run), "email")
    states = states.select("email", *_columns(F.col("s")))
    if start is None:
        return states
    quiet = start.select(*states.columns).join(actions.select("email").distinct(), "email", "left_anti")
    return states.unionByName(quiet)


def _refused(events: Column, start: Column, check_tokens: bool) -> Column:
    """State after `events` and the refused ones among them."""
    zero = F.struct(start.alias("s"), F.array().cast(REJECTS).alias("refused"))

    def refuse(a: Column, x: Column) -> Column:
        row = F.struct(
            x["event_id"].alias("event_id"),
            x["action"].alias("action"),
            _reason(a["s"], x, check_tokens).alias("reason"),
        )
        return F.struct(
            _refuse(a["s"]).alias("s"),
            F.concat(a["refused"], F.array(row)).alias("refused"),
        )

    def step(a: Column, x: Column) -> Column:
        return _bind(
            _outcome(a["s"], x, check_tokens),
            lambda did: F.when(did.isNull(), refuse(a, x)).otherwise(
                F.struct(_after(a["s"], x, did).alias("s"), a["refused"].alias("refused"))
            ),
        )

    return F.aggregate(events, zero, step)


def _listed(events: Column, start: Column, check_tokens: bool) -> Column:
    """State after `events` and the refused ones as lists, one per block: appending copies a block, not all."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(events) - 1) / BLOCK).cast("int")),
        lambda i: F.slice(events, i * BLOCK + 1, F.lit(BLOCK)),
    )
    zero = F.struct(start.alias("s"), F.array().cast(f"array<{REJECTS}>").alias("lists"))

    def block(a: Column, part: Column) -> Column:
        return _bind(
            _refused(part, a["s"], check_tokens),
            lambda r: F.struct(
                r["s"].alias("s"),
                F.concat(a["lists"], F.array(r["refused"])).cast(f"array<{REJECTS}>").alias("lists"),
            ),
        )

    return F.aggregate(blocks, zero, block)


def lifecycle_rejects(
    actions: DataFrame,
    check_tokens: bool = True,
    gather_limit: int = GATHER_LIMIT,
    run: int = RUN,
    start: DataFrame | None = None,
) -> DataFrame:
    """Every refused action with the reason: `email, event_id, action, reason`."""
    fold = lambda events, s: _listed(events, s, check_tokens)
    first, *more = _rounds(actions, start, fold, check_tokens, gather_limit, run)
    lists = first
    for done in more:
        lists = lists.unionByName(done)
    return lists.select("email", F.inline(F.flatten("r.lists")))


def subscriber_rows(folded: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The subscriber table after a fold.

    Known addresses keep id and creation time; new ones get ids above the highest one, in order of
    their first subscription, and that time. The token stands for all three, which change together.
    Rows of addresses the fold does not know stay as they are.
    """
    names = subscribers.columns
    key = F.lower(F.trim("email"))
    states = folded.filter(F.col("status").isNotNull()).select(
        key.alias("_key"), F.col("email").alias("_email"), *[F.col(c).alias(f"_{c}") for c in ("status", "mode", "keywords", "confirmed_at", "token", "created_at")]
    )
    both = subscribers.withColumn("_key", key).join(states, "_key", "full_outer")
    known = F.col("_status").isNotNull()
    new = states.join(subscribers.select(key.alias("_key")), "_key", "left_anti")
    highest = subscribers.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ids = numbered(new, "_nth", "_created_at", "_key").select("_key", (highest + 1 + F.col("_nth")).alias("_id"))
    made = {
        "id": F.coalesce("id", "_id"),
        "email": F.coalesce("email", "_email"),
        "mode": F.when(known, F.col("_mode")).otherwise(F.col("mode")),
        "keywords_json": F.when(known, F.to_json("_keywords")).otherwise(F.col("keywords_json")),
        "status": F.coalesce("_status", "status"),
        "created_at": F.coalesce("created_at", "_created_at"),
        "confirmed_at": F.when(known, F.col("_confirmed_at")).otherwise(F.col("confirmed_at")),
    } | {t: F.when(known, F.coalesce("_token", t)).otherwise(F.col(t)) for t in ("confirm_token", "unsubscribe_token", "manage_token")}
    return both.join(ids, "_key", "left").select(*[made[n].alias(n) for n in names])
