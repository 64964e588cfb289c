"""Subscribers: filters, lookups, newest rows, token audits, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.keys import address
from gazette.functions.keywords import has_keyword, keywords_parse
from gazette.functions.text import strip
from gazette.operators.histories import GATHER_LIMIT, RUN, fold_rounds, last_states
from gazette.operators.common import first_per, split_join
from gazette.schemas import ACTIVE, STATUSES

TOKENS = ("confirm_token", "unsubscribe_token", "manage_token")


def eligible(subscribers: DataFrame) -> DataFrame:
    """Active and confirmed: unsubscribing keeps `confirmed_at`, so both count."""
    return subscribers.filter((F.col("status") == ACTIVE) & F.col("confirmed_at").isNotNull())


def by_status(subscribers: DataFrame, status: str | None) -> DataFrame:
    """A status that is not one of the known ones filters nothing."""
    wanted = (status or "").strip()
    return subscribers.filter(F.col("status") == wanted) if wanted in STATUSES else subscribers


def by_email_text(subscribers: DataFrame, q: str | None) -> DataFrame:
    """Address contains `q`, upper and lower case alike; `%` and `_` in `q` are wildcards."""
    wanted = (q or "").strip()
    return subscribers.filter(F.col("email").ilike(f"%{wanted}%")) if wanted else subscribers


def by_keyword(subscribers: DataFrame, keyword: str | None) -> DataFrame:
    if not (keyword or "").strip():
        return subscribers
    return subscribers.filter(has_keyword(keywords_parse(F.col("keywords_json")), keyword))


def target_email(subscribers: DataFrame, email: str | None) -> DataFrame:
    wanted = (email or "").strip().lower()
    return subscribers.filter(address(F.col("email")) == wanted) if wanted else subscribers


def newest(subscribers: DataFrame, key: Column | str) -> DataFrame:
    """The newest row per address or token; of equal times the lowest id."""
    return first_per(subscribers, [key], [F.desc("created_at"), F.asc("id")])


def holders(requests: DataFrame, subscribers: DataFrame, key: str) -> DataFrame:
    """The newest subscriber of each `key` that any request asks for, once; only those asked for are ranked."""
    asked = requests.select(key).distinct()
    return newest(subscribers.join(asked, key, "left_semi"), key)


def lookup(requests: DataFrame, subscribers: DataFrame, key: str) -> DataFrame:
    """Each request row with the newest subscriber that has its `key`; unknown keys drop out.

    Only subscribers that are asked for go on; many requests may ask for one key, so they are spread.
    """
    known = holders(requests, subscribers, key)
    clash = [c for c in known.columns if c != key and c in requests.columns]
    for c in clash:
        known = known.withColumnRenamed(c, f"subscriber_{c}")
    spread = [c for c in requests.columns if c != key]
    if not spread:
        return requests.join(known, key)
    return split_join(requests, known, [key], "inner", spread)


def duplicate_tokens(subscribers: DataFrame, token: str) -> DataFrame:
    """Rows that share a token: the newest holder keeps it, the others need new ones.

    The holder is found by a plain aggregate; rows of one token are spread for the comparison.
    """
    rank = F.struct(F.col("created_at"), (-F.col("id")).alias("neg_id"))
    holders = (
        subscribers.groupBy(token)
        .agg(F.count("*").alias("n_holders"), F.max(rank).alias("_newest"))
        .filter("n_holders > 1")
        .select(token, "n_holders", (-F.col("_newest.neg_id")).alias("holder_id"))
    )
    shared = split_join(subscribers, holders, [token], "inner", ["id"])
    return shared.withColumn("needs_new_tokens", F.col("id") != F.col("holder_id"))


def token_clashes(candidates: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Candidate ids of which any of the three tokens is taken by a token of the same kind.

    One join on kind and token in place of an OR over three columns; of the subscribers' tokens
    only those asked for go on.
    """
    asked = _token_rows(candidates, "candidate_id")
    pair = ["kind", "token"]
    taken = _token_rows(subscribers).join(asked.select(*pair), pair, "left_semi").distinct()
    hits = asked.join(taken, pair, "left_semi")
    return hits.groupBy("candidate_id").agg(F.count("*").alias("n_taken"))


def _token_rows(df: DataFrame, *keep: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).alias("token")) for t in TOKENS])
    return df.select(*keep, F.inline(rows))


STATE_COLUMNS = ["mode", "keywords_json", "status", *TOKENS, "confirmed_at"]
ROW_STATE = "struct<id: bigint, " + ", ".join(f"{c}: {'timestamp' if c == 'confirmed_at' else 'string'}" for c in STATE_COLUMNS) + ">"


def apply_changes(subscribers: DataFrame, changes: DataFrame, gather_limit: int = GATHER_LIMIT, run: int = RUN) -> DataFrame:
    """The subscriber table after guarded updates, applied one after the other by `change_id`.

    `changes`: `email, change_id`, the guards `if_status` and `if_token` (null = no guard; the token
    is compared with the column named by `token_kind`), `new_*` values (null = keep) and
    `clear_confirmed`. Guards look at the row as the changes before have left it; a change that does
    not fit is left out (`refused_changes`). Addresses not in the table are ignored, rows that share an
    address change each for itself.
    """
    rounds = _change_rounds(subscribers, changes, False, gather_limit, run)
    after = last_states(rounds, "_address").select(F.col("s.id").alias("id"), F.col("s").alias("_s"))
    both = subscribers.join(after, "id", "left")
    now = {c: F.when(F.col("_s").isNotNull(), F.col("_s")[c]).otherwise(F.col(c)).alias(c) for c in STATE_COLUMNS}
    return both.select(*[now.get(c, F.col(c)) for c in subscribers.columns])


def refused_changes(subscribers: DataFrame, changes: DataFrame, gather_limit: int = GATHER_LIMIT, run: int = RUN) -> DataFrame:
    """`id, change_id` of every change that did not fit its row when its turn came."""
    first, *more = _change_rounds(subscribers, changes, True, gather_limit, run)
    for done in more:
        first = first.unionByName(done)
    return first.select(F.col("r.s.id").alias("id"), F.explode("r.refused").alias("change_id"))


def _change_rounds(subscribers: DataFrame, changes: DataFrame, listed: bool, gather_limit: int, run: int) -> list[DataFrame]:
    fields = ["change_id", *[c for c in changes.columns if c not in ("change_id", "email")]]
    events = changes.select(address(F.col("email")).alias("_address"), "change_id", F.struct(*fields).alias("x"))
    held = subscribers.select(address(F.col("email")).alias("_address"), F.struct("id", *STATE_COLUMNS).cast(ROW_STATE).alias("s"))

    def fits(s: Column, x: Column) -> Column:
        token = F.coalesce(*[F.when(x["token_kind"] == t, s[t]) for t in TOKENS])
        status_ok = x["if_status"].isNull() | F.coalesce(s["status"] == x["if_status"], F.lit(False))
        return status_ok & (x["if_token"].isNull() | F.coalesce(token == x["if_token"], F.lit(False)))

    def after(s: Column, x: Column) -> Column:
        new = {c: F.coalesce(x[f"new_{c}"], s[c]) for c in STATE_COLUMNS}
        new["confirmed_at"] = F.when(x["clear_confirmed"], F.lit(None)).otherwise(new["confirmed_at"])
        return F.struct(s["id"].alias("id"), *[v.alias(c) for c, v in new.items()]).cast(ROW_STATE)

    def plain(events: Column, state: Column) -> Column:
        return F.struct(F.aggregate(events, state, lambda s, x: F.when(fits(s, x), after(s, x)).otherwise(s)).alias("s"))

    def with_refused(events: Column, state: Column) -> Column:
        none = F.array().cast("array<bigint>")
        step = lambda a, x: F.when(fits(a["s"], x), F.struct(after(a["s"], x).alias("s"), a["refused"].alias("refused"))).otherwise(
            F.struct(a["s"].alias("s"), F.concat(a["refused"], F.array(x["change_id"])).alias("refused"))
        )
        return F.aggregate(events, F.struct(state.alias("s"), none.alias("refused")), step)

    return fold_rounds(events, "_address", ["change_id"], with_refused if listed else plain, held, None, gather_limit, run)
