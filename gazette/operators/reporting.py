"""Metrics, listings and export."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.keywords import has_keyword, keywords_parse, keywords_to_cell
from gazette.functions.text import datetime_text
from gazette.operators.audience import by_email_text, by_status, eligible
from gazette.schemas import ACTIVE, PENDING, UNSUBSCRIBED

# Sizes of the reports; each is a parameter of its operator.
RANKED_SUBSCRIBERS, TOP_KEYWORDS = 5000, 20
PAGE_MOST = 200
DEEP = 4096  # offsets beyond which a page is found by rank
CELL_BITS = 10  # of the ranges that are counted at once
CSV_HEADER = "id,email,status,mode,keywords,created_at,confirmed_at"
CSV_MARK = "﻿"


def audience_metrics(subscribers: DataFrame) -> DataFrame:
    status = F.col("status")
    return subscribers.agg(
        F.count("id").alias("total"),
        F.count_if((status == ACTIVE) & F.col("confirmed_at").isNotNull()).alias("active_confirmed"),
        F.count_if(status == PENDING).alias("pending"),
        F.count_if(status == UNSUBSCRIBED).alias("unsubscribed"),
    )


def top_keywords(subscribers: DataFrame, newest: int = RANKED_SUBSCRIBERS, most: int = TOP_KEYWORDS) -> DataFrame:
    """Keyword counts of the most recently confirmed subscribers.

    Equal counts stand in order of first appearance: newest confirmation, id, place in the list.
    """
    latest = (
        eligible(subscribers)
        .select("id", "confirmed_at", "keywords_json")
        .orderBy(F.desc("confirmed_at"), "id")
        .limit(newest)
    )
    words = latest.select(
        "id", "confirmed_at", F.posexplode(keywords_parse(F.col("keywords_json"))).alias("pos", "word")
    )
    first_seen = F.struct(-F.unix_micros("confirmed_at"), F.col("id"), F.col("pos"))
    counts = words.groupBy(F.lower("word").alias("keyword")).agg(
        F.count("*").alias("active_confirmed_count"), F.min(first_seen).alias("_first")
    )
    ranked = counts.orderBy(F.desc("active_confirmed_count"), "_first").limit(most)
    return ranked.select("keyword", "active_confirmed_count")


def send_stats(send_log: DataFrame) -> DataFrame:
    return send_log.groupBy("subscriber_id").agg(
        F.count("*").alias("send_count"), F.max("sent_at").alias("last_sent_at")
    )


def with_sends(subscribers: DataFrame, send_log: DataFrame) -> DataFrame:
    stats = send_stats(send_log).withColumnRenamed("subscriber_id", "id")
    return subscribers.join(stats, "id", "left").withColumn(
        "send_count", F.coalesce("send_count", F.lit(0))
    )


def admin_row(rows: DataFrame) -> DataFrame:
    """Listing columns, times as text."""

    def text(name: str) -> Column:
        return datetime_text(F.col(name)).alias(name)

    return rows.select(
        "id",
        "email",
        "status",
        "mode",
        keywords_parse(F.col("keywords_json")).alias("keywords"),
        F.coalesce(F.nullif(F.col("keywords_json"), F.lit("")), F.lit("[]")).alias("keywords_json"),
        text("created_at"),
        text("confirmed_at"),
        text("last_sent_at"),
        "send_count",
    )


def from_rank(rows: DataFrame, order: list[str], skip: int, most: int) -> tuple[DataFrame, int]:
    """The rows from a bound on that lies shortly ahead of rank `skip`, and how many of them are still ahead of it.

    `order` names long columns without nulls, ascending. Rows are counted in at most `2 ** CELL_BITS + 1` ranges of a
    column; the range that holds the rank is counted again until it has no more than `most` rows, then the next
    column decides. That takes a pass per ten bits at most. Only rows equal in all columns are never parted.
    """
    known: list[tuple[str, int]] = []
    for name in order:
        inside = rows.filter(_all(F.col(c) == v for c, v in known))
        low, high = inside.agg(F.min(name), F.max(name)).first()
        if low is None:
            return rows.filter(F.lit(False)), 0
        held = most + 1
        while low < high and held > most:
            shift = max(0, (high - low).bit_length() - CELL_BITS)
            cells = inside.filter(F.col(name).between(low, high)).groupBy(F.shiftright(name, shift).alias("cell")).count()
            for cell, held in sorted((r["cell"], r["count"]) for r in cells.collect()):  # at most 1025 rows
                if skip < held:
                    break
                skip -= held
            else:
                return rows.filter(F.lit(False)), 0  # the rank lies behind the last row
            low, high = max(low, cell << shift), min(high, ((cell + 1) << shift) - 1)
        known.append((name, low))
        if held <= most:
            break
    bound = F.lit(False)
    for i, (name, value) in enumerate(known):
        last = i == len(known) - 1
        ahead = F.col(name) >= value if last else F.col(name) > value
        bound = bound | _all([*(F.col(c) == v for c, v in known[:i]), ahead])
    return rows.filter(bound), skip


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def subscribers_page(
    subscribers: DataFrame,
    send_log: DataFrame,
    q: str | None = None,
    status: str | None = None,
    keyword: str | None = None,
    limit: int = 50,
    offset: int = 0,
    keyword_after_page: bool = True,
    after: tuple[datetime, int] | None = None,
    deep: int = DEEP,
) -> DataFrame:
    """One page, newest first. The keyword drops rows of the page, so pages may be short;
    with `keyword_after_page=False` it filters first.

    `after`, the creation time and id of the last row seen, takes the place of the offset: a page far
    down the list then costs no more than the first one. An offset over `deep` is found by counts of ranges
    (`from_rank`), so a task sends no more than two pages, however far down the list it is.

    The page, at most `PAGE_MOST` rows, is cut before the log is read for its subscribers only.
    """
    most, skip = max(1, min(int(limit), PAGE_MOST)), max(0, int(offset))
    kw = (keyword or "").strip()
    fits = has_keyword(keywords_parse(F.col("keywords_json")), kw) if kw else F.lit(True)
    rows = by_status(by_email_text(subscribers, q), status)
    if not keyword_after_page:
        rows = rows.filter(fits)
    if after is not None:
        time, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.filter((F.col("created_at") < time) | ((F.col("created_at") == time) & (F.col("id") > last)))
        skip = 0
    if skip > deep:
        # In the order of the list: newest first, without a time last; of equal times the lowest id, null first.
        time = F.coalesce(-F.unix_micros("created_at"), F.lit(1 << 62))
        number = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
        rows, skip = from_rank(rows.withColumn("_time", time).withColumn("_number", number), ["_time", "_number"], skip, most)
        rows = rows.drop("_time", "_number")
    page = rows.orderBy(F.desc("created_at"), "id").offset(skip).limit(most)
    if keyword_after_page:
        page = page.filter(fits)
    ids = F.broadcast(page.select(F.col("id").alias("subscriber_id")))
    rows = with_sends(page, send_log.join(ids, "subscriber_id", "left_semi"))
    return admin_row(rows.orderBy(F.desc("created_at"), "id"))


def subscriber_detail(ids: DataFrame, subscribers: DataFrame, send_log: DataFrame) -> DataFrame:
    """Listing rows of the requested ids; unknown ids drop out."""
    wanted = ids.select("id").distinct()
    rows = subscribers.join(wanted, "id", "left_semi")
    log = send_log.join(wanted.withColumnRenamed("id", "subscriber_id"), "subscriber_id", "left_semi")
    return admin_row(with_sends(rows, log))


def export_lines(subscribers: DataFrame, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """CSV lines in `ord, created_at, id` order, the header first, led by a byte order mark."""
    keywords = keywords_parse(F.col("keywords_json"))
    rows = by_status(subscribers, status)
    if (keyword or "").strip():
        rows = rows.filter(has_keyword(keywords, keyword))

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    line = F.concat_ws(
        ",",
        F.col("id").cast("string"),
        quoted(F.col("email")),
        "status",
        "mode",
        quoted(keywords_to_cell(keywords)),
        datetime_text(F.col("created_at")),
        F.coalesce(datetime_text(F.col("confirmed_at")), F.lit("")),
    )
    body = rows.select(F.lit(1).alias("ord"), "created_at", "id", line.alias("line"))
    header = subscribers.sparkSession.range(1).select(
        F.lit(0).alias("ord"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("long").alias("id"),
        F.lit(CSV_MARK + CSV_HEADER).alias("line"),
    )
    return header.unionByName(body).orderBy("ord", F.desc("created_at"), "id")
