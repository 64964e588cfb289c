"""Delivery planning: audience, issue, what was already sent, the finished mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import render as R
from gazette.functions.keys import delivery_key, issue_key
from gazette.functions.keywords import keywords_parse
from gazette.functions.matching import filter_digest, no_match_banner, searchable
from gazette.functions.payload import with_payload
from gazette.operators.common import first_per

# The wording of the subjects.
WEEKLY, LATEST, LATEST_AGAIN, LATEST_MANUAL = (
    " · 周刊 · ", " · 最新一期", " · 最新一期（补发）", " · 最新一期（管理员补发）",
)
MANUAL_KIND = "manual_resend"


def issue_head(issue: DataFrame) -> DataFrame:
    """`id, key, period` of an issue row."""
    key = issue_key(F.col("period_start"), F.col("ready_at"))
    return issue.select("id", key.alias("key"), F.col("period_start").cast("string").alias("period"))


def attach(rows: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """Every row beside the one row of `one`, as struct `name`; no rows when there is none.

    A scalar subquery: Spark refuses more than one row, and nothing is shuffled or joined.
    """
    value = one.select(F.struct(*one.columns).alias(name)).scalar()
    return rows.withColumn(name, value).filter(F.col(name).isNotNull())


def fan_out(audience: DataFrame, issue: DataFrame, base: str) -> DataFrame:
    """The audience with the issue's head and the key of the delivery to each."""
    rows = attach(audience, issue_head(issue), "head")
    prefix = F.concat(F.lit(base + ":"), F.col("head")["key"])
    return rows.withColumn("kind", delivery_key(prefix, F.col("email")))


def sent_keys(send_log: DataFrame, issue: DataFrame, base: str, issues: DataFrame) -> DataFrame:
    """The delivery keys the log holds for this mail and issue, each once.

    The log is stored by issue: only the parts of issues of this period are opened, and that of rows
    whose issue was purged. It is cut by the start of the key as it is read, so neither other issues nor
    a constant kind with very many rows meet the join.
    """
    prefix = issue_head(issue).select(F.concat(F.lit(base + ":"), F.col("key"), F.lit(":"))).scalar()
    period = issue.select("period_start").scalar()
    ids = issues.filter(F.col("period_start") == period).agg(F.collect_set("id")).scalar()  # a few rows per period
    mine = F.col("issue_id").isNull() | F.array_contains(ids, F.col("issue_id").cast("long"))
    return send_log.filter(mine & F.startswith("kind", prefix)).select("kind").distinct()


def not_sent(fanned: DataFrame, send_log: DataFrame, issue: DataFrame, base: str, issues: DataFrame) -> DataFrame:
    """Deliveries whose key the log does not hold. Each key once: of one address the lowest id."""
    first = first_per(fanned, ["kind"], [F.col("id")])
    return first.join(sent_keys(send_log, issue, base, issues), "kind", "left_anti")


def with_mail(deliveries: DataFrame, issue: DataFrame, subject: Column, public_url: str, brand: str = R.BRAND) -> DataFrame:
    """The planned mails: `subscriber_id, issue_id, kind, email, matched, subject, html, text`.

    The issue is parsed and its elements rendered once; per subscriber they are picked and joined.
    """
    body = with_payload(issue).select(searchable(F.col("payload")).alias("body"))
    rows = attach(deliveries, body, "issue").withColumn("issue", F.col("issue")["body"])
    rows = rows.withColumn("keywords", keywords_parse(F.col("keywords_json")))
    rows = filter_digest(rows)
    banner = no_match_banner(F.col("keywords"), F.col("matched"))
    rows = rows.withColumn("banner", banner)
    digest, mode, email = F.col("digest"), F.col("mode"), F.col("email")
    html = R.render_html(digest, mode, F.col("banner"), email, brand)
    text = R.render_text(digest, mode, F.col("banner"), email, brand)
    block = R.footer_block(public_url, F.col("unsubscribe_token"), F.col("manage_token"))
    mails = rows.withColumn("_html", html).withColumn("_text", text)
    return mails.select(
        F.col("id").alias("subscriber_id"),
        F.col("head")["id"].alias("issue_id"),
        "kind",
        "email",
        "matched",
        subject.alias("subject"),
        R.append_footer(F.col("_html"), block).alias("html"),
        F.concat(F.col("_text"), R.unsubscribe_text(public_url, F.col("unsubscribe_token"))).alias("text"),
    )
