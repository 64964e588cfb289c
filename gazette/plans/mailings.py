"""The four mailings: weekly, on confirmation, on request, by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.render import BRAND
from gazette.functions.text import strip
from gazette.operators import delivery as D
from gazette.operators.audience import eligible, holders, lookup, target_email
from gazette.operators.issues import latest_ready_issue, ready_issue_for


def weekly_delivery(
    subscribers: DataFrame,
    issues: DataFrame,
    send_log: DataFrame,
    period: Column,
    public_url: str,
    only: str | None = None,
    dry_run: bool = False,
    brand: str = BRAND,
) -> DataFrame:
    """The mails still to send for the ready issue of `period`.

    Log rows are written after the hand-off (`sources.tables.append_log`); a run after that plans
    nothing. A dry run logs nothing, so rows that share a key are all listed.
    """
    issue = ready_issue_for(issues, period)
    audience = target_email(eligible(subscribers), only)
    fanned = D.fan_out(audience, issue, "weekly")
    if dry_run:
        todo = fanned.join(D.sent_keys(send_log, issue, "weekly", issues), "kind", "left_anti")
    else:
        todo = D.not_sent(fanned, send_log, issue, "weekly", issues)
    subject = F.concat(F.lit(brand + D.WEEKLY), F.col("head")["period"])
    return D.with_mail(todo, issue, subject, public_url, brand)


def _latest(rows: DataFrame, issue: DataFrame, subject: str, public_url: str, brand: str) -> DataFrame:
    return D.with_mail(rows, issue, F.lit(brand + subject), public_url, brand)


def confirm_digest_plan(
    confirmed: DataFrame, issues: DataFrame, public_url: str, brand: str = BRAND
) -> DataFrame:
    """Mails for subscribers just confirmed; no look at the log."""
    issue = latest_ready_issue(issues)
    rows = confirmed.withColumn("email", strip(F.col("email")))
    return _latest(D.fan_out(rows, issue, "confirm_digest"), issue, D.LATEST, public_url, brand)


def resend_latest_plan(
    requests: DataFrame, subscribers: DataFrame, issues: DataFrame, send_log: DataFrame,
    public_url: str, brand: str = BRAND,
) -> DataFrame:
    """Mails asked for by `manage_token`, once per issue and address."""
    issue = latest_ready_issue(issues)
    rows = eligible(holders(requests, subscribers, "manage_token")).withColumn("email", strip(F.col("email")))
    todo = D.not_sent(D.fan_out(rows, issue, "resend_latest"), send_log, issue, "resend_latest", issues)
    return _latest(todo, issue, D.LATEST_AGAIN, public_url, brand)


def manual_resend_plan(
    requests: DataFrame, subscribers: DataFrame, issues: DataFrame, public_url: str, brand: str = BRAND
) -> DataFrame:
    """One mail per request by `subscriber id`, never held back; the log kind is a constant."""
    issue = latest_ready_issue(issues)
    rows = eligible(lookup(requests, subscribers, "id")).withColumn("email", strip(F.col("email")))
    fanned = D.fan_out(rows, issue, "latest").withColumn("kind", F.lit(D.MANUAL_KIND))
    return _latest(fanned, issue, D.LATEST_MANUAL, public_url, brand)
