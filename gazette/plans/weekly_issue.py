"""The weekly issue build: entries to raw items and prompt, answers to payload and issue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.entries import PER_FEED, PER_ISSUE, leaderboard
from gazette.operators.issues import (
    newest_payloads,
    prompt_corpus,
    upsert_issues,
    with_texts,
)


def raw_items(entries: DataFrame, issue_id: Column, per_feed: int = PER_FEED, most: int = PER_ISSUE) -> DataFrame:
    """The items of one issue: the hottest entries of all feeds, each once."""
    return leaderboard(entries, per_feed, most).select(
        F.col("entry_id").alias("id"),
        issue_id.alias("issue_id"),
        F.col("feed_url").alias("source"),
        "feed_ord",
        "title",
        "summary",
        "link",
        "published_at",
        "heat_score",
    )


def prompt(items: DataFrame) -> DataFrame:
    """The prompt corpus of each issue, from its items in order of the board."""
    order = [F.desc("heat_score"), F.asc("feed_ord"), F.asc("id")]
    return prompt_corpus(items.withColumnRenamed("source", "feed_url"), ["issue_id"], order)


def weekly_build(
    entries: DataFrame, issues: DataFrame, answers: DataFrame, issue_id: int, period: Column, ready_at: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run for one issue: its items, the prompt made of them, and the issue table after the run.

    Without items the issue stays a draft whatever the answers say. Store the items with
    `IssueItems.replace(items, rebuilt)`, so that a run that finds nothing clears them.
    """
    items = raw_items(entries, F.lit(issue_id))
    found = items.agg((F.count("*") > 0).alias("has_items"))
    periods = found.select(F.lit(issue_id).alias("issue_id"), period.alias("period_start"), "has_items")
    mine = answers.filter(F.col("issue_id") == issue_id)
    return items, prompt(items), build_issues(issues, periods, mine, ready_at)


def finished_texts(answers: DataFrame) -> DataFrame:
    """Payload and texts of each issue from its newest usable answer."""
    return with_texts(newest_payloads(answers))


def build_issues(issues: DataFrame, periods: DataFrame, answers: DataFrame, ready_at: Column) -> DataFrame:
    """The issue table after building `periods` (`issue_id, period_start, has_items`)."""
    texts = finished_texts(answers).select(
        "issue_id", "simple_text", "normal_text", "glossary_json", "payload_json"
    )
    return upsert_issues(issues, periods.join(texts, "issue_id", "left"), ready_at)
