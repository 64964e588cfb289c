"""Weekly issues: answers to payloads and texts, the prompt corpus, the issue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import payload as P
from gazette.functions.text import clip
from gazette.operators.common import first_per, once
from gazette.schemas import DRAFT, READY

# Size and wording of the list a prompt carries.
PROMPT_ITEMS, PROMPT_SUMMARY = 60, 500
SUMMARY_LABEL, LINK_LABEL, HEAT_LABEL = "   摘要: ", "   链接: ", "   热度分: "

#: Issues whose newest answer is looked up by a broadcast of two ids each; those of more issues are joined by a shuffle that
#: hashes the ids, so that the answers pass unsorted there too.
BROADCAST_ISSUES = 100_000


def prompt_corpus(items: DataFrame, keys: list[str], order: list[Column], most: int = PROMPT_ITEMS) -> DataFrame:
    """One numbered text per issue from its first `most` items; at most `most` rows are gathered."""
    block = F.concat(
        F.col("_rank").cast("string"), F.lit(". ["), F.col("feed_url"), F.lit("] "), F.col("title"),
        F.lit("\n" + SUMMARY_LABEL), clip(F.col("summary"), PROMPT_SUMMARY),
        F.lit("\n" + LINK_LABEL), F.col("link"),
        F.lit("\n" + HEAT_LABEL), F.col("heat_score").cast("string"),
    )
    first = first_per(items, keys, order, most, "_rank")
    blocks = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rank"), block.alias("block")))).alias("blocks")
    )
    return blocks.select(
        *keys,
        F.size("blocks").cast("long").alias("n_items"),
        F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("corpus"),
    )


def with_answer_payload(answers: DataFrame, passes: int = 2) -> DataFrame:
    """Answers that hold a JSON object, with the clean `payload`, worked out once."""
    docs = P.extract_answer(answers).filter(F.col("doc").isNotNull())
    return once(docs, payload=P.normalize_payload(F.col("doc"), passes)).drop("doc")


def rejected_answers(answers: DataFrame) -> DataFrame:
    return P.extract_answer(answers).filter(F.col("doc").isNull()).drop("doc")


def with_texts(payloads: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return payloads.select(
        "*",
        P.simple_text(payload).alias("simple_text"),
        P.normal_text(payload).alias("normal_text"),
        P.glossary_to_json(payload["glossary"]).alias("glossary_json"),
        P.payload_to_json(payload).alias("payload_json"),
    )


def newest_payloads(answers: DataFrame, passes: int = 2) -> DataFrame:
    """The newest usable answer of each issue with its clean `payload`.

    Which one that is shows in the ids alone, by an aggregate over two numbers, so no answer is sorted or
    shuffled to find it. Every answer is parsed once, and those found once more, when they are fetched.
    """
    usable = P.extract_answer(answers).filter(F.col("doc").isNotNull())
    newest = usable.groupBy("issue_id").agg(F.max("response_id")).toDF("_issue", "_newest").checkpoint()
    newest = F.broadcast(newest) if newest.count() <= BROADCAST_ISSUES else newest.hint("shuffle_hash")
    same = F.col("issue_id").eqNullSafe(F.col("_issue")) & F.col("response_id").eqNullSafe(F.col("_newest"))
    docs = P.extract_answer(answers.join(newest, same, "left_semi")).filter(F.col("doc").isNotNull()).drop("content")
    one = first_per(docs, ["issue_id"], [F.desc("response_id")])  # an id may be there twice
    return once(one, payload=P.normalize_payload(F.col("doc"), passes)).drop("doc")


def one_per_period(issues: DataFrame) -> DataFrame:
    """The store does not keep periods unique: the newest row stands."""
    return first_per(issues, ["period_start"], [F.desc("created_at"), F.desc("id")])


def duplicate_periods(issues: DataFrame) -> DataFrame:
    return issues.groupBy("period_start").agg(F.count("*").alias("n_issues")).filter("n_issues > 1")


def duplicate_deliveries(send_log: DataFrame) -> DataFrame:
    """Delivery keys logged more than once."""
    return send_log.groupBy("kind").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def upsert_issues(issues: DataFrame, built: DataFrame, ready_at: Column) -> DataFrame:
    """The issue table after a build.

    `built` holds `period_start, has_items` and, where an answer came, its four texts. Of the rows of a
    period the newest is the one that is built; the others stay as they are. A period already ready
    stays untouched; a new or draft one becomes ready with the texts, or draft when nothing was
    collected or no answer came. New rows get the ids above the highest one, in order of their period.
    """
    texts = ["simple_text", "normal_text", "glossary_json", "payload_json"]
    blanks = ["", "", "[]", "{}"]
    new = built.select(
        "period_start", "has_items", *[F.col(t).alias(f"new_{t}") for t in texts], F.lit(True).alias("_built")
    )
    newest = one_per_period(issues)
    fresh = new.select("period_start").join(newest, "period_start", "left_anti")
    # A build brings few new periods, weeks of one run: they are numbered in one task.
    numbers = fresh.select("period_start", F.row_number().over(Window.orderBy("period_start")).alias("_nth"))
    both = newest.join(new, "period_start", "full_outer").join(numbers, "period_start", "left")
    done = F.coalesce(F.col("status") == READY, F.lit(False))
    touched = F.coalesce(F.col("_built"), F.lit(False)) & ~done
    finished = touched & F.col("has_items") & F.col("new_payload_json").isNotNull()

    def text(name: str, blank: str) -> Column:
        kept = F.coalesce(F.col(name), F.lit(blank))
        return F.when(finished, F.col(f"new_{name}")).otherwise(kept).alias(name)

    highest = issues.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    after = both.select(
        F.coalesce(F.col("id"), highest + F.col("_nth")).alias("id"),
        "period_start",
        *[text(t, b) for t, b in zip(texts, blanks)],
        F.when(done, F.lit(READY))
        .when(finished, F.lit(READY))
        .when(touched, F.lit(DRAFT))
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(finished, ready_at).otherwise(F.col("ready_at")).alias("ready_at"),
        F.coalesce(F.col("created_at"), ready_at).alias("created_at"),
    )
    others = issues.join(newest.select("id"), "id", "left_anti")
    return after.unionByName(others.select(*after.columns))


def ready_issue_for(issues: DataFrame, period: Column) -> DataFrame:
    ready = issues.filter((F.col("status") == READY) & (F.col("period_start") == period))
    return ready.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def latest_ready_issue(issues: DataFrame) -> DataFrame:
    ready = issues.filter(F.col("status") == READY)
    return ready.orderBy(F.desc("ready_at"), F.desc("id")).limit(1)


def recent_issues(issues: DataFrame, most: int = 5) -> DataFrame:
    order = [F.desc_nulls_last("ready_at"), F.desc("created_at"), F.desc("id")]
    return issues.select("id", "period_start", "status", "ready_at", "created_at").orderBy(*order).limit(most)
