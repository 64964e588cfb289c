from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gazette.functions import render as R
from gazette.functions.matching import NO_MATCH_BANNER, searchable
from gazette.functions.payload import with_payload
from gazette.operators import issues as I
from gazette.plans import mailings
from gazette.schemas import SEND_LOG, SUBSCRIBERS, WEEKLY_ISSUES
from gazette.sources.tables import IssueItems, append_log, read_table, write_log

URL = "https://d.example.org/"
PERIOD = date(2026, 4, 6)
PAYLOAD = {
    "simple": {"lines": [{"text": "Agent <b>", "url": " https://x/?a=1&b=2 "}, {"text": "ring's", "url": "u"}], "footer": "all about models"},
    "normal": {
        "top3": [{"title": "Top agent", "url": "v"}],
        "sections": [{"title": "S1", "paragraph": "one\ntwo"}, {"title": "S2", "paragraph": "ring"}],
    },
    "glossary": [{"term": "LLM", "explain": "secretword"}, {"term": "ring", "explain": "circle"}],
}
NOW = datetime(2026, 4, 6, 1)


def person(i, email, mode="simple", kws="[]", status="active", confirmed=NOW):
    return (i, email, mode, kws, status, f"c{i}", f"u{i}&", f"m{i}", datetime(2026, 1, i), confirmed)


PEOPLE = [
    person(1, "A@example.com", kws='["AGENT"]'),
    person(2, " a@Example.com", kws='["ring"]'),  # the same address in another spelling
    person(3, "c@example.com", mode="normal", kws='["secretword"]'),
    person(4, "d@example.com", mode="other", kws='["model","ring"]'),
    person(5, "e@example.com", status="unsubscribed"),
    person(6, "f@example.com", confirmed=None),
    person(7, "g@example.com", kws="not json"),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SUBSCRIBERS)


@pytest.fixture(scope="module")
def issues(spark):
    text = json.dumps(PAYLOAD)
    rows = [
        (1, date(2026, 3, 30), "", "", "[]", "{}", "ready", datetime(2026, 3, 30), NOW),
        (2, PERIOD, "", "", "[]", text, "ready", datetime(2026, 4, 6), NOW),
        (3, date(2026, 4, 13), "", "", "[]", "{}", "draft", None, NOW),
    ]
    return spark.createDataFrame(rows, WEEKLY_ISSUES)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([], SEND_LOG)


def weekly(people, issues, log, **kw):
    return mailings.weekly_delivery(people, issues, log, F.lit(PERIOD), URL, **kw)


def test_a_second_run_plans_nothing(spark, people, issues, log, tmp_path):
    path, shape = str(tmp_path / "log"), "subscriber_id long, kind string, sent_at timestamp, issue_id long"
    spark.createDataFrame([], "subscriber_id long, issue_id long, kind string, sent_at timestamp").write.parquet(path)
    first = weekly(people, issues, log)
    assert sorted(r.subscriber_id for r in first.collect()) == [1, 3, 4, 7]
    append_log(first, path)
    assert weekly(people, issues, read_table(spark, path, shape)).count() == 0


def test_dry_run_and_target(people, issues, log):
    assert weekly(people, issues, log, dry_run=True).count() == 5
    assert [r.subscriber_id for r in weekly(people, issues, log, only="C@EXAMPLE.com ").collect()] == [3]


def test_no_issue_no_mail(people, issues, log):
    assert mailings.weekly_delivery(people, issues, log, F.lit(date(2026, 4, 13)), URL).count() == 0


def test_other_mailings(spark, people, issues, log):
    asked = spark.createDataFrame([("m1",), ("m1",), ("m5",), ("zz",)], "manage_token string")
    again = mailings.resend_latest_plan(asked, people, issues, log, URL)
    assert [(r.subscriber_id, r.kind.split(":")[:2]) for r in again.collect()] == [(1, ["resend_latest", "2026-04-06"])]
    sent = again.select(F.lit(1).cast("long").alias("id"), "subscriber_id", "issue_id", "kind", F.lit(NOW).alias("sent_at"))
    assert mailings.resend_latest_plan(asked, people, issues, sent, URL).count() == 0
    assert mailings.confirm_digest_plan(people.filter("id < 3"), issues, URL).count() == 2
    by_hand = spark.createDataFrame([(10, 1), (11, 1), (12, 5)], "request_id long, id long")
    rows = mailings.manual_resend_plan(by_hand, people, issues, URL).collect()
    assert [(r.subscriber_id, r.kind) for r in rows] == [(1, "manual_resend")] * 2


def test_tokens_asked_for_are_gathered_once(spark, issues, log):
    """Each gathering of the tokens is a hash table of all tokens in a task's share."""
    token = F.when(F.col("id") < 700, F.concat(F.lit("m"), (F.col("id") % 8).cast("string")))
    asked = spark.range(777).select(token.alias("manage_token"))
    again = (*person(8, "h@example.com")[:7], "m3", NOW, NOW)  # the newest holder of m3
    none = (*person(9, "i@example.com")[:7], None, NOW, NOW)
    plan = mailings.resend_latest_plan(asked, spark.createDataFrame([*PEOPLE, again, none], SUBSCRIBERS), issues, log, URL)
    assert sorted(r.subscriber_id for r in plan.collect()) == [1, 4, 7, 8]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 777") == 1


def test_matching_and_fallbacks(people, issues, log):
    mails = {r.subscriber_id: r for r in weekly(people, issues, log).collect()}
    one = mails[1]  # line and top3 match; sections and glossary stay whole
    assert one.matched and "Agent" in one.text and "ring's" not in one.text
    assert "LLM" in one.text and "小结：all about models" in one.text
    three = mails[3]  # only the glossary knows the word, which does not count
    assert not three.matched and NO_MATCH_BANNER in three.html and "ring: circle" in three.text
    four = mails[4]  # footer, line, section and glossary match
    assert four.matched and "S2" in four.text and "S1" not in four.text and "LLM" not in four.text
    assert four.text.startswith("Weekly Digest · 正常模式")  # any mode but simple is normal
    seven = mails[7]
    assert seven.matched and NO_MATCH_BANNER not in seven.text
    assert seven.subject == "Weekly Digest · 周刊 · 2026-04-06"


def test_simple_mail_to_the_letter(people, issues, log):
    mail = weekly(people, issues, log, only="a@example.com", brand="B").first()
    assert mail.html == (
        "<html><body style='font-family:system-ui,sans-serif;max-width:640px'>"
        '<p style="color:#666;font-size:13px">本邮件发送至：<b>A@example.com</b></p>\n'
        "<h2>B · 简单模式</h2><ol>\n"
        '<li><a href="https://x/?a=1&amp;b=2">Agent &lt;b&gt;</a></li>\n'
        "</ol>\n"
        "<p><strong>小结：</strong>all about models</p>\n"
        "<h3>本周术语表</h3><table border='0' cellpadding='6' style='border-collapse:collapse'>\n"
        "<tr><th align='left'>术语</th><th align='left'>解释</th></tr>\n"
        "<tr><td>LLM</td><td>secretword</td></tr>\n"
        "<tr><td>ring</td><td>circle</td></tr>\n"
        "</table>"
        "<hr style='border:none;border-top:1px solid #eee;margin:2rem 0'/><p style='font-size:13px;color:#666'>"
        '<a href="https://d.example.org/api/unsubscribe?token=u1&amp;">退订</a> · '
        '<a href="https://d.example.org/manage/m1">管理关键词与模式</a></p>'
        "</body></html>"
    )
    assert mail.text == (
        "本邮件发送至：A@example.com\n\nB · 简单模式\n\n- Agent <b> ( https://x/?a=1&b=2 )\n\n小结：all about models\n\n"
        "\n本周术语表\n\n- LLM: secretword\n\n- ring: circle\n\n退订: https://d.example.org/api/unsubscribe?token=u1&"
    )


def test_normal_text_order(spark, issues):
    rows = with_payload(issues.filter("id = 2")).withColumn("d", searchable(F.col("payload")))
    text = rows.select(R.render_text(F.col("d"), F.lit("normal"), F.lit("banner"), F.lit("me"), "B")).first()[0]
    assert text == (
        "B · 正常模式\n\nTop3:\n- Top agent (v)\n\n本邮件发送至：me\n\nbanner\n\n## S1\none\ntwo\n\n## S2\nring\n\n"
        "\n本周术语表\n\n- LLM: secretword\n\n- ring: circle"
    )
    html = rows.select(R.render_html(F.col("d"), F.lit("normal"), F.lit(None), F.lit(None), "B")).first()[0]
    assert "<h3>S1</h3><p>one<br/>two</p>" in html and "本邮件" not in html


def test_newest_row_of_a_period_stands(spark, issues):
    twice = issues.unionByName(issues.filter("id = 2").withColumn("id", F.lit(9).cast("long")))
    assert I.ready_issue_for(twice, F.lit(PERIOD)).first().id == 9
    assert [r.n_issues for r in I.duplicate_periods(twice).collect()] == [2]
    assert I.latest_ready_issue(issues).first().id == 2
    assert [r.id for r in I.recent_issues(issues).collect()] == [2, 1, 3]


def test_upsert(spark, issues):
    texts = "period_start date, has_items boolean, simple_text string, normal_text string, glossary_json string, payload_json string"
    built = spark.createDataFrame(
        [
            (PERIOD, True, "s", "n", "g", "p"),  # ready already
            (date(2026, 4, 13), True, "s", "n", "g", "p"),  # draft becomes ready
            (date(2026, 4, 20), False, "s", "n", "g", "p"),  # nothing collected
            (date(2026, 4, 27), True, None, None, None, None),  # no answer
            (date(2026, 5, 4), True, "s", "n", "g", "p"),
        ],
        texts,
    )
    rows = {str(r.period_start): r for r in I.upsert_issues(issues, built, F.lit(NOW)).collect()}
    assert {k: (r.status, r.simple_text) for k, r in rows.items()} == {
        "2026-03-30": ("ready", ""), "2026-04-06": ("ready", ""), "2026-04-13": ("ready", "s"),
        "2026-04-20": ("draft", ""), "2026-04-27": ("draft", ""), "2026-05-04": ("ready", "s"),
    }
    assert rows["2026-04-13"].id == 3 and rows["2026-04-13"].ready_at == NOW
    fresh = [rows[k].id for k in ("2026-04-20", "2026-04-27", "2026-05-04")]
    assert len(set(fresh)) == 3 and min(fresh) > 3


def test_replacing_items_leaves_other_issues(spark, tmp_path):
    table = IssueItems(spark, str(tmp_path / "items"), "id long, issue_id long")
    table.replace(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, issue_id long"))
    table.replace(spark.createDataFrame([(9, 1)], "id long, issue_id long"))
    rows = table.read().collect()
    assert sorted((r.id, r.issue_id) for r in rows) == [(3, 2), (9, 1)]


def test_log_rows_keep_their_issue(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, None, "manual_resend", NOW), (2, 5, "weekly:x", NOW)],
                                 "subscriber_id long, issue_id long, kind string, sent_at timestamp")
    write_log(rows, path)
    back = read_table(spark, path, "subscriber_id long, kind string, sent_at timestamp, issue_id long")
    assert {r.subscriber_id: r.issue_id for r in back.collect()} == {1: None, 2: 5}
