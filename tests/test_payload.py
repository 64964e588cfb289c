from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gazette.functions import payload as P
from gazette.operators import issues
from gazette.operators.issues import rejected_answers, with_answer_payload, with_texts
from gazette.plans import weekly_issue
from gazette.registry import catalog
from gazette.registry.fixtures import view


def cleaned(spark, doc, passes=2):
    df = spark.createDataFrame([(1, json.dumps(doc, ensure_ascii=False))], "response_id long, content string")
    row = with_answer_payload(df, passes).first()
    return row.payload.asDict(recursive=True) if row else None


def test_bare_strings_count_before_they_go(spark):
    lines = [f"bare {i}" for i in range(6)] + [{"text": f"t{i}", "url": "u"} for i in range(8)]
    doc = {"simple": {"lines": lines}}
    assert [x["text"] for x in cleaned(spark, doc)["simple"]["lines"]] == ["t0", "t1", "t2", "t3"]
    once = cleaned(spark, doc, passes=1)["simple"]["lines"]
    assert len(once) == 10 and once[0] == {"text": "bare 0", "url": ""}


def test_caps_and_cuts(spark):
    doc = {
        "simple": {"lines": [{"text": "x" * 301, "url": "u" * 3000}] * 12},
        "normal": {"top3": [{"title": "y" * 201, "url": "u"}] * 7},
        "glossary": [{"term": "z" * 65, "explain": "e" * 121}] * 20,
    }
    got = cleaned(spark, doc)
    assert len(got["simple"]["lines"]) == 10 and len(got["normal"]["top3"]) == 5 and len(got["glossary"]) == 20
    assert len(got["simple"]["lines"][0]["text"]) == 300 and len(got["simple"]["lines"][0]["url"]) == 2048
    assert len(got["normal"]["top3"][0]["title"]) == 200
    assert (len(got["glossary"][0]["term"]), len(got["glossary"][0]["explain"])) == (64, 120)


def test_null_absent_and_other_kinds(spark):
    doc = {
        "simple": {"footer": None, "lines": [{"text": "a"}, {"text": "", "url": "u"}, {"text": 5, "url": True}, 7, None]},
        "normal": {"sections": [{"title": None}, "no", {"paragraph": "p"}, 3]},
        "glossary": [{"term": "t", "explain": None}, {"term": "t"}, {"term": 0}, {"explain": "e"}, {"term": False}],
    }
    got = cleaned(spark, doc)
    assert got["simple"] == {"lines": [{"text": "5", "url": "True"}], "footer": ""}
    assert got["normal"]["sections"] == [{"title": "None", "paragraph": ""}, {"title": "", "paragraph": "p"}]
    assert got["glossary"] == [{"term": "t", "explain": "None"}, {"term": "t", "explain": ""}]


@pytest.mark.parametrize("doc", [{}, {"simple": {"lines": {}}, "glossary": {"term": "x"}}])
def test_missing_parts_are_empty(spark, doc):
    assert cleaned(spark, doc) == {
        "simple": {"lines": [], "footer": ""}, "normal": {"top3": [], "sections": []}, "glossary": [],
    }


@pytest.mark.parametrize(
    "content,footer",
    [
        ('```json\n{"simple":{"footer":"f"}}\n```', "f"),
        ('```JSON{"simple":{"footer":"f"}}```', "f"),
        ('prose ```\n{"simple":{"footer":"f"}}\n``` more {"x":1}', "f"),
        ('  {"simple":{"footer":"f"}}  ', "f"),
        ('Sure: {"simple":{"footer":"f"}} done', "f"),
        ('```json\nhere {"simple":{"footer":"f"}} ok\n```', "f"),
        ("no json", None),
        ("{broken", None),
        ("[1, 2]", None),
        ('```json\n[]\n``` {"simple":{"footer":"f"}}', None),
        ("``````", None),
        ("", None),
    ],
)
def test_answer_shapes(spark, content, footer):
    df = spark.createDataFrame([(1, content)], "response_id long, content string")
    row = with_answer_payload(df).first()
    assert (row.payload.simple.footer if row else None) == footer
    assert rejected_answers(df).count() == (0 if row else 1)


def test_texts(spark):
    doc = {
        "simple": {"lines": [{"text": "a", "url": "u"}], "footer": 'say "hi"'},
        "normal": {"top3": [{"title": "t", "url": "v"}], "sections": [{"title": "s", "paragraph": "p\nq"}]},
        "glossary": [{"term": "g", "explain": "中\"\n"}],
    }
    df = spark.createDataFrame([(1, json.dumps(doc))], "response_id long, content string")
    row = with_texts(with_answer_payload(df)).first()
    assert row.simple_text == 'a (u)\n\nsay "hi"'
    assert row.normal_text == "## 本周 AI 热点排行（Top3）\n- t (v)\n\n## s\n\np\nq"
    assert row.glossary_json == json.dumps(doc["glossary"], ensure_ascii=False)
    assert row.payload_json == json.dumps(doc, ensure_ascii=False)
    back = P.with_payload(df.select(F.lit(row.payload_json).alias("payload_json"))).first()
    assert back.payload.asDict(recursive=True) == doc


@pytest.mark.parametrize("stored", ["", "  ", "{", "{}", None, '{"simple":{}}'])
def test_stored_payload_defaults(spark, stored):
    row = P.with_payload(spark.createDataFrame([(stored,)], "payload_json string")).first()
    assert row.payload.asDict(recursive=True) == {
        "simple": {"lines": [], "footer": ""}, "normal": {"top3": [], "sections": []}, "glossary": [],
    }


def test_stored_lists_keep_bare_elements(spark):
    doc = {
        "simple": {"lines": ["bare", {"text": "t", "url": "u"}, 5, {"text": None}], "footer": "f"},
        "normal": {"top3": [{"title": "a"}, "b"], "sections": ["no", {"title": "s", "paragraph": 1}]},
        "glossary": [{"term": "t", "explain": "e"}, "no"],
    }
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, " "), (3, "{broken"), (4, None)], "id long, payload_json string")
    got = {r.id: r.payload.asDict(recursive=True) for r in P.with_payload(rows).collect()}
    assert got[1] == {
        "simple": {"lines": [{"text": "bare", "url": ""}, {"text": "t", "url": "u"}, {"text": "5", "url": ""}, {"text": "None", "url": ""}], "footer": "f"},
        "normal": {"top3": [{"title": "a", "url": ""}, {"title": "b", "url": ""}], "sections": [{"title": "s", "paragraph": "1"}]},
        "glossary": [{"term": "t", "explain": "e"}],
    }
    empty = {"simple": {"lines": [], "footer": ""}, "normal": {"top3": [], "sections": []}, "glossary": []}
    assert got[2] == got[3] == got[4] == empty


def test_answers_of_one_row_group_are_spread(spark, tmp_path):
    """A part table of one row group is read by one task; what its answers cost is shared by all."""
    part = spark.range(4000).selectExpr(
        "id AS p_partkey", "concat('name ', id) AS p_name", "concat('Brand#', id % 25) AS p_brand", "'SMALL' AS p_type"
    )
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    answers = view(spark, str(tmp_path), "answers").withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in answers.groupBy("task").count().collect()]
    assert len(tasks) == 8 and max(tasks) < 1000 and sum(tasks) == 4000
    assert answers.select("response_id").distinct().count() == 4000


NEWEST = [
    (1, 7, '{"simple": {"footer": "old"}}'), (3, 7, '{"simple": {"footer": "new"}}'), (5, 7, "no object"), (4, 7, "[1]"),
    (2, 8, '{"simple": {"footer": "twice"}}'), (2, 8, '{"simple": {"footer": "twice"}}'), (2, 8, "broken {"), (9, 9, "none"),
    (6, None, '{"simple": {"footer": "no issue"}}'), (None, None, "{}"), (None, 10, '{"simple": {"footer": "no id"}}'),
]


@pytest.mark.parametrize("broadcast", [100, 0])
def test_newest_usable_answer(spark, monkeypatch, broadcast):
    monkeypatch.setattr(issues, "BROADCAST_ISSUES", broadcast)
    answers = spark.createDataFrame(NEWEST, "response_id long, issue_id long, content string")
    got = {(r.issue_id, r.response_id, r.payload.simple.footer) for r in issues.newest_payloads(answers).collect()}
    assert got == {(7, 3, "new"), (8, 2, "twice"), (None, 6, "no issue"), (10, None, "no id")}
    assert issues.newest_payloads(answers).count() == 4


def test_only_the_answers_found_are_sorted(spark):
    """Sorting every answer with its text takes memory that grows with the answers of a task."""
    answers = spark.range(1000).selectExpr("id AS response_id", "id % 5 AS issue_id", "'{}' AS content")
    plan = issues.newest_payloads(answers)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "LeftSemi" in plan[plan.rindex("Window") :]


def test_answers_of_many_issues_are_not_sorted(spark, monkeypatch):
    """More issues than a broadcast takes: the ids are hashed, and the answers pass by them as they come."""
    monkeypatch.setattr(issues, "BROADCAST_ISSUES", 0)
    answers = spark.range(1000).selectExpr("id AS response_id", "id % 500 AS issue_id", "'{}' AS content")
    plan = issues.newest_payloads(answers)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", [
    "delivery_plan", "digest_filter", "issue_fanout", "issue_upsert", "manual_resend_plan", "no_match_banner",
    "resend_latest_plan", "send_log_append", "stream_delivery",
])
def test_no_query_sorts_every_answer(spark, monkeypatch, name):
    plans = []

    def newest(answers, passes=2):
        found = issues.newest_payloads(answers, passes)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(weekly_issue, "newest_payloads", newest)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "LeftSemi" in plans[0][plans[0].rindex("Window") :]
