"""Views over the given tables in the shapes the operators work on.

Each is one projection of one table, written in SQL that Spark and DuckDB read alike. Where the two
name a function differently the text holds a mark, see `DIALECTS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.common import once, spread

DIALECTS = {
    "spark": {"<sha(": "sha2(", ")sha>": ", 256)", "<days(": "unix_date(", ")days>": ")"},
    "duckdb": {
        "<sha(": "sha256(", ")sha>": ")",
        "<days(": "date_diff('day', DATE '1970-01-01', ", ")days>": ")",
    },
}


def dialect(text: str, name: str) -> str:
    for mark, spelled in DIALECTS[name].items():
        text = text.replace(mark, spelled)
    return text


NL = "chr(10)"
EMAIL = "concat('User.', CAST({id} AS STRING), '@Example.org')"
WEEK = "CAST(date_trunc('week', o_orderdate + INTERVAL '8' HOUR) AS DATE)"
BRAND = "CAST(split_part(p_brand, '#', 2) AS INT)"
KEY = "CAST(p_partkey AS STRING)"


def _concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _q(text: str) -> str:
    """A text literal; a backslash becomes chr(92), which both engines read the same."""
    pieces = ["'" + t.replace("'", "''") + "'" for t in text.split("\\")]
    return pieces[0] if len(pieces) == 1 else _concat(", chr(92), ".join(pieces))


# A raw answer: objects, bare strings and rejects in each list, escapes, over-long texts, nulls,
# and, in some rows, more elements than a list keeps or a glossary that is no list.
ANSWER_JSON = _concat(
    _q('{"simple":{"lines":[{"text":"'), "p_name", _q('","url":"https://example.org/p/'), KEY,
    _q('"},"plain '), "p_type", _q('",{"text":"no url"},{"text":"'), "p_brand",
    _q(' <b>&\\"co\\" it\'s</b>","url":" https://example.org/b?x=1&y=2 "},{"text":true,"url":'), KEY, _q("}"),
    f"CASE WHEN p_partkey % 3 = 0 THEN repeat({_concat(_q(',{"text":"'), 'p_type', _q(' again","url":"https://example.org/t"}'))}, 9) ELSE '' END",
    _q('],"footer":'),
    f"CASE p_partkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN {_q('""')} ELSE {_concat(_q('"about '), 'p_type', _q('"'))} END",
    _q('},"normal":{"top3":[{"title":"'), "p_name", _q('","url":"u"},"bare",{"title":"'), "repeat(p_type, 50)",
    _q('","url":"https://example.org/top"}'),
    f"CASE WHEN p_partkey % 4 = 0 THEN {_q(',"a","b","c",{"title":"cut off","url":"x"}')} ELSE '' END",
    _q('],"sections":[{"title":"'), "p_brand", _q('","paragraph":"first '), "p_name",
    _q('\\nsecond line"},"skip me",{"title":null}]},"glossary":'),
    f"CASE WHEN p_partkey % 9 = 4 THEN {_q('{"term":"no list"}')} ELSE "
    + _concat(
        _q('[{"term":"'), "p_type", _q('","explain":"'), "p_name", _q('"},{"explain":"no term"},{"term":"'),
        "repeat(p_type, 20)", _q('","explain":null},{"term":"bare"}]'),
    )
    + " END",
    _q("}"),
)

VIEWS: dict[str, tuple[str, list[str]]] = {
    # Feed entries. Copies across sources share link and title; some have neither.
    "entries": (
        "documents",
        [
            "doc_id AS entry_id",
            "source AS feed_url",
            "CAST(substr(source, 4) AS INT) AS feed_ord",
            f"CASE WHEN doc_id % 22 = 3 THEN '  ' ELSE split_part(text, {NL}, 1) END AS title",
            "text AS summary",
            "CASE WHEN doc_id % 11 = 3 THEN '' ELSE concat(' https://example.org/', lang, '/', "
            "CAST(n_chars AS STRING)) END AS link",
            "TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS published_at",
        ],
    ),
    # Subscription actions, one history per user.
    "actions": (
        "events",
        [
            "event_id",
            "CAST(user_id AS STRING) AS email",
            "CAST(ts AS TIMESTAMP) AS ts",
            "CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'view' THEN 'confirm' "
            "WHEN 'error' THEN 'unsubscribe' WHEN 'click' THEN 'manage' "
            "ELSE 'resend_confirmation' END AS action",
            "CASE WHEN event_id % 2 = 0 THEN 'simple' ELSE 'normal' END AS mode",
            "concat(event_type, '，', ' k', CAST(event_id % 5 AS STRING), ',, ', CAST(value AS STRING), ',d') AS keywords_text",
            "concat('t', CAST(event_id % 2 AS STRING)) AS token",
            "event_id % 7 <> 0 AS mail_ok",
        ],
    ),
    # Guarded updates of the subscriber table.
    "changes": (
        "events",
        [
            "event_id AS change_id",
            f"lower({EMAIL.format(id='user_id')}) AS email",
            "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'active' END AS if_status",
            "CASE event_type WHEN 'click' THEN 'manage_token' WHEN 'error' THEN 'unsubscribe_token' END AS token_kind",
            "CASE event_type WHEN 'click' THEN concat('m', CAST(user_id - event_id % 3 AS STRING)) "
            "WHEN 'error' THEN concat('u', CAST(user_id AS STRING), '&x') END AS if_token",
            "CASE WHEN event_type IN ('click', 'signup') THEN 'simple' END AS new_mode",
            "CASE WHEN event_type = 'click' THEN '[\"new\"]' END AS new_keywords_json",
            "CASE event_type WHEN 'error' THEN 'unsubscribed' WHEN 'purchase' THEN 'pending' END AS new_status",
            "CASE WHEN event_type = 'purchase' THEN concat('c', CAST(event_id AS STRING), '!') END AS new_confirm_token",
            "CAST(NULL AS STRING) AS new_unsubscribe_token",
            "CASE WHEN event_type = 'purchase' THEN concat('m', CAST(event_id AS STRING), '!') END AS new_manage_token",
            "CASE WHEN event_type = 'view' THEN CAST(ts AS TIMESTAMP) END AS new_confirmed_at",
            "event_type = 'purchase' AS clear_confirmed",
        ],
    ),
    "subscribers": (
        "customer",
        [
            "c_custkey AS id",
            f"{EMAIL.format(id='c_custkey')} AS email",
            "CASE WHEN c_custkey % 2 = 0 THEN 'simple' ELSE 'normal' END AS mode",
            "CASE c_custkey % 6 WHEN 0 THEN '[]' WHEN 1 THEN '[\"widget\",\" widget \",\"Widget\"]' "
            "WHEN 2 THEN '[\"plate\",\"ring\"]' WHEN 3 THEN '{\"keywords\":[\"rod\",\"red\"]}' "
            "WHEN 4 THEN 'not json' ELSE concat('[\"', lower(c_mktsegment), '\",\"RING\",7,null]') END AS keywords_json",
            "CASE WHEN c_custkey % 10 < 6 THEN 'active' WHEN c_custkey % 10 < 8 THEN 'pending' "
            "ELSE 'unsubscribed' END AS status",
            "concat('c', CAST(c_custkey AS STRING)) AS confirm_token",
            "concat('u', CAST(c_custkey AS STRING), '&x') AS unsubscribe_token",
            "concat('m', CAST(c_custkey AS STRING)) AS manage_token",
            "TIMESTAMP '2023-06-01 00:00:00' + ((c_custkey * 7919) % 100003) * INTERVAL '1' SECOND AS created_at",
            "CASE WHEN c_custkey % 10 IN (5, 6, 7) THEN NULL ELSE TIMESTAMP '2023-07-01 00:00:00' + "
            "((c_custkey * 104729) % 100003) * INTERVAL '1' SECOND END AS confirmed_at",
        ],
    ),
    "send_log": (
        "orders",
        [
            "o_orderkey AS id",
            "o_custkey AS subscriber_id",
            f"CAST((<days({WEEK})days> - 9867) / 7 AS BIGINT) AS issue_id",
            f"concat('weekly:', CAST({WEEK} AS STRING), ':', "
            f"substr(<sha(lower({EMAIL.format(id='o_custkey')}))sha>, 1, 16)) AS kind",
            "CAST(o_orderdate AS TIMESTAMP) AS sent_at",
        ],
    ),
    # Several rows per address, as a store without unique keys may hold them.
    "signups": (
        "orders",
        [
            "o_orderkey AS id",
            f"{EMAIL.format(id='o_custkey')} AS email",
            "concat('t', CAST(o_custkey % 997 AS STRING)) AS confirm_token",
            "concat('u', CAST(o_orderkey AS STRING)) AS unsubscribe_token",
            "concat('m', CAST(o_custkey AS STRING)) AS manage_token",
            "CAST(o_orderdate AS TIMESTAMP) AS created_at",
        ],
    ),
    # Raw model answers in five shapes: fenced, bare, inside prose, fenced without a name, none.
    "answers": (
        "part",
        [
            "p_partkey AS response_id",
            f"{BRAND} AS issue_id",
            f"concat(CASE p_partkey % 5 WHEN 0 THEN concat('```JSON', {NL}) WHEN 2 THEN 'Here it is: ' "
            f"WHEN 3 THEN '```' WHEN 4 THEN 'sorry ' ELSE '' END, "
            f"CASE WHEN p_partkey % 5 = 4 THEN p_name ELSE {ANSWER_JSON} END, "
            f"CASE p_partkey % 5 WHEN 0 THEN concat({NL}, '```') WHEN 2 THEN ' Done.' WHEN 3 THEN '```' ELSE '' END) AS content",
        ],
    ),
    # Payload elements one per row.
    "issue_items": (
        "part",
        [
            f"{BRAND} AS issue_id",
            "p_partkey AS item_id",
            "CASE p_type WHEN 'ECONOMY' THEN 'line' WHEN 'STANDARD' THEN 'line' WHEN 'LARGE' THEN 'top3' "
            "WHEN 'MEDIUM' THEN 'section' WHEN 'SMALL' THEN 'glossary' ELSE 'footer' END AS section",
            "concat(p_name, ' https://example.org/p/', CAST(p_partkey AS STRING)) AS content",
        ],
    ),
}

# Issues of the store, one per brand number; every fourth is still a draft.
ISSUE_ROWS = [
    "CAST(b AS BIGINT) AS id",
    "DATE '1997-01-06' + CAST(7 * b AS INT) AS period_start",
    "CASE WHEN b % 4 = 0 THEN 'draft' ELSE 'ready' END AS status",
    "CASE WHEN b % 4 = 0 THEN NULL ELSE TIMESTAMP '1997-01-06 00:30:00' + b * INTERVAL '7' DAY END AS ready_at",
    "TIMESTAMP '1997-01-06 00:00:00' + b * INTERVAL '7' DAY AS created_at",
]




def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    rows = table(spark, sf_dir, source)
    if name == "answers":  # a few bytes of a part make an answer of some kilobytes
        rows = spread(rows)
    rows = rows.selectExpr(*[dialect(c, "spark") for c in columns])
    if name == "answers":  # one long expression, as a stored column would be
        rows = once(rows.withColumnRenamed("content", "_c"), content=F.col("_c")).drop("_c")
    return rows


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.expr(BRAND).alias("b")).distinct()
    return brands.selectExpr(*ISSUE_ROWS)


def ctes() -> dict[str, str]:
    """The same views for DuckDB, by name."""
    made = {
        name: dialect(f"SELECT {', '.join(columns)} FROM {source}", "duckdb")
        for name, (source, columns) in VIEWS.items()
    }
    made["issues"] = f"SELECT {', '.join(ISSUE_ROWS)} FROM (SELECT DISTINCT {BRAND} AS b FROM part) t"
    return made
