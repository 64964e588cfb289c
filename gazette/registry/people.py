"""Queries over subscribers and the send log."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import keywords as K
from gazette.operators import audience as A
from gazette.operators import integrity as I
from gazette.operators import matching as M
from gazette.operators import reporting as R
from gazette.registry.base import STEPS, query, sql_strip, sql_time, time_text
from gazette.registry.fixtures import issues, table, view
from gazette.schemas import SUBSCRIBERS
from gazette.session import shared_dir
from gazette.sources.tables import read_table, write_snapshot

_JSON_LIST = """CASE WHEN json_valid({c}) THEN CASE json_type({c})
  WHEN 'ARRAY' THEN from_json({c}, '["JSON"]')
  WHEN 'OBJECT' THEN CASE WHEN json_type({c}, '$.keywords') = 'ARRAY'
    THEN from_json(json_extract({c}, '$.keywords'), '["JSON"]') END END END"""

STEPS["words"] = f"""
SELECT *, list_filter(words, lambda w, i: list_position(words, w) = i) AS keywords FROM (
  SELECT s.*, list_filter(list_transform(list_filter(coalesce({_JSON_LIST.format(c='keywords_json')}, []),
    lambda x: json_type(x) = 'VARCHAR'), lambda x: {sql_strip("x->>'$'")}), lambda w: w <> '') AS words
  FROM v_subscribers s) t"""
STEPS["lower_words"] = f"""
SELECT *, list_transform(list_filter(keywords, lambda k: {sql_strip('k')} <> ''), lambda k: lower({sql_strip('k')})) AS kws
FROM v_words"""
STEPS["eligible"] = "SELECT * FROM v_lower_words WHERE status = 'active' AND confirmed_at IS NOT NULL"
STEPS["stats"] = """SELECT subscriber_id, count(*) AS send_count, max(sent_at) AS last_sent_at
FROM v_send_log GROUP BY subscriber_id"""
_WHOLE = "CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END"
STEPS["admin_rows"] = f"""
SELECT w.id, w.email, w.status, w.mode, array_to_string(w.keywords, ',') AS keywords,
  coalesce(nullif(w.keywords_json, ''), '[]') AS keywords_json, {_WHOLE.format(c='w.created_at')} AS created_at,
  {_WHOLE.format(c='w.confirmed_at')} AS confirmed_at, {_WHOLE.format(c='s.last_sent_at')} AS last_sent_at,
  coalesce(s.send_count, 0) AS send_count, w.kws, w.created_at AS created
FROM v_lower_words w LEFT JOIN v_stats s ON s.subscriber_id = w.id"""
_ADMIN = "id, email, status, mode, keywords, keywords_json, created_at, confirmed_at, last_sent_at, send_count"


def _joined(df):
    return df.withColumn("keywords", F.array_join("keywords", ","))


def _subscribers(spark, sf):
    return view(spark, sf, "subscribers")


# The table is written in the store's layout and read back with its schema.
@query(
    "subscriber_scan",
    f"""SELECT id, email, mode, keywords_json, status, confirm_token, unsubscribe_token, manage_token,
    {sql_time('created_at')} AS created_at, {sql_time('confirmed_at')} AS confirmed_at FROM v_subscribers""",
)
def subscriber_scan(spark, sf):
    path = shared_dir(spark, "subscribers")
    write_snapshot(_subscribers(spark, sf), path)
    rows = read_table(spark, path, SUBSCRIBERS)
    return rows.withColumn("created_at", time_text("created_at")).withColumn("confirmed_at", time_text("confirmed_at"))


@query("keywords_parse", "SELECT id, CAST(len(keywords) AS INT) AS n, array_to_string(keywords, '|') AS keywords FROM v_words")
def keywords_parse(spark, sf):
    rows = _subscribers(spark, sf).select("id", K.keywords_parse(F.col("keywords_json")).alias("k"))
    return rows.select("id", F.size("k").alias("n"), F.array_join("k", "|").alias("keywords"))


@query("keywords_normalize", "SELECT id, array_to_string(kws, '|') AS keywords FROM v_lower_words")
def keywords_normalize(spark, sf):
    words = K.keywords_normalize(K.keywords_parse(F.col("keywords_json")))
    return _subscribers(spark, sf).select("id", F.array_join(words, "|").alias("keywords"))


STEPS["typed"] = f"""SELECT event_id, list_filter(list_transform(string_split(replace(keywords_text, '，', ','), ','),
  lambda p: {sql_strip('p')}), lambda p: p <> '')[1:3] AS k FROM v_actions"""


@query("keywords_from_text", "SELECT event_id, array_to_string(k, '|') AS keywords FROM v_typed")
def keywords_from_text(spark, sf):
    words = K.keywords_from_text(F.col("keywords_text"))
    return view(spark, sf, "actions").select("event_id", F.array_join(words, "|").alias("keywords"))


@query(
    "keywords_format",
    """SELECT event_id, '[' || array_to_string(list_transform(k, lambda x: '"' || x || '"'), ', ') || ']' AS as_json,
    array_to_string(k, ', ') AS as_csv, array_to_string(k, ';') AS as_cell FROM v_typed""",
)
def keywords_format(spark, sf):
    rows = view(spark, sf, "actions").withColumn("k", K.keywords_from_text(F.col("keywords_text")))
    k = F.col("k")
    return rows.select(
        "event_id",
        K.keywords_to_json(k).alias("as_json"),
        K.keywords_to_csv(k).alias("as_csv"),
        K.keywords_to_cell(k).alias("as_cell"),
    )


@query("audience_eligible", "SELECT id, email FROM v_eligible")
def audience_eligible(spark, sf):
    return A.eligible(_subscribers(spark, sf)).select("id", "email")


@query("subscribers_by_status", "SELECT 'pending' AS asked, id FROM v_subscribers WHERE status = 'pending' UNION ALL SELECT 'gone', id FROM v_subscribers")
def subscribers_by_status(spark, sf):
    rows = _subscribers(spark, sf)
    asked = [A.by_status(rows, s).select(F.lit(s).alias("asked"), "id") for s in ("pending", "gone")]
    return asked[0].unionByName(asked[1])


@query(
    "subscribers_email_search",
    "SELECT id, email FROM v_subscribers WHERE email ILIKE '%user._5%example%'",
)
def subscribers_email_search(spark, sf):
    return A.by_email_text(_subscribers(spark, sf), " user._5%EXAMPLE ").select("id", "email")


@query("subscribers_by_keyword", "SELECT id, email FROM v_words WHERE list_contains(list_transform(keywords, lambda k: lower(k)), 'ring')")
def subscribers_by_keyword(spark, sf):
    return A.by_keyword(_subscribers(spark, sf), " Ring ").select("id", "email")


_WORDS = ["mig", "über", "the ring", "casino"]


@query(
    "keyword_contains",
    f"""SELECT doc_id, list_any_value(list_filter({_WORDS}, lambda k: contains(lower(text), k))) IS NOT NULL AS matched
    FROM documents""",
)
def keyword_contains(spark, sf):
    words = F.array(*[F.lit(w) for w in _WORDS])
    return table(spark, sf, "documents").select(
        "doc_id", K.contains_any(F.col("text"), words).alias("matched")
    )


@query("audience_target_email", "SELECT id, email FROM v_eligible WHERE lower(email) = 'user.21@example.org'")
def audience_target_email(spark, sf):
    return A.target_email(A.eligible(_subscribers(spark, sf)), " USER.21@example.org").select("id", "email")


# Requests: each event asks for the subscriber that holds a manage token.
@query(
    "subscriber_lookup",
    f"""SELECT e.event_id, s.id, s.email, {sql_time('s.created_at')} AS created_at FROM events e
    JOIN (SELECT * FROM v_signups QUALIFY row_number() OVER (PARTITION BY manage_token ORDER BY created_at DESC, id) = 1) s
    ON s.manage_token = 'm' || CAST(e.user_id AS VARCHAR)""",
)
def subscriber_lookup(spark, sf):
    asked = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("manage_token")
    )
    found = A.lookup(asked, view(spark, sf, "signups"), "manage_token")
    return found.select("event_id", "id", "email", time_text("created_at").alias("created_at"))


@query(
    "latest_subscriber",
    f"""SELECT id, email, {sql_time('created_at')} AS created_at FROM v_signups
    QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id) = 1""",
)
def latest_subscriber(spark, sf):
    rows = A.newest(view(spark, sf, "signups"), "email")
    return rows.select("id", "email", time_text("created_at").alias("created_at"))


@query(
    "duplicate_tokens",
    """SELECT id, confirm_token, count(*) OVER (PARTITION BY confirm_token) AS n_holders,
    row_number() OVER (PARTITION BY confirm_token ORDER BY created_at DESC, id) > 1 AS needs_new_tokens
    FROM v_signups QUALIFY n_holders > 1""",
)
def duplicate_tokens(spark, sf):
    rows = A.duplicate_tokens(view(spark, sf, "signups"), "confirm_token")
    return rows.select("id", "confirm_token", "n_holders", "needs_new_tokens")


_CANDIDATES = [
    "s_suppkey AS candidate_id",
    "concat('c', CAST(s_suppkey * 7 AS STRING)) AS confirm_token",
    "concat('u', CAST(s_suppkey * 40 AS STRING), '&x') AS unsubscribe_token",
    "concat('new', CAST(s_suppkey AS STRING)) AS manage_token",
]


@query(
    "token_clashes",
    f"""SELECT candidate_id, count(*) AS n_taken FROM (
    SELECT candidate_id FROM (SELECT {', '.join(_CANDIDATES)} FROM supplier) c
      WHERE confirm_token IN (SELECT confirm_token FROM v_subscribers)
    UNION ALL SELECT candidate_id FROM (SELECT {', '.join(_CANDIDATES)} FROM supplier) c
      WHERE unsubscribe_token IN (SELECT unsubscribe_token FROM v_subscribers)
    UNION ALL SELECT candidate_id FROM (SELECT {', '.join(_CANDIDATES)} FROM supplier) c
      WHERE manage_token IN (SELECT manage_token FROM v_subscribers)) t GROUP BY candidate_id""",
)
def token_clashes(spark, sf):
    return A.token_clashes(table(spark, sf, "supplier").selectExpr(*_CANDIDATES), _subscribers(spark, sf))


_ROW = ["id", "mode", "keywords_json", "status", "confirm_token", "unsubscribe_token", "manage_token", "confirmed_at"]
_CHANGE = ["change_id", "if_status", "token_kind", "if_token", "new_mode", "new_keywords_json", "new_status", "new_confirm_token",
           "new_unsubscribe_token", "new_manage_token", "new_confirmed_at", "clear_confirmed"]
_FITS = """((x.if_status IS NULL OR coalesce(x.if_status = a.status, false)) AND (x.if_token IS NULL OR coalesce(x.if_token = CASE x.token_kind
  WHEN 'confirm_token' THEN a.confirm_token WHEN 'manage_token' THEN a.manage_token WHEN 'unsubscribe_token' THEN a.unsubscribe_token END, false)))"""


def _after(name):
    if name == "id":
        return "a.id"
    new = f"coalesce(x.new_{name}, a.{name})"
    new = f"CASE WHEN x.clear_confirmed THEN NULL ELSE {new} END" if name == "confirmed_at" else new
    return f"CASE WHEN {_FITS} THEN {new} ELSE a.{name} END"


# One pass over the changes of each row; every list element carries the row beside the change.
_BARE = ", ".join(f"'{c}': CAST(NULL AS {'TIMESTAMP' if c == 'confirmed_at' else 'BIGINT' if c == 'id' else 'VARCHAR'})" for c in _ROW)
_HELD = ", ".join(f"'{c}': s.{c}" for c in _ROW)
STEPS["changed"] = f"""
SELECT s.id, s.email, list_reduce(list_prepend({{{_HELD}, 'refused': CAST([] AS BIGINT[]), {', '.join(f"'{c}': l[1].{c}" for c in _CHANGE)}}}, l), lambda a, x:
  {{{', '.join(f"'{c}': {_after(c)}" for c in _ROW)}, 'refused': CASE WHEN {_FITS} THEN a.refused ELSE list_append(a.refused, x.change_id) END,
  {', '.join(f"'{c}': x.{c}" for c in _CHANGE)}}}) AS r
FROM v_subscribers s JOIN (SELECT email AS address, list({{{_BARE}, 'refused': CAST([] AS BIGINT[]), {', '.join(f"'{c}': {c}" for c in _CHANGE)}}} ORDER BY change_id) AS l
  FROM v_changes GROUP BY email) c ON c.address = lower(s.email)"""


@query(
    "subscriber_apply_changes",
    f"""SELECT id, email, r.mode AS mode, r.keywords_json AS keywords_json, r.status AS status, r.confirm_token AS confirm_token,
    r.unsubscribe_token AS unsubscribe_token, r.manage_token AS manage_token, {sql_time('r.confirmed_at')} AS confirmed_at FROM v_changed
    UNION ALL SELECT id, email, mode, keywords_json, status, confirm_token, unsubscribe_token, manage_token, {sql_time('confirmed_at')}
    FROM v_subscribers WHERE id NOT IN (SELECT id FROM v_changed)""",
)
def subscriber_apply_changes(spark, sf):
    rows = A.apply_changes(_subscribers(spark, sf), view(spark, sf, "changes"))
    return rows.drop("created_at").withColumn("confirmed_at", time_text("confirmed_at"))


@query("subscriber_refused_changes", "SELECT id, unnest(r.refused) AS change_id FROM v_changed")
def subscriber_refused_changes(spark, sf):
    return A.refused_changes(_subscribers(spark, sf), view(spark, sf, "changes"))


@query(
    "audience_metrics",
    """SELECT count(id) AS total, count(*) FILTER (status = 'active' AND confirmed_at IS NOT NULL) AS active_confirmed,
    count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'unsubscribed') AS unsubscribed FROM v_subscribers""",
)
def audience_metrics(spark, sf):
    return R.audience_metrics(_subscribers(spark, sf))


STEPS["ranked_words"] = """
SELECT lower(w) AS keyword, count(*) AS active_confirmed_count, min((-epoch_us(confirmed_at), id, pos)) AS first_seen
FROM (SELECT id, confirmed_at, unnest(keywords) AS w, generate_subscripts(keywords, 1) AS pos
      FROM (SELECT * FROM v_eligible ORDER BY confirmed_at DESC, id LIMIT 5000) l) t
GROUP BY lower(w) ORDER BY active_confirmed_count DESC, first_seen LIMIT 20"""


@query("top_keywords", "SELECT keyword, active_confirmed_count FROM v_ranked_words")
def top_keywords(spark, sf):
    return R.top_keywords(_subscribers(spark, sf))


@query("send_stats", f"SELECT subscriber_id, send_count, {sql_time('last_sent_at')} AS last_sent_at FROM v_stats")
def send_stats(spark, sf):
    return R.send_stats(view(spark, sf, "send_log")).withColumn("last_sent_at", time_text("last_sent_at"))


@query("subscribers_with_sends", "SELECT id, email, send_count, last_sent_at FROM v_admin_rows")
def subscribers_with_sends(spark, sf):
    rows = R.admin_row(R.with_sends(_subscribers(spark, sf), view(spark, sf, "send_log")))
    return rows.select("id", "email", "send_count", "last_sent_at")


@query("admin_row", f"SELECT {_ADMIN} FROM v_admin_rows")
def admin_row(spark, sf):
    return _joined(R.admin_row(R.with_sends(_subscribers(spark, sf), view(spark, sf, "send_log"))))


# The keyword drops rows of the page; the page itself is cut first.
@query(
    "subscribers_page",
    f"""SELECT {_ADMIN} FROM (SELECT * FROM v_admin_rows WHERE status = 'active' AND email ILIKE '%user.1%'
    ORDER BY created DESC, id LIMIT 200 OFFSET 3) t WHERE list_contains(kws, 'ring')""",
)
def subscribers_page(spark, sf):
    return _joined(
        R.subscribers_page(
            _subscribers(spark, sf), view(spark, sf, "send_log"),
            q="user.1", status="active", keyword="Ring", limit=1000, offset=3,
        )
    )


# A page down the list, found by counts of ranges instead of the rows ahead of it.
@query("subscribers_page_deep", f"SELECT {_ADMIN} FROM v_admin_rows ORDER BY created DESC, id LIMIT 50 OFFSET 70")
def subscribers_page_deep(spark, sf):
    return _joined(R.subscribers_page(_subscribers(spark, sf), view(spark, sf, "send_log"), limit=50, offset=70, deep=0))


# Every customer that ordered is asked for, some of them many times.
@query("subscriber_detail", f"SELECT {_ADMIN} FROM v_admin_rows WHERE id IN (SELECT o_custkey FROM orders)")
def subscriber_detail(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return _joined(R.subscriber_detail(ids, _subscribers(spark, sf), view(spark, sf, "send_log")))


@query(
    "subscriber_export_csv",
    f"""SELECT '{R.CSV_MARK}id,email,status,mode,keywords,created_at,confirmed_at' AS line UNION ALL
    SELECT CAST(id AS VARCHAR) || ',"' || replace(email, '"', '""') || '",' || status || ',' || mode || ',"' ||
    replace(array_to_string(keywords, ';'), '"', '""') || '",' || {_WHOLE.format(c='created_at')} || ',' ||
    coalesce({_WHOLE.format(c='confirmed_at')}, '') FROM v_words""",
)
def subscriber_export_csv(spark, sf):
    return R.export_lines(_subscribers(spark, sf)).select("line")


STEPS["kept_subscribers"] = "SELECT * FROM v_subscribers WHERE status <> 'unsubscribed'"


@query(
    "fk_orphans",
    """SELECT 'raw_items.issue_id' AS reference, CAST(issue_id AS BIGINT) AS ref_id, count(*) AS n_rows FROM v_issue_items
      WHERE issue_id NOT IN (SELECT id FROM v_issues WHERE status = 'ready') GROUP BY issue_id
    UNION ALL SELECT 'send_log.issue_id', issue_id, count(*) FROM v_send_log
      WHERE issue_id NOT IN (SELECT id FROM v_issues WHERE status = 'ready') GROUP BY issue_id
    UNION ALL SELECT 'send_log.subscriber_id', subscriber_id, count(*) FROM v_send_log
      WHERE subscriber_id NOT IN (SELECT id FROM v_kept_subscribers) GROUP BY subscriber_id""",
)
def fk_orphans(spark, sf):
    return I.fk_orphans(
        view(spark, sf, "issue_items").withColumn("issue_id", F.col("issue_id").cast("long")),
        view(spark, sf, "send_log"),
        issues(spark, sf).filter("status = 'ready'"),
        _subscribers(spark, sf).filter("status <> 'unsubscribed'"),
    )


@query(
    "purge_subscriber",
    """SELECT 'subscribers' AS kept_in, id FROM v_kept_subscribers UNION ALL SELECT 'send_log', id FROM v_send_log
    WHERE subscriber_id NOT IN (SELECT id FROM v_subscribers WHERE status = 'unsubscribed')""",
)
def purge_subscriber(spark, sf):
    people = _subscribers(spark, sf)
    kept, log = I.purge_subscribers(people, view(spark, sf, "send_log"), people.filter("status = 'unsubscribed'"))
    return kept.select(F.lit("subscribers").alias("kept_in"), "id").unionByName(
        log.select(F.lit("send_log").alias("kept_in"), "id")
    )


@query(
    "purge_issue",
    """SELECT 'issues' AS kept_in, id, id AS issue_id FROM v_issues WHERE status <> 'draft'
    UNION ALL SELECT 'raw_items', item_id, CASE WHEN issue_id NOT IN (SELECT id FROM v_issues WHERE status = 'draft')
      THEN CAST(issue_id AS BIGINT) END FROM v_issue_items
    UNION ALL SELECT 'send_log', id, CASE WHEN issue_id NOT IN (SELECT id FROM v_issues WHERE status = 'draft')
      THEN issue_id END FROM v_send_log""",
)
def purge_issue(spark, sf):
    store = issues(spark, sf)
    items = view(spark, sf, "issue_items").select(
        F.col("item_id").alias("id"), F.col("issue_id").cast("long").alias("issue_id")
    )
    kept, items, log = I.purge_issues(store, items, view(spark, sf, "send_log"), store.filter("status = 'draft'"))
    tagged = [
        kept.select(F.lit("issues").alias("kept_in"), "id", F.col("id").alias("issue_id")),
        items.select(F.lit("raw_items").alias("kept_in"), "id", "issue_id"),
        log.select(F.lit("send_log").alias("kept_in"), "id", "issue_id"),
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


STEPS["all_words"] = "SELECT DISTINCT unnest(kws) AS keyword FROM v_lower_words"
STEPS["matches"] = """SELECT k.keyword, i.item_id, i.issue_id, i.section FROM v_all_words k
JOIN v_issue_items i ON contains(lower(i.content), k.keyword)"""


@query("keyword_item_match", "SELECT keyword, item_id FROM v_matches")
def keyword_item_match(spark, sf):
    words = M.distinct_keywords(_subscribers(spark, sf))
    return M.keyword_matches(words, view(spark, sf, "issue_items"), "item_id", "content")


@query(
    "keyword_set_match",
    """SELECT DISTINCT set_key, issue_id, section FROM (
      SELECT DISTINCT array_to_string(list_sort(list_distinct(kws)), chr(10)) AS set_key, unnest(kws) AS keyword FROM v_lower_words) s
    JOIN v_matches m USING (keyword)""",
)
def keyword_set_match(spark, sf):
    people, items = _subscribers(spark, sf), view(spark, sf, "issue_items")
    found = M.keyword_matches(M.distinct_keywords(people), items, "item_id", "content")
    return M.sections_per_set(M.keyword_sets(people), found, items, "item_id")
