"""Queries over answers, payloads, mails and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import keys
from gazette.functions import payload as P
from gazette.functions import render as R
from gazette.functions.keywords import keywords_normalize, keywords_parse
from gazette.functions.matching import NO_MATCH_BANNER, filter_digest, no_match_banner, searchable
from gazette.functions.text import html_escape
from gazette.operators import audience as A
from gazette.operators import delivery as D
from gazette.operators import issues as I
from gazette.operators import matching as M
from gazette.operators.common import salted_join
from gazette.plans import mailings, weekly_issue
from gazette.registry import people  # noqa: F401  (its SQL steps are used here)
from gazette.registry.base import STEPS, query, rows_text, sql_rows_text, sql_strip, sql_time, time_text
from gazette.registry.fixtures import issues, table, view
from gazette.schemas import WEEKLY_ISSUES
from gazette.session import shared_dir
from gazette.sources.tables import append_log, read_table, write_log, write_snapshot

URL = "https://digest.example.org/"
PERIOD = "1997-06-30"
SENT_AT = "1997-06-30 01:00:00"


# --- the SQL side -----------------------------------------------------------------------------

def _truthy(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR) NOT IN ('\"\"', '0', '0.0', 'false', 'null', '[]', '{{}}'), false)"


def _printed(x: str) -> str:
    return (
        f"CASE json_type({x}) WHEN 'VARCHAR' THEN {x}->>'$' WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN "
        f"CASE WHEN CAST({x} AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END "
        f"ELSE coalesce(CAST({x} AS VARCHAR), '') END"
    )


def _json_list(path: str) -> str:
    at = f"json_extract(j, '{path}')"
    return f"CASE WHEN json_type({at}) = 'ARRAY' THEN from_json({at}, '[\"JSON\"]') ELSE [] END"


def _links(path: str, label: str, length: int, most: int) -> str:
    value, url = f"json_extract(x, '$.{label}')", "json_extract(x, '$.url')"
    made = (
        f"CASE WHEN json_type(x) = 'OBJECT' AND {_truthy(value)} AND {_truthy(url)} THEN "
        f"{{'{label}': substr({_printed(value)}, 1, {length}), 'url': substr({_printed(url)}, 1, 2048)}} "
        f"WHEN json_type(x) = 'VARCHAR' AND {sql_strip('(x->>' + chr(39) + '$' + chr(39) + ')')} <> '' THEN "
        f"{{'{label}': substr({sql_strip('(x->>' + chr(39) + '$' + chr(39) + ')')}, 1, {length}), 'url': ''}} END"
    )
    all_ = f"list_filter(list_transform({_json_list(path)}, lambda x: {made}), lambda p: p IS NOT NULL)"
    return f"list_filter(({all_})[1:{most}], lambda p: p.url <> '')"


def _esc(c: str) -> str:
    out = c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{plain}', '{entity}')"
    return out


FENCE = "```(?:json)?\\s*([\\s\\S]*?)\\s*```"
STEPS["raw_answers"] = f"""
SELECT response_id, issue_id, content, {sql_strip(f"CASE WHEN regexp_matches(content, '{FENCE}', 'i') THEN regexp_extract(content, '{FENCE}', 1, 'i') ELSE content END")} AS raw
FROM v_answers"""
STEPS["docs"] = """
SELECT response_id, issue_id, j FROM (
  SELECT response_id, issue_id, CASE WHEN json_valid(raw) THEN raw
    WHEN json_valid(regexp_extract(raw, '(\\{[\\s\\S]*\\})', 1)) THEN regexp_extract(raw, '(\\{[\\s\\S]*\\})', 1) END AS j
  FROM v_raw_answers) t WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'"""
_FOOT = "json_extract(j, '$.simple.footer')"
STEPS["payloads"] = f"""
SELECT response_id, issue_id,
  {_links('$.simple.lines', 'text', 300, 10)} AS lines,
  CASE WHEN {_truthy(_FOOT)} THEN {_printed(_FOOT)} ELSE '' END AS footer,
  {_links('$.normal.top3', 'title', 200, 5)} AS top3,
  list_transform(list_filter({_json_list('$.normal.sections')}, lambda x: json_type(x) = 'OBJECT'),
    lambda x: {{'title': {_printed("json_extract(x, '$.title')")}, 'paragraph': {_printed("json_extract(x, '$.paragraph')")}}}) AS sections,
  list_transform(list_filter({_json_list('$.glossary')}, lambda x: {_truthy("json_extract(x, '$.term')")}),
    lambda x: {{'term': substr({_printed("json_extract(x, '$.term')")}, 1, 64), 'explain': substr({_printed("json_extract(x, '$.explain')")}, 1, 120)}}) AS glossary
FROM v_docs"""


def _with_link(label: str) -> str:
    return f"CASE WHEN x.url <> '' THEN x.{label} || ' (' || x.url || ')' ELSE x.{label} END"


def _json_rows(items: str, first: str, second: str) -> str:
    one = " || ', ' || ".join(
        f"'\"{f}\": ' || CAST(to_json(x.{f}) AS VARCHAR)" for f in (first, second)
    )
    return f"'[' || coalesce(array_to_string(list_transform({items}, lambda x: '{{' || {one} || '}}'), ', '), '') || ']'"


STEPS["texts"] = f"""
SELECT *, lines_text || CASE WHEN footer <> '' THEN chr(10) || chr(10) || footer ELSE '' END AS simple_text,
  array_to_string(list_concat(CASE WHEN len(top3) > 0 THEN ['## 本周 AI 热点排行（Top3）' || chr(10) ||
    array_to_string(list_transform(top3, lambda x: '- ' || {_with_link('title')}), chr(10))] ELSE [] END,
    list_transform(sections, lambda x: '## ' || x.title || chr(10) || chr(10) || x.paragraph)), chr(10) || chr(10)) AS normal_text,
  {_json_rows('glossary', 'term', 'explain')} AS glossary_json
FROM (SELECT *, coalesce(array_to_string(list_transform(lines, lambda x: {_with_link('text')}), chr(10)), '') AS lines_text FROM v_payloads) t"""
STEPS["newest"] = "SELECT * FROM v_texts QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY response_id DESC) = 1"


def _item_html(label: str) -> str:
    href = sql_strip("x.url")
    return (
        f"CASE WHEN {href} <> '' THEN '<li><a href=\"' || {_esc(href)} || '\">' || {_esc('x.' + label)} || '</a></li>' "
        f"ELSE '<li>' || {_esc('x.' + label)} || '</li>' END"
    )


def _mail_sql(source: str, brand: str = R.BRAND) -> tuple[str, str]:
    """html and text of a row of `source`: mode, email, banner, lines, footer, top3, sections, glossary."""
    nl = "chr(10)"
    simple_html = (
        f"list_concat(list_concat(['<h2>{brand} · 简单模式</h2><ol>'], list_transform(lines, lambda x: {_item_html('text')})), "
        f"['</ol>', CASE WHEN footer <> '' THEN '<p><strong>小结：</strong>' || {_esc('footer')} || '</p>' END])"
    )
    section_para = f"replace({_esc('x.paragraph')}, {nl}, '<br/>')"
    normal_html = (
        f"list_concat(list_concat(['<h2>{brand} · 正常模式</h2>'], CASE WHEN len(top3) > 0 THEN "
        f"list_concat(list_concat(['<h3>本周 AI 热点排行（Top3）</h3><ul>'], list_transform(top3, lambda x: {_item_html('title')})), ['</ul>']) ELSE [] END), "
        f"list_transform(sections, lambda x: '<h3>' || {_esc('x.title')} || '</h3><p>' || {section_para} || '</p>'))"
    )
    gloss_html = (
        "CASE WHEN len(glossary) > 0 THEN list_concat(list_concat(['<h3>本周术语表</h3><table border=''0'' cellpadding=''6'' style=''border-collapse:collapse''>', "
        "'<tr><th align=''left''>术语</th><th align=''left''>解释</th></tr>'], "
        f"list_transform(glossary, lambda x: '<tr><td>' || {_esc('x.term')} || '</td><td>' || {_esc('x.explain')} || '</td></tr>')), ['</table>']) ELSE [] END"
    )
    opening_html = (
        f"['<p style=\"color:#666;font-size:13px\">本邮件发送至：<b>' || {_esc('email')} || '</b></p>', "
        f"'<p style=\"color:#555;font-size:14px\">' || {_esc('banner')} || '</p>']"
    )
    html = (
        "'<html><body style=''font-family:system-ui,sans-serif;max-width:640px''>' || array_to_string(list_filter(list_concat(list_concat("
        f"{opening_html}, CASE WHEN mode = 'simple' THEN {simple_html} ELSE {normal_html} END), {gloss_html}), lambda p: p IS NOT NULL), {nl}) || '</body></html>'"
    )
    opening_text = "['本邮件发送至：' || email, banner]"
    simple_text = (
        f"list_concat(list_concat({opening_text}, list_concat(['{brand} · 简单模式'], list_transform(lines, lambda x: '- ' || {_with_link('text')}))), "
        "[CASE WHEN footer <> '' THEN '小结：' || footer END])"
    )
    normal_text = (
        f"list_concat(list_concat(['{brand} · 正常模式', CASE WHEN len(top3) > 0 THEN 'Top3:' || {nl} || "
        f"array_to_string(list_transform(top3, lambda x: '- ' || {_with_link('title')}), {nl}) END], {opening_text}), "
        f"list_transform(sections, lambda x: '## ' || x.title || {nl} || x.paragraph))"
    )
    gloss_text = (
        f"CASE WHEN len(glossary) > 0 THEN list_concat([{nl} || '本周术语表'], list_transform(glossary, lambda x: '- ' || x.term || ': ' || x.explain)) ELSE [] END"
    )
    text = (
        f"array_to_string(list_filter(list_concat(CASE WHEN mode = 'simple' THEN {simple_text} ELSE {normal_text} END, {gloss_text}), "
        f"lambda p: p IS NOT NULL), {nl} || {nl})"
    )
    return html, text


_HTML, _TEXT = _mail_sql("")
_BLOCK = (
    "'<hr style=''border:none;border-top:1px solid #eee;margin:2rem 0''/><p style=''font-size:13px;color:#666''>' || "
    f"'<a href=\"' || {_esc(chr(39) + URL.rstrip('/') + '/api/unsubscribe?token=' + chr(39) + ' || unsubscribe_token')} || '\">退订</a> · <a href=\"' || "
    f"{_esc(chr(39) + URL.rstrip('/') + '/manage/' + chr(39) + ' || manage_token')} || '\">管理关键词与模式</a></p>'"
)

# The latest issue of the store built from all answers, and each subscriber's cut of it.
STEPS["latest"] = """
SELECT n.*, i.period_start FROM v_issues i JOIN v_newest n ON n.issue_id = i.id ORDER BY i.period_start DESC LIMIT 1"""


def _hits(text: str) -> str:
    return f"len(list_filter(kws, lambda k: contains(lower({text}), k))) > 0"


STEPS["cut"] = f"""
SELECT *, len(kws) = 0 OR len(f_lines) > 0 OR len(f_top3) > 0 OR len(f_sections) > 0 OR (footer <> '' AND {_hits('footer')}) AS matched
FROM (SELECT s.id, s.email, s.mode, s.status, s.confirmed_at, s.unsubscribe_token, s.manage_token, s.keywords, s.kws,
  l.issue_id, l.period_start, l.lines, l.footer, l.top3, l.sections, l.glossary,
  list_filter(l.lines, lambda x: {_hits("x.text || ' ' || x.url")}) AS f_lines,
  list_filter(l.top3, lambda x: {_hits("x.title || ' ' || x.url")}) AS f_top3,
  list_filter(l.sections, lambda x: {_hits("x.title || x.paragraph")}) AS f_sections,
  list_filter(l.glossary, lambda x: {_hits("x.term || x.explain")}) AS f_glossary
FROM v_lower_words s, v_latest l) t"""
STEPS["digests"] = f"""
SELECT id, email, mode, status, confirmed_at, unsubscribe_token, manage_token, issue_id, period_start, footer, matched,
  CASE WHEN len(keywords) > 0 AND NOT matched THEN '{NO_MATCH_BANNER}' END AS banner,
  {', '.join(f"CASE WHEN len(kws) > 0 AND matched AND len(f_{n}) > 0 THEN f_{n} ELSE {n} END AS {n}" for n in ('lines', 'top3', 'sections', 'glossary'))}
FROM v_cut"""
STEPS["mails"] = f"""
SELECT *, replace({_HTML}, '</body>', {_BLOCK} || '</body>') AS html,
  {_TEXT} || chr(10) || chr(10) || '退订: {URL.rstrip('/')}/api/unsubscribe?token=' || unsubscribe_token AS text FROM v_digests"""


def _kind(base: str) -> str:
    return f"'{base}:' || CAST(period_start AS VARCHAR) || ':' || substr(sha256(lower(email)), 1, 16)"


STEPS["weekly"] = f"""
SELECT m.* FROM (SELECT *, {_kind('weekly')} AS kind FROM v_mails WHERE status = 'active' AND confirmed_at IS NOT NULL) m
WHERE kind NOT IN (SELECT kind FROM v_send_log)"""


# --- the queries ------------------------------------------------------------------------------

def _docs(spark, sf):
    return P.extract_answer(view(spark, sf, "answers")).filter(F.col("doc").isNotNull())


def _payloads(spark, sf):
    return I.with_answer_payload(view(spark, sf, "answers"))


def _store(spark, sf):
    """The issue table as a build of all periods leaves it, each ready at half past midnight."""
    drafts = _with_texts(issues(spark, sf).withColumn("status", F.lit("draft")))
    periods = issues(spark, sf).select(
        F.col("id").alias("issue_id"), "period_start", F.lit(True).alias("has_items")
    )
    ready_at = F.col("period_start").cast("timestamp") + F.expr("INTERVAL '30' MINUTE")
    built = weekly_issue.build_issues(drafts, periods, view(spark, sf, "answers"), ready_at)
    path = shared_dir(spark, "issues")
    write_snapshot(built, path)
    return read_table(spark, path, WEEKLY_ISSUES)


def _with_texts(store):
    blanks = {"simple_text": "", "normal_text": "", "glossary_json": "[]", "payload_json": "{}"}
    return store.select("*", *[F.lit(v).alias(k) for k, v in blanks.items()])


@query(
    "response_json_extract",
    """SELECT a.response_id, d.j IS NOT NULL AS usable, json_extract_string(d.j, '$.simple.footer') AS footer,
    json_extract_string(d.j, '$.normal.top3[0].title') AS first_title FROM v_answers a LEFT JOIN v_docs d USING (response_id)""",
)
def response_json_extract(spark, sf):
    doc = F.col("doc")
    return P.extract_answer(view(spark, sf, "answers")).select(
        "response_id",
        doc.isNotNull().alias("usable"),
        F.try_variant_get(doc, "$.simple.footer", "string").alias("footer"),
        F.try_variant_get(doc, "$.normal.top3[0].title", "string").alias("first_title"),
    )


def _list_query(name, column, fields, build):
    @query(
        name,
        f"SELECT response_id, CAST(len({column}) AS INT) AS n, {sql_rows_text(column, *fields)} AS items FROM v_payloads",
    )
    def run(spark, sf):
        rows = _docs(spark, sf).select("response_id", build(F.col("doc")).alias("x"))
        return rows.select(
            "response_id", F.size("x").alias("n"), rows_text(F.col("x"), *fields).alias("items")
        )

    return run


_list_query("payload_lines", "lines", ("text", "url"), P.payload_lines)
_list_query("payload_top3", "top3", ("title", "url"), P.payload_top3)
_list_query("payload_sections", "sections", ("title", "paragraph"), P.payload_sections)
_list_query("payload_glossary", "glossary", ("term", "explain"), P.payload_glossary)


@query("payload_texts", "SELECT response_id, simple_text, normal_text, glossary_json FROM v_texts")
def payload_texts(spark, sf):
    rows = I.with_texts(_payloads(spark, sf))
    return rows.select("response_id", "simple_text", "normal_text", "glossary_json")


# Stored payloads, some of them blank or broken.
@query(
    "payload_parse",
    f"""SELECT response_id, CAST(CASE WHEN bad THEN 0 ELSE len(lines) END AS INT) AS n_lines,
    CASE WHEN bad THEN '' ELSE footer END AS footer,
    CASE WHEN bad THEN '' ELSE {sql_rows_text('sections', 'title', 'paragraph')} END AS sections,
    CAST(CASE WHEN bad THEN 0 ELSE len(glossary) END AS INT) AS n_terms
    FROM (SELECT *, response_id % 7 < 2 AS bad FROM v_payloads) t""",
)
def payload_parse(spark, sf):
    stored = I.with_texts(_payloads(spark, sf)).select(
        "response_id",
        F.when(F.col("response_id") % 7 == 0, F.lit(" "))
        .when(F.col("response_id") % 7 == 1, F.concat(F.lit("broken "), F.col("payload_json")))
        .otherwise(F.col("payload_json"))
        .alias("payload_json"),
    )
    rows = P.with_payload(stored)
    return rows.select(
        "response_id",
        F.size("payload.simple.lines").alias("n_lines"),
        F.col("payload.simple.footer").alias("footer"),
        rows_text(F.col("payload.normal.sections"), "title", "paragraph").alias("sections"),
        F.size("payload.glossary").alias("n_terms"),
    )


@query("html_escape", f"SELECT response_id, {_esc('content')} AS escaped FROM v_answers")
def html_escape_(spark, sf):
    return view(spark, sf, "answers").select("response_id", html_escape(F.col("content")).alias("escaped"))


STEPS["shown"] = """SELECT *, 'r' || CAST(response_id AS VARCHAR) || '<x>@example.org' AS email,
CASE WHEN response_id % 2 = 0 THEN 'nothing & found' END AS banner, 'simple' AS mode FROM v_payloads"""


def _render_query(name, mode):
    html, text = _mail_sql("")

    @query(name, f"SELECT response_id, {html} AS html, {text} AS text FROM (SELECT * REPLACE ('{mode}' AS mode) FROM v_shown) t")
    def run(spark, sf):
        rows = _payloads(spark, sf).withColumn("digest", searchable(F.col("payload")))
        mail = F.concat(F.lit("r"), F.col("response_id").cast("string"), F.lit("<x>@example.org"))
        banner = F.when(F.col("response_id") % 2 == 0, F.lit("nothing & found"))
        asked = (F.col("digest"), F.lit(mode), banner, mail)
        return rows.select(
            "response_id", R.render_html(*asked).alias("html"), R.render_text(*asked).alias("text")
        )

    return run


_render_query("render_simple", "simple")
_render_query("render_normal", "other")


@query(
    "render_glossary",
    f"""SELECT response_id, coalesce(array_to_string(CASE WHEN len(glossary) > 0 THEN list_transform(glossary,
    lambda x: '<tr><td>' || {_esc('x.term')} || '</td><td>' || {_esc('x.explain')} || '</td></tr>') ELSE [] END, chr(10)), '') AS table_rows,
    CAST(CASE WHEN len(glossary) > 0 THEN len(glossary) + 3 ELSE 0 END AS INT) AS n_parts FROM v_payloads""",
)
def render_glossary(spark, sf):
    rows = _payloads(spark, sf).withColumn("digest", searchable(F.col("payload")))
    rows = rows.select("response_id", R.glossary_html(F.col("digest")).alias("parts"))
    n = F.size("parts")
    return rows.select(
        "response_id",
        F.array_join(F.slice("parts", 3, F.greatest(n - 3, F.lit(0))), "\n").alias("table_rows"),
        n.alias("n_parts"),
    )


# A body in one row of two, so the block goes before its end or after the text.
@query(
    "render_footer",
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN '<body>' || email || {_BLOCK} || '</body></html>' ELSE email || {_BLOCK} END AS html
    FROM v_subscribers""",
)
def render_footer(spark, sf):
    body = F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("<body>"), F.col("email"), F.lit("</body></html>"))
    ).otherwise(F.col("email"))
    block = R.footer_block(URL, F.col("unsubscribe_token"), F.col("manage_token"))
    return view(spark, sf, "subscribers").select("id", R.append_footer(body, block).alias("html"))


@query("no_match_banner", "SELECT id, matched, banner FROM v_digests")
def no_match_banner_(spark, sf):
    rows = _filtered(spark, sf)
    return rows.select("id", "matched", no_match_banner(F.col("keywords"), F.col("matched")).alias("banner"))


def _filtered(spark, sf):
    latest = I.latest_ready_issue(_store(spark, sf))
    body = P.with_payload(latest).select(searchable(F.col("payload")).alias("body"))
    people_ = view(spark, sf, "subscribers").withColumn("keywords", keywords_parse(F.col("keywords_json")))
    rows = D.attach(people_, body, "issue").withColumn("issue", F.col("issue")["body"])
    return filter_digest(rows)


DIGEST_FILTER = f"""SELECT id, matched, {', '.join(
        f"coalesce(array_to_string(list_transform({n}, lambda x: {t}), chr(10)), '') AS {n}"
        for n, t in (
            ('lines', "'- ' || " + _with_link('text')), ('top3', "'- ' || " + _with_link('title')),
            ('sections', "'## ' || x.title || chr(10) || x.paragraph"), ('glossary', "'- ' || x.term || ': ' || x.explain")
        ))}, footer FROM v_digests"""


@query("digest_filter", DIGEST_FILTER)
def digest_filter(spark, sf):
    rows = _filtered(spark, sf)
    lists = [
        F.array_join(F.transform(F.col("digest")[n], lambda x: x["text"]), "\n").alias(n)
        for n in ("lines", "top3", "sections", "glossary")
    ]
    return rows.select("id", "matched", *lists, F.col("digest")["footer"].alias("footer"))


# The same rows, each distinct keyword list worked out once.
@query("digest_filter_per_set", DIGEST_FILTER)
def digest_filter_per_set(spark, sf):
    latest = I.latest_ready_issue(_store(spark, sf))
    bodies = P.with_payload(latest).select(F.col("id").alias("issue_id"), searchable(F.col("payload")).alias("body")).checkpoint()
    words = F.array_sort(F.array_distinct(keywords_normalize(keywords_parse(F.col("keywords_json")))))
    people_ = D.attach(view(spark, sf, "subscribers"), bodies.select("issue_id", F.col("body")["footer"].alias("footer")), "issue")
    people_ = people_.select("id", "issue.*", words.alias("keywords")).withColumn("set_key", F.array_join("keywords", "\n"))
    asked = people_.select("set_key", "issue_id", "keywords").distinct()
    digests = M.gathered_digests(M.digests_per_set(asked, M.issue_elements(bodies)))
    rows = salted_join(people_, digests, ["set_key", "issue_id"], "inner", ["id"])
    return rows.select("id", "matched", *[F.array_join(n, "\n").alias(n) for n in M.LISTS], "footer")


@query("issue_key", """SELECT id, CASE WHEN id % 3 = 0 THEN CAST(period_start AS VARCHAR)
    WHEN ready_at IS NOT NULL THEN strftime(ready_at, '%Y-%m-%dT%H:%M:%S') ELSE 'unknown' END AS issue_key FROM v_issues""")
def issue_key_(spark, sf):
    period = F.when(F.col("id") % 3 == 0, F.col("period_start"))
    return issues(spark, sf).select("id", keys.issue_key(period, F.col("ready_at")).alias("issue_key"))


@query("delivery_key", """SELECT id, 'weekly:1997-06-30:' || substr(sha256(lower(email)), 1, 16) AS kind FROM v_subscribers""")
def delivery_key_(spark, sf):
    key = keys.delivery_key(F.lit("weekly:1997-06-30"), F.concat(F.lit("  "), F.col("email"), F.lit("\t")))
    return view(spark, sf, "subscribers").select("id", key.alias("kind"))


@query(
    "period_monday",
    "SELECT event_id, CAST(CAST(date_trunc('week', ts + INTERVAL '8' HOUR) AS DATE) AS VARCHAR) AS period_start FROM events",
)
def period_monday_(spark, sf):
    rows = table(spark, sf, "events")
    period = keys.period_monday(F.col("ts").cast("timestamp"))
    return rows.select("event_id", period.cast("string").alias("period_start"))


_ISSUE = f"id, CAST(period_start AS VARCHAR) AS period_start, status, {sql_time('ready_at')} AS ready_at"


def _issue_columns(df):
    return df.select("id", F.col("period_start").cast("string").alias("period_start"), "status", time_text("ready_at").alias("ready_at"))


@query("issue_ready_for_period", f"SELECT {_ISSUE} FROM v_issues WHERE status = 'ready' AND period_start = DATE '{PERIOD}'")
def issue_ready_for_period(spark, sf):
    return _issue_columns(I.ready_issue_for(issues(spark, sf), F.lit(PERIOD).cast("date")))


@query("latest_ready_issue", f"SELECT {_ISSUE} FROM v_issues WHERE status = 'ready' ORDER BY ready_at DESC, id DESC LIMIT 1")
def latest_ready_issue(spark, sf):
    return _issue_columns(I.latest_ready_issue(issues(spark, sf)))


@query("recent_issues", f"SELECT {_ISSUE} FROM v_issues ORDER BY ready_at DESC NULLS LAST, created_at DESC LIMIT 5")
def recent_issues(spark, sf):
    return _issue_columns(I.recent_issues(issues(spark, sf)))


# Each order stands for an issue row of its week.
@query(
    "duplicate_periods",
    """SELECT CAST(p AS VARCHAR) AS period_start, count(*) AS n_issues FROM (
    SELECT CAST(date_trunc('week', o_orderdate + INTERVAL '8' HOUR) AS DATE) AS p FROM orders) t GROUP BY p HAVING count(*) > 1""",
)
def duplicate_periods(spark, sf):
    period = keys.period_monday(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(period.cast("string").alias("period_start"))
    return I.duplicate_periods(rows)


@query("duplicate_deliveries", "SELECT kind, count(*) AS n_rows FROM v_send_log GROUP BY kind HAVING count(*) > 1")
def duplicate_deliveries(spark, sf):
    return I.duplicate_deliveries(view(spark, sf, "send_log"))


@query("rejected_answers", "SELECT response_id, content FROM v_answers WHERE response_id NOT IN (SELECT response_id FROM v_docs)")
def rejected_answers(spark, sf):
    return I.rejected_answers(view(spark, sf, "answers")).select("response_id", "content")


# The store lacks every third issue and holds an older draft of every fifth period; one brand in eight
# has no items this time. The newest row of a period is built, older ones pass through.
STEPS["old_store"] = """SELECT id, period_start, status, ready_at, created_at FROM v_issues WHERE id % 3 <> 0
UNION ALL SELECT id + 100, period_start, 'draft', CAST(NULL AS TIMESTAMP), created_at - INTERVAL '1' DAY FROM v_issues WHERE id % 5 = 0"""
STEPS["ranked_store"] = "SELECT *, row_number() OVER (PARTITION BY period_start ORDER BY created_at DESC, id DESC) AS age FROM v_old_store"


def _built_sql(wanted: str) -> str:
    """The store after a build of all periods; `wanted`: whether the build finds items for issue `i`."""
    fresh = f"coalesce(o.status, '') <> 'ready' AND {wanted}"
    return f"""
SELECT coalesce(o.id, (SELECT max(id) FROM v_old_store) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY i.period_start)) AS id,
  CAST(i.period_start AS VARCHAR) AS period_start,
  CASE WHEN o.status = 'ready' THEN 'ready' WHEN {wanted} AND n.issue_id IS NOT NULL THEN 'ready' ELSE 'draft' END AS status,
  CASE WHEN {fresh} THEN coalesce(n.simple_text, '') ELSE '' END AS simple_text,
  CASE WHEN {fresh} THEN coalesce(n.normal_text, '') ELSE '' END AS normal_text,
  CASE WHEN {fresh} THEN coalesce(n.glossary_json, '[]') ELSE '[]' END AS glossary_json
FROM v_issues i LEFT JOIN v_ranked_store o ON o.period_start = i.period_start AND o.age = 1 LEFT JOIN v_newest n ON n.issue_id = i.id
UNION ALL SELECT id, CAST(period_start AS VARCHAR), status, '', '', '[]' FROM v_ranked_store WHERE age > 1"""


_BUILT = _built_sql("i.id % 8 <> 5")
_COLUMNS = ["id", "period_start", "status", "simple_text", "normal_text", "glossary_json"]


def _old_store(spark, sf):
    store = issues(spark, sf)
    older = store.filter("id % 5 = 0").select(
        (F.col("id") + 100).alias("id"), "period_start", F.lit("draft").alias("status"),
        F.lit(None).cast("timestamp").alias("ready_at"), (F.col("created_at") - F.expr("INTERVAL '1' DAY")).alias("created_at"),
    )
    return _with_texts(store.filter("id % 3 <> 0").unionByName(older))


def _built(spark, sf):
    periods = issues(spark, sf).select(
        F.col("id").alias("issue_id"), "period_start", (F.col("id") % 8 != 5).alias("has_items")
    )
    ready_at = F.lit("1997-12-31").cast("timestamp")
    built = weekly_issue.build_issues(_old_store(spark, sf), periods, view(spark, sf, "answers"), ready_at)
    return built.withColumn("period_start", F.col("period_start").cast("string"))


# One run for one issue, from the feed entries to the stored issue.
ISSUE = 12


@query(
    "weekly_build",
    f"""SELECT id, CAST(period_start AS VARCHAR) AS period_start, CASE WHEN id = {ISSUE} AND EXISTS (SELECT 1 FROM v_leaders)
      AND n.issue_id IS NOT NULL THEN 'ready' ELSE status END AS status, coalesce(n.simple_text, '') AS simple_text,
    coalesce(n.normal_text, '') AS normal_text, coalesce(n.glossary_json, '[]') AS glossary_json
    FROM v_issues i LEFT JOIN v_newest n ON n.issue_id = i.id AND i.id = {ISSUE} AND EXISTS (SELECT 1 FROM v_leaders)""",
)
def weekly_build(spark, sf):
    store = _with_texts(issues(spark, sf))
    period = F.lit("1997-01-06").cast("date") + 7 * ISSUE
    _, _, built = weekly_issue.weekly_build(
        view(spark, sf, "entries"), store, view(spark, sf, "answers"), ISSUE, period, F.lit("1997-12-31").cast("timestamp")
    )
    return built.withColumn("period_start", F.col("period_start").cast("string")).select(*_COLUMNS)


@query("issue_upsert", f"SELECT id, period_start, status FROM ({_BUILT}) t")
def issue_upsert(spark, sf):
    return _built(spark, sf).select("id", "period_start", "status")


@query("build_issue", _BUILT)
def build_issue(spark, sf):
    return _built(spark, sf).select("id", "period_start", "status", "simple_text", "normal_text", "glossary_json")


@query("issue_fanout", f"SELECT id, issue_id, {_kind('weekly')} AS kind FROM v_digests WHERE status = 'active' AND confirmed_at IS NOT NULL")
def issue_fanout(spark, sf):
    latest = I.latest_ready_issue(_store(spark, sf))
    rows = D.fan_out(A.eligible(view(spark, sf, "subscribers")), latest, "weekly")
    return rows.select("id", F.col("head")["id"].cast("int").alias("issue_id"), "kind")


@query("delivery_plan", "SELECT id, kind FROM v_weekly")
def delivery_plan(spark, sf):
    store = _store(spark, sf)
    latest = I.latest_ready_issue(store)
    rows = D.fan_out(A.eligible(view(spark, sf, "subscribers")), latest, "weekly")
    return D.not_sent(rows, view(spark, sf, "send_log"), latest, "weekly", store).select("id", "kind")


def _mail_columns(df):
    return df.select("subscriber_id", F.col("issue_id").cast("int").alias("issue_id"), "kind", "subject", "html", "text")


@query(
    "weekly_delivery",
    f"""SELECT id AS subscriber_id, issue_id, kind, '{R.BRAND} · 周刊 · ' || CAST(period_start AS VARCHAR) AS subject, html, text FROM v_weekly""",
)
def weekly_delivery(spark, sf):
    return _mail_columns(
        mailings.weekly_delivery(
            view(spark, sf, "subscribers"), _store(spark, sf), view(spark, sf, "send_log"),
            F.lit(PERIOD).cast("date"), URL,
        )
    )


# The addresses confirmed in one part of the day.
@query(
    "confirm_digest_plan",
    f"""SELECT id AS subscriber_id, issue_id, {_kind('confirm_digest')} AS kind, '{R.BRAND} · 最新一期' AS subject, html, text
    FROM v_mails WHERE status = 'active' AND confirmed_at >= TIMESTAMP '2023-07-01 12:00:00'""",
)
def confirm_digest_plan(spark, sf):
    confirmed = A.eligible(view(spark, sf, "subscribers")).filter("confirmed_at >= TIMESTAMP '2023-07-01 12:00:00'")
    return _mail_columns(mailings.confirm_digest_plan(confirmed, _store(spark, sf), URL))


STEPS["asked"] = "SELECT DISTINCT o_custkey AS id FROM orders"


# Each order asks for the issue again; it is sent once.
@query(
    "resend_latest_plan",
    f"""SELECT id AS subscriber_id, issue_id, {_kind('resend_latest')} AS kind, '{R.BRAND} · 最新一期（补发）' AS subject, html, text
    FROM v_mails WHERE status = 'active' AND confirmed_at IS NOT NULL AND id IN (SELECT id FROM v_asked)""",
)
def resend_latest_plan(spark, sf):
    asked = table(spark, sf, "orders").select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("manage_token"))
    return _mail_columns(
        mailings.resend_latest_plan(
            asked, view(spark, sf, "subscribers"), _store(spark, sf), view(spark, sf, "send_log"), URL
        )
    )


# Each supplier stands for one request by hand; two of them ask for the same subscriber.
@query(
    "manual_resend_plan",
    f"""SELECT m.id AS subscriber_id, issue_id, 'manual_resend' AS kind, '{R.BRAND} · 最新一期（管理员补发）' AS subject, html, text
    FROM supplier s JOIN v_mails m ON m.id = s.s_suppkey // 2 WHERE m.status = 'active' AND m.confirmed_at IS NOT NULL""",
)
def manual_resend_plan(spark, sf):
    asked = table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 2).alias("id"), F.col("s_suppkey").alias("request_id"))
    return _mail_columns(
        mailings.manual_resend_plan(asked, view(spark, sf, "subscribers"), _store(spark, sf), URL)
    )


# The planned deliveries are logged; the log then holds the old rows and the new ones.
@query(
    "send_log_append",
    """SELECT subscriber_id, issue_id, kind FROM v_send_log
    UNION ALL SELECT id, CAST(issue_id AS BIGINT), kind FROM v_weekly""",
)
def send_log_append(spark, sf):
    path = shared_dir(spark, "send_log")
    log = view(spark, sf, "send_log")
    write_log(log.select("subscriber_id", "issue_id", "kind", "sent_at"), path)
    shape = "subscriber_id long, kind string, sent_at timestamp, issue_id long"
    plan = mailings.weekly_delivery(
        view(spark, sf, "subscribers"), _store(spark, sf), read_table(spark, path, shape),
        F.lit(PERIOD).cast("date"), URL,
    )
    append_log(plan, path, SENT_AT)
    return read_table(spark, path, shape).select("subscriber_id", "issue_id", "kind")
