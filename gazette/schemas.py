"""Table layouts."""

from __future__ import annotations

SUBSCRIBERS = (
    "id long, email string, mode string, keywords_json string, status string, "
    "confirm_token string, unsubscribe_token string, manage_token string, "
    "created_at timestamp, confirmed_at timestamp"
)
WEEKLY_ISSUES = (
    "id long, period_start date, simple_text string, normal_text string, glossary_json string, "
    "payload_json string, status string, ready_at timestamp, created_at timestamp"
)
RAW_ITEMS = (
    "id long, issue_id long, source string, title string, summary string, link string, "
    "published_at timestamp, heat_score int, created_at timestamp"
)
SEND_LOG = "id long, subscriber_id long, issue_id long, kind string, sent_at timestamp"
ACTIONS = (
    "event_id long, email string, ts timestamp, action string, token string, mode string, "
    "keywords array<string>, mail_ok boolean"
)
PAYLOAD = (
    "struct<simple: struct<lines: array<struct<text: string, url: string>>, footer: string>, "
    "normal: struct<top3: array<struct<title: string, url: string>>, "
    "sections: array<struct<title: string, paragraph: string>>>, "
    "glossary: array<struct<term: string, explain: string>>>"
)

MODES = ("simple", "normal")
PENDING, ACTIVE, UNSUBSCRIBED = "pending", "active", "unsubscribed"
STATUSES = (PENDING, ACTIVE, UNSUBSCRIBED)
DRAFT, READY = "draft", "ready"
