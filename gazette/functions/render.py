"""Digest mails as column expressions over a filtered digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import html_escape

# The markup and wording of a digest mail.
OPEN_HTML = "<html><body style='font-family:system-ui,sans-serif;max-width:640px'>"
CLOSE_HTML = "</body></html>"
RECIPIENT_LABEL = "本邮件发送至："
SIMPLE_NAME, NORMAL_NAME = "简单模式", "正常模式"
SUMMARY_LABEL = "小结："
TOP3_TITLE = "<h3>本周 AI 热点排行（Top3）</h3><ul>"
GLOSSARY_TITLE = "本周术语表"
GLOSSARY_OPEN = (
    "<h3>本周术语表</h3><table border='0' cellpadding='6' style='border-collapse:collapse'>"
)
GLOSSARY_HEAD = "<tr><th align='left'>术语</th><th align='left'>解释</th></tr>"
FOOTER_OPEN = "<hr style='border:none;border-top:1px solid #eee;margin:2rem 0'/><p style='font-size:13px;color:#666'>"
UNSUBSCRIBE_LABEL, MANAGE_LABEL = "退订", "管理关键词与模式"

BRAND = "Weekly Digest"


def _strings(*items: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])


def _part(items: Column, form: str) -> Column:
    return F.transform(items, lambda x: x[form])


def _when_any(items: Column, block: Column) -> Column:
    return F.when(F.size(items) > 0, block).otherwise(F.array().cast("array<string>"))


def _opening_html(recipient: Column, banner: Column) -> Column:
    return _strings(
        F.concat(
            F.lit(f'<p style="color:#666;font-size:13px">{RECIPIENT_LABEL}<b>'),
            html_escape(recipient),
            F.lit("</b></p>"),
        ),
        F.concat(F.lit('<p style="color:#555;font-size:14px">'), html_escape(banner), F.lit("</p>")),
    )


def _opening_text(recipient: Column, banner: Column) -> Column:
    return _strings(F.concat(F.lit(RECIPIENT_LABEL), recipient), banner)


def glossary_html(digest: Column) -> Column:
    rows = digest["glossary"]
    return _when_any(
        rows,
        F.concat(_strings(GLOSSARY_OPEN, GLOSSARY_HEAD), _part(rows, "html"), _strings("</table>")),
    )


def glossary_text(digest: Column) -> Column:
    rows = digest["glossary"]
    return _when_any(rows, F.concat(_strings("\n" + GLOSSARY_TITLE), _part(rows, "text")))


def simple_html(digest: Column, brand: str) -> Column:
    footer = digest["footer"]
    return F.concat(
        _strings(f"<h2>{brand} · {SIMPLE_NAME}</h2><ol>"),
        _part(digest["lines"], "html"),
        _strings(
            "</ol>",
            F.when(
                footer != "",
                F.concat(
                    F.lit(f"<p><strong>{SUMMARY_LABEL}</strong>"), html_escape(footer), F.lit("</p>")
                ),
            ),
        ),
    )


def simple_text(digest: Column, brand: str) -> Column:
    footer = digest["footer"]
    return F.concat(
        _strings(f"{brand} · {SIMPLE_NAME}"),
        _part(digest["lines"], "text"),
        _strings(F.when(footer != "", F.concat(F.lit(SUMMARY_LABEL), footer))),
    )


def normal_html(digest: Column, brand: str) -> Column:
    top3 = digest["top3"]
    return F.concat(
        _strings(f"<h2>{brand} · {NORMAL_NAME}</h2>"),
        _when_any(top3, F.concat(_strings(TOP3_TITLE), _part(top3, "html"), _strings("</ul>"))),
        _part(digest["sections"], "html"),
    )


def normal_heading_text(digest: Column, brand: str) -> Column:
    top3 = digest["top3"]
    return _strings(
        f"{brand} · {NORMAL_NAME}",
        F.when(
            F.size(top3) > 0,
            F.concat(F.lit("Top3:\n"), F.array_join(_part(top3, "text"), "\n")),
        ),
    )


def render_html(digest: Column, mode: Column, banner: Column, recipient: Column, brand: str = BRAND) -> Column:
    """Null banner or recipient leaves its line out. Any mode but `simple` is the normal one."""
    body = F.when(mode == "simple", simple_html(digest, brand)).otherwise(normal_html(digest, brand))
    parts = F.concat(_opening_html(recipient, banner), body, glossary_html(digest))
    return F.concat(F.lit(OPEN_HTML), F.array_join(parts, "\n"), F.lit(CLOSE_HTML))


def render_text(digest: Column, mode: Column, banner: Column, recipient: Column, brand: str = BRAND) -> Column:
    """In normal mode the heading and the top list come before recipient and banner."""
    opening = _opening_text(recipient, banner)
    body = F.when(
        mode == "simple", F.concat(opening, simple_text(digest, brand))
    ).otherwise(
        F.concat(normal_heading_text(digest, brand), opening, _part(digest["sections"], "text"))
    )
    return F.array_join(F.concat(body, glossary_text(digest)), "\n\n")


def footer_block(public_url: str, unsubscribe_token: Column, manage_token: Column) -> Column:
    base = public_url.rstrip("/")
    return F.concat(
        F.lit(FOOTER_OPEN + '<a href="'),
        html_escape(F.concat(F.lit(base + "/api/unsubscribe?token="), unsubscribe_token)),
        F.lit(f'">{UNSUBSCRIBE_LABEL}</a> · <a href="'),
        html_escape(F.concat(F.lit(base + "/manage/"), manage_token)),
        F.lit(f'">{MANAGE_LABEL}</a></p>'),
    )


def append_footer(html: Column, block: Column) -> Column:
    """Before the first `</body>`, or at the end when there is none."""
    at = F.instr(html, "</body>")
    return F.when(
        at > 0, F.concat(F.substr(html, F.lit(1), at - 1), block, F.substr(html, at))
    ).otherwise(F.concat(html, block))


def unsubscribe_text(public_url: str, unsubscribe_token: Column) -> Column:
    return F.concat(
        F.lit(f"\n\n{UNSUBSCRIBE_LABEL}: {public_url.rstrip('/')}/api/unsubscribe?token="),
        unsubscribe_token,
    )
