"""Keyword matching of a payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.keywords import keywords_normalize
from gazette.functions.text import html_escape, strip
from gazette.functions.payload import with_link

# Fixed value: shown when a subscriber's keywords match nothing in the issue.
NO_MATCH_BANNER = "本周期暂无与关键词直接匹配的内容，以下为本期全文。"


def searchable(payload: Column) -> Column:
    """The payload with everything a matching or rendering step needs, worked out once per issue.

    Each list element carries the lower-cased text to search (`needle`) and its finished html and
    plain-text forms, so per subscriber only filtering and joining is left.
    """
    simple, normal = payload["simple"], payload["normal"]

    def link(label: str):
        def item(x: Column) -> Column:
            href = strip(x["url"])
            escaped = html_escape(x[label])
            return F.struct(
                F.lower(F.concat_ws(" ", x[label], x["url"])).alias("needle"),
                F.when(
                    href != "",
                    F.concat(
                        F.lit('<li><a href="'), html_escape(href), F.lit('">'), escaped,
                        F.lit("</a></li>"),
                    ),
                )
                .otherwise(F.concat(F.lit("<li>"), escaped, F.lit("</li>")))
                .alias("html"),
                F.concat(F.lit("- "), with_link(x[label], x["url"])).alias("text"),
            )

        return item

    def section(x: Column) -> Column:
        paragraph = F.replace(html_escape(x["paragraph"]), F.lit("\n"), F.lit("<br/>"))
        return F.struct(
            F.lower(F.concat(x["title"], x["paragraph"])).alias("needle"),
            F.concat(
                F.lit("<h3>"), html_escape(x["title"]), F.lit("</h3><p>"), paragraph, F.lit("</p>")
            ).alias("html"),
            F.concat(F.lit("## "), x["title"], F.lit("\n"), x["paragraph"]).alias("text"),
        )

    def term(x: Column) -> Column:
        return F.struct(
            F.lower(F.concat(x["term"], x["explain"])).alias("needle"),
            F.concat(
                F.lit("<tr><td>"), html_escape(x["term"]), F.lit("</td><td>"),
                html_escape(x["explain"]), F.lit("</td></tr>"),
            ).alias("html"),
            F.concat(F.lit("- "), x["term"], F.lit(": "), x["explain"]).alias("text"),
        )

    return F.struct(
        F.transform(simple["lines"], link("text")).alias("lines"),
        simple["footer"].alias("footer"),
        F.transform(normal["top3"], link("title")).alias("top3"),
        F.transform(normal["sections"], section).alias("sections"),
        F.transform(payload["glossary"], term).alias("glossary"),
    )


def filter_digest(df: DataFrame, issue: str = "issue", keywords: str = "keywords") -> DataFrame:
    """Adds `digest` (the `searchable` issue cut to the keywords) and `matched`.

    A list whose own filter is empty stays whole. Lines, top3, sections and footer decide
    `matched`; the glossary does not. Without keywords everything matches.
    """
    kws = F.col("_kws")

    def hits(needle: Column) -> Column:
        return F.exists(kws, lambda k: F.contains(needle, k))

    def matching(name: str) -> Column:
        return F.filter(F.col(issue)[name], lambda x: hits(x["needle"]))

    lists = ["lines", "top3", "sections", "glossary"]
    found = df.withColumn("_kws", keywords_normalize(F.col(keywords))).withColumn(
        "_hit", F.when(F.size(kws) > 0, F.struct(*[matching(n).alias(n) for n in lists]))
    )
    footer = F.col(issue)["footer"]
    any_hit = (
        (F.size(F.col("_hit")["lines"]) > 0)
        | (F.size(F.col("_hit")["top3"]) > 0)
        | (F.size(F.col("_hit")["sections"]) > 0)
        | ((footer != "") & hits(F.lower(footer)))
    )
    found = found.withColumn("matched", F.when(F.size(kws) == 0, F.lit(True)).otherwise(any_hit))
    use_hits = (F.size(kws) > 0) & F.col("matched")
    digest = F.struct(
        *[
            F.when(use_hits & (F.size(F.col("_hit")[n]) > 0), F.col("_hit")[n])
            .otherwise(F.col(issue)[n])
            .alias(n)
            for n in lists
        ],
        footer.alias("footer"),
    )
    return found.withColumn("digest", digest).drop("_kws", "_hit")


def no_match_banner(keywords: Column, matched: Column) -> Column:
    return F.when((F.size(keywords) > 0) & ~matched, F.lit(NO_MATCH_BANNER))
