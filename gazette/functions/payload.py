"""Model answers: finding the JSON, cleaning it into the payload struct, writing it out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import clip, json_quote, strip
from gazette.operators.common import once
from gazette.schemas import PAYLOAD

# List and text limits of a payload.
MAX_LINES, MAX_TOP3 = 10, 5
LINE_TEXT, TOP3_TITLE, URL_LENGTH = 300, 200, 2048
TERM_LENGTH, EXPLAIN_LENGTH = 64, 120

# Headings of the stored texts.
TOP3_HEADING = "## 本周 AI 热点排行（Top3）"

# JSON texts of the values that count as false.
FALSY = ["null", "false", "0", "0.0", "-0.0", "0E0", "[]", "{}"]

FENCE = "```"


def answer_text(parts: Column) -> Column:
    """The inside of the first fenced block, else the whole text; `parts` is the text cut at fences."""
    inside = F.get(parts, F.lit(1))
    named = F.lower(F.substring(inside, 1, 4)) == "json"
    block = F.when(named, F.substr(inside, F.lit(5))).otherwise(inside)
    return strip(F.when(F.size(parts) > 2, block).otherwise(F.array_join(parts, FENCE)))


def extract_answer(answers: DataFrame, content: str = "content") -> DataFrame:
    """Adds `doc`, the answer as VARIANT; null when the answer holds no JSON object.

    The fenced (or whole) text is tried first, then its part from the first `{` to the last `}`.
    """
    raw, whole = F.col("_raw"), F.col("_whole")
    read = answers.withColumn("_parts", F.split(content, FENCE))
    read = read.withColumn("_raw", answer_text(F.col("_parts"))).withColumn("_whole", F.try_parse_json(raw))
    braces = F.regexp_extract(raw, r"(\{[\s\S]*\})", 1)
    found = F.when(whole.isNull(), F.try_parse_json(braces)).when(F.startswith(raw, F.lit("{")), whole)
    return once(read, doc=found).drop("_parts", "_raw", "_whole")


def is_object(v: Column) -> Column:
    return F.startswith(F.to_json(v), F.lit("{"))


def _plain(v: Column) -> Column:
    """A JSON value as `text`, and as `json` where the text alone does not tell its kind."""
    text = v.cast("string")
    unsure = text.isNull() | text.isin([*FALSY, "true"])
    return F.struct(text.alias("text"), F.when(unsure, F.to_json(v)).alias("json"))


def truthy(p: Column) -> Column:
    """Whether a value counts as true; an absent one does not."""
    return F.when(p["json"].isNotNull(), ~p["json"].isin(FALSY)).otherwise(
        F.coalesce(p["text"] != "", F.lit(False))
    )


def printed(p: Column) -> Column:
    """A JSON value as text: null is `None`, booleans are capitalised, absent is empty."""
    return (
        F.when(p["json"] == "null", F.lit("None"))
        .when(p["json"].isin("true", "false"), F.initcap(p["json"]))
        .otherwise(F.coalesce(p["text"], F.lit("")))
    )


def _fields(items: Column, *paths: str) -> Column:
    """Each element with the values at `paths` as plain text, and itself as `whole`."""
    found = F.transform(
        items, lambda v: F.struct(v.alias("whole"), *[_get(v, f"$.{p}").alias(p) for p in paths])
    )
    return F.transform(
        found,
        lambda e: F.struct(e["whole"].alias("whole"), *[_plain(e[p]).alias(p) for p in paths]),
    )


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _links(items: Column, label: str, label_length: int, most: int, passes: int) -> Column:
    """Objects with label and url, or bare strings with an empty url; cut off after `most`.

    A second pass finds the bare strings without a url and drops them, after they were counted.
    """
    def bare(p: Column) -> Column:
        nothing = p[label]["text"].isNull() & p["url"]["text"].isNull()
        return nothing & F.startswith(F.to_json(p["whole"]), F.lit('"'))

    def text(p: Column) -> Column:
        return strip(p["whole"].cast("string"))

    kept = F.filter(
        _fields(items, label, "url"),
        lambda p: (truthy(p[label]) & truthy(p["url"])) | (bare(p) & (text(p) != "")),
    )
    cut = F.transform(
        F.slice(kept, 1, most),
        lambda p: F.struct(
            clip(F.when(bare(p), text(p)).otherwise(printed(p[label])), label_length).alias(label),
            clip(F.when(bare(p), F.lit("")).otherwise(printed(p["url"])), URL_LENGTH).alias("url"),
        ),
    )
    cleaned = F.coalesce(cut, F.array().cast(f"array<struct<{label}: string, url: string>>"))
    return cleaned if passes == 1 else F.filter(cleaned, lambda p: p["url"] != "")


def payload_lines(doc: Column, passes: int = 2) -> Column:
    return _links(_get(doc, "$.simple.lines", "array<variant>"), "text", LINE_TEXT, MAX_LINES, passes)


def payload_top3(doc: Column, passes: int = 2) -> Column:
    return _links(_get(doc, "$.normal.top3", "array<variant>"), "title", TOP3_TITLE, MAX_TOP3, passes)


def payload_sections(doc: Column) -> Column:
    objects = F.filter(_get(doc, "$.normal.sections", "array<variant>"), is_object)
    return F.coalesce(
        F.transform(
            _fields(objects, "title", "paragraph"),
            lambda p: F.struct(
                printed(p["title"]).alias("title"), printed(p["paragraph"]).alias("paragraph")
            ),
        ),
        F.array().cast("array<struct<title: string, paragraph: string>>"),
    )


def payload_glossary(doc: Column) -> Column:
    found = _fields(_get(doc, "$.glossary", "array<variant>"), "term", "explain")
    return F.coalesce(
        F.transform(
            F.filter(found, lambda p: truthy(p["term"])),
            lambda p: F.struct(
                clip(printed(p["term"]), TERM_LENGTH).alias("term"),
                clip(printed(p["explain"]), EXPLAIN_LENGTH).alias("explain"),
            ),
        ),
        F.array().cast("array<struct<term: string, explain: string>>"),
    )


def payload_footer(doc: Column) -> Column:
    footer = _plain(_get(doc, "$.simple.footer"))
    return F.when(truthy(footer), printed(footer)).otherwise(F.lit(""))


def normalize_payload(doc: Column, passes: int = 2) -> Column:
    """The clean payload struct of a raw VARIANT object."""
    return F.struct(
        F.struct(
            payload_lines(doc, passes).alias("lines"), payload_footer(doc).alias("footer")
        ).alias("simple"),
        F.struct(
            payload_top3(doc, passes).alias("top3"), payload_sections(doc).alias("sections")
        ).alias("normal"),
        payload_glossary(doc).alias("glossary"),
    )


def stored_payload(doc: Column) -> Column:
    """The payload struct of a stored payload, read as it stands: nothing is cut or cleaned again.

    Elements that are no objects are kept as bare labels in lines and top list and dropped from sections
    and glossary; what a payload lacks is empty.
    """

    def items(path: str, first: str, second: str, bare: bool) -> Column:
        every = _get(doc, path, "array<variant>")
        found = F.transform(
            _fields(every if bare else F.filter(every, is_object), first, second),
            lambda p: F.struct(
                F.when(is_object(p["whole"]), printed(p[first])).otherwise(printed(_plain(p["whole"]))).alias(first),
                printed(p[second]).alias(second),
            ),
        )
        return F.coalesce(found, F.array().cast(f"array<struct<{first}: string, {second}: string>>"))

    return F.struct(
        F.struct(items("$.simple.lines", "text", "url", True).alias("lines"), payload_footer(doc).alias("footer")).alias("simple"),
        F.struct(
            items("$.normal.top3", "title", "url", True).alias("top3"),
            items("$.normal.sections", "title", "paragraph", False).alias("sections"),
        ).alias("normal"),
        items("$.glossary", "term", "explain", False).alias("glossary"),
    )


def with_payload(issues: DataFrame, source: str = "payload_json", out: str = "payload") -> DataFrame:
    """Stored payloads as structs; blank or broken text reads as empty."""
    read = once(issues, _doc=F.coalesce(F.try_parse_json(source), F.parse_json(F.lit("{}"))))
    return once(read, **{out: stored_payload(F.col("_doc"))}).drop("_doc")


def _object(*fields: tuple[str, Column]) -> Column:
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


def _list(items: Column, first: str, second: str) -> Column:
    rows = F.transform(
        items, lambda x: _object((first, json_quote(x[first])), (second, json_quote(x[second])))
    )
    return F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]"))


def glossary_to_json(glossary: Column) -> Column:
    return _list(glossary, "term", "explain")


def payload_to_json(payload: Column) -> Column:
    simple, normal = payload["simple"], payload["normal"]
    return _object(
        (
            "simple",
            _object(
                ("lines", _list(simple["lines"], "text", "url")),
                ("footer", json_quote(simple["footer"])),
            ),
        ),
        (
            "normal",
            _object(
                ("top3", _list(normal["top3"], "title", "url")),
                ("sections", _list(normal["sections"], "title", "paragraph")),
            ),
        ),
        ("glossary", glossary_to_json(payload["glossary"])),
    )


def with_link(label: Column, url: Column) -> Column:
    return F.when(url != "", F.concat(label, F.lit(" ("), url, F.lit(")"))).otherwise(label)


def simple_text(payload: Column) -> Column:
    simple = payload["simple"]
    lines = F.array_join(F.transform(simple["lines"], lambda x: with_link(x["text"], x["url"])), "\n")
    return F.when(
        simple["footer"] != "", F.concat(lines, F.lit("\n\n"), simple["footer"])
    ).otherwise(lines)


def normal_text(payload: Column) -> Column:
    normal = payload["normal"]
    top3 = F.array_join(
        F.transform(normal["top3"], lambda x: F.concat(F.lit("\n- "), with_link(x["title"], x["url"]))),
        "",
    )
    sections = F.transform(
        normal["sections"],
        lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["paragraph"]),
    )
    head = F.when(
        F.size(normal["top3"]) > 0, F.array(F.concat(F.lit(TOP3_HEADING), top3))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, sections), "\n\n")
