"""Keywords against many texts: a substring join without comparing every pair, and digests worked out per
keyword list instead of per subscriber."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.keywords import keywords_normalize, keywords_parse
from gazette.operators.common import salted_join, split_join

GRAM = 3
LONGS = 1 << 16  # of the table that marks grams some keyword holds: 64 cells each, 512 kB whatever the dictionary


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _grams(chars: Column, length: int) -> Column:
    """Distinct substrings of `length` characters, from the array of single characters."""
    if length == 1:
        return F.array_distinct(chars)
    last = F.greatest(F.size(chars) - (length - 1), F.lit(0))
    windows = F.transform(
        F.slice(chars, F.lit(1), last),
        lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, length)]),
    )
    return F.array_distinct(windows)


def _cell(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(64 * LONGS))


def _marked(grams: DataFrame) -> Column:
    """Whether column `gram` may be one of `grams`: false says it certainly is not.

    One bit per cell of a table of fixed size, a scalar subquery; more grams set more bits, no more memory.
    """
    cells = grams.select(_cell(F.col("gram")).alias("cell"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("cell") % 64).cast("int"))
    longs = cells.groupBy(F.shiftright("cell", 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = grams.sparkSession.range(LONGS).join(longs, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("t")).scalar()
    cell = _cell(F.col("gram"))
    return F.getbit(F.get(table, F.shiftright(cell, 6).cast("int")), (cell % 64).cast("int")) == 1


def distinct_keywords(subscribers: DataFrame) -> DataFrame:
    words = keywords_normalize(keywords_parse(F.col("keywords_json")))
    return subscribers.select(F.explode(words).alias("keyword")).distinct()


def keyword_matches(keywords: DataFrame, items: DataFrame, item_id: str, content: str) -> DataFrame:
    """`keyword, item_id` for every item whose lower-cased text holds the keyword.

    Texts are cut into the character triples (and, for shorter keywords, pairs and single
    characters) they hold. Each keyword is looked up by its rarest triple; only those candidates
    are compared in full. A triple found in very many items is spread over several tasks; of triples no
    keyword holds, next to none is shuffled.
    """
    words = keywords.select("keyword").filter(F.col("keyword") != "").distinct()
    words = words.withColumn("chars", _letters(F.col("keyword")))
    size = F.least(F.size("chars"), F.lit(GRAM))
    own = F.when(size == 1, _grams(F.col("chars"), 1)).when(size == 2, _grams(F.col("chars"), 2))
    wanted = words.select("keyword", F.explode(own.otherwise(_grams(F.col("chars"), GRAM))).alias("gram"))

    # Texts give up pairs and single characters only if some keyword is that short.
    none = F.array().cast("array<string>")
    asked = words.agg(F.struct(*[F.max(size == n).alias(f"n{n}") for n in range(1, GRAM + 1)])).scalar()
    lengths = [F.when(asked[f"n{n}"], _grams(F.col("chars"), n)).otherwise(none) for n in range(1, GRAM + 1)]
    cut = items.select(F.col(item_id).alias("item_id"), _letters(F.lower(F.col(content))).alias("chars"))
    every = cut.select("item_id", F.explode(F.concat(*lengths)).alias("gram"))
    # One pass over the texts: what no keyword holds goes where it is read, but for the few that share a
    # cell; the rest is stored for both uses.
    held = every.filter(_marked(wanted)).checkpoint()
    frequency = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A keyword with a triple no text holds cannot match: its count is null and sorts first.
    rarest = (
        wanted.join(frequency, "gram", "left")
        .groupBy("keyword")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        .filter("r.n > 0")
        .select("keyword", "r.gram")
    )
    candidates = split_join(held, rarest, ["gram"], "inner", ["item_id"]).select("keyword", "item_id")
    texts = items.select(F.col(item_id).alias("item_id"), F.lower(F.col(content)).alias("text"))
    return (
        candidates.join(texts, "item_id")
        .filter(F.contains(F.col("text"), F.col("keyword")))
        .select("keyword", "item_id")
    )


def keyword_sets(subscribers: DataFrame) -> DataFrame:
    """Each distinct normalized keyword list, with the number of subscribers that have it."""
    words = F.array_sort(F.array_distinct(keywords_normalize(keywords_parse(F.col("keywords_json")))))
    return (
        subscribers.select(words.alias("keywords"))
        .filter(F.size("keywords") > 0)
        .groupBy("keywords")
        .agg(F.count("*").alias("n_subscribers"))
        .withColumn("set_key", F.array_join("keywords", "\n"))
    )


def sections_per_set(sets: DataFrame, matches: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """The issue sections in which a keyword list finds something: `set_key, issue_id, section`.

    Matches are first cut down to one row per keyword and section, so a keyword found in very many
    items, or asked for by very many lists, does not pair them all.
    """
    placed = items.select(F.col(item_id).alias("item_id"), "issue_id", "section")
    found = matches.join(placed, "item_id").select("keyword", "issue_id", "section").distinct()
    words = sets.select("set_key", F.explode("keywords").alias("keyword"))
    return (
        salted_join(words, found, ["keyword"], "inner", ["set_key"])
        .select("set_key", "issue_id", "section")
        .distinct()
    )


LISTS = ("lines", "top3", "sections", "glossary")  # of an issue; a footer is no list and is never cut
ELEMENT = ["issue_id", "list", "pos"]


def issue_elements(bodies: DataFrame) -> DataFrame:
    """`issue_id, list, pos, needle, text` for every element of issues (`issue_id`, `body` as `searchable` makes it).

    A footer that is not empty comes as the one element of the list `footer`.
    """
    body = F.col("body")

    def listed(name: str) -> Column:
        return F.transform(
            body[name],
            lambda x, i: F.struct(F.lit(name).alias("list"), i.alias("pos"), x["needle"].alias("needle"), x["text"].alias("text")),
        )

    footer = body["footer"]
    last = F.struct(F.lit("footer").alias("list"), F.lit(0).alias("pos"), F.lower(footer).alias("needle"), footer.alias("text"))
    none = F.filter(F.array(last), lambda x: x["text"] != "")
    return bodies.select("issue_id", F.inline(F.concat(*[listed(n) for n in LISTS], none)))


def digests_per_set(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """Each keyword list's cut of each issue it is asked for, in rows: `set_key, issue_id, matched, list, pos, text`.

    `asked`: distinct `set_key, issue_id` with the normalized `keywords`. Every keyword is looked up once
    over all elements, every pair of list and issue is worked out once, however many subscribers share it.
    Rows are those of `filter_digest`: without keywords, or where neither lines, top list, sections nor
    footer hold one, all elements stay; else each list is cut to its hits, and a list without a hit stays
    whole. A list that is empty in the issue has no rows; a pair of which the issue has no element at all
    comes as one row without list.
    """
    pair = ["set_key", "issue_id"]
    words = asked.select(*pair, F.explode("keywords").alias("keyword"))
    named = elements.withColumn("element", F.concat_ws("/", *ELEMENT))
    found = keyword_matches(words.select("keyword").distinct(), named, "element", "needle").withColumnRenamed("item_id", "element")
    placed = found.join(named.select("element", *ELEMENT), "element").drop("element")
    hits = salted_join(words, placed, ["issue_id", "keyword"], "inner", ["set_key"]).select(*pair, "list", "pos").distinct().checkpoint()
    matched = hits.filter(F.col("list") != "glossary").select(*pair).distinct().withColumn("_hit", F.lit(True))
    pairs = asked.join(matched, pair, "left").select(
        *pair, (F.col("_hit").isNotNull() | (F.size("keywords") == 0)).alias("matched"), F.col("_hit").isNotNull().alias("_cut")
    )
    cut = hits.join(pairs.filter("_cut").select(*pair, "matched"), pair).filter(F.col("list").isin(*LISTS))
    lists = pairs.withColumn("list", F.explode(F.array(*[F.lit(n) for n in LISTS])))
    # Lists without a hit of their own, and all lists of pairs that are not cut, stay whole.
    whole = lists.join(cut.select(*pair, "list").distinct(), [*pair, "list"], "left_anti")
    texts = elements.select(*ELEMENT, "text")
    kept = salted_join(cut, texts, ELEMENT, "inner", ["set_key"])
    rest = salted_join(whole, texts, ["issue_id", "list"], "inner", ["set_key"])
    names = [*pair, "matched", "list", "pos", "text"]
    rows = kept.select(*names).unionByName(rest.select(*names))
    bare = pairs.join(texts.filter(F.col("list").isin(*LISTS)).select("issue_id").distinct(), "issue_id", "left_anti")
    none = {"list": "string", "pos": "int", "text": "string"}
    return rows.unionByName(bare.select(*pair, "matched", *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))


def gathered_digests(rows: DataFrame) -> DataFrame:
    """`set_key, issue_id, matched` and the texts of each list in order; a row holds one issue's elements at most."""
    in_order = {
        n: F.transform(
            F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("pos", "text")))), lambda x: x["text"]
        ).alias(n)
        for n in LISTS
    }
    return rows.groupBy("set_key", "issue_id").agg(F.any_value("matched").alias("matched"), *in_order.values())
