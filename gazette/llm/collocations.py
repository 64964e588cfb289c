"""Phrase collocations by best-first branch and bound over prefixes.

Phrases of two and three words grow from their prefixes. With a = f(phrase), a phrase that starts with the prefix p has
a <= f(p), and the counts of what a cut leaves are at least a; so its score, a*a / (l*r) at the worst cut,
is at most f(p) / f(first word) - a bound that needs the counts of prefixes only. The order of growth:

* Words. All are counted; only words with at least `least` occurrences can be in a phrase. A single word bounds
  nothing (its phrases may score 1), so that all of them are expanded at once.
* Pairs. Counted exactly, those of frequent words only. They are phrases and the prefixes of the frontier.
* Triples, best first. Per language a threshold is put at the score of the pair at rank `reach`. Every prefix with a
  bound at or above it is expanded; so are those that could hold a pair of such a score inside a longer phrase
  often enough to drop it. Then all phrases at or above the threshold are known, with their fate. If
  `limit` of them survive, ties included, nothing below matters and the language is settled; else the threshold falls
  (`reach` grows fourfold) and only prefixes not yet expanded are counted, until the threshold is zero.

How it is spread: tasks count in Python, in tables that are emptied at `HELD` phrases, and send (language, phrase,
number); a hot language or phrase is so combined ahead of the shuffle. Which words and prefixes to count
travels as bits of hashes, at most `MOST_BITS` of them: a bit set by chance lets a phrase through that later joins drop;
none is missed, and a phrase is counted wholly or not at all. Thresholds come from a histogram of scores, which has
at most 1,000,001 values a language. Products are decimals of 38 digits, exact up to 10^15 occurrences.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count as often as
they stand there; no rows, or no phrase that is frequent enough, no result. Other columns are not looked at.
Very long texts are counted slice by slice; a slice never cuts a word, and phrases across slices count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored
from gazette.llm.words import BASE, mixed

LIMIT, LEAST, PERCENT = 2000, 10, 50
MILLION = 1_000_000
#: Phrases a task holds at most before it sends them on; words a language remembers the hash of.
HELD, MEMORY = 200_000, 100_000
SLICE_BYTES = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
SEGMENT = 1 << 15  # bits that Spark puts into one bitmap

#: A separator becomes a full stop, a tab a blank, A-Z a-z. A full stop as a word of its own ends a piece.
STOP = b"."
TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b".......... abcdefghijklmnopqrstuvwxyz")


def word_lists(text: bytes, carry: int) -> Iterator[list[bytes]]:
    """The words of a text slice by slice, stops between pieces; each list starts with the last `carry` of the one before."""
    data, start, last = text.translate(TABLE).replace(STOP, b" . "), 0, []
    while start < len(data):
        end = data.find(b" ", start + SLICE_BYTES)
        end = len(data) if end < 0 else end
        words = last + data[start:end].split()
        yield words
        last, start = words[max(0, len(words) - carry) :] if carry else [], end


class Hashes(dict):
    """64-bit hashes of the words of one language, remembered; that of a stop is zero."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, seed=self.seed) | 1 if word != STOP else 0
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """A hash of every two neighbours."""
    with np.errstate(over="ignore"):
        return mixed(hashes[:-1] * BASE + hashes[1:])


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits_of(phrases: DataFrame, length: int) -> np.ndarray:
    """A bit for the hash of each (lang, phrase) of one or two words; their number follows that of the phrases, up to `MOST_BITS`."""
    size = LEAST_BITS
    n = phrases.count()
    while size < min(16 * n, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Hashes] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            words = [known.setdefault(lang, Hashes(lang)).of(text.encode().split(b" ")) for lang, text in zip(langs, texts, strict=True)]
            keys = np.concatenate([w if length == 1 else pair_keys(w) for w in words]) if words else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((keys & np.uint64(size - 1)).astype(np.int64))], names=["cell"])

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell bigint")
    segments = cells.groupBy(F.floor(F.col("cell") / SEGMENT).alias("segment")).agg(F.bitmap_construct_agg(F.col("cell") % SEGMENT).alias("bits"))
    out = np.zeros((size // SEGMENT, SEGMENT // 8), dtype=np.uint8)
    for row in segments.toLocalIterator():  # at most MOST_BITS / SEGMENT of them
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def counted(docs: DataFrame, length: int, grams: Callable[[str], Callable[[list[bytes]], Iterable[bytes]]]) -> DataFrame:
    """lang, phrase and a, its occurrences, of the phrases that `grams` gives for a language and a list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, Callable]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = (Counter(), grams(lang))
                counts, found = held[lang]
                for words in word_lists(text, length - 1):
                    counts.update(found(words))
                    if len(counts) >= HELD:
                        yield sent(lang, counts)
                if sum(len(c) for c, _ in held.values()) >= HELD:
                    for other, (c, _) in held.items():
                        yield sent(other, c)
        for lang, (counts, _) in held.items():
            yield sent(lang, counts)

    def sent(lang: str, counts: Counter) -> pa.RecordBatch:
        phrases, numbers = list(counts), list(counts.values())
        counts.clear()
        columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(numbers, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])

    parts = docs.mapInArrow(run, "lang string, phrase binary, a bigint")
    return parts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a"))


def all_words(lang: str) -> Callable:
    return lambda words: filter(STOP.__ne__, words)


def pairs_of(frequent: np.ndarray) -> Callable:
    """Pairs of words whose bits are set."""

    def by_lang(lang: str) -> Callable:
        known = Hashes(lang)

        def found(words: list[bytes]) -> Iterable[bytes]:
            hashes = known.of(words)
            sound = (hashes > 0) & marked(frequent, hashes)
            return map(b" ".join, compress(zip(words, words[1:], strict=False), (sound[:-1] & sound[1:]).tobytes()))

        return found

    return by_lang


def triples_of(frequent: np.ndarray, prefixes: np.ndarray, pairs: np.ndarray) -> Callable:
    """Triples of frequent words whose first two are to be expanded and whose last two are a frequent pair."""

    def by_lang(lang: str) -> Callable:
        known = Hashes(lang)

        def found(words: list[bytes]) -> Iterable[bytes]:
            if len(words) < 3:
                return ()
            hashes = known.of(words)
            sound = (hashes > 0) & marked(frequent, hashes)
            keys = pair_keys(hashes)
            both = sound[:-1] & sound[1:]
            grown = both[:-1] & both[1:] & marked(prefixes, keys[:-1]) & marked(pairs, keys[1:])
            return map(b" ".join, compress(zip(words, words[1:], words[2:], strict=False), grown.tobytes()))

        return found

    return by_lang


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) of the named columns, exact."""
    square = f"(CAST({a} AS DECIMAL(16,0)) * CAST({a} AS DECIMAL(15,0)))"
    return F.expr(f"(CAST({MILLION} AS DECIMAL(7,0)) * {square}) DIV (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0)))")


def frequent_pairs(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, first, second, a, l, r, score and bound of the pairs."""
    each = counts.select("lang", "phrase", F.substring_index("phrase", " ", 1).alias("first"), F.substring_index("phrase", " ", -1).alias("second"), "a")
    word = lambda place, count: words.select("lang", F.col("phrase").alias(place), F.col("a").alias(count))
    joined = each.join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
    bound = F.expr(f"(CAST({MILLION} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(18,0))) DIV CAST(l AS DECIMAL(18,0))")
    return joined.select("lang", "phrase", "first", "second", "a", "l", "r", score("a", "l", "r").alias("score"), bound.alias("bound"))


def scored_triples(counts: DataFrame, prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, phrase, head, rest (its two pairs), a, l, r and score of the triples that grow from `prefixes`."""
    each = counts.select(
        "lang", "phrase", F.substring_index("phrase", " ", 2).alias("head"), F.substring_index("phrase", " ", -2).alias("rest"), "a"
    )
    before = prefixes.select("lang", F.col("phrase").alias("head"), F.col("l").alias("first"), F.col("a").alias("both"))
    behind = pairs.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("tail"), F.col("r").alias("last"))
    joined = each.join(before, ["lang", "head"]).join(behind, ["lang", "rest"])
    cuts = joined.withColumn("one", score("a", "first", "tail")).withColumn("two", score("a", "both", "last"))
    early = F.col("one") <= F.col("two")
    return cuts.select(
        "lang", "phrase", "head", "rest", "a",
        F.when(early, F.col("first")).otherwise(F.col("both")).alias("l"),
        F.when(early, F.col("tail")).otherwise(F.col("last")).alias("r"),
        F.least("one", "two").alias("score"),
    )


def thresholds(pairs: DataFrame, langs: DataFrame, reach: int) -> DataFrame:
    """lang and theta: the score of the pair at rank `reach`, zero where a language has fewer."""
    bars = pairs.join(langs, "lang", "left_semi").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score"))) - F.col("n")
    enough = F.min(F.when(F.col("above") < reach, F.col("score")))
    found = bars.withColumn("above", above).groupBy("lang").agg(F.sum("n").alias("all"), enough.alias("theta"))
    return found.select("lang", F.when(F.col("all") < reach, F.lit(0)).otherwise(F.col("theta")).alias("theta"))


def to_expand(pairs: DataFrame, theta: DataFrame, percent: int) -> DataFrame:
    """The prefixes that can lead to a phrase at or above the threshold, or drop a pair there."""
    here = pairs.join(theta, "lang")
    contenders = here.filter("score >= theta").groupBy("lang", F.col("first").alias("second")).agg(F.min("a").alias("held"))
    droppers = F.col("held").isNotNull() & (100 * F.col("a") >= percent * F.col("held"))
    return here.join(contenders, ["lang", "second"], "left").filter((F.col("bound") >= F.col("theta")) | droppers).select(*pairs.columns)


def survivors(pairs: DataFrame, triples: DataFrame, theta: DataFrame, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases at or above the threshold that no longer one drops."""
    kept = ["lang", "phrase", "a", "l", "r", "score"]
    inside = triples.select("lang", F.col("head").alias("phrase"), "a").unionByName(triples.select("lang", F.col("rest").alias("phrase"), "a"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    here = pairs.join(theta, "lang").filter("score >= theta").join(longest, ["lang", "phrase"], "left")
    stay = here.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return stay.select(*kept).unionByName(triples.join(theta, "lang").filter("score >= theta").select(*kept))


def collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, percent: int = PERCENT, reach: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `limit` best phrases of each language.

    `reach` is the rank of the pair that gives the first threshold; it only decides how the work is split."""
    spark = docs.sparkSession
    # Rank limits up to 10,000 are applied ahead of the shuffle.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words = stored(counted(slim, 1, all_words), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= least)
    word_bits = bits_of(frequent, 1)
    counts = counted(slim, 2, pairs_of(word_bits)).filter(F.col("a") >= least)
    pairs = stored(frequent_pairs(counts, frequent), "pairs")
    pair_bits = bits_of(pairs, 2)
    langs = stored(pairs.select("lang").distinct(), "langs")
    expanded: DataFrame | None = None
    triples: DataFrame | None = None
    settled: list[DataFrame] = []
    reach = reach or 2 * limit
    while langs.limit(1).count():
        theta = stored(thresholds(pairs, langs, reach), "thresholds")
        prefixes = to_expand(pairs, theta, percent)
        if expanded is not None:
            prefixes = prefixes.join(expanded, ["lang", "phrase"], "left_anti")
        prefixes = stored(prefixes, "prefixes")
        counts = counted(slim, 3, triples_of(word_bits, bits_of(prefixes, 2), pair_bits)).filter(F.col("a") >= least)
        grown = stored(scored_triples(counts, prefixes, pairs), "triples")
        triples = grown if triples is None else triples.unionByName(grown)
        reached = prefixes.select("lang", "phrase")
        expanded = reached if expanded is None else expanded.unionByName(reached)
        alive = stored(survivors(pairs, triples, theta, percent), "survivors")
        enough = theta.join(alive.groupBy("lang").agg(F.count(F.lit(1)).alias("alive")), "lang", "left")
        enough = stored(enough.select("lang", (F.coalesce("alive", F.lit(0)) >= limit) | (F.col("theta") == 0)), "settled").toDF("lang", "done")
        settled.append(alive.join(enough.filter("done"), "lang", "left_semi"))
        langs = stored(enough.filter("NOT done").select("lang"), "langs")
        reach *= 4
    if not settled:
        empty = pairs.select("lang", "phrase", "a", "l", "r", "score")
        settled.append(empty)
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", *whole)
