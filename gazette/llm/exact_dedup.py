"""Exact de-duplication by deterministic block naming, in DataFrame functions only.

Texts are equal if they agree after deleting white space. The remaining bytes are cut into blocks of
fixed size. Sorting the distinct blocks gives each an integer name; then neighbouring names are paired,
the distinct pairs sorted and named in turn, until every document has one name. Equal names mean equal
texts and the other way round: nothing rests on a hash being free of collisions.

How it is spread:

* Names are given per bucket of a hash: `rank in the bucket * buckets + bucket`. The number of buckets
  follows the number of distinct contents, so a bucket holds a few dozen of them.
* Repeats of a content are combined before the shuffle, so a content that makes up a third of all
  blocks costs as much as any other. Block contents cross the network once.
* Blocks find their names by a 64-bit key of the content. Only if two different contents share a key
  (the names tell) are all blocks looked up by the content itself.
* A document leaves the recursion once it has one name; every level is stored, so it is worked out once
  and survives lost executors. Levels: log2 of the blocks of the longest document.

Defined cases: null and white-space-only texts are empty, equal to one another, and one block; of equal
texts the row with the most code points stays, then the smallest doc_id (a null id last); repeated rows
with one doc_id are rows of their own, exactly one of them stays. No rows, no result rows. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import packed, stored, texts
from gazette.operators.common import once

#: Bytes of a block, and distinct contents per naming bucket.
BLOCK_BYTES = 8192
PER_BUCKET = 64

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def blocks_of(norm: Column, size: int) -> Column:
    """The bytes of a text in blocks, at least one."""
    data = F.encode(norm, "UTF-8")
    last = F.floor((F.greatest(F.octet_length(norm), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(data, i * size + 1, F.lit(size)))


def bucket_count(distinct: int) -> int:
    return max(1, distinct // PER_BUCKET)


def place_names(sets: DataFrame, buckets: int) -> DataFrame:
    """`x` and its `name`: the place in its bucket's sorted list, told apart by the bucket."""
    each = sets.select("bucket", F.posexplode(F.sort_array("all")).alias("place", "x"))
    return each.select("x", (F.col("place").cast("long") * buckets + F.col("bucket") + 1).alias("name"))


def named(contents: DataFrame, keys: list[Column], value: Column, buckets: int) -> DataFrame:
    """Integer names of the distinct values; equal keys meet in one bucket."""
    bucket = F.pmod(*keys, F.lit(buckets)).alias("bucket")
    return place_names(contents.groupBy(bucket).agg(F.collect_set(value).alias("all")), buckets)


def paired(names: DataFrame) -> DataFrame:
    """row, place, a, b: neighbouring names of a document; a last one without a partner has b = 0."""
    side = lambda i: F.max(F.when(F.col("place") % 2 == i, F.col("name")))
    half = F.floor(F.col("place") / 2).cast("int").alias("place")
    return names.groupBy("row", half).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(0)).alias("b"))


def identities(docs: DataFrame, size: int = BLOCK_BYTES, key=F.xxhash64) -> DataFrame:
    """row, doc_id, points, text_sha256 and the collision-free identity (level, name) of every text."""
    slim = once(texts(docs, "doc_id"), norm=normalised(F.col("text")))
    blocks = once(slim, blocks=blocks_of(F.col("norm"), size))
    rows = stored(
        blocks.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.char_length("text").alias("points"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform("blocks", lambda x: key(x)).alias("keys"),
        ),
        "rows",
    )
    distinct = rows.select(F.explode("keys").alias("k")).agg(F.approx_count_distinct("k", 0.02)).first()[0]
    content = blocks.select(F.explode("blocks").alias("content"))
    named_blocks = named(content, [key("content")], F.col("content"), bucket_count(distinct))
    names = stored(named_blocks.select(key("x").alias("key"), F.col("x").alias("content"), "name"), "block-names")
    # Stored before the join, so that the rows of a hot key can be split.
    per_key = stored(names.groupBy("key").agg(F.count(F.lit(1)).alias("alike"), F.min("name").alias("name")), "per-key")
    if per_key.filter("alike > 1").limit(1).count() == 0:
        placed = rows.select("row", F.posexplode("keys").alias("place", "key"))
        now = placed.join(per_key, "key").select("row", "place", "name")
    else:
        rows, now = by_content(blocks, names)
    sizes = rows.select("row", F.size("keys").alias("left"))
    now = stored(now.join(sizes, "row").select("row", "place", "name", "left"), "names-0")
    done, level = [], 0
    while True:
        done.append(now.filter("left = 1").select("row", F.lit(level).alias("level"), "name"))
        open_ = now.filter("left > 1")
        pairs = stored(
            paired(open_).join(open_.filter("place = 0").select("row", F.ceil(F.col("left") / 2).cast("int").alias("left")), "row"),
            f"pairs-{level}",
        )
        distinct = pairs.agg(F.approx_count_distinct(F.struct("a", "b"), 0.02)).first()[0]
        if distinct == 0:
            break
        value = F.struct("a", "b")
        names = named(pairs, [F.xxhash64("a", "b")], value, bucket_count(distinct))
        names = names.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), "name")
        level += 1
        now = stored(pairs.join(names, ["a", "b"]).select("row", "place", "name", "left"), f"names-{level}")
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return rows.drop("keys").join(ids, "row")


def by_content(blocks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and block names where a key does not tell contents apart: looked up by content."""
    kept = ["row", "doc_id", "points", "text_sha256", "keys"]
    rows = blocks.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.char_length("text").alias("points"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform("blocks", lambda x: F.lit(0)).alias("keys"),
        "blocks",
    ).select(*kept, F.posexplode("blocks").alias("place", "content"))
    found = stored(rows.join(names.drop("key"), "content").drop("content"), "found")
    return found.filter("place = 0").select(*kept), found.select("row", "place", "name")


def exact_dedup(docs: DataFrame, size: int = BLOCK_BYTES, key=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too; points (its code
    points) and ties (rows of its group that share doc_id and points with the one that stays)."""
    rows = stored(identities(docs, size, key), "identities")
    place = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id")
    sizes = rows.groupBy("level", "name", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    groups = sizes.groupBy("level", "name").agg(F.sum("n").alias("group_size"), F.min(F.struct("place", "row", "n")).alias("best"))
    return rows.join(stored(groups, "groups"), ["level", "name"]).select(
        "doc_id",
        F.col("best.place.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "text_sha256",
        "points",
        F.col("best.n").alias("ties"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, whole. Rows that agree in doc_id, points and normalised text with
    the one that stays cannot be told apart by these; of them one with the smallest text stays."""
    names = ["doc", "key", "length"]
    kept = exact_dedup(docs).filter("kept").select(
        F.col("doc_id").alias("doc_k"), F.col("text_sha256").alias("key_k"), F.col("points").alias("length_k"), "ties"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = packed(docs, doc=F.col("doc_id"), text=text)
    marked = once(marked, key=F.sha2(normalised(F.col("text")), 256), length=F.char_length("text"))
    same = F.col("doc").eqNullSafe(F.col("doc_k")) & (F.col("key") == F.col("key_k")) & (F.col("length") == F.col("length_k"))
    found = marked.join(stored(kept, "kept"), same)
    tied = found.filter("ties > 1").groupBy(*names).agg(F.min_by("given", "text").alias("given"))
    return found.filter("ties = 1").select("given").unionByName(tied.select("given")).select("given.*")
