"""N-gram Jaccard join with several global token orders.

A document is the set of its `WORDS`-word shingles. Two sets with a Jaccard similarity of at least t share
a token among the first n - ceil(t n) + 1 of each, under any order of all tokens. Candidates must do so
under three orders at once; only then are they verified on the whole sets.

Orders. Each is (frequent or not, a hash of its own), frequent tokens last. How many documents hold a
token is counted over all shingles of all documents, in a table of fixed size (`BITMAP_BITS` cells); a
token is frequent if its cell has over `FREQUENT` hits more than the mean and `SIGMAS` times its spread. One bit
per cell is broadcast. Any function of the token gives a valid order, so chance hits of a cell, more of
them the larger the corpus, cost time only. Common passages leave the prefixes that way, and in a large
group of near copies what is private to a document stands first: documents whose private part is too
large to be similar to any other meet none.

Steps, none of which puts out all pairs of a group:

1. Documents with the same words form a class; one of each takes part.
2. Of the documents that share a prefix token one is the leader (the one with the fewest infrequent tokens, as
   the origin of copies has). Every other is a candidate with the leader only: as many pairs as rows.
3. Links found there give first components. Only pairs of different components are left: documents
   outside the component of a token's leader against all that share the token.
4. The links of both rounds give the components.

A candidate passes the filter of an order if the overlap that its two prefixes allow (tokens both have up
to the smaller of the two last ones, plus what is left of the smaller set) reaches the needed overlap.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; null, empty and
blank texts have none and link with nothing, not even one another; repeated rows are copies; a component
without any doc_id has a null component_id. No rows, no result. Other columns are not looked at. Tokens are
64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import packed, stored, texts
from gazette.llm.components import components
from gazette.llm.substring_dedup import class_column, class_of, class_texts
from gazette.llm.words import MIX_A, WordHashes, mixed, run_hashes, words_of
from gazette.operators.common import once

WORDS, PERCENT = 4, 85
FREQUENT, SIGMAS, BITMAP_BITS = 8, 6, 1 << 24
#: Cells of a block, shingles that a task counts at once, tables of counts that are added at once.
BLOCK, FLUSH, FAN_IN = 1 << 16, 1 << 22, 32
ORDERS = 3


def shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    found = run_hashes(hashes.of(words), min(size, len(words)))
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def order_keys(tokens: np.ndarray, order: int) -> np.ndarray:
    """The place of each token in an order, without regard to frequency."""
    with np.errstate(over="ignore"):
        return mixed(tokens + np.uint64(order + 1) * MIX_A) >> np.uint64(1)


def is_frequent(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = tokens & np.uint64(BITMAP_BITS - 1)
    return (bitmap[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def prefix(keys: np.ndarray, size: int) -> np.ndarray:
    """The first `size` keys of a set, in no order."""
    return np.partition(keys, size - 1)[:size] if size < len(keys) else keys


def block_rows(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Counts of sorted cells, block by block."""
    cut = np.searchsorted(cells, np.arange(0, BITMAP_BITS + 1, BLOCK, dtype=np.uint64))
    for block, (start, stop) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if stop > start:
            counts = np.bincount((cells[start:stop] - np.uint32(block * BLOCK)).astype(np.int64), minlength=BLOCK)
            yield block, zstandard.compress(counts.astype("<u4").tobytes(), 1)


def read_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def frequent_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """The bitmap of cells that far more documents hit than the mean, over all shingles of all documents.

    Tasks count hits of cells (tokens cut to `BITMAP_BITS` values) in blocks; blocks are added up in a
    tree, `FAN_IN` or so at a time; what comes to the driver is one bit per cell.
    """
    schema = "block int, part bigint, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n, made = WordHashes(), [], 0, 0
        place = TaskContext.get().partitionId() if TaskContext.get() else 0

        def flush() -> pa.RecordBatch:
            rows = list(block_rows(np.sort(np.concatenate(held))))
            part = [(place << 20) + made] * len(rows)
            columns = [pa.array([b for b, _ in rows], pa.int32()), pa.array(part, pa.int64()), pa.array([c for _, c in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "part", "counts"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = shingles(words_of(text, lower=True), hashes, size)
                held.append((tokens & np.uint64(BITMAP_BITS - 1)).astype(np.uint32))
                n += len(tokens)
                if n >= FLUSH:
                    yield flush()
                    held, n, made = [], 0, made + 1
        if n:
            yield flush()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, dtype=np.uint64)
        for data in group.column("counts").to_pylist():
            total += read_counts(data)
        data = zstandard.compress(np.minimum(total, np.iinfo(np.uint32).max).astype("<u4").tobytes(), 1)
        return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "part": pa.array([group.column("part")[0].as_py()], pa.int64()), "counts": pa.array([data], pa.binary())})

    counts = stored(texts(docs).mapInArrow(count, schema), "counts")
    parts = counts.select("part").distinct().count()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        group = F.pmod(F.xxhash64("part"), F.lit(parts)).alias("group")
        counts = stored(counts.groupBy("block", group).applyInArrow(add, schema), "counts")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"hits": [int(read_counts(x).sum(dtype=np.uint64)) for x in batch.column("counts").to_pylist()]})

    hits = counts.mapInArrow(sums, "hits bigint").agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    mean = hits / BITMAP_BITS
    limit = FREQUENT + mean + SIGMAS * mean**0.5

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(read_counts(x) > limit, bitorder="little").tobytes() for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(found, pa.binary())], names=["block", "bits"])

    bitmap = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for block, found in counts.mapInArrow(bits, "block int, bits binary").collect():  # one bit per cell
        bitmap[block * BLOCK // 8 : (block + 1) * BLOCK // 8] |= np.frombuffer(found, np.uint8)
    return bitmap


def scan(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """row, doc_id, class, n (shingles), cold (infrequent ones) and the prefix keys of each order, as bytes:
    of the first order whole, of the others the upper half of each key, both sorted."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, size))
    slim = texts(docs, "doc_id")
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["class", "n", "cold", *[f"o{i}" for i in range(ORDERS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text, lower=True)
                tokens = shingles(words, hashes, size)
                hot, short = is_frequent(tokens, shared.value), prefix_size(len(tokens), percent)
                last = hot.astype(np.uint64) << np.uint64(63)
                keys = [prefix(order_keys(tokens, i) | last, short) for i in range(ORDERS)]
                halves = [np.sort((k >> np.uint64(32)).astype("<u4")) for k in keys[1:]]
                rows.append((class_of(words), len(tokens), len(tokens) - int(hot.sum()), *[k.tobytes() for k in (np.sort(keys[0]), *halves)]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            kinds = [pa.binary(), pa.int64(), pa.int64()] + [pa.binary()] * ORDERS
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    orders = ", ".join(f"o{i} binary" for i in range(ORDERS))
    found = slim.mapInArrow(run, f"doc_id {kind}, class binary, n bigint, cold bigint, {orders}")
    return found.withColumn("row", F.monotonically_increasing_id())


def exploded(classes: DataFrame) -> DataFrame:
    """token, id, at: the first order's prefix, one row per token with its place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, "<i8") for x in batch.column("o0").to_pylist()]
            if keys:
                ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(k) for k in keys])
                at = np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids), pa.array(at)], names=["token", "id", "at"])

    return classes.select("id", "o0").mapInArrow(run, "token bigint, id bigint, at int")


def can_reach(n: Column, at: Column, m: Column, there: Column, percent: int) -> Column:
    """Whether sets of n and m tokens that first share the tokens at these places can be similar enough.

    What stands before is not shared, so at most the rest of either set is. At any later shared token the
    bound is lower still: a pair that can be similar passes at its first one. (With `at` 0 this bounds the
    sizes.) Documents with a large private part, which stands first in the order, pass nowhere.
    """
    return F.least(n - at, m - there) * (100 + percent) >= (n + m) * percent


def passing(pairs: DataFrame, scanned: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes allow the needed overlap under each of the other orders."""
    orders = [f"o{i}" for i in range(1, ORDERS)]
    side = lambda x: scanned.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(o).alias(f"{o}_{x}") for o in orders])
    wide = pairs.filter("a >= 0").join(side("a"), "a").join(side("b"), "b")  # the filter: see class_texts

    def allowed(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> int:
        """Both prefixes are whole below the smaller of their last keys; keys are cut, so equal ones may differ."""
        limit = min(x[-1], y[-1])
        x, y = x[: np.searchsorted(x, limit)], y[: np.searchsorted(y, limit)]
        return common(x, y) + min(n_x - len(x), n_y - len(y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
            alive = list(range(batch.num_rows))
            for o in orders:
                x, y = batch.column(f"{o}_a"), batch.column(f"{o}_b")
                keys = lambda column, i: np.frombuffer(column[i].as_buffer(), "<u4")
                alive = [i for i in alive if allowed(keys(x, i), keys(y, i), n_a[i], n_b[i]) >= needed(n_a[i], n_b[i], percent)]
            chosen = pa.array(alive, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], names=["a", "b"])

    return wide.mapInArrow(run, "a bigint, b bigint")


def needed(n: int, m: int, percent: int) -> int:
    """The smallest overlap of sets of n and m tokens that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def token_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id and the whole sorted set, as bytes, of every class that stands in a pair."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = classes.select("id", "class", F.col("rep.doc_id").alias("doc")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            tokens = [shingles(words_of(t, lower=True), hashes, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens, pa.binary())], names=["id", "tokens"])

    found = class_texts(docs, stored(wanted, "wanted"), lower=True)
    return found.select("id", "text").mapInArrow(run, "id bigint, tokens binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    sets = stored(token_sets(pairs, classes, docs, size), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, alive = batch.column("t_a"), batch.column("t_b"), []
            for i in range(batch.num_rows):
                a, b = np.frombuffer(x[i].as_buffer(), "<u8"), np.frombuffer(y[i].as_buffer(), "<u8")
                if common(a, b) >= needed(len(a), len(b), percent):
                    alive.append(i)
            chosen = pa.array(alive, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def similar_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned documents, classes, and links (a, b) between classes that hold their components together."""
    scanned = stored(scan(docs, size, percent), "scanned")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("rep")
    classes = stored(
        scanned.filter("n > 0").groupBy("class").agg(first, F.min(F.struct("row", "n", "cold")).alias("x")).select(
            F.col("x.row").alias("id"), "class", "rep", F.col("x.n").alias("n"), (F.col("x.cold") * 1000 / F.col("x.n")).cast("int").alias("cold")
        ),
        "classes",
    )
    # Copies are few against all rows: taking them out moves less than picking the others.
    sound = scanned.filter("n > 0").select(F.col("row").alias("id"), "o0")
    copies = stored(sound.select("id").join(classes.select("id"), "id", "left_anti"), "copies")
    rows = exploded(sound.join(copies, "id", "left_anti"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("token")
    # What rows are joined with is stored first: a hot token's rows can then be split.
    met = rows.join(stored(often, "often"), "token", "left_semi").join(classes.select("id", "n", "cold"), "id")
    met = stored(met, "met")
    leaders = met.groupBy("token").agg(F.min(F.struct("cold", "id", "n", "at")).alias("leader"))
    shared = stored(
        met.join(stored(leaders, "leaders"), "token").select(
            "token", "id", "n", "at", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"), F.col("leader.at").alias("leader_at")
        ),
        "shared",
    )
    a, b = F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")
    reach = can_reach(F.col("n"), F.col("at"), F.col("leader_n"), F.col("leader_at"), percent)
    stars = shared.filter((F.col("id") != F.col("leader")) & reach).select(a, b).distinct()
    stars = stored(stars, "stars")
    near = stored(verified(stored(passing(stars, scanned, percent), "candidates"), classes, docs, size, percent), "links")
    labels = components(near)
    of = lambda x, label: labels.select(F.col("node").alias(x), F.col("label").alias(label))
    labelled = shared.join(of("id", "label"), "id", "left").join(of("leader", "leader_label"), "leader", "left")
    labelled = stored(
        labelled.select("token", "id", "n", "at", F.coalesce("label", "id").alias("label"), F.coalesce("leader_label", "leader").alias("leader_label")),
        "labelled",
    )
    outside = labelled.filter("label <> leader_label")
    left = outside.select("token", F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.col("label").alias("label_x"))
    right = labelled.join(stored(outside.select("token").distinct(), "open"), "token", "left_semi").select(
        F.col("token").alias("token_y"), F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("at").alias("at_y"), F.col("label").alias("label_y"), (F.col("label") != F.col("leader_label")).alias("too")
    )
    # Both outside the leader's component: taken once, from the smaller id.
    apart = (F.col("label_x") != F.col("label_y")) & (~F.col("too") | (F.col("x") < F.col("y")))
    reach = can_reach(F.col("n_x"), F.col("at_x"), F.col("n_y"), F.col("at_y"), percent)
    pairs = left.join(stored(right, "right"), (F.col("token") == F.col("token_y")) & apart & reach)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = stored(passing(stored(pairs, "pairs"), scanned, percent), "candidates")
    more = stored(verified(pairs, classes, docs, size, percent), "links")
    return scanned, classes, near.unionByName(more)


def labelled_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """class, smallest (none, doc_id and class of the component's first document): one row per class."""
    labels = components(links).withColumnRenamed("node", "id")
    labelled = classes.select("id", "class", "rep").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = labelled.groupBy("label").agg(F.min(F.struct("rep.none", "rep.doc_id", "class")).alias("smallest"))
    return labelled.join(smallest, "label").select("class", "smallest")


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id it is linked with, over any number of links)."""
    scanned, classes, links = similar_classes(docs, size, percent)
    by_class = labelled_classes(classes, links).select("class", F.col("smallest.doc_id").alias("component"), F.lit(True).alias("known"))
    every = scanned.select("doc_id", "class", F.col("n").alias("n_shingles")).join(by_class, "class", "left")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("doc_id"))
    return every.select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay: of each component one row, that of the smallest doc_id (a null one last; of
    several texts with that doc_id the first by class, of rows with the same words that with the smallest
    text), and every document without shingles."""
    scanned, classes, links = similar_classes(docs, size, percent)
    first = labelled_classes(classes, links).select("smallest").distinct()
    ties = scanned.filter("n > 0").groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("ties"))
    kept = first.select(F.col("smallest.doc_id").alias("doc_k"), F.col("smallest.class").alias("class_k"))
    alike = F.col("doc_k").eqNullSafe(F.col("doc_id")) & (F.col("class_k") == F.col("class"))
    kept = kept.join(ties, alike).select("doc_k", "class_k", "ties")
    empty = scanned.filter("n = 0").select(F.col("doc_id").alias("doc_k"), F.col("class").alias("class_k"), F.lit(1).cast("bigint").alias("ties"))
    stay = stored(kept.unionByName(empty.distinct()), "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = once(packed(docs, doc=F.col("doc_id"), text=text), **{"class": class_column(F.col("text"), lower=True)})
    found = marked.join(stay, F.col("doc").eqNullSafe(F.col("doc_k")) & (F.col("class") == F.col("class_k")))
    tied = found.filter("ties > 1").groupBy("doc", "class").agg(F.min_by("given", "text").alias("given"))
    return found.filter("ties = 1").select("given").unionByName(tied.select("given")).select("given.*")
