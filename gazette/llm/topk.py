"""Exact top-k search: tiles of queries against shards, a partial selection per tile, a tree of merges.

Components become integers, floor(scale * x); the score is the integer inner product. Vectors are packed,
task by task, into shards of at most `shard_rows` rows (one row per shard, a matrix as bytes); every vector
gets a number of its own there. The queries among them are packed into blocks of at most `block_rows`. A tile
joins one block with one shard: one matrix product, and the `k` best per query stay. Lists of one block
are then merged, `FAN_IN` or so at a time, until one is left.

Products are taken in double precision where every partial sum stays below 2^53, so that they are
whole numbers and exact; beyond that in 64-bit integers, and beyond 2^63 in Python integers, each only for the
pairs concerned. A score outside the range of a long is held at its end, and so is scale * x at the largest double.

Every shard meets every block of queries, by nature of an exact search; the work grows with queries
times vectors and is spread over tiles. Nothing is broadcast: a tile holds one block and one shard.

Defined cases: vectors that are null or hold null or non-finite components, or whose vec_id is null, take
no part; neither side compares vectors of different lengths; an empty vector has score 0 with others.
A query never meets its own row, but other rows of its vec_id as well as any; every row that is a query is
asked, also where rows repeat. Ties go to the smaller vec_id. Fewer than k candidates: all of them. No rows,
no result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import slices, stored

SHARD_ROWS, BLOCK_ROWS, FAN_IN = 8192, 1024, 8
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**63

LISTS = "dim int, block string, shard string, ids binary, found binary"
PACKED_SCHEMA = pa.schema(
    [("dim", pa.int32()), ("part", pa.string()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("asked", pa.binary()), ("cells", pa.binary())]
)
PACKED = "dim int, part string, n int, ids binary, rows binary, asked binary, cells binary"
#: What a task packs: ids, own numbers, whether a query, integer components.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def integers(matrix: np.ndarray, scale: int) -> np.ndarray:
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix.astype(np.float64) * scale), -most, most)


def place_of_task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def packer(size: int, given: Iterator[tuple[int, Rows]]) -> Iterator[pa.RecordBatch]:
    """(dimension, rows) put together to matrices of at most `size` rows, by dimension."""
    held: dict[int, list[Rows]] = {}
    made = 0

    def flush(dim: int) -> pa.RecordBatch:
        nonlocal made
        ids, rows, asked, cells = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        made += 1
        values = [dim, f"{place_of_task()}-{made}", len(ids), *[x.tobytes() for x in (ids, rows, asked, cells.astype("<f8"))]]
        return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(PACKED_SCHEMA, values, strict=True)}, schema=PACKED_SCHEMA)

    for dim, rows in given:
        for part in slices(len(rows[0]), size):
            if dim in held and sum(len(x[0]) for x in held[dim]) + part.stop - part.start > size:
                yield flush(dim)
            held.setdefault(dim, []).append(tuple(x[part] for x in rows))
    for dim in list(held):
        yield flush(dim)


def pack(size: int, scale: int):
    """Vectors of a task in shards; each vector gets a number of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Rows]]:
        number = place_of_task() << 40
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
            asked = batch.column("asked").to_numpy(zero_copy_only=False).astype(bool)
            rows = np.arange(number, number + len(ids), dtype="<i8")
            number += len(ids)
            vectors = batch.column("embedding")
            ends = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(ends)[:-1]])
            for dim in np.unique(ends).tolist():
                mine = np.flatnonzero(ends == dim)
                cells = integers(flat[starts[mine][:, None] + np.arange(dim)], scale).reshape(len(mine), dim)
                yield dim, (ids[mine], rows[mine], asked[mine], cells)

    return lambda batches: packer(size, read(batches))


def unpacked(x: dict, prefix: str = "") -> Rows:
    ids, rows = (np.frombuffer(x[prefix + c], "<i8") for c in ("ids", "rows"))
    cells = np.frombuffer(x[prefix + "cells"], "<f8").reshape(len(ids), x["dim"])
    return ids, rows, np.frombuffer(x[prefix + "asked"], bool), cells


def pack_queries(size: int):
    """The queries of shards in blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Rows]]:
        for batch in batches:
            for x in batch.to_pylist():
                rows = unpacked(x)
                if rows[2].any():
                    yield x["dim"], tuple(c[rows[2]] for c in rows)

    return lambda batches: packer(size, read(batches))


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of a long."""
    top = lambda m: np.abs(m).max(axis=1, initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.multiply.outer(top(queries), top(shard)) * max(1, shard.shape[1])  # of any partial sum
        plain = queries @ shard.T
    out = np.where(bound < EXACT_DOUBLE, plain, 0.0).astype(np.int64)
    middle = (bound >= EXACT_DOUBLE) & (bound < EXACT_LONG)
    if middle.any():
        q, s = np.flatnonzero(middle.any(axis=1)), np.flatnonzero(middle.any(axis=0))
        whole = lambda m: np.clip(m, -EXACT_LONG / 2, EXACT_LONG / 2).astype(np.int64)
        found = whole(queries[q]) @ whole(shard[s]).T
        out[np.ix_(q, s)] = np.where(middle[np.ix_(q, s)], found, out[np.ix_(q, s)])
    ends = np.iinfo(np.int64)
    for i, j in zip(*np.nonzero(bound >= EXACT_LONG), strict=True):
        exact = sum(int(a) * int(b) for a, b in zip(queries[i], shard[j], strict=True))
        out[i, j] = min(max(exact, ends.min), ends.max)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query, ties to the smaller id."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores >= limit)
        scores, ids = scores[chosen], ids[chosen]
    order = np.lexsort((ids, ~scores))[:k]  # ~x = -x - 1 turns the order round without overflow
    return scores[order], ids[order]


def search_tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                (_, q_rows, _, queries), (s_ids, s_rows, _, shard) = unpacked(x, "q_"), unpacked(x)
                scores = products(queries, shard)
                found = []
                for i, row in enumerate(q_rows):
                    others = s_rows != row
                    found.append(best(scores[i][others], s_ids[others], k))
                yield list_row(x["dim"], x["block"], x["part"], x["q_ids"], found)

    return run


def list_row(dim: int, block: str, shard: str, ids: bytes, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Per query its number of hits, then scores, then ids, all as longs."""
    sizes = np.array([len(s) for s, _ in found], dtype="<i8")
    data = np.concatenate([sizes, *[s for s, _ in found], *[i for _, i in found]]).astype("<i8").tobytes()
    return pa.RecordBatch.from_pydict({"dim": [dim], "block": [block], "shard": [shard], "ids": [ids], "found": [data]}, schema=LIST_SCHEMA)


LIST_SCHEMA = pa.schema([("dim", pa.int32()), ("block", pa.string()), ("shard", pa.string()), ("ids", pa.binary()), ("found", pa.binary())])


def read_lists(queries: int, data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    flat = np.frombuffer(data, "<i8")
    ends = np.cumsum(flat[:queries])
    total = int(ends[-1]) if queries else 0
    scores, ids = flat[queries : queries + total], flat[queries + total :]
    return [(scores[a:b], ids[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


def merge_lists(k: int):
    """Lists of one block that meet in one group become one list."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        queries = len(rows[0]["ids"]) // 8
        lists = [read_lists(queries, x["found"]) for x in rows]
        merged = [best(np.concatenate([x[i][0] for x in lists]), np.concatenate([x[i][1] for x in lists]), k) for i in range(queries)]
        first = rows[0]
        return pa.Table.from_batches([list_row(first["dim"], first["block"], min(x["shard"] for x in rows), first["ids"], merged)])

    return run


def sound(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best of each query."""
    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    slim = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), asked)
    slim = slim.filter(F.col("vec_id").isNotNull()).filter(sound(F.col("embedding")))
    # Stored once: the numbers of the rows hold for queries and candidates alike.
    shards = stored(slim.mapInArrow(pack(shard_rows, scale), PACKED), "shards")
    blocks = stored(shards.mapInArrow(pack_queries(block_rows), PACKED), "blocks")
    n_shards = shards.count()
    # Tiles: a shard goes to every block of its dimension, under the key of the pair.
    pairs = shards.select("dim", "part").join(blocks.select("dim", F.col("part").alias("block")), "dim")
    sides = [F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "asked", "cells")]
    tiles = pairs.join(shards, ["dim", "part"]).join(blocks.select("dim", F.col("part").alias("block"), *sides), ["dim", "block"])
    lists = stored(tiles.mapInArrow(search_tiles(k), LISTS), "lists")
    while n_shards > 1:
        n_shards = -(-n_shards // FAN_IN)
        group = F.pmod(F.xxhash64("shard"), F.lit(n_shards)).alias("group")
        lists = stored(lists.groupBy("dim", "block", group).applyInArrow(merge_lists(k), LISTS), "lists")
    hits = lists.mapInArrow(unpack, "query_id bigint, rank int, vec_id bigint, score bigint")
    return hits


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            ids = np.frombuffer(x["ids"], "<i8")
            found = read_lists(len(ids), x["found"])
            sizes = np.array([len(s) for s, _ in found], dtype=np.int64)
            if sizes.sum() == 0:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, sizes)),
                    pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)),
                    pa.array(np.concatenate([i for _, i in found])),
                    pa.array(np.concatenate([s for s, _ in found])),
                ],
                names=["query_id", "rank", "vec_id", "score"],
            )
