"""Packing documents into sequences: shortest pack first, over the length histogram.

A document's tokens (with the closing id) are cut into pieces of the capacity and a rest. The histogram
of piece lengths is small: at most one entry per length up to the capacity, whatever the corpus. On it,
lengths are placed longest first; each goes into the emptiest packs that still have room, a pack being a
pattern of lengths with the number of sequences that follow it. The patterns are then joined back to the
pieces: the r-th piece of a length takes the r-th place that the patterns have for that length.

How it is spread: the rank of a piece among those of its length is the number of such pieces in earlier
tasks plus its number within its task, both known without bringing a length together; so a length that a
third of all pieces share is ranked in parallel. Only the histogram (at most `capacity` rows) comes to
the driver; places by length go to the tasks, at most `capacity` squared and in practice a few thousand.

Defined cases: null and empty texts consist of the closing id; repeated rows are documents of their own;
no rows, no sequences; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.bpe import byte_letters, pattern_of, tokenizer_file
from gazette.llm.common import stored, texts

CAPACITY = 2048

#: Lengths of one pack, longest first, each with its number of copies.
Pattern = tuple[tuple[int, int], ...]


def place(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Packing patterns and how many sequences follow each."""
    by_fill: dict[int, dict[Pattern, int]] = defaultdict(dict)

    def put(fill: int, pattern: Pattern, count: int) -> None:
        by_fill[fill][pattern] = by_fill[fill].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min(by_fill, default=capacity)
            if fill + length > capacity:
                put(length, ((length, 1),), left)
                break
            pattern, count = by_fill[fill].popitem()
            taken = min(left, count)
            if count > taken:
                by_fill[fill][pattern] = count - taken
            elif not by_fill[fill]:
                del by_fill[fill]
            *rest, (last, copies) = pattern
            grown = (*rest, (last, copies + 1)) if last == length else (*pattern, (length, 1))
            put(fill + length, grown, taken)
            left -= taken
    return [(p, n) for fill in sorted(by_fill, reverse=True) for p, n in sorted(by_fill[fill].items())]


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length, the places for its pieces in order of rank: rows of first rank, first sequence,
    copies in a sequence, offset of the first copy."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    seen: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length, copies in pattern:
            rows[length].append((seen[length], sequence, copies, offset))
            seen[length] += copies * count
            offset += copies * length
        sequence += count
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def tokenizer(shared: Broadcast) -> tiktoken.Encoding:
    """The worker's encoder, built once from the vocabulary file."""
    held = shared.value
    if "encoding" not in held:
        spec = json.loads(held["file"])
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        merged = [vocab[m.replace(" ", "", 1) if isinstance(m, str) else m[0] + m[1]] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids are not in order of its merges")
        held["encoding"] = tiktoken.Encoding(
            "packing",
            pat_str=held["pattern"],
            mergeable_ranks={bytes(byte[c] for c in token): i for token, i in vocab.items()},
            special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
        )
    return held["encoding"]


def token_ids(encoding: tiktoken.Encoding, pattern: str, text: str) -> np.ndarray:
    """Ids of a whole text. Where tiktoken's splitter gives up (long runs of white space), the text is
    split here and tiktoken merges word by word."""
    try:
        return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:
        special = "|".join(map(regex.escape, sorted(encoding.special_tokens_set, key=len, reverse=True)))
        ids: list[int] = []
        for i, part in enumerate(regex.split(f"({special})", text) if special else [text]):
            if i % 2:
                ids.append(encoding.encode_single_token(part))
            else:
                for word in regex.findall(pattern, part):
                    ids += encoding._encode_single_piece(word)
        return np.array(ids, dtype="<u4")


def pieces(docs: DataFrame, path: str, closing: int, capacity: int) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids of every piece, its task and its number among the pieces
    of its length in that task."""
    shared = docs.sparkSession.sparkContext.broadcast({"file": tokenizer_file(path), "pattern": pattern_of(None).pattern})
    slim = texts(docs, "doc_id")
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, part int, nth bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pattern, context = tokenizer(shared), shared.value["pattern"], TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, starts, lengths, totals, ids, nth = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = token_ids(encoding, pattern, text)
                tokens = np.append(tokens, np.array([closing], dtype="<u4"))
                for start in range(0, len(tokens), capacity):
                    piece = tokens[start : start + capacity]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    totals.append(len(tokens))
                    ids.append(piece.tobytes())
                    nth.append(seen[len(piece)])
                    seen[len(piece)] += 1
            columns = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64())]
            columns += [pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
            doc = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, *columns], names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

    return slim.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, closing: int = 1, capacity: int = CAPACITY, carry: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, `carry` (by default its ids), sequence_id, offset.

    Sequences are gapless; ids of pieces are unsigned 32-bit little-endian.
    """
    whole = stored(pieces(docs, path, closing, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in whole.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = docs.sparkSession.sparkContext.broadcast(places(place(histogram, capacity)))

    counts = whole.groupBy("length", "part").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    carried = F.col("ids") if carry is None else carry
    name = whole.select(carried).columns[0]
    slim = whole.select("doc_id", "start", "length", "doc_tokens", carried, "part", "nth")
    ranked = slim.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "start", "length", "doc_tokens", name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths).tolist():
                mine, table = np.flatnonzero(lengths == length), shared.value[length]
                first, start, copies, base = table[np.searchsorted(table[:, 0], ranks[mine], side="right") - 1].T
                at = ranks[mine] - first
                sequence[mine], offset[mine] = start + at // copies, base + at % copies * length
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["sequence_id bigint", "offset bigint"])
    return ranked.select(*kept, "rank").mapInArrow(run, schema)
