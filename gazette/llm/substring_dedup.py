"""Substring de-duplication: prefix-partitioned suffix trees over the words of all documents.

A window is `WINDOW` neighbouring words of one document; if its words also start anywhere else, all its
words go. Windows are the beginnings of suffixes; two equal ones are leaves under one node of depth
`WINDOW` or more in the suffix tree of all texts. That tree is built in parts, one per prefix:

* Anchors. Of the `PREFIX`-word runs inside a window the one with the smallest hash is its anchor. Equal
  windows have equal anchors at the same place, and neighbouring windows mostly share one, so about one
  position in twelve is an anchor. Runs that occur once in the corpus cannot lie in a repeat.
* Stretches. An anchor's windows overlap and travel as one stretch of words. Equal stretches are
  combined ahead of the shuffle, with their number.
* Prefixes of variable length. A group of suffixes is named by words that all its windows hold: first
  the anchor. Where more than `GROUP` different stretches share the name, it is lengthened: the windows of a stretch are
  dealt into halves by the anchor's place in them, and a half's windows have more words in common (`width`
  windows in a row share `WINDOW - width + 1` words). This goes on until the group fits, at the latest
  when the name is the whole window; then it is one node, whose leaves need only be counted.
* Subtrees. A group's suffixes are sorted. Neighbours that agree down to the window's depth stand under a deep
  internal node; the common prefixes of neighbours give all such nodes, and those whose leaves differ in the
  word before are maximal repeats. Their word ranges go back to the stretches, one row per stretch.

Copies. Documents with the same words form a class, named by the SHA-256 of the words. Only one member of
a class takes part in the search; of a class with two members or more every window occurs elsewhere.

Defined cases: null, empty and blank texts have no words; texts shorter than a window lose nothing;
repeated rows are documents of their own and so copies; no rows, no result. Other columns pass through
`without_repeats`, whatever their names, and are not looked at. In trees windows are compared word for word; equal
stretches, and whole windows as names, are combined by 128 and 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import packed, stored, texts
from gazette.llm.words import WordHashes, run_hashes, words_of

#: `GROUP`: different stretches of a subtree, a few hundred KB of words.
WINDOW, PREFIX, GROUP = 35, 12, 1024


def class_of(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def anchors_of(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the anchors of a document, the first window of each, and the anchor's place in that window."""
    runs = run_hashes(hashes, prefix)
    span = window - prefix + 1
    if len(runs) < span:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
    at = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(runs) - span + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return runs[at[first]].view(np.int64), first.astype(np.int32), (at[first] - first).astype(np.int32)


def scan(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, class, n_words, and the anchors: keys, first windows, places in them."""
    slim = texts(docs, "doc_id")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            classes, sizes, keys, first, lead = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                classes.append(class_of(words))
                sizes.append(len(words))
                found = anchors_of(hashes.of(words), window, prefix) if len(words) >= window else ([], [], [])
                for held, value in zip((keys, first, lead), found, strict=True):
                    held.append(value)
            columns = [pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(x, pa.list_(pa.int32())) for x in (first, lead)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "class", "n_words", "keys", "first", "lead"])

    return slim.mapInArrow(run, f"doc_id {kind}, class binary, n_words bigint, keys array<bigint>, first array<int>, lead array<int>")


def class_texts(docs: DataFrame, wanted: DataFrame, lower: bool = False) -> DataFrame:
    """One text for each row of `wanted` (id, class, doc and others): that of document `doc`.

    A doc_id may stand for several texts, so the class is compared; documents without doc_id are found
    by their class. The filter on `id` lets Spark keep other documents out of the shuffle.
    """
    names, slim = wanted.columns, texts(docs, "doc_id")
    found = slim.join(wanted.filter("id >= 0"), F.col("doc_id") == F.col("doc")).select(*names, "text")
    nameless = wanted.filter("doc IS NULL")
    if nameless.limit(1).count():
        classed = slim.filter("doc_id IS NULL").select("text", class_column(F.col("text"), lower).alias("named"))
        found = found.unionByName(classed.join(nameless, F.col("named") == F.col("class")).select(*names, "text"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("class").to_pylist(), strict=True)
            yield batch.filter(pa.array([class_of(words_of(t, lower)) == c for t, c in pairs], pa.bool_()))

    kept = found.mapInArrow(same, found.schema)
    return kept.groupBy("id").agg(*[F.first(c).alias(c) for c in [*names, "text"] if c != "id"])


def class_column(text: Column, lower: bool = False) -> Column:
    """`class_of` the words of a text, as a column."""
    if lower:
        text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.sha2(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" ")), 256))


def stretches(work: DataFrame, window: int) -> DataFrame:
    """The words of each anchor's windows: s, t (128 bits of hash), key, members, id, first, lead, windows, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                words, anchors = words_of(x["text"]), x["anchors"]
                parts = [b" ".join(words[a["first"] : a["first"] + a["windows"] + window - 1]) for a in anchors]
                names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
                columns = [pa.array(names[:, i].copy()) for i in (0, 1)]
                columns += [pa.array([a[c] for a in anchors], k) for c, k in (("key", pa.int64()), ("members", pa.int64()))]
                columns += [pa.array([x["id"]] * len(anchors), pa.int64())]
                columns += [pa.array([a[c] for a in anchors], pa.int32()) for c in ("first", "lead", "windows")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names=["s", "t", "key", "members", "id", "first", "lead", "windows", "words"])

    schema = "s bigint, t bigint, key bigint, members bigint, id bigint, first int, lead int, windows int, words binary"
    return work.select("id", "text", "anchors").mapInArrow(run, schema)


Member = tuple[int, int, int, int, int, bytes]  # s, t, times, low (the first window in its stretch), windows, words


def deep_nodes(members: list[Member], window: int) -> Iterator[list[tuple[int, int]]]:
    """Leaves (member, window) under each node of depth `window`: neighbours of the sorted suffixes that agree so far."""
    suffixes: list[tuple[bytes, int, int]] = []
    for i, (*_, windows, words) in enumerate(members):
        ends = list(accumulate(len(w) + 1 for w in words.split(b" ")))
        starts = [0, *ends[: windows - 1]]
        suffixes += [(words[starts[j] : ends[j + window - 1] - 1], i, j) for j in range(windows)]
    suffixes.sort()
    held: list[tuple[int, int]] = []
    last = None
    for text, i, j in suffixes:
        if text != last:
            if len(held) > 1:
                yield held
            held, last = [], text
        held.append((i, j))
    if len(held) > 1:
        yield held


def shared_words(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def maximal_repeats(members: list[Member], window: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Depth and leaves of the internal nodes at `window` words or deeper whose leaves differ in the word before.

    The leaves of a node of depth `window` are sorted by what follows; the intervals of common prefixes are
    the nodes below. A leaf at the start of its member has no word before, so differs from any. A member that
    stands for several equal stretches is a repeat by itself, over all its words.
    """
    for i, (_, _, times, _, windows, _) in enumerate(members):
        if times > 1:
            yield windows + window - 1, [(i, 0)]
    if len(members) < 2 and members[0][4] < 2:
        return
    split: dict[int, list[bytes]] = {}
    for leaves in deep_nodes(members, window):
        for i, _ in leaves:
            if i not in split:
                split[i] = members[i][5].split(b" ")
        leaves.sort(key=lambda leaf: split[leaf[0]][leaf[1] + window :])
        rest = [split[i][j + window :] for i, j in leaves]
        before = [split[i][j - 1] if j else None for i, j in leaves]
        # Open intervals: depth, first leaf, the word before all leaves (False once they differ).
        open_: list[list] = []
        for k in range(len(leaves)):
            depth = shared_words(rest[k], rest[k + 1]) if k + 1 < len(leaves) else -1
            start, word = k, before[k] if before[k] is not None else False
            while open_ and open_[-1][0] > depth:
                found, first, left = open_.pop()
                left = left if left == word else False
                if left is False:
                    yield window + found, leaves[first : k + 1]
                start, word = first, left
            if open_ and open_[-1][0] == depth:
                open_[-1][2] = open_[-1][2] if open_[-1][2] == word else False
            elif depth >= 0:
                open_.append([depth, start, word])


def repeated_ranges(members: list[Member], window: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """s, t and the word ranges, within the stretch, that the maximal repeats of a group cover."""
    deepest: dict[tuple[int, int], int] = {}
    for depth, leaves in maximal_repeats(members, window):
        for leaf in leaves:
            deepest[leaf] = max(deepest.get(leaf, 0), depth)
    by_member: dict[int, list[tuple[int, int]]] = {}
    for (i, j), depth in deepest.items():
        by_member.setdefault(i, []).append((j, j + depth))
    for i, found in by_member.items():
        s, t, _, low, *_ = members[i]
        yield s, t, [(low + a, low + b) for a, b in merged(found)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start: int, end: int>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
MEMBER = ["key", "s", "t", "times", "low", "windows", "words"]


def subtrees(groups: DataFrame, window: int) -> DataFrame:
    """s, t, spans: the word ranges of repeats within stretches. Groups stand together in sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            found: list[tuple[int, int, list]] = []
            for k, *member in zip(*[batch.column(c).to_pylist() for c in MEMBER], strict=True):
                if k != key:
                    if members:
                        found += repeated_ranges(members, window)
                    key, members = k, []
                members.append(tuple(member))
            yield rows(found)
        if members:
            yield rows(list(repeated_ranges(members, window)))

    def rows(found: list[tuple[int, int, list]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        spans = [[{"start": a, "end": b} for a, b in x] for x in columns[2]]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(spans, SPANS_ARROW)], names=["s", "t", "spans"]
        )

    even = groups.select(*MEMBER).repartition("key").sortWithinPartitions("key")
    return even.mapInArrow(run, f"s bigint, t bigint, spans {SPANS}")


def lengthened(groups: DataFrame, width: int, window: int, prefix: int) -> DataFrame:
    """Members dealt anew: the windows of a stretch whose anchor lies in the same `width` places, named by the words they all hold."""
    places = window - prefix + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                words, ends = x["words"].split(b" "), x["lead"] - x["low"]  # the anchor's place in the first window here
                kinds = sorted({(ends - j) // width for j in range(x["windows"])})
                for kind in kinds:
                    least, most = kind * width, min((kind + 1) * width, places)  # the anchor's places, `most` left out
                    first, stop = max(0, ends - most + 1), min(x["windows"], ends - least + 1)
                    name = b" ".join(words[ends - least : ends - most + 1 + window])
                    key = xxhash.xxh3_64_intdigest(name, seed=kind * places + width) - (1 << 63)
                    part = b" ".join(words[first : stop + window - 1])
                    out.append((key, x["s"], x["t"], x["times"], x["low"] + first, stop - first, part, x["lead"]))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds_ = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], names=[*MEMBER, "lead"])

    schema = "key bigint, s bigint, t bigint, times bigint, low int, windows int, words binary, lead int"
    return groups.select(*MEMBER, "lead").mapInArrow(run, schema)


def one_node(groups: DataFrame, window: int) -> DataFrame:
    """The same as `subtrees` where the name is the whole window: all leaves are under one node."""
    often = groups.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key")
    span = F.array(F.struct(F.col("low").alias("start"), (F.col("low") + window).cast("int").alias("end")))
    return groups.join(stored(often, "often"), "key", "left_semi").select("s", "t", span.alias("spans"))


def all_subtrees(different: DataFrame, hot: bool, window: int, prefix: int, group: int) -> DataFrame:
    """s, t, spans: one row per stretch with repeats. `hot`: a name may be shared by more stretches than fit."""
    now = different.withColumn("low", F.lit(0))
    if not hot:
        return subtrees(now, window)
    width, found = window - prefix + 1, []
    while True:
        now = stored(now, "members")
        full = stored(now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("key"), "full")
        if full.limit(1).count() == 0:
            found.append(subtrees(now, window))
            break
        found.append(subtrees(now.join(full, "key", "left_anti"), window))
        rest = now.join(full, "key", "left_semi")
        if width == 1:
            found.append(one_node(rest, window))
            break
        width = -(-width // 2)
        now = lengthened(rest, width, window, prefix)
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    return parts.groupBy("s", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeats(scanned: DataFrame, docs: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """class, kept, n_removed: for every class in which something goes, what stays of its words.

    `scanned` is the stored result of `scan`.
    """
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one")
    classes = stored(
        scanned.groupBy("class")
        .agg(F.count(F.lit(1)).alias("copies"), one, F.first("n_words").alias("n_words"), F.first(F.struct("keys", "first", "lead")).alias("x"))
        .select(F.monotonically_increasing_id().alias("id"), "class", "one.doc_id", "copies", "n_words", "x.keys", "x.first", "x.lead"),
        "classes",
    )
    each = classes.select("id", "n_words", "keys", "first", "lead", F.posexplode("keys").alias("place", "key"))
    here = F.element_at("first", F.col("place") + 1)
    after = F.when(F.col("place") + 1 < F.size("first"), F.element_at("first", F.least(F.col("place") + 2, F.size("first"))))
    windows = (F.coalesce(after, F.col("n_words") - window + 1) - here).cast("int")
    anchors = each.select("id", "key", here.alias("first"), windows.alias("windows"), F.element_at("lead", F.col("place") + 1).alias("lead"))
    shared = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    found = anchors.join(stored(shared, "shared"), "key")  # stored first: a hot key's rows can then be split
    by_class = found.groupBy("id").agg(F.collect_list(F.struct("key", "first", "lead", "windows", "members")).alias("anchors"))
    alone = classes.filter(f"copies = 1 OR n_words < {window}").select("id")
    # Copies lose everything whatever the trees say, but their windows count as occurrences for others.
    wanted = by_class.join(classes.select("id", "class", F.col("doc_id").alias("doc")), "id")
    work = stored(class_texts(docs, stored(wanted, "wanted")).drop("doc"), "texts")
    occurring = stored(stretches(work, window), "stretches")
    pick = ["key", "lead", "windows", "words"]
    different = occurring.groupBy("s", "t").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in pick])
    hot = occurring.filter(F.col("members") > group).limit(1).count() > 0
    found = stored(all_subtrees(different, hot, window, prefix, group), "found")
    # One row of `found` per stretch: the join gives at most one row per occurrence.
    here = occurring.select("s", "t", "id", "first").join(found, ["s", "t"])
    place = F.transform("spans", lambda x: F.struct((F.col("first") + x["start"]).alias("start"), (F.col("first") + x["end"]).alias("end")))
    spans = here.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list(place))).alias("spans"))
    cut = cut_texts(work.select("id", "class", "text").join(spans.join(alone, "id", "left_semi"), "id"))
    copied = classes.filter(f"copies > 1 AND n_words >= {window}")
    return cut.unionByName(copied.select("class", F.lit("").alias("kept"), F.col("n_words").alias("n_removed")))


def cut_texts(rows: DataFrame) -> DataFrame:
    """class, kept, n_removed: the words outside the spans, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, out, at = words_of(text), [], 0
                for span in spans:
                    out += words[at : span["start"]]
                    at = max(at, span["end"])
                out += words[at:]
                kept.append(b" ".join(out).decode())
                removed.append(len(words) - len(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=["class", "kept", "n_removed"]
            )

    return rows.select("class", "text", "spans").mapInArrow(run, "class binary, kept string, n_removed bigint")


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept (null if nothing was removed) and kept_sha256 of every row."""
    scanned = stored(scan(docs, window, prefix), "scanned")
    gone = stored(repeats(scanned, docs, window, prefix, group), "repeats")
    digest = F.coalesce(F.sha2("kept", 256), F.lower(F.hex("class")))
    return scanned.select("doc_id", "class", "n_words").join(gone, "class", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "kept", digest.alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """`docs` with repeats cut out of `text`; documents that lose nothing keep their text as it is."""
    scanned = stored(scan(docs, window, prefix), "scanned")
    gone = stored(repeats(scanned, docs, window, prefix, group), "repeats").select("class", F.col("kept").alias("rest"))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = packed(docs, **{"class": class_column(text)}).join(gone, "class", "left")
    cut = F.coalesce("rest", F.col("given").getField("text"))
    return joined.select(*[cut.alias(c) if c == "text" else F.col("given").getField(c).alias(c) for c in docs.columns])
