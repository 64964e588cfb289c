"""Token counts of a sentencepiece BPE model by overlap resynchronisation.

A document of more than `chunk` characters is cut into chunks that overlap by `overlap` characters; the chunks
are encoded apart, on any executor, and their tokens are put in place by offsets. Where two neighbouring
chunks both hold the same token at the same place, the text is spliced before it: the tokens of the
earlier chunk up to there, those of the later chunk from there.

Why such a place is proven. BPE performs the best merge of all adjacent symbols again and again. A sequence
of tokens is the encoding of a text exactly if every two neighbours are what their own concatenation
encodes to: as long as no merge crosses a boundary, the merges on its two sides run as they would
alone, and whether one ever crosses depends on the two tokens beside it only. Within a chunk all neighbours
are of this kind, since they come from a real encoding; at the splice the neighbours are the last token of
the earlier chunk and the shared token, which stand side by side in the earlier chunk as well. Nothing is
asked of the chunk's edges: the blank that the model puts in front of a chunk, and characters cut
off at its ends, change tokens near them, which then are not shared.

Where two chunks share no token in their overlap (long runs of one character), the document goes round
again with chunks and overlaps `WIDER` times as long, up to one chunk for the whole document.

Documents up to one chunk are encoded as they are, where they are read. Longer ones are stored once; their chunks
are dealt out by document and number, so a single huge document is spread over all tasks. What chunks leave
behind is their number of tokens and the tokens of their two overlaps.

The proof holds for BPE models that take characters as they are, with bytes for unknown ones; `spliceable` reads
this off the model. Other models are encoded whole.

Defined cases: null and empty texts have no bytes and no tokens; special strings inside texts are plain
text, as in the library; repeated rows, also with one doc_id, each have their row; a null doc_id stays null.
No rows, no result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import BATCH_BYTES, slices, stored, texts

CHUNK, OVERLAP, WIDER = 1 << 15, 1 << 9, 4
MAX_FILE_BYTES = 64 << 20
BPE_MODEL = 2  # the model type of the file's trainer settings


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return data


def spliceable(model: bytes) -> bool:
    """Whether chunks of a text may be encoded apart: a BPE model, characters unchanged, bytes for the rest."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    rules, made = spec.normalizer_spec, spec.trainer_spec
    plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    return made.model_type == BPE_MODEL and made.byte_fallback and plain and not made.treat_whitespace_as_suffix


class Encoder:
    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Characters of a token. Of the bytes of one character the first counts, the others add none.
        self.widths = np.array([self.width(i) for i in range(self.model.vocab_size())], dtype=np.int64)
        # The blank put in front of a text, if the model does so.
        self.lead = int(self.widths[self.model.encode("a", num_threads=1)].sum()) - 1

    def width(self, i: int) -> int:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return int(not 0x80 <= int(piece[1:-1], 16) < 0xC0)
        return len(piece)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1)) if text else 0

    def tokens(self, text: str, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's tokens and the character of the document at which each starts."""
        ids = np.array(self.model.encode(text, num_threads=1), dtype=np.int64)
        widths = self.widths[ids]
        ends = np.cumsum(widths) - self.lead
        if len(ids) and ends[-1] != len(text):
            raise ValueError("the model's tokens do not add up to the text")
        return ids, start + ends - widths


def loaded(shared: Broadcast) -> Encoder:
    """The encoder of this worker, made once."""
    held = shared.value
    if "encoder" not in held:
        held["encoder"] = Encoder(held["model"])
    return held["encoder"]


def counted(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, n_bytes, n_tokens of documents that are encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(shared)
        for batch in batches:
            counts = [encoder.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(run, f"doc_id {kind_of(docs)}, n_bytes bigint, n_tokens bigint")


def kind_of(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, i, start, last, text: the chunks of each document."""
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = max(1, -(-(len(text) - overlap) // step))
                for part in slices(n, max(1, BATCH_BYTES // chunk)):
                    places = range(part.start, part.stop)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(places), pa.int64()),
                            pa.array(places, pa.int64()),
                            pa.array([i + 1 == n for i in places], pa.bool_()),
                            pa.array([text[i * step : i * step + chunk] for i in places], pa.string()),
                        ],
                        names=["row", "i", "last", "text"],
                    )

    return docs.select("row", "text").mapInArrow(run, "row bigint, i bigint, last boolean, text string")


def summaries(chunks: DataFrame, shared: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """row, i, last, n (tokens) and those that start in the overlaps before and behind: places, and number of the first."""
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(shared)
        for batch in batches:
            found: list[list] = [[] for _ in range(5)]
            for i, text in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, starts = encoder.tokens(text, i * step)
                keys = np.where(encoder.widths[ids] > 0, starts << 24 | ids, -1)  # bytes inside a character share no place
                head = int(np.searchsorted(starts, i * step + overlap))
                tail = int(np.searchsorted(starts, (i + 1) * step))
                for held, value in zip(found, (len(ids), keys[:head].tobytes(), keys[tail:].tobytes(), tail, 0), strict=True):
                    held.append(value)
            columns = [batch.column(c) for c in ("row", "i", "last")]
            columns += [pa.array(found[k], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "i", "last", "n", "head", "tail", "before"])

    return chunks.mapInArrow(run, "row bigint, i bigint, last boolean, n bigint, head binary, tail binary, before bigint")


def shared_token(tail: bytes, head: bytes) -> tuple[int, int] | None:
    """Places of the middle one of the tokens that stand in both overlaps."""
    a, b = np.frombuffer(tail, "<i8"), np.frombuffer(head, "<i8")
    both = np.intersect1d(a[a >= 0], b[b >= 0])
    if not len(both):
        return None
    key = both[len(both) // 2]
    return int(np.flatnonzero(a == key)[0]), int(np.flatnonzero(b == key)[0])


def joints(chunks: DataFrame) -> DataFrame:
    """row, extra (tokens that two neighbours count too many; null where they share none) of each splice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = []
            for x in batch.to_pylist():
                found = shared_token(x["tail"], x["head"])
                extra.append(None if found is None else x["n"] - (x["before"] + found[0]) + found[1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(extra, pa.int64())], names=["row", "extra"])

    later = chunks.select("row", (F.col("i") - 1).alias("i"), "head")
    pairs = chunks.filter("NOT last").select("row", "i", "n", "tail", "before").join(later, ["row", "i"])
    return pairs.select("row", "n", "tail", "before", "head").mapInArrow(run, "row bigint, extra bigint")


def spliced(docs: DataFrame, shared: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """row and n_tokens; null where some neighbours share no token."""
    dealt = cut(docs, chunk, overlap).repartition("row", "i")
    chunks = stored(summaries(dealt, shared, chunk, overlap), "chunks")
    counts = chunks.groupBy("row").agg(F.sum("n").alias("n"))
    splices = joints(chunks).groupBy("row").agg(F.sum("extra").alias("extra"), F.bool_or(F.col("extra").isNull()).alias("lost"))
    joined = counts.join(splices, "row", "left")
    return joined.select("row", F.when(~F.coalesce("lost", F.lit(False)), F.col("n") - F.coalesce("extra", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text."""
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("an overlap is at most half a chunk")
    model = model_bytes(path)
    shared = docs.sparkSession.sparkContext.broadcast({"model": model})
    slim = texts(docs, "doc_id").withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    if not spliceable(model):
        return counted(slim, shared)
    huge = F.char_length("text") > chunk
    rows = slim.filter(huge).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
    rows = stored(rows, "huge-texts")
    found, left = [], rows
    while left.limit(1).count():
        made = stored(spliced(left, shared, chunk, overlap), "spliced")
        found.append(made.filter("n_tokens IS NOT NULL"))
        left = rows.join(made.filter("n_tokens IS NULL").select("row"), "row", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = counted(slim.filter(~huge), shared)
    for made in found:
        out = out.unionByName(rows.join(made, "row").select("doc_id", "n_bytes", "n_tokens"))
    return out
