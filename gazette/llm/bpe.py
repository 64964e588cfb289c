"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no vocabulary token can never be joined by a merge, so a
word may be cut there for certain. The fragments between cuts are encoded independently, each by the
usual merges (lowest rank first, leftmost of equal ones), and their ids are put together. Only the last
fragment of a word carries the end-of-word mark. Words and fragments repeat, so each worker remembers
those it has seen, up to a bound.

Reads the JSON file of a byte-level BPE tokenizer: vocabulary, merges, end-of-word mark, special tokens,
and of the text rules those that such files use (NFC, lower case, white space, split pattern). The file
is read on the driver and broadcast; its size is checked (`MAX_FILE_BYTES`).

Defined cases: null and empty texts have no tokens and decode to an empty text; a special token's string
inside a text is that token, as in the library; unknown ids decode to nothing. Rows are handled one by
one: repeated rows stay, empty tables give empty ones, other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from gazette.llm.common import texts

MAX_FILE_BYTES = 64 << 20
#: Words a worker remembers: two generations of so many; the older one goes when the newer is full.
MEMORY = 150_000
#: Symbols of a fragment up to which a plain scan for the lowest rank beats a heap.
SHORT = 48

#: What counts as white space in split patterns (Unicode's property of that name).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The split pattern of byte-level tokenizers that name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def pattern_of(text: str | None) -> regex.Pattern:
    """The split pattern with white space spelled out; without one, that of byte-level tokenizers."""
    text = (text or BYTE_LEVEL).replace(r"\S", f"[^{SPACE}]")
    inside = regex.sub(r"\[\^?(?:\\.|[^\]])*\]", lambda m: m[0].replace(r"\s", SPACE), text)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]"))


class Words(dict):
    """Ids of words as bytes (unsigned 32-bit, little-endian), worked out at first sight."""

    def __init__(self, encode_word: Callable[[str], list[int]]):
        self.encode_word, self.older = encode_word, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word) or np.array(self.encode_word(word), dtype="<u4").tobytes()
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Bpe:
    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.joined = self.pairs_inside()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        rules = spec.get("normalizer") or {}
        kinds = {r["type"] for r in rules.get("normalizers", [rules]) if r}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = spec["pre_tokenizer"]
        splits = [s["pattern"]["Regex"] for s in steps.get("pretokenizers", []) if s["type"] == "Split"]
        self.findall = pattern_of(splits[0] if splits else None).findall
        byte = {c: b for b, c in enumerate(self.letters)}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        known = set(self.special.values())
        self.pieces = [n.encode() if i in known else bytes(byte[c] for c in n if c in byte) for i, n in enumerate(self.names)]
        self.words = Words(self.encode_word)

    def pairs_inside(self) -> set[str]:
        """Neighbouring bytes (as letters) that occur inside some token: everywhere else a cut is certain."""
        pairs: set[str] = set()
        for token in self.vocab:
            bare = token.removesuffix(self.end) if self.end else token
            pairs.update(a + b for a, b in zip(bare, bare[1:], strict=False))
        return pairs

    def fragments(self, letters: str) -> Iterator[str]:
        start = 0
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in self.joined:
                yield letters[start:i]
                start = i
        yield letters[start:]

    def encode_word(self, word: str) -> list[int]:
        letters = "".join(map(self.letters.__getitem__, word.encode()))
        parts = list(self.fragments(letters))
        ids: list[int] = []
        for i, part in enumerate(parts):
            ids += self.merge([*part[:-1], part[-1] + self.end] if i == len(parts) - 1 else [*part])
        return ids

    def merge(self, symbols: list[str]) -> list[int]:
        symbols = self.merge_short(symbols) if len(symbols) <= SHORT else self.merge_long(symbols)
        return [self.vocab[s] for s in symbols if s in self.vocab]

    def merge_short(self, symbols: list[str]) -> list[str]:
        """Joins the leftmost pair of the lowest rank until no pair has one."""
        rank, none = self.ranks.get, len(self.ranks)
        left = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while left and (low := min(left)) < none:
            i = left.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del left[i]
            if i < len(left):
                left[i] = rank((symbols[i], symbols[i + 1]), none)
            if i:
                left[i - 1] = rank((symbols[i - 1], symbols[i]), none)
        return symbols

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of (rank, place) over a linked list of symbols."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = pair[0] + pair[1], ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (symbols[a], symbols[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [s for s in symbols if s]

    def normalise(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text

    def encode(self, text: str) -> bytes:
        if not self.special or self.special_pattern.search(text) is None:
            return b"".join(map(self.words.__getitem__, self.findall(self.normalise(text))))
        out, start = [], 0
        for found in self.special_pattern.finditer(text):
            out += map(self.words.__getitem__, self.findall(self.normalise(text[start : found.start()])))
            out.append(np.uint32(self.special[found[0]]).astype("<u4").tobytes())
            start = found.end()
        out += map(self.words.__getitem__, self.findall(self.normalise(text[start:])))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Byte-level decoders give the text back; files without a decoder give the tokens, spaced."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.names):
            numbers = numbers[numbers < len(self.names)]
        if self.byte_decoder:
            return b"".join(map(self.pieces.__getitem__, numbers.tolist())).decode("utf-8", "replace")
        return " ".join(map(self.names.__getitem__, numbers.tolist()))


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} characters")
    return text


def loaded(shared: Broadcast) -> Bpe:
    """The tokenizer of this worker: read once, kept beside the file with the words it has seen."""
    held = shared.value
    if "tokenizer" not in held:
        held["tokenizer"] = Bpe(held["file"])
    return held["tokenizer"]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids: the token ids of each whole text, as bytes (unsigned 32-bit, little-endian)."""
    shared = docs.sparkSession.sparkContext.broadcast({"file": tokenizer_file(path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(shared)
        for batch in batches:
            ids = [tokenizer.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    slim = texts(docs, "doc_id")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast({"file": tokenizer_file(path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(shared)
        for batch in batches:
            texts = [tokenizer.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"]
            )

    slim = encoded.select("doc_id", "ids")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
