"""BPE coding and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gazette.llm import bpe, packing
from gazette.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

SF_DIR = "/root/testdata/sf0.001"

ODD = [
    "", " ", "<|endoftext|>x <|startoftext|>", "ΑΣ ΣΑΣ İ ſ K", "a\x1cb\x85c\u00a0d\u2003e", " 's  don't  \n\n x", "zqxjkvbnqqqq" * 300,
    "日本語テキスト", "é e\u0301", "\u0000\x01", "👩‍👩‍👧 ok", "½ ² Ⅷ ٣", "<|ENDOFTEXT|>", "ǅ ß ẞ İİ", "q" * 5000, "x " * 20000,
]


def library(file: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def odd_texts() -> list[str]:
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x1C5, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x10400, 0x1E9E, 0x345]]
    return ODD + ["".join(rng.choices(letters, k=60)) for _ in range(500)]


@pytest.mark.parametrize("file", [WORD_BPE, BYTE_BPE])
def test_codes_as_the_library(file):
    mine, theirs = bpe.Bpe(bpe.tokenizer_file(public_tokenizers.path(file))), library(file)
    for text in odd_texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids
        assert mine.decode(mine.encode(text)) == theirs.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain_and_long_fragments_agree():
    mine = bpe.Bpe(bpe.tokenizer_file(public_tokenizers.path(WORD_BPE)))
    assert any(len(list(mine.fragments(w))) > 1 for w in ("zqxjkvbn", "qqzxjq"))
    rng = random.Random(5)
    for _ in range(200):
        symbols = rng.choices("theandingso", k=rng.randint(1, 40))
        assert mine.merge_short([*symbols]) == mine.merge_long([*symbols])


def test_words_are_remembered_within_a_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    calls = []
    words = bpe.Words(lambda w: calls.append(w) or [len(w)])
    for w in ["a", "b", "c", "d", "a", "e", "f", "g"]:
        assert words[w] == np.uint32(1).tobytes()
    assert len(words) <= 3 and calls.count("a") == 1


def test_query_codes_every_document(spark):
    tokenizer = library(WORD_BPE)
    rows = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, SF_DIR).collect()}
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(given)
    for doc_id, text in given:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        row = rows[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_coding_of_nulls_repeats_and_nothing(docs):
    path = public_tokenizers.path(WORD_BPE)
    given = docs([(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "dog")])
    rows = bpe.decode(bpe.encode(given, path), path).collect()
    assert sorted(((r["doc_id"] or 0), len(r["ids"]) // 4, r["text"]) for r in rows) == [
        (0, 1, "dog</w>"), (1, 0, ""), (2, 0, ""), (3, 2, "the</w> cat</w>"), (3, 2, "the</w> cat</w>"),
    ]
    assert bpe.decode(bpe.encode(docs([]), path), path).count() == 0


def test_places_longest_first_in_the_emptiest_pack():
    assert packing.place({5: 1, 4: 1, 3: 2, 2: 1}, 8) == [(((5, 1), (3, 1)), 1), (((4, 1), (3, 1)), 1), (((2, 1),), 1)]
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        patterns = packing.place(histogram, 64)
        used = defaultdict(int)
        for pattern, n in patterns:
            assert sum(length * copies for length, copies in pattern) <= 64
            for length, copies in pattern:
                used[length] += copies * n
        assert used == histogram


def check_packed(rows, given, capacity=2048):
    """Every id in one piece, pieces gapless in their sequence."""
    tokenizer = library(BYTE_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in given:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            piece = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(piece), len(ids))
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    waste = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        waste += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return waste / total if total else 0


def test_query_packs_every_document(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packed(QUERIES["op2_packing"](spark, SF_DIR).collect(), given) < 0.03


def test_packing_of_nulls_long_texts_and_nothing(docs):
    from pyspark.sql import functions as F

    path, carry = public_tokenizers.path(BYTE_BPE), F.crc32("ids").alias("ids_crc32")
    given = [(1, None), (2, ""), (3, "word " * 9000), (4, "<|endoftext|> a"), (5, "b")]
    check_packed(packing.pack(docs(given), path, carry=carry).collect(), given)
    assert packing.pack(docs([]), path, carry=carry).count() == 0
    twice = packing.pack(docs([(1, "same"), (1, "same")]), path).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_packing_of_white_space_without_end(docs):
    from pyspark.sql import functions as F

    path, carry = public_tokenizers.path(BYTE_BPE), F.crc32("ids").alias("ids_crc32")
    given = [(1, " " * 2_000_000), (2, "a<|endoftext|>é " + "\n" * 1_500_000 + "b<|startoftext|>"), (3, " \t" * 600_000 + " the"), (4, "c")]
    check_packed(packing.pack(docs(given), path, carry=carry).collect(), given)


def test_words_of_the_splitter_as_the_library():
    """The way for texts that tiktoken refuses, on all odd texts."""

    class Refusing(tiktoken.Encoding):
        def encode_to_numpy(self, *args, **kwargs):
            raise ValueError("refused")

    path = public_tokenizers.path(BYTE_BPE)
    shared = SimpleNamespace(value={"file": bpe.tokenizer_file(path), "pattern": bpe.pattern_of(None).pattern})
    encoding, theirs = packing.tokenizer(shared), library(BYTE_BPE)
    encoding.__class__ = Refusing
    for text in odd_texts():
        assert packing.token_ids(encoding, shared.value["pattern"], text).tolist() == theirs.encode(text, add_special_tokens=False).ids
