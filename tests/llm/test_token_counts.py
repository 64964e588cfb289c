"""Token counts against the library, with chunks small enough to be spliced often."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gazette.llm import token_counts
from gazette.llm.queries import PIECE_BPE, QUERIES

PATH = public_tokenizers.path(PIECE_BPE)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def hostile(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    parts = ["the ", "token", "ization ", "  ", "\n\n", "\t", "é", "ß", "中文字", "🙂", "👩‍👩‍👧", "<s>", "</s>", "<unk>", "▁", "́", "\x00", "٣", "x" * 9, "=" * 20, " " * 17, "1234567890", "don't ", "ﬁ①", "<0x41>"]
    out = [None, "", " ", "a", "▁", "\n"]
    for _ in range(60):
        out.append("".join(rng.choices(parts, k=rng.randint(1, 300))))
    out += ["a" * 3000, " " * 5000, "\n" * 2500, "ab" * 1500, "🙂" * 700, "word " * 2000, "中" * 900]
    return out


def library(text: str | None) -> tuple[int, int]:
    return len((text or "").encode()), len(MODEL.encode(text or ""))


@pytest.mark.parametrize(("chunk", "overlap"), [(32, 16), (100, 20), (400, 60), (1 << 15, 1 << 9)])
def test_against_the_library(docs, chunk, overlap):
    rows = list(enumerate(hostile(chunk)))
    found = token_counts.count_tokens(docs(rows), PATH, chunk, overlap)
    assert sorted(tuple(r) for r in found.collect()) == [(i, *library(t)) for i, t in rows]


def test_repeated_rows_and_null_ids(docs):
    long = "some words again and again, " * 60
    rows = [(1, long), (1, long), (None, long), (2, None), (2, "")]
    found = token_counts.count_tokens(docs(rows), PATH, 128, 32)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found.collect()) == sorted((i or 0, library(t)[1]) for i, t in rows)
    assert token_counts.count_tokens(docs([]), PATH).count() == 0


def test_one_huge_text_is_spread_and_right(docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop é中", k=rng.randint(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=200_000))
    given = docs([(1, text)])
    assert [tuple(r) for r in token_counts.count_tokens(given, PATH).collect()] == [(1, *library(text))]


def test_widening_until_neighbours_agree(docs, monkeypatch):
    """A run of blanks longer than any overlap: first no token is shared, then the chunks cover the run."""
    rounds = []
    spliced = token_counts.spliced
    monkeypatch.setattr(token_counts, "spliced", lambda d, s, chunk, overlap: rounds.append(chunk) or spliced(d, s, chunk, overlap))
    text = "start " + " " * 999 + "middle" + "​" * 50 + "z" * 1111 + " end"
    found = token_counts.count_tokens(docs([(1, text)]), PATH, 64, 16)
    assert [tuple(r) for r in found.collect()] == [(1, *library(text))]
    assert len(rounds) > 1


def test_splice_places():
    import numpy as np

    a, b = np.array([5, 7, -1, 9], "<i8"), np.array([-1, 7, 8, 9], "<i8")
    assert token_counts.shared_token(a.tobytes(), b.tobytes()) == (3, 3)
    assert token_counts.shared_token(a[:1].tobytes(), b.tobytes()) is None
    assert token_counts.shared_token(b"", b"") is None


def test_models_that_cannot_be_spliced_are_encoded_whole(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "spliceable", lambda model: False)
    monkeypatch.setattr(token_counts, "spliced", None)
    rows = [(1, "some text " * 50)]
    assert [tuple(r) for r in token_counts.count_tokens(docs(rows), PATH, 64, 16).collect()] == [(1, *library(rows[0][1]))]


def test_query_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op12_token_counts"](spark, sf).collect()
    assert sorted(tuple(r) for r in found) == sorted((i, *library(t), library(t)[1] > 4096) for i, t in given.items())
    assert QUERIES["op12_token_counts"](spark, sf).filter(F.col("over_limit")).count() == sum(r["over_limit"] for r in found)
