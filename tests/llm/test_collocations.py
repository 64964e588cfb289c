"""Collocations against brute force over all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from gazette.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, limit=2000, least=10, percent=50):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        held = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            held.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p for t, b in some.items() if len(t) == 3 for p in (t[:2], t[1:]) if p in some and 100 * b >= percent * some[p]}
        scored = []
        for p, a in some.items():
            if p not in dropped:
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], n, s))
        out += [(lang, r, *x[3:]) for r, x in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


def corpus(seed: int, n: int = 300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["New", "york", "City", "é", "a b", "x-y"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice([["new", "York", "city"], ["New", "york"], ["w1", "w2", "w3"], ["w2", "w3"], ["one", "One"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]]))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!? "]) for p in words for w in p)
        rows.append((rng.choice(["en", "en", "de", None, ""]), text))
    return [*rows, ("en", None), ("fr", "only a few words"), (None, "")]


def given(spark, rows):
    return spark.createDataFrame([(i, t, x, "x", "x", 1, "x") for i, (x, t) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n string, a int, theta string")


def found(spark, rows, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(given(spark, rows), **how).collect())


@pytest.mark.parametrize(("limit", "reach"), [(2000, None), (5, 5), (20, 3), (60, 1)])
def test_against_all_phrases(spark, limit, reach):
    """A small reach takes several rounds of the frontier."""
    rows = corpus(limit)
    assert found(spark, rows, limit=limit, reach=reach) == brute(rows, limit)


def test_only_reached_prefixes_are_expanded(spark, monkeypatch):
    seen = []
    bits_of = collocations.bits_of
    monkeypatch.setattr(collocations, "bits_of", lambda phrases, length: seen.append(phrases.count()) or bits_of(phrases, length))
    rows = corpus(3, 600)
    assert found(spark, rows, limit=3, reach=4) == brute(rows, 3)
    words, pairs, *frontier = seen
    assert frontier and frontier[0] < pairs


def test_long_texts_and_small_tables(spark, monkeypatch):
    """Texts in slices, counts sent on early, bits forgotten, and bits that say yes to nearly everything."""
    for name, value in (("SLICE_BYTES", 40), ("HELD", 30), ("MEMORY", 20), ("LEAST_BITS", 1 << 15), ("MOST_BITS", 1 << 15)):
        monkeypatch.setattr(collocations, name, value)
    rows = [("en", " ".join(t or "" for _, t in corpus(8, 200))), ("en", "." * 500 + "z" * 300), *corpus(9, 50)]
    assert found(spark, rows, limit=40) == brute(rows, 40)


def test_exact_scores_and_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [("en", "a b"), (None, None)]) == []
    rows = [("en", "a b, " * 7 + "b c, " * 11 + "a a a a")] * 3
    assert found(spark, rows) == brute(rows)
    big = spark.createDataFrame([(10**14, 10**14 + 7, 10**14 + 9)], "a bigint, l bigint, r bigint")
    a, l, r = big.first()
    assert big.select(collocations.score("a", "l", "r").alias("s")).first()["s"] == 1000000 * a * a // (l * r)
