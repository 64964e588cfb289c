"""Exact, near and substring de-duplication against brute force on small hard cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gazette.llm import exact_dedup, ngram_join, substring_dedup
from gazette.llm.components import components

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return SPLIT.findall(text or "")


def hard_texts(seed: int, n: int = 90) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, odd white space, empties and a long text."""
    rng = random.Random(seed)
    vocabulary = [rng.choice("aeiou") + rng.choice("bcdfg") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(400)]
    passage = rng.choices(vocabulary, k=60)
    base = rng.choices(vocabulary, k=150)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\x0b\x0c\r\n"), (3, "one"), (4, "ONE"), (5, "o ne"), (6, "a\x1cb a\u00a0b")]
    for i in range(7, n):
        kind = rng.randrange(6)
        text = rng.choices(vocabulary, k=rng.randint(1, 120))
        if kind == 0:
            text = base[:]
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        elif kind == 1:
            at = rng.randrange(len(text) + 1)
            start = rng.randrange(25)
            text[at:at] = passage[start : start + rng.randint(33, 60)]
        elif kind == 2 and i > 20:
            text = words(rows[rng.randrange(7, i)][1])
            if rng.random() < 0.3:
                text = [w.upper() for w in text]
        elif kind == 3:
            text = text[:20] * rng.randint(1, 5)
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in text)))
    rows.append((n, " ".join(rng.choices(vocabulary, k=9000))))
    rows.append((n + 1, "  ".join(words(rows[-1][1]))))
    return rows


def brute_exact(rows):
    norm = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm[i]].append((-len(t or ""), i))
    best = {k: min(v)[1] for k, v in groups.items()}
    return {(i, best[norm[i]], len(groups[norm[i]]), best[norm[i]] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in rows}


@pytest.mark.parametrize(("size", "weak"), [(8192, False), (64, False), (64, True)])
def test_exact(docs, size, weak):
    rows = hard_texts(1)
    key = (lambda c: F.pmod(F.xxhash64(c), F.lit(7))) if weak else F.xxhash64  # a key that tells little apart
    found = exact_dedup.exact_dedup(docs(rows), size, key)
    assert {tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == brute_exact(rows)


def test_exact_with_repeated_rows_and_null_ids(docs):
    rows = [(5, "a b"), (5, "a b"), (None, "ab"), (7, None), (8, "")]
    found = exact_dedup.exact_dedup(docs(rows))
    kept = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in found.collect())
    assert kept == [(-1, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True), (7, 7, 2, True), (8, 7, 2, False)]
    stay = exact_dedup.kept_rows(docs(rows))
    assert sorted((r["doc_id"], r["text"]) for r in stay.collect()) == [(5, "a b"), (7, None)]
    assert stay.columns == docs(rows).columns
    assert exact_dedup.exact_dedup(docs([])).count() == 0 and exact_dedup.kept_rows(docs([])).count() == 0


def shingle_set(text, size):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, size=4, percent=85):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {(i, len(a), find(i)) for i, a in sets}


@pytest.mark.parametrize("frequent", [32, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_near(docs, monkeypatch, frequent, seed):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = hard_texts(seed, 160)
    assert {tuple(r) for r in ngram_join.jaccard_components(docs(rows)).collect()} == brute_components(rows)


def test_near_around_the_threshold(docs):
    """Chains of texts that are just similar enough, or just not."""
    rng = random.Random(9)
    rows, text = [], [f"w{rng.randrange(10**6)}" for _ in range(100)]
    for i in range(60):
        rows.append((i, " ".join(text)))
        text = text[:]
        for _ in range(rng.choice([1, 2, 2, 3])):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    assert {tuple(r) for r in ngram_join.jaccard_components(docs(rows)).collect()} == brute_components(rows)


def test_near_keeps_one_of_each(docs):
    rows = [(3, "a b c d e"), (2, "A b c d e"), (2, "a b c d e"), (9, ""), (8, None), (7, "x"), (None, "x")]
    stay = ngram_join.one_of_each(docs(rows))
    assert sorted((r["doc_id"], r["text"]) for r in stay.collect() if r["text"]) == [(2, "A b c d e"), (7, "x")]
    assert stay.count() == 4 and stay.columns == docs(rows).columns
    assert ngram_join.one_of_each(docs([])).count() == 0 and ngram_join.jaccard_components(docs([])).count() == 0


def test_overlap_that_is_needed():
    for n in range(1, 60):
        for m in range(1, 60):
            least = next((i for i in range(min(n, m) + 1) if 100 * i >= 85 * (n + m - i)), None)
            need = ngram_join.needed(n, m, 85)
            assert need == least or (least is None and need > min(n, m))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (201, 201)]
    found = {tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)} | {(200, 200), (201, 200)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_substring(rows, window=35):
    starts = Counter(tuple(w[p : p + window]) for _, t in rows for w in [words(t)] for p in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - window + 1) if starts[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [1024, 12, 2])
@pytest.mark.parametrize("seed", [1, 4])
def test_substring(docs, group, seed):
    """With small groups prefixes are lengthened, at two members down to whole windows."""
    rows = hard_texts(seed, 160)
    found = substring_dedup.substring_dedup(docs(rows), group=group)
    assert sorted(tuple(r) for r in found.drop("kept").collect()) == brute_substring(rows)


def test_substring_at_the_edges(docs):
    passage = [f"p{i}" for i in range(36)]
    rows = [
        (1, " ".join(passage[:34])), (2, " ".join(passage[:34] + ["x"])), (3, " ".join(passage[:35])), (4, "a " + " ".join(passage)),
        (5, "z " * 200), (6, "y " * 35), (7, "y " * 36), (8, None), (9, ""), (10, "y " * 35),
    ]
    found = substring_dedup.substring_dedup(docs(rows))
    assert sorted(tuple(r) for r in found.drop("kept").collect()) == brute_substring(rows)
    assert substring_dedup.substring_dedup(docs([])).count() == 0


def test_cut_documents_keep_their_columns(docs):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"Own words\there. {passage}"), (2, f"{passage} Other  words"), (3, "a  b\n c"), (4, None)]
    out = substring_dedup.without_repeats(docs(rows))
    assert out.columns == docs(rows).columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Own words here.", 2: "Other words", 3: "a  b\n c", 4: None}


def brute_maximal(texts, window):
    """Repeats of at least `window` words that no occurrence-keeping word before or behind extends: words -> places."""
    places = defaultdict(set)
    for i, w in enumerate(texts):
        for p in range(len(w)):
            for n in range(window, len(w) - p + 1):
                places[tuple(w[p : p + n])].add((i, p))
    found = {}
    for run, at in places.items():
        after = {texts[i][p + len(run)] if p + len(run) < len(texts[i]) else (i, "end") for i, p in at}
        before = {texts[i][p - 1] if p else (i, "start") for i, p in at}
        if len(at) > 1 and len(after) > 1 and len(before) > 1:
            found[run] = at
    return found


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    texts = [rng.choices("ab" if seed % 2 else "abc", k=rng.randint(4, 14)) for _ in range(rng.randint(1, 9))]
    texts = [list(t) for t in {tuple(t) for t in texts}]
    members = [(i, 0, 1, 0, len(t) - 2, " ".join(t).encode()) for i, t in enumerate(texts) if len(t) >= 3]
    found = {}
    for depth, leaves in substring_dedup.maximal_repeats(members, 3):
        i, j = leaves[0]
        found[tuple(texts[members[i][0]][j : j + depth])] = {(members[a][0], b) for a, b in leaves}
    assert found == brute_maximal(texts, 3)


def test_a_stretch_that_occurs_twice_is_a_repeat():
    assert list(substring_dedup.maximal_repeats([(5, 6, 2, 0, 2, b"a b c d")], 3)) == [(4, [(0, 0)])]
    assert list(substring_dedup.repeated_ranges([(5, 6, 2, 1, 2, b"a b c d")], 3)) == [(5, 6, [(1, 5)])]
    assert list(substring_dedup.maximal_repeats([(5, 6, 1, 0, 1, b"a b c")], 3)) == []


def test_hot_stretches_give_one_row_each(spark, docs):
    """300 texts that share 120 words: findings never outnumber the different stretches."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join([f"a{rng.randrange(10**9)}" for _ in range(20)] + passage + [f"b{rng.randrange(10**9)}" for _ in range(20)])) for i in range(300)]
    scanned = substring_dedup.scan(docs(rows), 35, 12)
    assert scanned.count() == 300
    found = substring_dedup.substring_dedup(docs(rows), group=8)
    assert {(r["n_words"], r["n_removed"]) for r in found.collect()} == {(160, 120)}


CLASH = "doc_id bigint, text string, given string, class string, rest string, key string, ties string, doc string, doc_k string, length string, `a.b` string, _key string, class_ string, kept_ string, _doc string"


@pytest.mark.parametrize("stage", [exact_dedup.kept_rows, ngram_join.one_of_each, substring_dedup.without_repeats])
def test_any_column_names(spark, stage):
    rows = [(i, t, *[str(i)] * 13) for i, t in enumerate(["one text of a few words", "one text of  a few words", None, "another"])]
    given = spark.createDataFrame(rows, CLASH)
    out = stage(given)
    assert out.columns == given.columns
    assert {r["class_"] for r in out.collect()} >= {"3"} and all(r["doc"] == str(r["doc_id"]) for r in out.collect())


def test_results_outlive_other_runs(spark, docs):
    """Tables belong to the run that made them."""
    from gazette.llm.common import owned

    first = exact_dedup.exact_dedup(docs([(1, "a"), (2, "a")]))
    with owned() as tables:
        second = exact_dedup.exact_dedup(docs([(3, "b")]))
        assert second.count() == 1
    assert tables.paths
    tables.remove(spark)
    assert not tables.paths and first.count() == 2


@pytest.mark.parametrize("lower", [False, True])
def test_class_as_a_column(docs, lower):
    texts = ["", "  a  B\tc\x0b\x0c\r\n", "É Ä\u00a0x", "\x1cA \x00b", " "]
    found = docs(list(enumerate(texts))).select("doc_id", substring_dedup.class_column(F.col("text"), lower).alias("c")).collect()
    from gazette.llm.words import words_of

    assert all(bytes(r["c"]) == substring_dedup.class_of(words_of(texts[r["doc_id"]], lower)) for r in found)
