"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from test_copies import brute_components, words
from test_tokens import check_packed

import corpus_pipeline
from pyspark.sql import functions as F
from gazette.llm import exact_dedup, quality
from gazette.llm.common import prepare
from gazette.llm.queries import quality_model

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    prepare(spark)
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.score(given, quality_model(spark, SF_DIR)).collect()}
    docs = [(r["doc_id"], r["text"]) for r in given.collect() if score[r["doc_id"]] >= 0.5]
    best: dict[str, tuple[int, int]] = {}
    for i, t in docs:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        best[norm] = min(best.get(norm, (1, 0)), (-len(t or ""), i))
    kept = {i for _, i in best.values()}
    docs = [(i, t) for i, t in docs if i in kept]
    stay = {i for i, _, c in brute_components(docs, 5, 80) if i == c}
    docs = [(i, t) for i, t in docs if i in stay]
    starts = Counter(tuple(w[p : p + 35]) for _, t in docs for w in [words(t)] for p in range(len(w) - 34))
    cut = []
    for i, t in docs:
        w = words(t)
        gone = {q for p in range(len(w) - 34) if starts[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        cut.append((i, " ".join(x for q, x in enumerate(w) if q not in gone) if gone else t))
    check_packed(rows, cut)


def test_stages_keep_the_columns_and_odd_rows(spark, tmp_path):
    prepare(spark)
    odd = spark.createDataFrame(
        [(1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "some words here", "en", "s", 15), (3, "x " * 3000, "en", "s", 6000)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for empty in (False, True):
        docs = odd.limit(0) if empty else odd
        for k, (_, work) in enumerate(corpus_pipeline.STAGES):
            out = work(spark, docs, SF_DIR)
            path = f"{tmp_path}/{empty}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == odd.columns
        assert (docs.count() == 0) == empty


def test_stages_leave_other_results_alone_and_take_any_names(spark):
    """A result of another operator is read after the stages have cleared up; a given column bears the score's name."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40).withColumn("score", F.lit("x")).withColumn("_score", F.lit("y"))
    other = exact_dedup.exact_dedup(docs)
    good = corpus_pipeline.good_documents(spark, docs, SF_DIR)
    assert good.columns == docs.columns and {(r["score"], r["_score"]) for r in good.collect()} == {("x", "y")}
    corpus_pipeline.distinct_documents(spark, docs, SF_DIR).count()
    corpus_pipeline.distinct_documents(spark, docs, SF_DIR).count()
    assert other.count() == 40


def test_near_stage_takes_five_words_and_four_fifths(docs):
    """Copies with a fifth appended (0.83 at any shingle size), and pairs around the bound, by brute force."""
    rng = random.Random(4)
    rows = []
    for i in range(0, 40, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        more = [f"w{rng.randrange(10**6)}" for _ in range([20, 24, 25, 26, 30][i // 2 % 5])]
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + more))]
    stay = {r["doc_id"] for r in corpus_pipeline.unlike_documents(docs(rows).sparkSession, docs(rows), SF_DIR).collect()}
    assert stay == {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert 1 not in stay and stay != {i for i, _, c in brute_components(rows) if i == c}


def test_five_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
