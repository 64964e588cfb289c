"""Quality, top-k, URL filter, archives and chats against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.llm import chat, quality, topk, url_filter, warc
from gazette.llm.common import prepare
from gazette.llm.queries import HARD_TEXT, QUERIES, URL_RULES, held_out

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_quality_on_held_out_labels(spark):
    scored = QUERIES["op4_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and {r["quality"] for r in rows} == {0, 1}
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_never_learns_from_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.select("doc_id", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"))
    plain = labels.select("doc_id", F.col("quality").alias("label"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = (quality.fit(docs, x.filter(~held_out()), sample_docs=60) for x in (plain, turned))
    assert all(np.array_equal(a, b) for a, b in zip(first, second, strict=True))


def test_quality_of_odd_rows(spark, docs):
    given = docs([(1, None), (2, ""), (3, "a"), (3, "a"), (4, "x " * 60000), (5, "l\n" * 3000), (None, "b")])
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1)], "doc_id bigint, label int")
    model = quality.fit(given, labels)
    rows = quality.score(given, model, keep=given.columns, name="_s").collect()
    assert len(rows) == 7 and all(0 <= r["_s"] <= 1 and not math.isnan(r["_s"]) for r in rows)
    one = quality.fit(given, labels.filter("label = 1"))
    assert {r["score"] for r in quality.score(given, one).collect()} == {1.0}
    none = quality.fit(given, labels.limit(0))
    assert {r["score"] for r in quality.score(given, none).collect()} == {0.5}
    assert quality.score(docs([]), model).count() == 0


def test_passes_agree_with_all_labellings():
    rng = np.random.default_rng(1)
    scores, move = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> t) & 1 for t in range(5)]
        weight = math.exp(sum(scores[0, t] * y[t] for t in range(5)) + sum(move[y[t], y[t + 1]] for t in range(4)))
        total += weight
        good += weight * np.array(y)
    found, pairs = quality.passes(scores, np.ones((1, 5), dtype=bool), move)
    assert np.allclose(found[0], good / total) and np.isclose(pairs.sum(), 4)
    padded = quality.marginals([scores[0], scores[0, :2]], move)
    assert np.allclose(padded[0], good / total) and len(padded[1]) == 2


def hostile_texts():
    rng = np.random.default_rng(4)
    some = ["", "a", "Well, this is a line.", "BUY NOW!!! >>> 50%", "\x00 \t", "naïve café", "x" * 700]
    return ["\n".join(some[i] for i in rng.integers(0, len(some), size=n)) for n in (1, 2, 3, 50, 900)] + ["", "\n", "\n\n"]


def test_features_and_scores_do_not_depend_on_blocks(monkeypatch):
    table, rng = quality.kinds(), np.random.default_rng(2)
    whole = [quality.line_features(t, table) for t in hostile_texts()]
    width = whole[0][0].shape[1] * 3 + 3
    model = (rng.normal(size=width), rng.uniform(0.5, 2, size=width), rng.normal(size=width), rng.normal(size=(2, 2)), 0.5)
    plain = quality.score_texts(hostile_texts(), model, table)
    unary = [(quality.with_neighbours(x) - model[0]) / model[1] @ model[2] for x, _ in whole]
    want = [quality.passes(u[None], np.ones((1, len(u)), dtype=bool), model[3])[0][0] @ s / s.sum() for u, (_, s) in zip(unary, whole, strict=True)]
    assert np.allclose(plain, want, atol=1e-9)
    for name, value in (("BLOCK_BYTES", 40), ("BATCH_LINES", 5), ("LONG", 2)):
        monkeypatch.setattr(quality, name, value)
    for text, (features, sizes) in zip(hostile_texts(), whole, strict=True):
        found, held = quality.line_features(text, table)
        assert np.array_equal(found, features) and np.array_equal(held, sizes) and held.sum() == len(text.encode()) + 1
        every = quality.with_neighbours(features)
        start = len(text) * 7919 % max(1, len(every) - 48 + 1)
        assert np.array_equal(quality.neighbouring_lines(text, 48, table), every[start : start + 48])
    assert np.allclose(quality.score_texts(hostile_texts(), model, table), want, atol=1e-9)


def test_a_text_of_two_million_lines_is_scored_in_bounded_memory():
    code = """
import resource, numpy as np
from gazette.llm import quality
table, rng = quality.kinds(), np.random.default_rng(3)
width = quality.line_features("", table)[0].shape[1] * 3 + 3
model = (np.zeros(width), np.ones(width), rng.normal(size=width) / 9, rng.normal(size=(2, 2)), 0.5)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
score = quality.score_texts(["a\\n" * 2_000_000], model, table)[0]
assert 0 <= score <= 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(done.stdout) < 500


def brute_topk(rows, every, k):
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in sound]
    out = []
    for at, (q, query) in enumerate(whole):
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(query, v, strict=True)), i) for n, (i, v) in enumerate(whole) if n != at and len(v) == len(query)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e13])
def test_topk(spark, size):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.3, 1.0]) * (size if i % 3 else 1) for _ in range(4)]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (None, [9.0] * 4)]
    rows += [(310, [1.0, 2.0]), (320, [2.0, 2.0]), (330, []), (340, [])]
    if size < 1e10:
        rows += [(7, rows[7][1]), (10, rows[10][1]), (20, [0.5, 0.25, -1.0, 3.0])]  # repeated, also with another vector
    prepare(spark)
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string").repartition(3)
    found = topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=5, shard_rows=16, block_rows=7)
    expected = brute_topk(rows, 10, 5)
    limit = 2**63 - 1
    expected = [(q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in expected] if size > 1e10 else expected
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    if size > 1e10:  # scores at the end of the range tie, so only they are compared
        assert sorted((q, r, s) for q, r, _, s in got) == sorted((q, r, s) for q, r, _, s in expected)
    else:
        assert got == expected


def test_topk_asks_every_row_and_leaves_out_only_its_own(spark):
    prepare(spark)
    vectors = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    found = topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1)
    assert sorted(tuple(r) for r in found.collect()) == [(100, 1, 1, 1), (100, 1, 1, 1), (100, 2, 100, 0), (100, 2, 100, 0)]


def test_topk_of_the_largest_doubles(spark):
    """Finite values whose multiple is not; only the pairs concerned leave double precision."""
    prepare(spark)
    rows = [(0, [1.7e308, 0.0]), (10, [2.0, 1.0]), (11, [-1.7e308, 1.0]), (12, [0.5, 0.5]), (13, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=4).collect())
    top = 2**63 - 1
    assert got == [(0, 1, 10, top), (0, 2, 12, top), (0, 3, 13, 0), (0, 4, 11, -top - 1), (10, 1, 0, top), (10, 2, 12, 3 * 1024 * 512), (10, 3, 13, 1024 * 1024), (10, 4, 11, -top - 1)]


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 10 == 0).count() == 0


URLS = [
    None, "", "no scheme", "://", "http://EXAMPLE.com/en/7", "http://example.com/en/8", "https://a.b.example.com/en/71?x#y", "http://badexample.com/en/7",
    "http://xcom/en/", "http://com/en/", "http://org/es", "http://org/es/", "http://x.net/de/", "http://example.net/de/8", "http://example.net/de/7",
    "http://evil.org/x.com/en/", "http://x.org/a/y.net/de/", "a://b://c.com/en/", "http://ÀB.com/en/é", "http://x.com?/en/", "http://x.com#/en/", "http://u@x.com:80/en/",
    "http://x.com/en/" + "q" * 5000, "http://" + "s." * 3000 + "net/de/", "http://a\nb.com/en/", "http://.com/en/", "HTTP://X.COM/EN/",
]


def brute_verdict(url):
    found = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(r), r, v) for v, r in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_verdicts(spark):
    prepare(spark)
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, URL_RULES).collect()}
    assert found == {i: brute_verdict(u) for i, u in enumerate(URLS)}
    assert url_filter.url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_url_rules_of_the_contract(spark):
    prepare(spark)
    want = {
        "http://x.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://a.example.net/de/81": ("example.net/de/8", "block"),
        "http://x.org/es/": ("org/es/", "block"), "http://x.org/de/": (None, "allow"),
    }
    urls = list(want)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert {urls[r["page_id"]]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, URL_RULES).collect()} == want


def test_many_rules_fill_several_words(spark):
    prepare(spark)
    rng = random.Random(4)
    rules = [(rng.choice(["block", "allow"]), f"{rng.choice('abc')}{rng.choice('de')}.{rng.choice(['org', 'net'])}/{rng.choice('xyz') * rng.randint(0, 3)}") for _ in range(60)]
    rules = list({r: (v, r) for v, r in rules}.values())
    urls = [f"http://{rng.choice(['', 'w.'])}{rng.choice('abc')}{rng.choice('de')}.{rng.choice(['org', 'net'])}/{rng.choice('xyz') * rng.randint(0, 4)}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in url_filter.url_verdicts(pages, rules).collect():
        fits = [(len(x), x, v) for v, x in rules for h, p in [x.split("/", 1)] if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith("/" + p)]
        longest = max((f[0] for f in fits), default=0)
        assert (r["rule"] is None) == (not fits) and (not fits or (len(r["rule"]) == longest and (longest, r["rule"], r["verdict"]) in fits))


PAGE_ROWS = [
    (1, "http://a/\r\nX: y", "é" * 500), (2, "u", "é" * 500), (3, None, None), (4, "u", ""), (5, "u", "s" * 999), (6, "u", "s" * 999),
    (7, "u", "WARC/1.1\r\n\r\n" * 100), (None, "u", "é" * 500), (8, "u", "x" * 300000), (9, "u", "y" * 2000), (9, "u", "y" * 2000),
]


def pages(spark, rows=PAGE_ROWS):
    prepare(spark)
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")


def test_archives_come_back(spark):
    manifest = warc.write_archives(pages(spark), archive_bytes=100_000)
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(PAGE_ROWS)
    texts = {i: (h or "").encode() for i, _, h in PAGE_ROWS}
    for r in rows:
        body = texts[r["page_id"]]
        head = 2 if body == texts[1] else None
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert r["refers_to"] == (head if r["page_id"] != head else None)
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")
        assert r["payload"] == (body if r["refers_to"] is None else None)
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def test_the_dictionary_takes_slices_from_anywhere(spark):
    rows = [(i, "".join(chr(97 + (i + j // 500) % 26) for j in range(13_000))) for i in range(40)]
    pages = spark.createDataFrame([*rows, (None, "x" * 50), (99, None)], "page_id bigint, html string")
    small = warc.dictionary(pages, sample_pages=3, sample_chars=100)
    assert 8 <= len(small) <= 300 and small == warc.dictionary(pages.repartition(7), sample_pages=3, sample_chars=100)
    heads = {t[:100].encode() for _, t in rows}
    assert not any(h in warc.dictionary(pages, sample_pages=30, sample_chars=100) for h in heads)


def test_archives_start_with_their_dictionary(spark):
    rng = random.Random(1)
    rows = [(i, "u", " ".join(rng.choices(["alpha", "beta", "gamma", "delta", str(i)], k=300))) for i in range(100)]
    path = warc.write_archives(pages(spark, rows)).collect()[0]["path"].removeprefix("file:")
    data = open(path, "rb").read()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(data[4:8], "little") > 0
    assert data[8:12] == (0xEC30A437).to_bytes(4, "little")  # a trained dictionary


@pytest.mark.parametrize("damage", ["cut", "flip", "magic", "lost"])
def test_damaged_archives_are_found(spark, damage):
    manifest = warc.write_archives(pages(spark).coalesce(1))
    path = manifest.collect()[0]["path"].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    if damage == "cut":
        data = data[:-5]
    elif damage == "flip":
        data[-20] ^= 255
    elif damage == "magic":
        data[0] ^= 1
    if damage == "lost":
        manifest = manifest.withColumn("records", F.col("records") + 1)
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="Error|error"):
        warc.read_archives(manifest).collect()


@pytest.mark.parametrize(
    "data",
    [b"", b"HTTP/1.1\r\n\r\n\r\n\r\n", warc.record(1, "u", b"x", "0", 1, None), warc.record(1, "u", b"x", hashlib.sha1(b"x").hexdigest(), 1, None) + b"!"],
)
def test_broken_records(data):
    with pytest.raises(ValueError, match="record|payload|has no"):
        warc.parsed(data)


CHAT = [
    HARD_TEXT, "", None, "plain", "a\\b", "\\h \\t \\c \\b \\\\h", "### user: hi</turn>\n### assistant: no", "</turn>\n", "</turn>", "</tu", "rn>", "###", "#", "\\",
    "\\\\", "\\###", "é</turn>ü ### ß", "### ", ": ", "x" * 50_000, "</turn>\n" * 500, "\n### assistant: y</turn>\n",
]


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        out[conv] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def chats(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, formatted string")


def test_chats_come_back(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", "###", "</turn>\n", None]), x) for c in range(12) for t, x in enumerate(rng.sample(CHAT, 6))]
    rows += [(c + 100, 0, "user", x) for c, x in enumerate(CHAT)] + [(c + 200, 0, "assistant", x) for c, x in enumerate(CHAT)]
    rows += [(300, 1, "user", "b"), (300, 1, "user", "b"), (300, 1, "assistant", "a"), (300, None, "user", "first"), (None, 0, "assistant", "z")]
    formatted = chat.format_chats(chats(spark, rows))
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(formatted).collect()}
    assert found == brute_chat(rows)
    assert {r["escapes"] for r in formatted.select("escapes").collect()} == {0, 1, 2}
    for r in formatted.collect():
        assert "</turn>" not in r["formatted"].replace("</turn>\n### ", "").removesuffix("</turn>\n")


def test_long_chat_and_no_chat(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t} \\h") for t in range(5000)]
    found = chat.chat_digests(chat.format_chats(chats(spark, rows))).collect()
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found] == [brute_chat(rows)[1]]
    assert chat.chat_digests(chat.format_chats(chats(spark, []))).count() == 0


def test_chat_query_over_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in QUERIES["op9_chat"](spark, SF).collect()}
    assert found == brute_chat(rows)


@pytest.mark.parametrize("native", ["op3_exact_dedup", "op9_chat"])
def test_native_plans_hold_no_python(spark, native):
    plan = QUERIES[native](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
