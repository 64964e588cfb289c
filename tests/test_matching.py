from __future__ import annotations

import random

from pyspark.sql import functions as F

from gazette.functions.matching import filter_digest, searchable
from gazette.operators.matching import LISTS, digests_per_set, gathered_digests, issue_elements, keyword_matches
from gazette.schemas import PAYLOAD


def test_every_pair_is_found_and_no_other(spark):
    rnd = random.Random(3)
    letters = "abc中😀 "
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))) for i in range(120)]
    texts += [(1000 + i, "AbcAbc") for i in range(60)]  # a third of all texts are the same
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))) for _ in range(80)} | {"abc", "zzz"}
    items = spark.createDataFrame(texts, "id long, t string")
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = sorted(tuple(r) for r in keyword_matches(keywords, items, "id", "t").collect())
    assert got == sorted((w, i) for w in words for i, t in texts if w in t.lower())


def test_digests_per_set_are_those_of_each_subscriber(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abAB ") for _ in range(rnd.randint(1, 4)))

    def issue(i):
        links = lambda label, n: [{label: word(), "url": rnd.choice(["", "u"])} for _ in range(n)]
        return (
            i,
            {"lines": links("text", rnd.randint(0, 4)), "footer": rnd.choice(["", "Ab", "zz"])},
            {"top3": links("title", rnd.randint(0, 3)), "sections": [{"title": word(), "paragraph": word()} for _ in range(rnd.randint(0, 2))]},
            [{"term": word(), "explain": word()} for _ in range(rnd.randint(0, 2))],
        )

    rows = [issue(i) for i in range(8)] + [(8, {"lines": [], "footer": "ab"}, {"top3": [], "sections": []}, [])]
    shape = PAYLOAD[7:-1].replace("simple:", "simple").replace("normal:", "normal").replace("glossary:", "glossary")
    issues = spark.createDataFrame(rows, "issue_id long, " + shape)
    bodies = issues.select("issue_id", searchable(F.struct("simple", "normal", "glossary")).alias("body"))
    sets = [[], ["a"], ["ab", "ba"], ["aaaa"], ["zz"], ["qq"], ["b a", "zz"]]
    asked = spark.createDataFrame([("\n".join(s), i, s) for s in sets for i in range(9)], "set_key string, issue_id long, keywords array<string>")
    got = {
        (r.set_key, r.issue_id): (r.matched, *[tuple(r[n]) for n in LISTS])
        for r in gathered_digests(digests_per_set(asked, issue_elements(bodies))).collect()
    }
    single = filter_digest(asked.join(bodies.withColumnRenamed("body", "issue"), "issue_id"))
    want = {(r.set_key, r.issue_id): (r.matched, *[tuple(x.text for x in r.digest[n]) for n in LISTS]) for r in single.collect()}
    assert got == want and len(want) == len(sets) * 9
