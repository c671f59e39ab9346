"""Learned words and best paths against brute force."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpuslens.operators import segment
from corpuslens.plans.query_set import QUERIES

WORDS = ["天地", "人山水", "火木", "金", "土日月星", "云风", "雨雪花"]


def corpus(n=300):
    rng = random.Random(2)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def every_cut(run):
    for marks in itertools.product([False, True], repeat=len(run) - 1):
        out, at = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


def test_lexicon_equals_plain_counts(spark):
    texts = corpus()
    got = {r.word: (r.n, r.cost) for r in segment.learn(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    n = Counter(t[i : i + k] for t in texts for k in range(1, 5) for i in range(len(t) - k + 1))
    total = sum(v for w, v in n.items() if len(w) == 1)
    held = {w for w, v in n.items() if len(w) == 1 or (v >= segment.MIN_COUNT and min(v * total / (n[w[:i]] * n[w[i:]]) for i in range(1, len(w))) >= segment.COHESION)}
    assert set(got) == held
    assert all(v == n[w] and abs(c + math.log(n[w] / total)) < 1e-9 for w, (v, c) in got.items())


def test_best_path_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        run = "".join(rng.choice("天地人山") for _ in range(rng.randint(1, 9)))
        costs = {"".join(p): rng.choice([1.0, 2.0, 2.5, 4.0]) for k in range(1, 4) for p in itertools.product("天地人", repeat=k) if rng.random() < 0.5}
        price = lambda ws: sum(costs.get(w, 14.0 if len(w) == 1 else math.inf) for w in ws)  # noqa: B023, E731
        got = segment.best_path(run, costs, 3, 14.0)
        assert "".join(got) == run and abs(price(got) - min(map(price, every_cut(run)))) < 1e-9


def test_terms_of_mixed_texts(spark):
    lexicon = spark.createDataFrame([("天地", 9, 1.0), ("人", 9, 1.0), ("地人", 9, 5.0), ("天", 9, 3.0)], "word string, n long, cost double")
    rows = spark.createDataFrame([(1, "Java 天地人 和 code_1"), (2, None), (3, ""), (4, "plain")], "i int, text string")
    got = {r.i: sorted(r.w) for r in rows.select("i", segment.terms(lexicon)("text").alias("w")).collect()}
    assert got == {1: sorted(["天地", "人", "和", "java", "code_1"]), 2: [], 3: [], 4: ["plain"]}
    plain = {r.i: sorted(r.w or []) for r in rows.select("i", segment.terms(lexicon, "characters")("text").alias("w")).collect()}
    assert plain[1] == sorted(["天", "地", "人", "和", "java", "code_1"])


def test_postings_hold_all_characters(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["segmented_postings"](spark, sf).groupBy("doc_id").agg(F.sum(F.length("term") * F.col("tf")).alias("n"), F.max(F.length("term")).alias("longest"))
    han = F.length(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{Nd}_]", ""))
    want = {r.doc_id: r.n for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", han.alias("n")).collect() if r.n}
    rows = got.collect()
    assert {r.doc_id: r.n for r in rows} == want and max(r.longest for r in rows) > 1
