"""Recall of the near-duplicate classes by brute force, and how their cost grows with one group of near copies.

    python -m tests.llm.recall_near_duplicates /root/testdata/sf0.1 1
    python -m tests.llm.recall_near_duplicates copies 8000 16000 32000
"""

import random
import sys
import time
from collections import Counter, defaultdict

from corpuslens.llm import minhash_dedup
from tests.llm.conftest import prose


def shingles(text):
    """Five-word shingles, each labelled with how often it came before."""
    words = "".join(c if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127 else " " for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split(" ")
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
    seen = Counter()
    out = set()
    for g in grams:
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def measure(spark, sf_dir, every=20, low=0.5):
    """Pairs of different texts with similarity 0.8 or more, one id of which is divisible by ``every``: how many are in one class.

    Every pair that shares a shingle is compared, frequent shingles too.  ``below`` counts the pairs whose
    similarity is from ``low`` to under 0.8: what the threshold leaves out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is not None]
    of = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    out = Counter()
    for i, (doc, text) in enumerate(rows):
        if doc % every:
            continue
        common = Counter(j for g in sets[i] for j in where[g])
        for j, n in common.items():
            if rows[j][1] == text:
                continue
            similar = n / (len(sets[i]) + len(sets[j]) - n)
            if similar >= 0.8:
                out["pairs"] += 1
                out["found"] += of[doc] == of[rows[j][0]]
            elif similar >= low:
                out["below"] += 1
                out["below_in_one_class"] += of[doc] == of[rows[j][0]]
    return out


def copies(spark, n):
    """Seconds for one group of n copies that differ in a word, and the classes found."""
    rng = random.Random(1)
    base = prose(rng, 150).split()

    def text(i):
        words = list(base)
        words[i % 150] = f"w{i}"
        return " ".join(words)

    df = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string").repartition(8)
    start = time.time()
    found = minhash_dedup.near_duplicates(df).select("class_id").distinct().count()
    return round(time.time() - start, 1), found


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    if sys.argv[1] == "copies":
        copies(session, 100)
        for size in sys.argv[2:]:
            print(size, *copies(session, int(size)), flush=True)
    else:
        print(dict(measure(session, sys.argv[1], *map(int, sys.argv[2:]))))
