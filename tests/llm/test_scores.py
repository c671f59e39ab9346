"""Quality rules, toxicity, quality classifier and language identification."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import language_id, models, quality_classifier, quality_rules, sparkutil, toxicity
from corpuslens.llm import textkernel as tk
from tests.llm.conftest import SCHEMA

ID_CRC = "crc32(cast(cast(doc_id AS string) AS binary))"


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_base_counts_equal_brute_force(odd, labels, odd_rows):
    got = quality_rules.score_quality(odd, labels)
    assert got.columns[0] == "doc_id"
    rows = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    assert rows == sorted((repr(r[0]), *brute_base(r[1])) for r in odd_rows)


def test_kept_is_never_true_where_base_failed(odd, labels):
    assert quality_rules.score_quality(odd, labels).filter("base_failed AND kept").count() == 0


def test_quality_rules_held_out(labelled):
    docs, lab = labelled
    held = quality_rules.score_quality(docs, lab).join(lab, "doc_id").filter(f"{ID_CRC} % 5 = 0").collect()
    wrong = sum(r.kept != (r.quality == 1) for r in held)
    assert len(held) > 60 and wrong <= 0.05 * len(held)


def test_toxicity_held_out(labelled):
    docs, lab = labelled
    held = toxicity.score_toxicity(docs, lab).join(lab, "doc_id").filter("held_out").collect()
    assert sum(r.predicted != r.toxic for r in held) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)
    kept = toxicity.filter_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.join(lab, "doc_id").filter("toxic = 1").count() <= 5


def test_quality_classifier_held_out(labelled):
    docs, lab = labelled
    held = quality_classifier.classify_quality(docs, lab).join(lab, "doc_id").filter("held_out").collect()
    assert sum(r.predicted != r.quality for r in held) <= 0.05 * len(held)
    rules = quality_classifier.fit(docs, lab)
    assert 1 <= len(rules.rules) <= 60


def test_rules_compile_to_what_they_say(spark):
    rules = quality_classifier.RuleEnsemble([((("n_words", True, 3.0), ("bars", False, 0.5)), 2.0), ((("n_words", False, 3.0),), -1.0)], 0.25)
    rows = [(4.0, 0.0), (4.0, 1.0), (3.0, 0.0)]
    df = spark.createDataFrame(rows, "n_words double, bars double").select(F.struct("n_words", "bars").alias("s"))
    got = [r.p for r in df.select(rules.column("s").alias("p")).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-z)) for z in (2.25, 0.25, -0.75)])


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred != r.lang for r in held) <= 0.02 * len(held)


def test_every_language_is_learned(spark):
    rows = [(10 * i + j, f"{chr(97 + i) * 4} {chr(98 + i) * 5} text", f"l{i}") for i in range(5) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.fit(docs, rows=20).languages) == {f"l{i}" for i in range(5)}


def test_samples_are_bounded(spark):
    """One id with many rows, null ids, labels that are no class, texts over the bound on bytes."""
    rows = [(1, f"text {i}") for i in range(20_000)] + [(None, "none")] * 50 + [(i, f"own {i}") for i in range(2, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 900)] + [(None, 1, 1)] * 9 + [(3, 2, 5), (5, None, 7), (1, 0, 0)], "doc_id long, quality int, toxic int")
    sample, weight = sparkutil.labelled_sample(docs, labels, "quality", 5, 0, 120)
    got = sample.collect()
    assert sum(r.label == 0 for r in got) == sum(r.label == 1 for r in got) == 120 and set(weight) == {0, 1}
    assert all(2 < w < 4 for w in weight.values())
    few = sparkutil.labelled_sample(docs, labels, "quality", 5, 0, 120, most=200)[0].collect()
    assert 20 < len(few) < 120 and sum(len(r.text) for r in few) <= 400
    assert sparkutil.labelled_sample(docs, labels, "toxic", 5, 0, 120)[0].count() <= 1


def test_hundreds_of_languages(spark):
    rows = [(10 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7) % 26)} " * 5 + str(j), f"l{i}") for i in range(700) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, rows=600).languages) == 700
    same = spark.createDataFrame([(None, "bonjour", "fr")] * 500 + [(None, "hello", "en")], "doc_id long, text string, lang string")
    assert set(language_id.fit(same).languages) == {"fr", "en"}


def test_mislabelled_rows_make_no_centroid(spark):
    rng = np.random.default_rng(5)
    words = {"aa": ["der", "die", "und", "nicht", "schlich", "einung"], "bb": ["the", "and", "with", "thing", "ough", "eath"]}
    rows = []
    for i in range(900):
        lang = "aa" if i % 2 else "bb"
        text = " ".join(rng.choice(words[lang], 12))
        rows.append((i, text, lang if i % 30 else "aa"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in got)


def grams_of(text, k):
    return [text[i : i + k] for i in range(len(text) - k + 1)]


def test_character_grams_are_of_characters():
    import pyarrow as pa

    texts = ["日本語のテキスト", "naïve café", "", "ab", "x" * 9, "ÄÖ", "a😀b😀c"]
    s = next(tk.slices(pa.array(texts)))
    value, off = tk.chars(s, s.buf)
    assert np.diff(off).tolist() == list(map(len, texts))
    for k in (2, 3, 4):
        gram, at = tk.char_grams(value, off, k)
        row = np.searchsorted(off, at, "right") - 1
        assert [int((row == i).sum()) for i in range(len(texts))] == [len(grams_of(t, k)) for t in texts]
        # equal grams, equal hashes, and no others
        names = [g for t in texts for g in grams_of(t, k)]
        assert len(set(names)) == len(set(zip(names, gram.tolist(), strict=True))) == len(set(gram.tolist()))


def test_language_edge_cases(odd):
    got = {(r.doc_id, r.score > 0): r.lang_pred for r in language_id.identify(odd).collect()}
    assert got[(2, False)] == got[(3, False)] == got[(7, False)] == got[(9, False)] == "und"
    assert got[(1, True)] == got[(4, True)] == "en"


@pytest.mark.parametrize("run", [quality_rules.score_quality, toxicity.score_toxicity, quality_classifier.classify_quality])
def test_odd_and_empty_tables(run, odd, none, labels, spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(odd, labels).count() == odd.count()
    assert run(odd, no_labels).count() == odd.count()
    assert run(none, labels).count() == 0


def test_language_of_an_empty_table(none):
    assert language_id.identify(none).count() == 0


def test_stages_keep_rows_whole(odd, labels):
    for kept in (quality_rules.filter_quality(odd, labels), toxicity.filter_toxic(odd, labels)):
        assert kept.schema == odd.schema
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}


def test_kernel_words_match_regex():
    import pyarrow as pa

    texts = ["", "a", "  x  yy\nz ", None, "ab", "cd", "é ü"]
    s = next(tk.slices(pa.array(texts)))
    start, end, row = tk.find_words(s, tk.SPACE_SEP)
    got = [[] for _ in texts]
    for a, b, r in zip(start, end, row, strict=True):
        got[r].append(s.buf[a:b].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    hashes = tk.span_hash(tk.prefix_hash(s.buf), start, end)
    assert [int(h) for h in hashes] == [tk.hash_text(w) for ws in got for w in ws]


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    z = rng.normal(size=500)
    y = (rng.random(500) < models.sigmoid(z)).astype(float)
    curve = models.fit_isotonic(z, y, np.ones(500))
    p = curve(np.linspace(-4, 4, 100))
    assert (np.diff(p) >= 0).all() and 0 <= p[0] and p[-1] <= 1


def test_schema_has_clashing_names():
    assert "score" in SCHEMA and "label" in SCHEMA
