"""Features and counts against plain Python, and long texts against the same texts worked on at once."""

import math
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import language_id, minhash_dedup, quality_classifier, quality_rules, toxicity
from corpuslens.llm import textkernel as tk

ROOT = Path(__file__).resolve().parents[2]
LEXICON = ["grobnok", "idiot", "scheltname"]


def texts_of(rows):
    return [r[1] for r in rows if r[1] is None or len(r[1]) < 20_000] + [
        "You IDIOT!! you are a gr0bnok, tu es nul... NO", "soooo stretched w0rds @nd 1d10t", "a#b c|d. e! f? g", "one\n\ntwo two\none\n x ", "É ÀÉ naïve ÖL", "日本語 テキスト. x", "1 22 333 - -- ab abc",
    ]


def sliced(texts, work):
    return np.concatenate([work(s) for s in tk.slices(pa.array(texts, pa.string()))])


def words_of(text, pattern):
    return re.findall(pattern, text)


def latin_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)


def plain_statistics(text):
    words = words_of(text, r"[^\x20\x09-\x0D]+")
    n, size, lines = len(words), max(len(text.encode()), 1), text.count("\n") + 1
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    cover = {i + k for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    count = max(n, 1)
    share = lambda pattern, by: len(re.findall(pattern, text)) / by
    return [
        n, sum(map(len, words)) / count, max((len(w.encode()) for w in words), default=0), share(r"[#*$%&|<>]", size), share("[A-Z]", size), share("[0-9]", size),
        share(r"[!-/:-@\[-`{-~]", size), share(r"[\x20\x09-\x0D]", size), (len(full) - len(set(full))) / lines, len(cover) / count, len(set(words)) / count,
        sum(a == b for a, b in zip(words, words[1:])) / count, sum(len(w.encode()) <= 2 for w in words) / count, n / lines, sum(w[-1] in ".!?" for w in words) / count,
        share(r"\|", count), share("!", count),
    ]


def test_statistics_equal_plain_python(odd_rows):
    texts = texts_of(odd_rows)
    got = sliced(texts, quality_classifier.statistics)
    assert np.allclose(got, [plain_statistics(t or "") for t in texts])


def plain_toxicity(text, lexicon, prefixes):
    low = latin_lower(text)
    words = words_of(low, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    raw = words_of(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    n, size = max(len(words), 1), max(len(text.encode()), 1)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    heads = sum(len(w.encode()) > 5 and w.encode()[:5] in prefixes for w in words)
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON.split()]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits)
    letters = sum(b >= 128 or chr(b).isalpha() for b in text.encode())
    letter = lambda b: b >= 128 or chr(b).isalpha()
    b, lb = text.encode(), low.encode()
    plain = low.translate(str.maketrans("013457@", "oieasta"))
    spans = [m.span() for m in re.finditer(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain)]
    masked = sum(plain[x:y] in lexicon for x, y in spans if plain[x:y] != low[x:y])
    return [
        100 * len(hits) / n, math.log1p(len(hits)), 100 * heads / n, math.log1p(heads), sum(lexicon[words[i]] for i in hits) / n * 10, max((lexicon[words[i]] for i in hits), default=0),
        math.log1p(len({words[i] for i in hits})), len(second) / n, near / max(len(hits), 1), sum(65 <= x < 91 for x in b) / max(letters, 1), sum(re.fullmatch("[A-Z]{2,}", w) is not None for w in raw) / n,
        text.count("!") / n, text.count("?") / n, len(re.findall(r"[!-/:-@\[-`{-~]", text)) / size, len(re.findall("[0-9]", text)) / size,
        sum(chr(b[i]) in "*@$!013457" and letter(b[i - 1]) and letter(b[i + 1]) for i in range(1, len(b) - 1)) / n, math.log1p(masked),
        sum(lb[i] == lb[i - 1] == lb[i - 2] and letter(lb[i]) for i in range(2, len(lb))) / size, math.log1p(len(words)),
    ]


def test_toxicity_features_equal_plain_python(odd_rows):
    texts = texts_of(odd_rows)
    odds = {w: 2.5 + i for i, w in enumerate(LEXICON)}
    heads = {b"grobn", b"schel", b"stret"}
    entry = np.array([tk.hash_text(w) for w in LEXICON], np.uint64)
    order = np.argsort(entry)
    lexicon = toxicity.Lexicon(entry[order], np.array(list(odds.values()))[order], np.sort(np.array([tk.hash_text(h.decode()) for h in heads], np.uint64)))
    got = sliced(texts, lambda s: toxicity.dense_features(s, lexicon))
    for text, row in zip(texts, got, strict=True):
        expect = plain_toxicity(text or "", odds, heads)
        wrong = [name for name, x, y in zip(toxicity.FEATURES, row, expect, strict=True) if not math.isclose(x, y, abs_tol=1e-9)]
        assert not wrong, (text, wrong)


def test_language_vectors_count_characters(odd_rows):
    """A vector's squares count characters, and pairs and triples that don't begin with two blanks."""
    texts = texts_of(odd_rows)
    got = sliced(texts, language_id.vectors) ** 2
    for text, row in zip(texts, got, strict=True):
        fold = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in latin_lower(text or ""))
        pairs = [fold[i : i + 2] for i in range(len(fold) - 1) if fold[i : i + 2] != "  "]
        triples = [fold[i : i + 3] for i in range(len(fold) - 2) if fold[i : i + 2] != "  "]
        assert round(row[language_id.DIMS :].sum()) == sum(c != " " for c in fold)
        assert round(row[: language_id.DIMS].sum()) == len(pairs) + len(triples)
        for c in set(fold) - {" "}:
            if c.isascii():
                assert round(row[language_id.DIMS + ord(c)]) == fold.count(c)
    # texts of the same characters and grams have the same vector, others don't
    same = sliced(["abab ab", "ABAB.ab", "abba ab"], language_id.vectors)
    assert np.array_equal(same[0], same[1]) and not np.array_equal(same[0], same[2])


def everything(text):
    """All that the kernels make of one text."""
    s = next(tk.slices(pa.array([text])))
    counts, words, row = quality_rules.base_counts(s)
    rng = np.random.default_rng(0)
    weights = rng.normal(size=quality_rules.DIMS)
    lexicon = toxicity.Lexicon(np.sort(np.unique(words))[:50], np.ones(50), np.zeros(0, np.uint64))
    label, _ = minhash_dedup.shingles(s)
    return [*counts, words, quality_rules.linear_score(s, words, row, weights), quality_classifier.statistics(s), toxicity.dense_features(s, lexicon), language_id.vectors(s), label, minhash_dedup.sketch(label)]


@pytest.mark.parametrize("unit", ["wort zwei\n", "ein langer Satz, Ünd nöch einer! ", "x" * 997 + " ", "日本語。"])
def test_long_texts_in_stretches(unit, monkeypatch):
    text = "".join(f"{unit}{i} " if i % 7 else unit for i in range(3000 // len(unit) + 400))
    whole = everything(text)
    monkeypatch.setattr(tk, "SLICE_BYTES", 256)
    for a, b in zip(whole, everything(text), strict=True):
        assert np.allclose(np.asarray(a, float), np.asarray(b, float))


MEMORY = """
import sys; sys.path.insert(0, sys.argv[1])
import random, resource, numpy as np, pyarrow as pa
from corpuslens.llm import textkernel as tk, quality_rules, quality_classifier, toxicity, language_id, minhash_dedup
rng = random.Random(1)
words = ["w%x" % rng.randrange(1 << 20) for _ in range(200_000)]
text = " ".join(words) * 31
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = next(tk.slices(pa.array([text], pa.large_string())))
what = sys.argv[2]
if what == "rules":
    c, w, r = quality_rules.base_counts(s)
    quality_rules.linear_score(s, w, r, np.zeros(quality_rules.DIMS))
elif what == "statistics":
    quality_classifier.statistics(s)
elif what == "toxicity":
    toxicity.dense_features(s, toxicity.Lexicon())
elif what == "language":
    language_id.vectors(s)
else:
    minhash_dedup.sketch(minhash_dedup.shingles(s)[0])
print(len(s.buf), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) >> 10)
"""


@pytest.mark.parametrize("what", ["rules", "statistics", "toxicity", "language", "sketch"])
def test_memory_of_a_text_of_40_mb(what):
    got = subprocess.run([sys.executable, "-c", MEMORY, str(ROOT), what], capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    size, mb = map(int, got.stdout.split())
    assert size > 40_000_000 and mb < 1100, mb
