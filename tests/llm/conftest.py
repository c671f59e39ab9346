import random

import pytest

#: Columns of documents, and clashing ones that operators have to leave alone.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, root string, place int"


def row(i, text, lang="en"):
    return (i, text, lang, "src0", None if text is None else len(text), -1.0, 7, "r", 3)


def prose(rng, n, vocabulary=400):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "st", "rm", "", "l", "nt", "k", "sh", "m", "p", "t", "g", "d", "x", "b", "z")][:vocabulary]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, blanks only, odd characters."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    return [
        row(1, prose(rng, 40)), row(2, None), row(3, ""), row(None, prose(rng, 30)), row(4, long), row(5, "x"), row(5, "x"), row(6, "x"), row(7, " \n\t "),
        row(8, "É日本 ½ <|endoftext|>!"), row(9, "1 2 3 ..."), row(None, None), row(10, "a" * 5000), row(11, "\n".join(["same line"] * 30)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def labelled(spark):
    """A small labelled corpus: junk and toxic texts are easy to tell."""
    rng = random.Random(11)
    docs, lab = [], []
    for i in range(600):
        text = prose(rng, rng.randint(30, 90))
        quality, toxic = 1, 0
        if i % 6 == 0:
            quality, text = 0, " ".join(f"{w}###" for w in text.split())
        elif i % 5 == 0:
            toxic = 1
            words = text.split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnok", "fluchwort", "scheltname", "you grobnok"]))
            text = " ".join(words)
        docs.append(row(i, text, "de" if i % 2 else "en"))
        lab.append((i, quality, toxic))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
