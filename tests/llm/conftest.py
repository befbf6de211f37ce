import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, size long"


def make_rows(seed=1, n=60):
    """Invented documents with nulls, empty, short, long and repeated texts, near copies and shared
    passages; the last three columns have names that operators use themselves."""
    r = random.Random(seed)
    vocab = ["the", "of", "und", "ciónes", "Été", "x1", "a-b", "re"] + ["".join(r.choice("aeioustrnlé") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(70)
    texts = []
    for k in range(n):
        kind = k % 10
        if kind == 0 or not texts:
            t = "\n".join(text(r.randint(5, 25)) for _ in range(r.randint(1, 8)))
        elif kind == 1:
            t = r.choice([x for x in texts if x])
        elif kind in (2, 3):
            words = r.choice([x for x in texts if x]).split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocab)
            t = " ".join(words)
        elif kind == 4:
            t = text(r.randint(1, 40)) + " " + passage + "\n" + text(r.randint(0, 40))
        elif kind == 5:
            t = (text(3) + " ") * r.randint(2, 30)
        elif kind == 6:
            t = f"Page {r.randint(1, 99)} of the printed book, see note {r.randint(1, 9)}\n" + text(30)
        elif kind == 7:
            t = r.choice([None, "", " \n\t ", "one", "one two three", "é"])
        else:
            t = text(r.randint(20, 200))
        texts.append(t)
    texts[8] = text(4000)
    rows = [(k * 3 % 1009, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "Z", "é", None]), None if t is None else len(t), 7, "k", 9) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
