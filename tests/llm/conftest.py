import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    """Small texts with copies, near copies, shared lines and passages, empty and odd ones."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "naïve", "日本", "x|y", "A.b", "#", "the", "of", "and"]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [sentence(40) for _ in range(3)]
    line = ["This very line is in many documents of all", "Another LINE that comes again and again", "short one"]
    out = []
    for i in range(n):
        parts = [sentence(r.randint(1, 60)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), r.choice(shared)[r.choice([0, 7]) :])
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(["", " ", "\t"]) + r.choice(line))
        out.append("\n".join(parts))
        if r.random() < 0.2:
            out.append(out[-1])
        if r.random() < 0.2:
            out.append(out[-1] + " " + r.choice(vocab))
    out += [None, "", " ", "\n\n", "one", "one two", "ab " * 300, "a" * 500, "\x00 nul \x01", "z\r\nz\r\n" * 30, sentence(6000), "ab " * 299 + "c"]
    r.shuffle(out)
    return [(i * 7 % 1009, t, "en", ["s1", "s2", None, "s3"][i % 4], len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return sorted(corpus(), key=lambda x: x[0])


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, one id with two texts; columns whose names the operators use themselves."""
    t = "Some words that are here to be counted and found again by all who look for them in this text of ours today"
    rows = [(None, t), (None, t), (1, t), (1, t), (1, t + " more"), (2, None), (None, None), (3, "Other words altogether")]
    return spark.createDataFrame([(d, x, "en", "s", 1, "u", 2, 3, "h") for d, x in rows], SCHEMA + ", shard string, copy long, kept long, _keep string")
