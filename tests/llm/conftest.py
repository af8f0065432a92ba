import random

import pytest

#: Columns beside those of documents whose names the operators use inside.
EXTRA = {"size": 1, "h": 2, "shard": 3, "row": 4, "fp": 5, "key": 6, "n_words": 7, "_w": 8, "bucket": 9, "leaf": 10, "target": 11, "rank": 12, "n_lines": 13, "kept": 14, "chunk": 15}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{chr(97 + rng.randrange(26))}{'abcdefghij'[rng.randrange(10)]}{'klmno'[rng.randrange(5)] * (rng.randrange(vocabulary) % 3 + 1)}" for _ in range(n))


def corpus(seed=0, n=60):
    """Rows with nulls in every column, empty and long texts, copies, near copies, repeated rows and junk."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        text = "\n".join(prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4)))
        rows.append((k, text, rng.choice(["en", "fr"]), f"s{rng.randrange(4)}", len(text)))
    long = prose(rng, 6000)
    copy, near = rows[3], rows[5][1].split(" ")
    near[-1] = "changed"
    rows += [(n + k, copy[1], copy[2], copy[3], copy[4]) for k in range(4)]
    rows += [(n + 10, " ".join(near), "en", "s1", 0), (n + 11, long, "en", "s2", 0), (n + 12, long + " tail", "en", "s2", 0)]
    rows += [(n + 13, None, "en", "s1", None), (n + 14, "", None, None, 0), (n + 15, " \n\t ", "en", None, 3), (None, "lone words here", "en", "s1", 3), (None, None, None, None, None)]
    rows += [rows[2], rows[2], (n + 16, "é ü 日本 \U0001f600 x", None, "s3", 9), (n + 17, " ".join(["#&%a***"] * 80), "en", "s1", 1), (n + 18, "same line here\n" * 40, "en", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same with columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
