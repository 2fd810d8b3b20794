import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, bucket string, fp long, blob string, toxic int, kept boolean, _id long, slot string, _own_sha string, _gone string, _mix_copies string, _mix_copy string, _mix_id string, _toxicity string, _row string"

CLASHES = tuple("stuvwxyz")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, ties, odd characters."""
    rng = random.Random(7)
    long = words(rng, 40_000)
    texts = [
        None, "", " \t\n", "one", "one", "One  two", "one two", "a b c", "a b c d", "a b c d e", long, long + " end", "é ñ ü ß Σ 😀 日本語   x\u0085y",
        "don't I'LL we're 12345 !!! ...", "password = hunter2hunter2 AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 2, "token: token: abcdef", "x" * 300_000, "\x01 \x00 \x1c z", words(rng, 50),
    ]
    texts += [words(rng, rng.randint(1, 60)) for _ in range(30)] + [texts[-1]] * 3
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s10", "s2", None]), None if i % 4 == 0 else 5, 1, 2, "b", 3, "x", 1, True, 9, *CLASHES))
    rows += [rows[5], rows[12], (None, "no id", None, None, None, None, None, None, None, None, None, None, None, *[None] * 8), (7, rows[20][1], "en", "s2", 1, 1, 1, "b", 1, "x", 0, False, 1, *CLASHES)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
