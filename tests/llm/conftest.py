import hashlib
import re

import pytest
from pyspark.sql import types as T

ODD_TEXTS = [
    "", None, " \t\n\x0b\x0c\r ", "one", "One two", "one two three four", "one two three four five", "ONE  two\tthree\nfour five", "a" * 5000, "b " * 3000,
    "it's we're I'll 'twas ''s  x y z\n\n  end ", "éß日本\U0001f600 12² ١", "<|endoftext|>a<|endoftext|>", "one two three four five", "-" * 300 + " 0123456789" * 40,
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="session")
def near_texts():
    """A passage, its exact copies, altered copies, a chain of altered copies, and others that share a part."""
    import random

    draw = random.Random(5)
    base = [f"w{draw.randrange(900)}" for _ in range(200)]
    out = [" ".join(base)] * 4 + [" ".join(base).upper(), "  ".join(base)]
    for k in range(60):
        copy = list(base)
        for _ in range(draw.choice((1, 2, 3, 4, 6, 9))):
            copy[draw.randrange(200)] = f"x{k}{draw.randrange(9)}"
        out.append(" ".join(copy))
    chain = [f"c{draw.randrange(900)}" for _ in range(120)]
    for k in range(12):
        out.append(" ".join(chain))
        chain = chain[2:] + [f"d{k}", f"e{k}"]
    for k in range(40):
        out.append(" ".join(base[50:90] + [f"y{k}{j}" for j in range(80)]))
    for k in range(30):
        out.append(" ".join(base[50:80] + [f"z{k}{j}" for j in range(draw.randrange(9))]))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table with clashing further columns; rows are (doc_id, text, source)."""

    def make(rows):
        shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
        df = spark.createDataFrame([(i, t, s) for i, t, s in rows], shape)
        from pyspark.sql import functions as F

        return df.withColumns({n: F.lit("clash") for n in ("id", "n", "label", "position", "block", "shard", "name", "keep_id", "component", "score", "key")}).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents([(100 + k, t, f"s{k % 3}") for k, t in enumerate(ODD_TEXTS)])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
