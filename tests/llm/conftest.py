import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside.
CLASHING = ["id", "row", "chunk", "slot", "fp", "key", "block", "size", "s", "n", "taken", "nth", "target", "base", "spans", "shard", "bytes", "label", "score", "toxic", "tree", "h", "_row", "_cut", "_hash", "_text_hash"]


def prose(rng, n):
    parts = ["the", "of", "and", "tion", "er", "in", "an", "re", "es", "on", "st", "en"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(7)
    found = [prose(rng, rng.randint(30, 300)) for _ in range(60)]
    shared = prose(rng, 70)
    found += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(8)]
    found += [found[3]] * 5 + [found[4] + " and more", found[4] + " or less"]
    found += [None, "", "   \n\t ", "one", "one two", "a b c d e f g h i j k l m", prose(rng, 30_000), "x" * 50_000, "é ü  \u0085 z� 🤦🏽‍♂️ \x1c w", "A\x0bB\x0cC", "HELLO World " * 40, "line\n" * 30]
    return found


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows of every kind: null and repeated ids, null, empty and very long texts, ties, and columns of clashing names."""
    rows = [(i * 3 + 1, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[64], (None, texts[7], None, "src1", None), (None, None, None, None, None), (7, "another text of a repeated id", "fr", "src2", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
