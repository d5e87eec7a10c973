from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed: int = 3, n: int = 60) -> list[tuple]:
    """Invented documents with copies, near copies, shared passages, repeats, blanks, a null, a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = text(40), text(9)
    out = []
    for i in range(n):
        lines = [text(rng.randint(3, 25)) for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(1, passage)
        if i % 7 == 0:
            lines.append(line)
        out.append("\n".join(lines))
    for i in range(12):
        words = out[i].split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = "Changed"
        out.append(" ".join(words))
    out += ["", None, "   \n\t", "one", "One", "tak " * 200, "tak " * 150, out[3], out[3], text(9000), "é日本 " * 20]
    ids = list(range(100, 100 + len(out)))
    rng.shuffle(ids)
    return [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, out, strict=True)]


@pytest.fixture(scope="session")
def docs(spark):
    # a clashing extra column does no harm
    from pyspark.sql import functions as F

    return spark.createDataFrame(make_docs(), SCHEMA).withColumn("digest", F.lit("x")).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
