import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, shared passages, nulls, empty and long texts."""
    rnd = random.Random(seed)
    words = {"en": "the of and river stone walks under bright heavy morning".split(), "de": "der die und straße schön über nicht heute größe wald".split(), "fr": "le la et été forêt où être garçon très encore".split()}
    say = lambda lang, k: " ".join(rnd.choice(words[lang]) + rnd.choice(["", "", "er", "ing", "s"]) for _ in range(k))
    shared = say("en", 40)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(words))
        text = say(lang, rnd.randint(1, 120))
        if i % 7 == 3:
            text = text + "\n" + shared
        if i % 11 == 5 and rows:
            text = rows[-1][1]  # an exact copy
        if i % 13 == 6 and rows and rows[-1][1]:
            text = rows[-1][1] + " added"
        rows.append((i, text, lang, f"src{i % 3}", len(text or "")))
    rows.append((n, None, None, None, None))
    rows.append((n + 1, "", "en", "src0", 0))
    rows.append((n + 2, "1234 5678 !!", "en", "src1", 12))
    rows.append((n + 3, say("en", 9000), "en", "src1", 1))
    rows.append((None, say("de", 30), "de", "src2", 1))
    rows.append((4, rows[4][1], "en", "src1", 1))  # a repeated row
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Dealt out, with extra columns whose names clash with what operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({"key": F.lit("k"), "fp": F.lit(1), "row": F.lit("r"), "host": F.lit("h"), "_n": F.lit(0), "score": F.lit(2.0), "size": F.lit(3), "shard": F.lit(9)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
