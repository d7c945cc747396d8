import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_rows():
    """Documents with every planted difficulty: nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    r = random.Random(5)
    words = ["w" + "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, hot = prose(80), prose(90)
    texts = [prose(r.randint(1, 150)) for _ in range(30)]
    texts += [prose(20) + " " + shared + "\n" + prose(30) for _ in range(4)]
    texts += [hot] * 6 + [hot + " " + prose(3) for _ in range(8)] + [prose(5) + "\t" + hot for _ in range(8)]
    texts += ["", None, " \n\t", "a", "a b", "aa" * 400, "ab " * 200, "x" * 30000, prose(4000), "é中\U0001f600" * 100]
    texts += [texts[3].replace(" ", "\n", 1), texts[3].upper(), texts[3]]
    rows = [(i, t, "en" if i % 3 else None, r.choice(["src0", "src0", "src1", "zz", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[32], rows[36], (None, hot, None, None, 1), (None, None, None, None, None), (None, "only here", "en", "src1", 9)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The same as a table, with extra columns whose names clash with ones the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, SCHEMA).repartition(4)
    for name in ("dkey", "rid", "fp", "digest", "n", "kept", "slot", "start", "length", "first", "pool", "_bucket", "toxicity", "ids", "spans", "count"):
        df = df.withColumn(name, F.lit("extra"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
