import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators might use themselves.
CLASH = ("score", "node", "a", "b", "p", "n", "tokens", "label", "kept", "component", "vec", "rank", "_doc", "_tokens", "row", "batch")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus(seed=5):
    """(doc_id, text): copies, near copies, shared passages, repeated lines, empty and very long texts."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(40)]
    for k in range(12):
        base = texts[k].split()
        near = list(base)
        for _ in range(max(1, len(base) // 40)):
            near[rng.randrange(len(near))] = "changed"
        texts += [texts[k], " ".join(near), "  ".join(x.upper() for x in near)]
    texts += [" ".join(words(rng, 20) + passage + words(rng, 20)) for _ in range(6)]
    texts += ["\n".join([" ".join(words(rng, 30))] * 5), " ".join(words(rng, 6000)), "x" * 1000, "é" * 300, None, "", " \t\n", "one", "one two three", "ONE two three", "a b c d e", "tie tie tie tie tie tie tie"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["src1", "src9", "odd", None][i % 4], len(t or "")) for i, t in corpus()]
    return spark.createDataFrame(rows, DOC).repartition(5)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})
