import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, key long, base long, score double"


@pytest.fixture
def odd_docs(spark):
    """Nulls, blanks, ties, repeated rows, one long text, and columns whose names the operators use inside."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 120))) for _ in range(25)]
    texts += [texts[0], texts[1], None, "", " \t\n", "x", "x y", "y" * 5000, "  ".join(rng.choices(vocab, k=3000)), "Ünï çodé text " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0, -1, "t", 7, 8, 0.5) for i, t in rows], SCHEMA)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
