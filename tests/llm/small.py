"""Small fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, pool: int = 400) -> list[str]:
    return [f"w{rng.randrange(pool)}é" if rng.random() < 0.1 else f"w{rng.randrange(pool)}" for _ in range(n)]


def docs(spark, rows, extra: bool = False):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "kept", "kept_text", "fp", "key", "text_", "score", "part", "length", "doc"):
            df = df.withColumn(name, F.lit("x"))
    return df


def edge_rows(seed: int = 7):
    """Nulls, empty and very long texts, ties, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    base = words(rng, 120)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "a b"), (5, " ".join(base)), (6, " ".join(base))]
    near = list(base)
    near[50] = "changed"
    rows += [(7, " ".join(near)), (8, "\n".join(base)), (9, " ".join(words(rng, 30000, 50000)))]
    rows += [(10 + i, " ".join(words(rng, 20 + i) + passage[: 10 + 5 * i] + words(rng, 15))) for i in range(10)]
    rows += [(20, " ".join(passage[:13])), (21, " ".join(passage[:12])), (22, " ".join(base)), (5, " ".join(base))]
    rows += [(None, " ".join(base)), (None, None)]
    rows += [(30 + i, " ".join(words(rng, 15, 3))) for i in range(20)]
    return rows
