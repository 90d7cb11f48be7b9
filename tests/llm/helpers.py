"""Fixtures shared by the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence_docs(n: int = 60, seed: int = 5) -> list[tuple]:
    """Documents of made-up words with copies, near copies, repeats, empty and null texts, and null ids and languages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts: list[str | None] = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 150)))
        texts.append(t.replace(" ", "\n", 2) if i % 3 else t.capitalize() + ".")
    texts += [texts[0], texts[1], texts[2].replace("a", "A", 1), texts[3] + " end", "", None, "x", "one two", "   \n\t", "ä ö Ü ß 日本語 😀 \x1c", "same same " * 60]
    docs = [(i, t, ("en", "fr", "de", None)[i % 4], f"src{i % 5}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*docs, (None, texts[4], "en", None, 3), docs[5]]


def frame(spark, rows, schema=DOCS, parts: int = 3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df):
    """The same rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["id", "ids", "bands", "digest", "word", "n", "kind", "base", "uid", "part", "label", "score", "spans", "host", "node", "root", "u", "v", "key", "bucket"]
    return df.select("*", *(F.lit("clash").alias(c) for c in extra if c not in df.columns))
