"""Very long texts and no documents, and the classifier's updates against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
from provena.llm import bpe, classifier, dartminhash, mixing, packing
from provena.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import frame

LONG = " ".join(f"word{i % 977} and the {i % 13}" for i in range(60_000))


def test_very_long_texts_are_whole(spark):
    rows = [(1, LONG, "en", "s", len(LONG)), (2, "a b c", "en", "s", 5)] + [(i, f"word{i} and the rest of it", "en", "s", 9) for i in range(3, 40)]
    docs = frame(spark, rows)
    n = len(Tokenizer.from_file(tokenizer_path()).encode(LONG, add_special_tokens=False).ids) + 1
    pieces = packing.pack(docs, tokenizer_path()).filter("doc_id = 1").orderBy("start").collect()
    assert sum(r["length"] for r in pieces) == n and {r["doc_tokens"] for r in pieces} == {n} and [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
    scored = {r["doc_id"]: r for r in mixing.score(docs, F.col("doc_id") != 1).collect()}
    assert scored[1]["n_tokens"] == 240_001 and scored[1]["score"] < 0 and math.isfinite(scored[1]["score"])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3, 40)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in classifier.classify(docs, labels).collect())


def test_no_documents_give_no_rows(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for made in (classifier.classify(none, labels), packing.pack(none, tokenizer_path()), mixing.score(none, F.lit(True)), dartminhash.near_duplicates(none), bpe.encode(none, tokenizer_path(), bpe.build_lexicon(none, tokenizer_path()))):
        assert made.collect() == []


def test_follow_the_regularised_leader_equals_plain_python():
    rng = random.Random(8)
    made = [(sorted(rng.sample(range(50), 6)), [rng.choice([0.5, 1.0, 2.0]) for _ in range(6)], i % 3 == 0) for i in range(80)]
    z, n = [0.0] * 51, [0.0] * 51

    def weight(i):
        if abs(z[i]) <= classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(classifier.L1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)

    for _ in range(classifier.PASSES):
        for at, x, y in made:
            at, x = [*at, 50], [*x, 1.0]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, wi, xi in zip(at, w, x, strict=True):
                g = (p - y) * xi
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA * wi
                n[i] += g * g
    got = classifier.fit([(np.array([*at, classifier.SIZE]), np.array([*x, 1.0]), int(y)) for at, x, y in made])
    assert np.allclose([*got[:50], got[classifier.SIZE]], [weight(i) for i in range(51)], atol=1e-12)
