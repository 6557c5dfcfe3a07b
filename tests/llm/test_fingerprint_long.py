import random

import pytest
from pyspark.sql import functions as F

from evidentia.llm.fingerprint import likeness, vector


def test_likeness_of_texts_of_thousands_of_sentences(spark):
    rng = random.Random(2)
    piece = lambda: " ".join(rng.choice("abcdefgh") * 4 for _ in range(9)) + f" {rng.random()}."
    rows = []
    for n in (300, 700, 2000, 5000):
        base = [piece() for _ in range(n)]
        for share in (0.92, 0.67, 0.5, 0.0):
            k = int(n * share)
            rows.append(("\n".join(base), "\n".join(base[:k] + [piece() for _ in range(n - k)]), k / (2 * n - k)))
    df = spark.createDataFrame(rows, "a string, b string, want double").repartition(4)
    for r in df.select("want", likeness(vector(F.col("a")), vector(F.col("b"))).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=0.13)
