import numpy as np
from pyspark.sql import functions as F

from evidentia.llm.toxicity import fit, op4_toxicity, score, train

SCHEMA = "doc_id long, text string"


def test_fit_finds_the_planted_word():
    texts = [f"plain words number {i}. more plain words." for i in range(60)] + [f"plain words. you vilebeast {i}! more." for i in range(60)]
    words, weights, _ = fit(texts, np.array([0] * 60 + [1] * 60, float))
    top = words[int(weights.argmax())]
    assert "vileb" in top or top in ("vil*", "vile*", "you", "you*") or top == "vilebeast"


def test_scores_locate_sentences_and_take_odd_rows(spark):
    rows = [(i, f"good day number {i}. fine weather.") for i in range(50)] + [(100 + i, f"fine day. such a scumbag {i}. bye.") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows] + [(None, 1), (3, None), (999, 1)], "doc_id long, label int")
    model = train(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "such a scumbag here. good day.", "x"), (3, "such a scumbag here. good day.", "x")], "doc_id long, text string, score string")
    got = score(odd, model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r["score"] for r in got[:2]] == [0.0, 0.0]
    assert got[2]["score"] > 0.5 and got[2]["score"] == got[3]["score"]
    assert [(s["start"], s["end"]) for s in got[2]["offending"]] == [(0, 20)]


def test_scores_are_the_noisy_or_of_sentence_scores(spark):
    """Against a plain version: sentences by hand, each feature's weight once, 1 - prod(1 - p)."""
    weights, bias = {"bad": 3.0, "wor*": 0.5, "day": -1.0, "worse": 4.5}, -3.0
    model = spark.createDataFrame([(list(weights), list(weights.values()), bias)], "words array<string>, weights array<double>, bias double")
    texts = {1: ["Bad day.", " Worse worse!", "\nfine"], 2: ["nothing here"], 3: ["day. ", "BAD, so bad?"], 4: ["bar none."]}
    got = {r["doc_id"]: r for r in score(spark.createDataFrame([(i, "".join(t)) for i, t in texts.items()], SCHEMA), model, ["doc_id"]).collect()}
    for i, sentences in texts.items():
        left, bad = 1.0, []
        for s in sentences:
            words = {w.strip(" .,!?\n").lower() for w in s.split()} - {""}
            hit = words | {w[:3] + "*" if len(w) > 3 else "" for w in words}
            p = 1 / (1 + np.exp(-(bias + sum(v for f, v in weights.items() if f in hit))))
            left *= 1 - p
            bad.append(p >= 0.5)
        assert abs(got[i]["score"] - (1 - left)) < 1e-9, i
        assert len(got[i]["offending"]) == sum(bad)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, label int")
    model = train(docs, labels)
    assert score(docs, model, ["doc_id"]).count() == 0
    assert score(spark.createDataFrame([(1, "a b")], SCHEMA), model, ["doc_id"]).first()["score"] < 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.85
