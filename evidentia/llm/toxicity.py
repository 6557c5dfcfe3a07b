"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words in
it; the document's score is the noisy-or of its sentences, 1 - prod(1 - p). Weights are
learned from document labels alone, and the sentence scores then point at the
offending places.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.common import bounded_sample, remainder, table

#: Labelled documents a model is fitted on at most (a hash order picks them).
TRAIN_DOCS = 6000
#: A word needs so large a share of the fitted documents (three documents at least): rarer ones only help to memorise.
SPREAD = 1 / 400
STEPS, L1, RATE, FIRST_BIAS = 120, 2e-4, 0.25, -6.0

_SENTENCE = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features beside the whole words: inflected forms share them.
STEMS = (3, 4, 5, 6, 7)


def features(sentence: str) -> set[str]:
    """Lower-cased words, and their beginnings marked by a star."""
    words = set(_WORD.findall(sentence.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class _Weighed(dict):
    """Word -> its features with a weight; remembers the words seen lately."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= 300_000:
            self.clear()
        self[word] = got = tuple(sorted(self.weights.keys() & features(word)))
        return got


def fit(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray, float]:
    """Words with nonzero weights, the weights, and the bias, by proximal adaptive gradients on the bag likelihood."""
    spread = Counter(f for t in texts for f in features(t))
    words = [w for w, n in sorted(spread.items(), key=lambda x: (-x[1], x[0])) if n >= max(3, SPREAD * len(texts))]
    ids = {w: i for i, w in enumerate(words)}
    known = _Weighed(dict(ids))
    doc, sentence, word = [], [], []
    at = 0
    for d, t in enumerate(texts):
        for s in _SENTENCE.findall(t):
            doc.append(d)
            found = np.array(sorted({ids[f] for v in _WORD.findall(s.lower()) for f in known[v]}), np.int32)
            word.append(found)
            sentence.append(np.full(len(found), at, np.int32))
            at += 1
    doc = np.array(doc, np.int64)
    word = np.concatenate(word) if word else np.zeros(0, np.int32)
    sentence = np.concatenate(sentence) if sentence else np.zeros(0, np.int32)
    n, y = max(1, len(texts)), labels.astype(float)
    w, b = np.zeros(len(words)), FIRST_BIAS
    gw2, gb2 = np.full(len(words), 1e-8), 1e-8
    for _ in range(STEPS if at else 0):
        z = np.clip(b + np.bincount(sentence, w[word], at), -30, 30)
        p = 1 / (1 + np.exp(-z))
        q = np.minimum(np.bincount(doc, -np.logaddexp(0, z), n), -1e-9)
        slope = (y * np.exp(q) / -np.expm1(q) - (1 - y)) / n
        dz = slope[doc] * -p
        gw, gb = np.bincount(word, dz[sentence], len(w)), dz.sum()
        gw2 += gw**2
        gb2 += gb**2
        step = RATE / np.sqrt(gw2)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        b -= RATE * gb / np.sqrt(gb2)
    keep = np.flatnonzero(w)
    return [words[i] for i in keep], w[keep], float(b)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """model(words, weights, bias), one row, from docs(doc_id, text) and labels(doc_id, label).

    Fits on at most max_docs labelled documents, the first by a hash of their labels' doc_id; null ids and labels take no part.
    Only these labels, at most max_docs rows, are broadcast to the documents, and the fit runs in one executor task
    over this bounded sample. Without rows the model has no words.
    """
    picked = bounded_sample(labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "label"), max_docs, "doc_id", "label")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "label").limit(max_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels = [], []
        for x in batches:
            texts += x["text"].tolist()
            labels += x["label"].tolist()
        words, weights, bias = fit(texts, np.array(labels, float))
        yield pd.DataFrame({"words": [words], "weights": [weights.tolist()], "bias": [bias]})

    return sample.select("text", "label").coalesce(1).mapInPandas(run, "words array<string>, weights array<double>, bias double")


def score(docs: DataFrame, model: DataFrame, carry: list[str]) -> DataFrame:
    """carry columns, score, and offending array<struct<start, end, score>>: sentences of 0.5 or more, as code points.

    Null and empty texts score 0. The model is sent to each task; the sample that it was fitted on bounds its words.
    """
    row = model.first()
    weigh, bias = (dict(zip(row["words"], row["weights"], strict=True)), row["bias"]) if row else ({}, FIRST_BIAS)
    shared = docs.sparkSession.sparkContext.broadcast(weigh)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    schema = f"{kept}, score double, offending array<struct<start:int,end:int,score:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        weighed = _Weighed(w)
        low = -float(np.logaddexp(0, bias))
        for x in batches:
            scores, found = [], []
            for t in x["__text"]:
                q, bad = 0.0, []
                for m in _SENTENCE.finditer(t):
                    hits = {f for v in _WORD.findall(m.group().lower()) for f in weighed[v]}
                    if hits:
                        z = bias + sum(w[h] for h in sorted(hits))
                        q -= float(np.logaddexp(0, z)) if z > -30 else 0.0
                        if z >= 0:
                            bad.append((m.start(), m.end(), 1 / (1 + float(np.exp(-z)))))
                    else:
                        q += low
                scores.append(-float(np.expm1(q)))
                found.append(bad)
            out = x.drop(columns="__text")
            out["score"], out["offending"] = scores, found
            yield out

    return docs.select(*carry, F.coalesce("text", F.lit("")).alias("__text")).mapInPandas(run, schema)


def toxic_labels(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """doc_id and toxic label, without the held-out fold."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(remainder("doc_id", folds) != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, toxic_labels(spark, sf_dir)), ["doc_id"])
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
