import math
import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm.lattice import MODEL_FILE, SPACE, likelihoods, vocabulary
from evidentia.llm.lm_score import ALPHA, _LN10, _urn, op3_lm_scoring, score_documents, tokens

ROWS = [(1, "The cat sat on the mat.", False), (2, "the dog\tsat\non the cat", False), (3, "", False), (4, None, False), (5, "the unseen word", True),
        (6, "", True), (7, "ünï 漢字 the\x00the", True), (8, "the cat sat " * 400, False), (9, "the dog\tsat\non the cat", None), (None, "cat", True), (10, "b" * 3000, True)]
SCHEMA = "doc_id long, text string, held_out boolean"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_scores_equal_brute_force(spark):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t, _ in ROWS}
    assert all([w.encode() for w in words[i]] == tokens(t or "") for i, t, _ in ROWS)
    learned = [i for i, _, held in ROWS if not held]
    seen = Counter(w for i in learned for w in words[i])
    n, v = seen.total() + len(learned), len(seen) + 1
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    model = open(MODEL_FILE, "rb").read()
    every = sorted({w for ws in words.values() for w in ws})
    lattice = dict(zip(every, likelihoods(vocabulary(model), vocabulary(model).rank_scores(), [SPACE + w for w in every]), strict=True))
    ones, twos = (sum(c == k for c in seen.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    stop = (len(learned) + 0.5) / (n + 1)
    got = {r["doc_id"]: r for r in score_documents(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert set(got) == set(words)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(w in seen for w in ws) + 1, n)
        assert r["base_score"] == pytest.approx(sum(base(seen[w]) for w in ws) + base(len(learned)))
        fixed = math.log(stop) + len(ws) * math.log1p(-stop)
        assert r["score"] == pytest.approx((sum(lattice[w] for w in ws) + fixed) / _LN10)
        urn = fixed - (math.lgamma(ALPHA + len(ws)) - math.lgamma(ALPHA))
        for w, k in Counter(ws).items():
            p = max(seen[w] - d, 0) / seen.total() + d * len(seen) / seen.total() * math.exp(lattice[w])
            urn += _urn(ALPHA, math.log(p) if p > 1e-290 else lattice[w] + math.log(d * len(seen) / seen.total()), k)
        assert r["word_score"] == pytest.approx(urn / _LN10)


def test_score_is_the_sum_over_all_segmentations(spark):
    """Each word's probability from a recursion over every piece that ends at a character, written anew."""
    vocab = vocabulary(open(MODEL_FILE, "rb").read())
    scores, piece = vocab.rank_scores(), {vocab.pieces[i]: i for i in vocab.plain}
    rows = [(1, "the cat", False, 1.0), (2, "catalogue of cats", True, 2.0)]
    got = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(rows, SCHEMA + ", score double")).collect()}
    for i, text, _, _ in rows:
        total = math.log10(1.5 / 4) + len(text.split()) * math.log10(1 - 1.5 / 4)  # two words and one end to learn from
        for w in text.split():
            reach = [1.0] + [0.0] * (len(w) + 1)
            marked = SPACE + w
            for j in range(1, len(marked) + 1):
                reach[j] = sum(reach[k] * math.exp(scores[piece[marked[k:j]]]) for k in range(j) if marked[k:j] in piece)
            total += math.log10(reach[len(marked)])
        assert got[i] == pytest.approx(total)


def test_empty_tables_and_no_training_rows(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    r = score_documents(spark.createDataFrame([(1, "a b", True), (1, "a b", True)], SCHEMA)).collect()
    assert len(r) == 2 and r[0] == r[1] and r[0]["n_known"] == 0 and np.isfinite(r[0]["score"])


def test_query_scores_every_document(spark, sf):
    got = op3_lm_scoring(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count() and got.where("score IS NULL OR score > 0 OR held_out IS NULL").count() == 0


def test_query_scores_held_out_rows_by_what_it_learned(spark, tmp_path):
    """Held-out texts of training words: the lattice alone would be at twice the base score."""
    words = "the quarterly revenue increased because customers ordered considerably more industrial equipment".split()
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(40))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_lm_scoring(spark, str(tmp_path)).where("held_out").collect()
    assert len(got) > 20 and all(np.isfinite(r["score"]) and r["score"] > 1.1 * r["base_score"] for r in got)
    assert all(r["lattice_score"] < 1.1 * r["base_score"] for r in got)
