import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import mixing
from evidentia.llm.mixing import fit_rates, mix, n_tokens, op10_mixing, with_features
from evidentia.llm.neighbours import nearest, op1_neighbours


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(np.isfinite(v)) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for q in ok:
        got = sorted(((-sum(float(a) * float(b) for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q))[:k]
        out[q] = [(i, -s) for s, i in got]
    return out


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    m = np.array(v["embedding"].tolist(), float)
    got = op1_neighbours(spark, sf).toPandas()
    hit = n = 0
    for q, part in got.groupby("query_id"):
        row = int(np.flatnonzero(v["vec_id"] == q)[0])
        s = m @ m[row]
        s[row] = -np.inf
        top = set(v["vec_id"].to_numpy()[np.lexsort((v["vec_id"], -s))[:20]])
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part["vec_id"])
        assert part["score"].is_monotonic_decreasing
        hit += len(top & set(part["vec_id"]))
        n += 20
    assert set(got["query_id"]) == {int(i) for i in v["vec_id"] if i % 20 == 0}
    assert hit / n >= 0.9


def test_odd_vectors_and_copies(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0]) for i in range(200, 320)]
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] + [1.0] * 5), (405, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    want = brute([(i, np.array(v, np.float32).tolist() if v and None not in v else v) for i, v in rows], 20)
    got = {}
    for r in nearest(df, df, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert nearest(df.limit(0), df).count() == 0
    few = nearest(df.where("vec_id < 5"), df.where("vec_id = 3"))
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [i for i, _ in brute(rows[:5], 20)[3]]


def test_rates_meet_targets(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        a, b = rng.random(), rng.random()
        rows.append((rng.randrange(1, 500), a * b, a * (1 - b), 1 - a))
    df = spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double, p2 double")
    targets = {"a": 0.3, "b": 0.3, "c": 0.4}
    m = np.array(rows)
    r = np.ones(len(rows))
    for v in fit_rates(df, ["a", "b", "c"], targets):
        r = np.maximum(0, r - m[:, 1:] @ np.array(v))
    e = (r * m[:, 0]) @ m[:, 1:]
    goal = np.array([0.3, 0.3, 0.4]) * min((m[:, 0] @ m[:, 1:]) / np.array([0.3, 0.3, 0.4]))
    assert abs(e - goal).max() < 2e-4 * m[:, 0].sum() and r.min() >= 0
    assert fit_rates(df.limit(0), ["a", "b", "c"], targets) == []
    with pytest.raises(ValueError):
        fit_rates(df, ["a"], {"a": 0.0})


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 <> 0")
    got = mix(docs.select("doc_id", "text"), train).join(labels.where("doc_id % 3 = 0"), "doc_id").where("toxic = 0")
    right = got.agg(F.avg(((F.col("p_high") >= F.col("p_low")) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.9


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (None, "z " * 50, "d")], "doc_id long, text string, rate string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mix(docs, none).collect()
    assert len(got) == 5 and all(abs(r["p_high"] - 1 / 3) < 1e-9 for r in got)
    assert mix(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(3, 1, 0), (3, None, 0), (3, 0, None), (None, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = mix(docs, odd).where("doc_id = 3").collect()
    assert len(rows) == 2 and rows[0]["rate"] == rows[1]["rate"] and rows[0]["copies"] == rows[1]["copies"]
    assert [r[0] for r in spark.createDataFrame([(" a\n b ",), ("",), (None,)], "t string").select(n_tokens(F.col("t"))).collect()] == [2, 0, 0]
    assert with_features(docs).count() == 5


def test_features_are_those_of_the_whole_text(spark):
    import re
    import unicodedata

    texts = ["", " a", "a ", "\t\n", "A1 ’x  y", "ΑΣ Σ ΑΣ.Σ", " x y", "\x0b\x0c\r", "a\x0bb\x0cc\rd  e", "😀 ok #1 ½", None, "a\x85b c", "x_y-z 'q' ’", "a b a b", "  a  a  ", "A's, b; C: D. -", "Ab\nab aB\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = with_features(docs)
    kind = lambda c: unicodedata.category(c)
    for r in rows.collect():
        t = texts[r["doc_id"]] or ""
        n, parts = max(1, len(t)), re.split(r"[ \t\n\x0b\f\r]+", t)
        tokens = sum(map(bool, parts))
        size = max(1, tokens)
        shape = {
            "capitals": sum(kind(c) == "Lu" for c in t) / n,
            "symbols": sum(kind(c)[0] not in "LN" and c not in " \t\n\x0b\f\r.,;:'’-" for c in t) / n,
            "digits": sum(kind(c)[0] == "N" for c in t) / n,
            "new": len(set(parts)) / size,
            "length": np.log2(n) / 20,
            "word": len(t) / size / 20,
            "lines": len(t.split("\n")) / size,
        }
        assert r["_tokens"] == tokens
        assert r["_bins"] == [f"{k}={min(12, int(np.floor(np.sqrt(v) * 12)))}" for k, v in shape.items()]
        words = "".join(c if kind(c)[0] == "L" else " " for c in t.lower()).split()
        assert [w for w in r["_words"] if w] == list(dict.fromkeys(words))
    # a whole text goes through one regular expression only
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(text") == 1


def test_posteriors_look_words_up_by_slots(spark):
    """A word costs a look at its own slot, not a search of all words; unknown words, odd letters and quotes count as they should."""
    rng = np.random.default_rng(6)
    known = [f"w{i}" for i in range(1500)] + ["ünï", "漢字", 'q"uo\\te', "it's", "𝒳"]
    weights = {f"word:{w}": rng.normal(size=3).tolist() for w in known} | {"capitals=3": [0.5, 0.25, -1.0]}
    start = [0.1, -0.2, 0.3]
    docs = [[], ["w1"], ["nothing", "w7", "w1499"], known, ["ünï", "漢字", 'q"uo\\te', "it's", "𝒳", "", "capitals=3"]]
    bins = [["capitals=3", "digits=0"], [], ["capitals=3"], [], ["w1"]]
    rows = spark.createDataFrame(list(enumerate(zip(bins, docs))), "id int, x struct<_bins:array<string>,_words:array<string>>").select("id", "x.*")
    out = mixing.with_posteriors(rows, start, weights)
    got = {r["id"]: [r[f"p{i}"] for i in range(3)] for r in out.collect()}
    for i, (b, d) in enumerate(zip(bins, docs)):
        logit = np.array(start) + sum([np.array(weights[k]) for k in [x for x in b if x in weights] + [f"word:{w}" for w in d if f"word:{w}" in weights]], np.zeros(3))
        p = np.exp(logit - logit.max())
        assert got[i] == pytest.approx((p / p.sum()).tolist(), abs=1e-12)
    slots = spark.range(1).select(mixing.word_slots({k.removeprefix("word:"): v for k, v in weights.items() if k.startswith("word:")}).alias("s")).first()["s"]
    assert sorted(e["w"] for s in slots for e in s) == sorted(known) and max(map(len, slots)) <= 5
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "word:" not in plan
