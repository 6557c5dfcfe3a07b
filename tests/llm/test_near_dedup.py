import random
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import near_dedup
from evidentia.llm.common import placed
from evidentia.llm.near_dedup import COMMON, Shingler, Weights, common_shingles, keep_one, near_duplicates, sketch, weighted_jaccard

VOCAB = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(VOCAB)
    return out


def test_sketch_agrees_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    s = np.sort(rng.integers(1, 2**63, 400, dtype=np.uint64))
    a, b = (s[:300], rng.uniform(0.5, 4, 300)), (s[100:], rng.uniform(0.5, 4, 300))
    want = weighted_jaccard(a, b)
    got = (sketch(*a, 4000) == sketch(*b, 4000)).mean()
    assert got == pytest.approx(want, abs=0.03)
    assert (sketch(*a, 50) == sketch(a[0][::1].copy(), a[1].copy(), 50)).all()


def test_common_shingles_are_exact(spark):
    rng = random.Random(2)
    shared = rng.choices(VOCAB, k=9)
    rows = [(i, " ".join(rng.choices(VOCAB, k=30) + (shared if i % 4 else []))) for i in range(80)]
    s, idf = common_shingles(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    one = Shingler()
    counts = {}
    for _, t in rows:
        for h in one(t)[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    want = {h: np.log(80 / n) / np.log(1 / COMMON) for h, n in counts.items() if n > COMMON * 80}
    assert len(want) == 5 and dict(zip(s.tolist(), idf.tolist())) == pytest.approx(want)


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "TEXTS", 5)
    rng = random.Random(3)
    texts = []
    for g in range(10):
        base = rng.choices(VOCAB, k=rng.choice((60, 120, 300)))
        chain = [base]
        for _ in range(rng.choice((0, 1, 12))):
            chain.append(edited(rng, rng.choice(chain), rng.choice((1, 2, 3))))
        texts += [" ".join(w) for w in chain]
    texts += ["", "  ", None, "one two", "one two", "ONE two!", "solo", texts[0], texts[0]]
    docs = spark.createDataFrame([(i if i % 11 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class string")
    rows = {r["row"]: r for r in near_duplicates(docs.select(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"), "doc_id", "text")).collect()}
    assert len(rows) == len(texts)
    one, flat = Shingler(), Weights(np.zeros(0, np.uint64), np.zeros(0))
    ids = sorted(rows)
    sets = []
    for t in texts:
        s, c = one(t or "")
        sets.append((s, flat(s, c)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or len(sets[i][0]) and len(sets[j][0]) and weighted_jaccard(sets[i], sets[j]) >= 0.8:
            root[find(j)] = find(i)
    want = [find(i) for i in range(len(texts))]
    classes = [rows[u]["class"] for u in ids]
    for i, j in combinations(range(len(texts)), 2):
        assert (want[i] == want[j]) == (classes[i] == classes[j]), (i, j)
    for c in set(classes):
        mine = [rows[u] for u in ids if rows[u]["class"] == c]
        assert sum(r["kept"] for r in mine) == 1 and {r["n_class"] for r in mine} == {len(mine)}
        known = [r["doc_id"] for r in mine if r["doc_id"] is not None]
        assert next(r["doc_id"] for r in mine if r["kept"]) == (min(known) if known else None)
    left = keep_one(docs)
    assert left.columns == docs.columns and left.count() == len(set(classes))


def test_classes_by_the_inverse_frequency_of_every_shingle(spark, monkeypatch):
    """Texts that share a passage of many others and differ in rare words are alike by plain counts, but not by tf-idf."""
    monkeypatch.setattr(near_dedup, "LOT", 4)
    rng = random.Random(5)
    passage = rng.choices(VOCAB, k=60)
    texts = [" ".join([*passage, *rng.choices(VOCAB, k=5)]) for _ in range(30)]  # 56 of 66 shingles of two are shared: 0.85
    for _ in range(25):
        base = rng.choices(VOCAB, k=150)
        texts += [" ".join(base), " ".join(edited(rng, base, 2))]
    texts += ["", None, texts[0], "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    one = Shingler()
    found = [one(t or "") for t in texts]
    shingles, n = np.unique(np.concatenate([f[0] for f in found]), return_counts=True)
    sets = [(s, c * (1 + np.log((1 + len(texts)) / (1 + n[np.searchsorted(shingles, s)])))) for s, c in found]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = 0
    for i, j in combinations(range(len(texts)), 2):
        flat += len(sets[i][0]) > 0 and weighted_jaccard((sets[i][0], found[i][1]), (sets[j][0], found[j][1])) >= 0.8
        if (texts[i] or "") == (texts[j] or "") or len(sets[i][0]) and len(sets[j][0]) and weighted_jaccard(sets[i], sets[j]) >= 0.8:
            root[find(j)] = find(i)
    want = [find(i) for i in range(len(texts))]
    assert flat > 400 and len(set(want)) > 50
    names = {tuple(sorted(i for i, w in enumerate(want) if w == c)) for c in set(want)}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(min(c) for c in names)
    rows = placed(docs, "docs").select("file", "row", "doc.doc_id", "doc.text")
    classes = {}
    for r in near_duplicates(rows, every=True).collect():
        classes.setdefault(r["class"], []).append(r["doc_id"])
    assert {tuple(sorted(c)) for c in classes.values()} == names


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert keep_one(docs).count() == 0
    odd = spark.createDataFrame([(1, "a b c", "u", 3, "x"), (2, "a b c", "v", 4, "y")], "doc_id long, text string, uid string, row int, kept string")
    assert [tuple(r) for r in keep_one(odd).collect()] == [(1, "a b c", "u", 3, "x")]


def test_words_are_those_of_the_pattern():
    one = Shingler()
    for a, b in (("Don't “stop” me, now: a_b…", "don t stop me now a b"), ("Größe äöü ñandú", "größe äöü ñandú"), ("3×4÷2", "3 4 2"), ("हिन्दी में text", " ".join(near_dedup._WORD.findall("हिन्दी में text")))):
        assert one(a)[0].tolist() == one(b)[0].tolist()
    assert one("a" * 40 + "b" + "c" * 40)[0].tolist() != one("a" * 40 + "d" + "c" * 40)[0].tolist()


def test_lots_times_parts_grow_no_faster_than_the_shingles():
    for size in (10**8, 10**9, 10**11, 3 * 10**12):
        documents = size // 3300
        parts = 2 * max(12, size // 4 // near_dedup.TASK_SHINGLES)
        rows = near_dedup.lot_rows(size, documents, parts)
        assert rows * 3300 <= near_dedup.LOT_BYTES
        if rows * 3300 < near_dedup.LOT_BYTES * 0.99:
            assert documents / rows * parts * near_dedup.FULL <= size / near_dedup.SHINGLE_BYTES * 1.01
    assert near_dedup.lot_rows(0, 0, 24) >= 1
    assert near_dedup.lot_rows(100 << 30, 100, 10_000) == 1  # texts larger than a lot may be


@pytest.mark.parametrize("held", [2_000_000, 40])
def test_frequencies_of_lots_sent_in_pieces_are_exact(spark, monkeypatch, held):
    monkeypatch.setattr(near_dedup, "LOT_BYTES", 1500)  # lots of a few rows
    monkeypatch.setattr(near_dedup, "HELD", held)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(VOCAB[:9], k=rng.randrange(0, 40))) for _ in range(120)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "file long, row long, text string").coalesce(2)
    got, of = near_dedup.frequencies(rows, len(texts))
    one, counts, lots = Shingler(), {}, {}
    for r in rows.select("row", "text", of.alias("lot")).collect():
        for s in one(r["text"])[0].view(np.int64).tolist():
            counts[s] = counts.get(s, 0) + 1
            lots.setdefault(r["lot"], set()).add(s)
    assert len(lots) > 5
    found = {}
    for r in got.collect():
        for s, n in zip(r["shingles"], r["n"], strict=True):
            assert n == counts[s]
            found.setdefault(r["lot"], set()).add(s)
    assert found == {k: w for k, v in lots.items() if (w := {s for s in v if counts[s] > 1})}


def test_texts_of_ids_by_broadcast_and_by_shuffle(spark, monkeypatch):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "text string")
    ids = texts.where("text < 'c'").distinct().select(near_dedup.text_id(F.col("text")).alias("text_id"), F.col("text").alias("root"))
    for most in (2_000_000, 0):
        monkeypatch.setattr(near_dedup, "IDS", most)
        assert sorted((r["text"], r["root"]) for r in near_dedup.texts_of(texts, ids).collect()) == [("a", "a"), ("b", "b")]


def test_pairs_of_a_crowded_bucket_are_never_rows(spark):
    """Texts near to all others of their bucket, but linked to few: what goes from task to task grows as they do, not as their pairs."""
    n = 400
    rng = np.random.default_rng(4)
    mark = rng.integers(0, 2**62, 64)
    marks = [np.where((np.arange(64) % 4 == 0) & (np.arange(64) > 3), rng.integers(0, 2**62, 64), mark) for _ in range(n)]  # any two agree in 49 of 64 and one band
    shared = " ".join(rng.choice(VOCAB, 300))
    texts = [f"{shared} " + " ".join(f"w{i // 2}x{k}y" for k in range(100)) + f" end{i}" for i in range(n)]  # two and two are links
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string").select("row", "text", near_dedup.text_id(F.col("text")).alias("id"))
    at = {r["row"]: r["id"] for r in rows.select("row", "id").collect()}
    held = spark.createDataFrame([(at[i], None, m.tolist()) for i, m in enumerate(marks)], "id binary, n array<int>, mark array<long>")
    open_ = spark.createDataFrame([(1, at[i], at[i], at[0], m.tolist()) for i, m in enumerate(marks)], "key long, id binary, root binary, main binary, mark array<long>")
    written = {}

    def count(df, name):
        out = staged(df, name)
        written[name] = sum(len(v) if isinstance(v, (list, tuple)) else 1 for r in out.drop("text", "mark", "n").collect() for v in r)
        return out

    one, flat = Shingler(), Weights(np.zeros(0, np.uint64), np.zeros(0))

    def weights():
        return lambda text, _: (lambda s, c: (s, flat(s, c)))(*one(text))

    staged = near_dedup.staged
    near_dedup.staged = count
    try:
        links = near_dedup.crossing(open_, rows.select("text"), held, weights, 0.8, 4)
        got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links.collect()}
    finally:
        near_dedup.staged = staged
    assert got == {frozenset((bytes(at[i]), bytes(at[i + 1]))) for i in range(0, n, 2)}
    assert max(written.values()) <= 10 * n
