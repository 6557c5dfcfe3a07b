import hashlib
import random

from pyspark.sql import functions as F

from evidentia.llm import fingerprint
from evidentia.llm.fingerprint import added, likeness, op6_fingerprints, text_of, vector, with_next

TEXTS = ["one. two! three", "three\none. two!", "a\nb\nc", "c\na\nb", "a\nb", "", None, "  \n ", "ünï 🙂. more\nlast", "word " * 3000, "a. \n b", " b\na. "]


def fingerprints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text_of(vector(F.col("t"))).alias("f")).collect()
    return [r["f"] for r in sorted(rows, key=lambda r: r["i"])]


def test_order_does_not_matter_and_content_does(spark):
    f = fingerprints(spark, TEXTS)
    assert f[2] == f[3] and f[5] == f[6] == f[7]
    assert f[10] == f[11]
    assert len({f[0], f[2], f[4], f[5], f[8], f[9]}) == 6


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([("a one. b two\nc", "d\ne. f"), ("", "x\nx"), ("x", "")], "a string, b string")
    whole = F.concat_ws("\n", "a", "b")
    r = df.select((added(vector(F.col("a")), F.col("b")) == vector(whole)).alias("put"), (added(vector(whole), F.col("b"), -1) == vector(F.col("a"))).alias("taken")).collect()
    assert all(x["put"] and x["taken"] for x in r)


def test_likeness_follows_the_shared_pieces(spark):
    rng = random.Random(1)
    piece = lambda: " ".join(rng.choice("abcdefgh") * 4 for _ in range(6))
    base = [piece() for _ in range(20)]
    rows = [("\n".join(base), "\n".join(base[:k] + [piece() for _ in range(20 - k)]), k / (40 - k)) for k in (20, 18, 10, 2)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select("want", likeness(vector(F.col("a")), vector(F.col("b"))).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 0.2
    assert df.select(likeness(vector(F.lit("")), vector(F.lit(None).cast("string"))).alias("x")).first()["x"] == 1.0


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i * 700, TEXTS[i % len(TEXTS)]) for i in range(12)] + [(-5, "low"), (1400, "a\nb\nc")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in op6_fingerprints(spark, str(tmp_path)).collect())
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    ways = []
    for a, b in ((6, 7), (7, 6)):  # two rows hold doc_id 1400; the order of ties is by a hash
        way = [(d, t) for d, t in order]
        at = [i for i, (d, _) in enumerate(way) if d == 1400]
        if (a, b) == (7, 6):
            way[at[0]], way[at[1]] = way[at[1]], way[at[0]]
        out = []
        for (d, t), (_, u) in zip(way, way[1:] + way[:1]):
            half = len(t) // 2
            out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
        ways.append(sorted(out))
    assert got in ways


def test_next_rows_with_far_out_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS", 4)
    rng = random.Random(5)
    ids = rng.sample(range(1000), 60) + [10**17, -(10**17)] + [None] * 9
    rows = [(i, f"text {k}", "clash") for k, i in enumerate(ids)]
    got = {r["text"]: r["next_text"] for r in with_next(spark.createDataFrame(rows, "doc_id long, text string, _tie string").repartition(3), ["text"]).collect()}
    assert len(got) == len(rows)
    known = [t for _, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])]
    assert [got[t] for t in known[:-1]] == known[1:]
    at, seen = got[known[-1]], []
    while at != known[0]:  # the null ids, each once, and back to the first
        seen.append(at)
        at = got[at]
    assert sorted(seen) == sorted(t for i, t, _ in rows if i is None)


def test_fingerprints_and_likenesses_equal_a_plain_sum(spark):
    """The counter and the likeness against sets of sentences; equality of lanes against one sum in Python over the parts' own fingerprints."""
    texts = ["A b. C d!\nE f", "E f\nA b. C d!", "A b.\nE f", "x\nx\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = {r["t"]: r["v"] for r in df.select("t", vector(F.col("t")).alias("v")).collect()}
    parts = {r["p"]: r["v"] for r in df.select(F.explode(F.split("t", "\n")).alias("p")).select("p", vector(F.col("p")).alias("v")).distinct().collect()}
    masks = [(1 << 32) - 1] + [(1 << 48) - 1] * fingerprint.DENSE + [(1 << 32) - 1] * (fingerprint.LEVELS * fingerprint.SPARSE)
    for t in texts:
        assert whole[t] == [sum(lane) & m for lane, m in zip(zip(*(parts[p] for p in t.split("\n"))), masks)]
    assert whole[texts[0]] == whole[texts[1]] and whole[texts[0]][0] == 3


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_fingerprints(spark, str(tmp_path)).count() == 0
