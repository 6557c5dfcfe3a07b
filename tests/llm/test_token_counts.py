import random

import pytest

from evidentia.llm.token_counts import VOCABULARY_FILE, _encoder, op5_token_counts, token_counts

TEXTS = ["one line", "two\nlines here", "", None, "\n\n", "ünï 漢字\n🙂 end\n", "x " * 5000, "two\nlines here"]


def brute(encoding, text, start, end, rule):
    """Tokens of the code points start..end, token by token."""
    lo, hi = (len(text[:i].encode()) for i in (start, end))
    at, got = 0, 0.0
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        if rule == "start":
            got += lo <= at < hi
        elif rule == "end":
            got += lo < at + n <= hi
        else:
            got += max(0, min(hi, at + n) - max(lo, at)) / n
        at += n
    return got


@pytest.mark.parametrize("rule", ["start", "end", "proportional"])
def test_sections_equal_brute_force(spark, rule):
    encoding, _ = _encoder(open(VOCABULARY_FILE, "rb").read())
    rng = random.Random(3)
    rows = []
    for i, t in enumerate(TEXTS):
        n = len(t or "")
        rows.append((i, t, [tuple(sorted((rng.randrange(n + 1), rng.randrange(n + 1)))) for _ in range(4)] + [(0, n), (-3, n + 9)], "k"))
    rows += [(50, "no sections", [], "k"), (51, "no sections", None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cuts array<struct<start:int,end:int>>, key string")
    got = token_counts(df, sections="cuts", rule=rule).collect()
    assert len(got) == 6 * len(TEXTS)
    for r in got:
        t = TEXTS[r["doc_id"]] or ""
        assert r["n_tokens"] == pytest.approx(brute(encoding, t, r["start"], r["end"], rule)), (r, rule)
        assert r["doc_tokens"] == len(encoding.encode_ordinary(t))


def test_lines_tile_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for rule in ("start", "proportional"):
        sums = {}
        for r in token_counts(df, rule=rule).collect():
            sums.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["n_tokens"]
        assert set(sums) == set(range(len(TEXTS))) and all(a == pytest.approx(b) for a, b in sums.values())
    with pytest.raises(ValueError):
        token_counts(df, rule="middle")
    assert token_counts(df.limit(0)).count() == 0


def test_query_covers_every_document(spark, sf):
    got = op5_token_counts(spark, sf)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()
