"""Subword lattice likelihood of whole documents.

Every word, with a space mark before it, is a lattice over an existing vocabulary's pieces
(lattice.py), weighted by the vocabulary's own scores. A forward recursion in log space gives
the word's marginal probability over all segmentations; no single one is chosen. A text is its
words in order and an end: score = (1 - stop)^n stop prod_w lattice(w), with stop from the
training documents' lengths.

word_score goes on from there: the training words are one more edge of the lattice, from a
word's start to its end: P(w) = max(c - D, 0) / N + (D V / N) lattice(w), absolute discounting
with the lattice as the lower order. The document's probability is the marginal of an urn that
starts with ALPHA draws' weight of P: a word that came before in the document is likelier to
come again, and the order of words doesn't matter:
P(text) = stop (1 - stop)^n prod_w prod_{j < n_w} (ALPHA P(w) + j) / prod_{i < n} (ALPHA + i).

Words are counted over all documents. The at most 1 / HEAVY words that make up a share of
HEAVY or more of all tokens go to the tasks as a table of bounded size; all other words meet
their documents in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.llm.common import remainder, staged, table
from evidentia.llm.lattice import MODEL_FILE, SPACE, likelihoods, vocabulary

ALPHA, HEAVY, FOLDS = 1000.0, 1 / 40_000, 10
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 400_000
_LN10 = math.log(10)


def tokens(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word binary, c (in training rows), n (in all rows) from docs(text, train boolean)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> Iterator[pd.DataFrame]:
            for train, held in seen.items():
                if held:
                    n = np.fromiter(held.values(), np.int64, len(held))
                    yield pd.DataFrame({"word": list(held), "c": n * train, "n": n})
                    held.clear()

        for x in batches:
            for text, train in zip(x["text"], x["train"], strict=True):
                seen[bool(train)].update(tokens(text))
                if len(seen[True]) + len(seen[False]) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return docs.select("text", "train").mapInPandas(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _spelt(words: pd.Series) -> list[str]:
    return [SPACE + bytes(w).decode("utf-8", "surrogatepass") for w in words]


def score_documents(docs: DataFrame, vocabulary_file: str = MODEL_FILE, alpha: float = ALPHA) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score of docs(doc_id, text, held_out).

    Rows with held_out false (or null) are the training rows. Null texts count as empty; an empty text has its end
    as the only token. score is the lattice alone; word_score has whole-word edges and the urn as well. Repeated rows give
    repeated rows, an empty table none. Other columns don't matter. Scores are log10 of the text's probability.
    """
    spark = docs.sparkSession
    with open(vocabulary_file, "rb") as f:
        model = f.read()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~F.coalesce("held_out", F.lit(False))).alias("train"))
    counted = staged(count_words(rows), "words")
    got = counted.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("n1"),
                                      F.count(F.when(F.col("c") == 2, 1)).alias("n2")).first()
    n_words, v_words, n1, n2 = got["n"] or 0, got["v"], got["n1"], got["n2"]
    ends = rows.where("train").count()
    n, v = n_words + ends, v_words + (ends > 0)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(shared.value)
        scores = vocab.rank_scores()
        for x in batches:
            x["lattice"] = likelihoods(vocab, scores, _spelt(x["word"]))
            yield x

    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    left = discount * v_words / n_words if n_words else 1.0
    priced = counted.mapInPandas(measure, "word binary, c long, n long, lattice double")
    # exp() underflows for very long words: there the lattice's own logarithm stands
    p = F.greatest(F.col("c") - discount, F.lit(0.0)) / max(1, n_words) + left * F.exp("lattice")
    priced = staged(priced.withColumn("log_p", F.when(p > 1e-290, F.log(p)).otherwise(F.col("lattice") + math.log(left))), "priced")
    total = priced.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = priced.where(F.col("n") >= max(1.0, HEAVY * total)).select("word", "c", "lattice", "log_p").collect()  # 1 / HEAVY rows at most
    known = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"], r["lattice"], r["log_p"]) for r in heavy})
    end_base = math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
    stop = (ends + 0.5) / (n + 1)
    scale = n + 0.1 * (v + 1)

    columns = ["uid", "doc_id", "word", "k", "n_tokens", "n_known", "base", "lattice", "urn"]
    kind = docs.schema["doc_id"].dataType
    schema = f"uid long, doc_id {kind.simpleString()}, word binary, k long, n_tokens long, n_known long, base double, lattice double, urn double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the heavy words give, and one for each other word of it."""
        held = known.value

        def out(cells: list[tuple], names: list[str]) -> pa.RecordBatch:
            got = dict(zip(names, zip(*cells, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(len(cells), f.type) for f in arrow], schema=arrow)

        for x in batches:
            heads, rest = [], []
            for uid, doc, text in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                words = tokens(text)
                m, base, lattice, urn, seen = len(words), end_base, 0.0, 0.0, int(ends > 0)
                for w, k in Counter(words).items():
                    hit = held.get(w)
                    if hit is None:
                        rest.append((uid, w, k))
                        continue
                    c, lat, log_p = hit
                    base += k * math.log10((c + 0.1) / scale)
                    lattice += k * lat
                    urn += _urn(alpha, log_p, k)
                    seen += k * (c > 0)
                fixed = math.log(stop) + m * math.log1p(-stop)
                heads.append((uid, doc, m + 1, seen, base, lattice + fixed, urn + fixed - (math.lgamma(alpha + m) - math.lgamma(alpha))))
                if len(rest) >= 100_000:
                    yield out(rest, ["uid", "word", "k"])
                    rest = []
            if rest:
                yield out(rest, ["uid", "word", "k"])
            if heads:
                yield out(heads, [c for c in columns if c not in ("word", "k")])

    parts = staged(rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text").mapInArrow(weigh, schema), "parts")
    rare = parts.where("word IS NOT NULL").select("uid", "word", "k").join(priced.select("word", "c", "lattice", "log_p"), "word")
    start = F.exp("log_p") * alpha
    more = F.aggregate(F.sequence(F.lit(1), F.col("k") - 1), F.lit(0.0), lambda s, j: s + F.log(start + j))
    urn = F.log(F.lit(alpha)) + F.col("log_p") + F.when(F.col("k") > 1, more).otherwise(F.lit(0.0))
    rest = rare.select("uid", F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"),
                       F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"),
                       (F.col("k") * F.log10((F.col("c") + 0.1) / scale)).alias("base"), (F.col("k") * F.col("lattice")).alias("lattice"), urn.alias("urn"))
    heads = parts.where("word IS NULL").select(*rest.columns)
    found = heads.unionByName(rest).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lattice", "urn")])
    return found.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                        F.col("base").alias("base_score"), (F.col("lattice") / _LN10).alias("score"), (F.col("urn") / _LN10).alias("word_score"))


def _urn(alpha: float, log_p: float, k: int) -> float:
    """log prod_{j < k} (alpha p + j)."""
    first = math.log(alpha) + log_p
    if k == 1:
        return first
    a = math.exp(first)
    return first + math.lgamma(a + k) - math.lgamma(a + 1)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text, learned from the documents outside the held-out tenth.

    score is the learned model's, score_documents' word_score; lattice_score is the lattice alone, which learns nothing but lengths.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", FOLDS) == 0).alias("held_out"))
    got = score_documents(docs)
    own = [c for c in got.columns if c not in ("score", "word_score")]
    return got.select(*own, F.col("word_score").alias("score"), F.col("score").alias("lattice_score"))
