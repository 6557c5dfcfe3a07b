"""Generators that need an outside model: the client or embedder is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidentia.functions import text as T

PASSAGES = 5
SYSTEM = "Answer from the numbered passages alone, as a JSON object with the keys answer and passage."


def generate(questions: DataFrame, hits: DataFrame, complete: Callable[[str, str], str], passages: int = PASSAGES) -> DataFrame:
    """query_id, text, chunk_id, support, failed of questions(query_id, text) and hits(query_id, rank, chunk_id, text).

    complete(system, user) is called once for each question with hits, in the tasks; an exception, a reply without an answer, or a passage number
    that was not given is no answer: empty text, support 0; failed says that it was an exception. Support is the share of the answer's terms in its passage.
    """
    near = hits.where(F.col("rank") <= passages).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("h"))
    asked = questions.select("query_id", F.col("text").alias("question")).join(near, "query_id", "left").withColumn("h", F.coalesce("h", F.array().cast(near.schema["h"].dataType)))
    asked = asked.withColumn("prompt", F.when(F.size("h") > 0, T.prompt(F.col("question"), F.transform("h", lambda x: x["text"]))))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            out = []
            for p in prompts:
                try:
                    out.append((complete(SYSTEM, p) if p else "", False))
                except Exception:  # noqa: BLE001  a client that fails gives no answer, and the row says so
                    out.append(("", True))
            yield pd.DataFrame(out, columns=["said", "failed"])

    reply = F.pandas_udf(run, "said string, failed boolean")(F.col("prompt"))
    got = asked.withColumn("reply", reply).withColumn("r", T.parse_reply(F.col("reply.said")))
    n = F.col("r.passage")
    given = (F.col("r.answer") != "") & (n >= 1) & (n <= F.size("h"))
    cited = F.get("h", n - 1)
    return got.select("query_id", F.when(given, F.col("r.answer")).otherwise("").alias("text"), F.when(given, cited["chunk_id"]).alias("chunk_id"),
                      F.when(given, T.grounding(F.col("r.answer"), cited["text"])).otherwise(0.0).alias("support"), F.col("reply.failed").alias("failed"))


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], prefix: str = "", window: int | None = None, count: Callable[[str], int] | None = None) -> DataFrame:
    """texts(chunk_id, text) with embedding array<float>; encode runs in the tasks, batch by batch. A text of window subwords or more (by count) is an error."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            told = [prefix + t for t in x["text"]]
            if window and count and (worst := max(map(count, told), default=0)) >= window:
                raise ValueError(f"a text has {worst} subwords, the model's window is {window}")
            x["embedding"] = encode(told)
            yield x

    return texts.mapInPandas(run, f"{kind}, embedding array<float>")
