"""The whole answer to a batch of questions: ledger where it names a tagged figure, else passages, else an abstention."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from evidentia.operators import ledger as L, retrieval as R

ABSTAIN_BELOW, TOP_K = 0.8, 10
MAX_QUESTION, MAX_TOP_K = 1000, 50


class Corpus(NamedTuple):
    """chunks(chunk_id, document_id, position, text), facts, and the concept index. An empty corpus has empty tables."""

    chunks: DataFrame
    facts: DataFrame
    wordings: DataFrame
    periods: DataFrame
    index: R.Index


def build(chunks: DataFrame, facts: DataFrame, labels: DataFrame) -> Corpus:
    """The corpus of chunks, facts and labels(document_id, concept, text); write its tables to ask it more than once."""
    wordings, periods = L.concept_index(facts, L.pool_labels(labels), labels)
    return Corpus(chunks, facts, wordings, periods, R.index(chunks))


def checked(questions: DataFrame, top_k: int) -> DataFrame:
    """questions; a text of no or over MAX_QUESTION characters is an error, as is a top_k out of range."""
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be from 1 to {MAX_TOP_K}")
    fine = F.length("text").between(1, MAX_QUESTION)
    return questions.withColumn("text", F.when(F.coalesce(fine, F.lit(False)), F.col("text")).otherwise(F.raise_error(F.lit(f"a question has 1 to {MAX_QUESTION} characters"))))


def answer(questions: DataFrame, corpus: Corpus, top_k: int = TOP_K, abstain_below: float = ABSTAIN_BELOW) -> DataFrame:
    """query_id, status, route, text, value, period, chunk_id, confidence, reason of questions(query_id, document_id, text).

    A document without chunks and facts is unknown: status abstained, route none.
    """
    q = checked(questions, top_k)
    known = corpus.chunks.select("document_id").union(corpus.facts.select("document_id")).distinct().withColumn("_known", F.lit(True))
    asked = q.join(known, "document_id", "left")
    decisions = L.route(asked.where("_known"), corpus.wordings, corpus.periods)
    told = L.answer(decisions, corpus.facts).select("query_id", "status", F.lit("ledger").alias("route"), "text", F.col("value").cast("string").alias("value"), "period", F.lit(None).cast(corpus.chunks.schema["chunk_id"].dataType).alias("chunk_id"), "confidence", "reason")
    rest = asked.where("_known").join(decisions.where("route = 'passage'").select("query_id", "reason"), "query_id")
    hits = R.with_text(R.bm25(rest.select("query_id", "document_id", "text"), corpus.index, top_k, scoped=True), corpus.chunks)
    best = R.best_sentences(rest.select("query_id", "text"), hits)
    support = F.coalesce("support", F.lit(0.0))
    ok = support >= abstain_below
    none = F.lit(None).cast("string")
    passages = rest.select("query_id", "reason").join(best, "query_id", "left").select(
        "query_id", F.when(ok, "answered").otherwise("abstained").alias("status"), F.lit("passage").alias("route"), F.when(ok, F.col("sentence")).otherwise("").alias("text"), none.alias("value"), none.alias("period"), "chunk_id",
        F.bround(support, 3).alias("confidence"), F.when(ok, "").otherwise(F.col("reason")).alias("reason"))
    unknown = asked.where("_known IS NULL").select("query_id", F.lit("abstained").alias("status"), F.lit("none").alias("route"), F.lit("").alias("text"), none.alias("value"), none.alias("period"),
                                                   F.lit(None).cast(corpus.chunks.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("confidence"), F.concat(F.lit("unknown document '"), F.col("document_id").cast("string"), F.lit("'")).alias("reason"))
    return told.unionByName(passages).unionByName(unknown)


def summaries(corpus: Corpus) -> DataFrame:
    """document_id, tagged_facts, chunks of every document."""
    f = corpus.facts.groupBy("document_id").agg(F.count("*").alias("tagged_facts"))
    c = corpus.chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return c.join(f, "document_id", "full").select("document_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tagged_facts", "chunks")])
