"""Queries of chunking and retrieval: benchmark passages asked of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import text as T
from evidentia.operators import chunking as C, retrieval as R
from evidentia.plans.text_queries import LINES_SQL, SPACE, sql_collapse, sql_sentences, sql_tokens
from evidentia.sources.tables import table

ABSTAIN_BELOW, TOP_K = 0.8, 10


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = C.line_blocks(table(spark, sf, "documents"))
    return b.select("document_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("text_md5"), F.col("span.page").alias("page"), F.round("span.y0", 6).alias("y0"), F.round("span.y1", 6).alias("y1"))


BLOCKS_SQL = f"""WITH {LINES_SQL} SELECT doc_id AS document_id, pos::BIGINT AS ord, md5(line) AS text_md5, (pos // 40)::INT AS page, round((pos % 40) / 40.0::DOUBLE, 6) AS y0,
  round((pos % 40) / 40.0::DOUBLE + 0.025::DOUBLE, 6) AS y1 FROM l WHERE length(trim(line)) > 0"""


def _pieces_sql(words: int) -> str:
    return rf"""{LINES_SQL}, w AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^{SPACE}]+') AS ws FROM l WHERE length(trim(line)) > 0),
r AS (SELECT doc_id, pos, ws, line, unnest(CASE WHEN len(ws) > {words} THEN range(0, len(ws)::BIGINT, {words}) ELSE [-1] END) AS s FROM w),
pieces AS (SELECT doc_id, pos, s, CASE WHEN s < 0 THEN line ELSE array_to_string(ws[s + 1:s + {words}], ' ') END AS text, CASE WHEN s < 0 THEN len(ws) ELSE least(len(ws) - s, {words}) END AS n,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos, s) AS i FROM r)"""


def oversize_split(spark: SparkSession, sf: str) -> DataFrame:
    p = C.pieces(C.line_blocks(table(spark, sf, "documents")), 125)
    return p.select("document_id", F.col("ord").cast("long").alias("ord"), F.col("piece").cast("long").alias("piece"), F.col("words").cast("long").alias("words"), F.md5("text").alias("text_md5"))


SPLIT_SQL = f"WITH {_pieces_sql(125)} SELECT doc_id AS document_id, pos::BIGINT AS ord, (greatest(s, 0) // 125)::BIGINT AS piece, n::BIGINT AS words, md5(text) AS text_md5 FROM pieces"


def _chunks(spark: SparkSession, sf: str, target: int, overlap: int) -> DataFrame:
    c = C.pack(C.line_blocks(table(spark, sf, "documents")), target, overlap)
    return c.select("chunk_id", "document_id", F.col("ord").cast("long").alias("ord"), F.col("token_count").cast("long").alias("token_count"), F.size("spans").cast("long").alias("n_spans"),
                    F.col("first_block").cast("long").alias("first_block"), F.col("last_block").cast("long").alias("last_block"), F.array_join(C.pages("spans"), ",").alias("pages"))


def _chunks_sql(target: int, overlap: int) -> str:
    budget, carry = C.budgets(target, overlap)
    return rf"""WITH RECURSIVE {_pieces_sql(budget)},
sums AS (SELECT doc_id, list(n ORDER BY i) AS ns, list(upto ORDER BY i) AS p FROM (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - n AS upto FROM pieces) GROUP BY doc_id),
fold AS (
  SELECT doc_id, 1::BIGINT AS i, 0::BIGINT AS c, 1::BIGINT AS a, ns[1]::BIGINT AS n FROM sums
  UNION ALL
  SELECT doc_id, i, c, a, n FROM (
    SELECT doc_id, i + 1 AS i, CASE WHEN f THEN c + 1 ELSE c END AS c, CASE WHEN NOT f THEN a WHEN kn + w <= {budget} THEN i - k + 1 ELSE i + 1 END AS a,
      CASE WHEN NOT f THEN n + w WHEN kn + w <= {budget} THEN kn + w ELSE w END AS n
    FROM (SELECT *, CASE WHEN k > 0 THEN p[i] + ns[i] - p[i - k + 1] ELSE 0 END AS kn
      FROM (SELECT fold.doc_id, i, c, a, n, ns, p, ns[i + 1] AS w, n + ns[i + 1] > {budget} AS f, len(list_filter(p[a:i], lambda x: x >= p[i] + ns[i] - {carry}))::BIGINT AS k
        FROM fold JOIN sums ON fold.doc_id = sums.doc_id WHERE i < len(ns))))),
g AS (SELECT doc_id, c, min(a) AS a, max(i) AS z FROM fold GROUP BY doc_id, c),
t AS (SELECT g.doc_id, c, string_agg(text, chr(10) ORDER BY i) AS text, count(*) AS n, min(pos) AS first_block, max(pos) AS last_block, list_sort(list_distinct(list(pos // 40))) AS pages
  FROM g JOIN pieces ON g.doc_id = pieces.doc_id AND i BETWEEN a AND z GROUP BY g.doc_id, c)
SELECT doc_id || ':' || lpad(c::VARCHAR, 5, '0') || ':' || left(sha256(doc_id || ':' || c || ':' || text), 12) AS chunk_id, doc_id AS document_id, c AS ord,
  floor(len(regexp_extract_all(text, '[^{SPACE}]+'))::DOUBLE * 1.6::DOUBLE)::BIGINT AS token_count, n AS n_spans, first_block::BIGINT AS first_block, last_block::BIGINT AS last_block, array_to_string(pages, ',') AS pages FROM t"""


def chunks_no_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, 600, 0)


def chunks_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, 200, 80)


def corpus(spark: SparkSession, sf: str, scope: str = "source") -> DataFrame:
    """Whole documents as chunks; their position is their id, their document the source (or language)."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col(scope).alias("document_id"), F.col("doc_id").alias("position"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage, whole."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


DOCS_SQL = f"""d AS (SELECT doc_id, source, lang, text, {sql_tokens("text")} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), u AS (SELECT doc_id, source, lang, len(t) AS length, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, source, lang, length, term, count(*) AS tf FROM u GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
QUESTIONS_SQL = f"""q AS (SELECT item_id AS query_id, text AS passage, text FROM benchmark)"""


def _bm25_sql(text: str, k1: float, b: float, name: str, top: int, scope: str = "") -> str:
    """Common table name(query_id, doc_id, score, rank) over q and DOCS_SQL."""
    return f"""{name}t AS (SELECT query_id, {"scope, " if scope else ""}term, count(*) AS qf FROM (SELECT query_id, {"scope, " if scope else ""}unnest({sql_tokens(text)}) AS term FROM q) GROUP BY ALL),
{name}s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * length / CASE WHEN a > 0 THEN a ELSE 1 END))), 8) AS score
  FROM {name}t JOIN df USING (term) JOIN tf USING (term), stats {f"WHERE tf.{scope} = {name}t.scope" if scope else ""} GROUP BY query_id, doc_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}s WHERE score > 0 QUALIFY rank <= {top})"""


def doc_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return R.frequencies(R.index(corpus(spark, sf)).tokens)


FREQUENCIES_SQL = f"WITH {DOCS_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term"


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.bm25(questions(spark, sf), R.index(corpus(spark, sf)), TOP_K))


BM25_SQL = f"WITH {DOCS_SQL}, {QUESTIONS_SQL}, {_bm25_sql('text', 1.5, 0.75, 'h', 10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM h"


def bm25_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Each question asked of one source only; the statistics stay those of all documents."""
    q = questions(spark, sf).withColumn("document_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return _out(R.bm25(q, R.index(corpus(spark, sf)), TOP_K, scoped=True))


SCOPED_SQL = f"""WITH {DOCS_SQL}, q AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS scope, text FROM benchmark), {_bm25_sql('text', 1.5, 0.75, 'h', 10, 'source')}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM h"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), F.col("vec_id").alias("position"), "embedding")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", "embedding")
    return R.dense(q, v, TOP_K).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("vec_id"), "score")


def _dense_sql(on: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score
  FROM e q JOIN e ON {on} WHERE q.vec_id % 50 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


def dense_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", "embedding")
    return R.dense(q, v, TOP_K, scoped=True).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("vec_id"), "score")


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return R.fused(R.bm25_each(questions(spark, sf), R.index(corpus(spark, sf)), [(R.K1, R.B), (0.9, 0.2)], R.DEPTH), TOP_K)


def rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_fused(spark, sf))


RRF_SQL = f"""WITH {DOCS_SQL}, {QUESTIONS_SQL}, {_bm25_sql('text', 1.5, 0.75, 'h', 50)}, {_bm25_sql('text', 0.9, 0.2, 'g', 50)},
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT query_id, doc_id, rank FROM h UNION ALL SELECT query_id, doc_id, rank FROM g) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank, doc_id, round(score, 6) AS score FROM f QUALIFY rank <= 10"""


def _best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q, c = questions(spark, sf), corpus(spark, sf)
    hits = R.with_text(R.bm25(q, R.index(c), 3), c)
    return q, R.best_sentences(q, hits)


def best_sentence(spark: SparkSession, sf: str) -> DataFrame:
    _, best = _best(spark, sf)
    return best.select("query_id", F.col("chunk_id").alias("doc_id"), "sentence", F.round("support", 6).alias("support"))


BEST_SQL = f"""{DOCS_SQL}, {QUESTIONS_SQL}, {_bm25_sql('text', 1.5, 0.75, 'h', 3)},
w AS (SELECT query_id, list_distinct(list_filter({sql_tokens("text")}, lambda t: length(t) > 3)) AS terms FROM q),
s AS (SELECT query_id, rank, doc_id, {sql_sentences("d.text")} AS ss FROM h JOIN d USING (doc_id)),
e AS (SELECT query_id, rank, doc_id, generate_subscripts(ss, 1) AS pos, {sql_collapse("unnest(ss)")} AS sentence FROM s),
v AS (SELECT query_id, rank, doc_id, pos, sentence, terms, len(list_intersect(terms, list_distinct({sql_tokens("sentence")})))::DOUBLE / len(terms) AS support FROM e JOIN w USING (query_id) WHERE length(sentence) >= 20 AND len(terms) > 0),
best AS (SELECT query_id, doc_id, sentence, support FROM v WHERE support > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY support DESC, rank, pos) = 1)"""
BEST_SENTENCE_SQL = f"WITH {BEST_SQL} SELECT query_id, doc_id, sentence, round(support, 6) AS support FROM best"


def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """How far each document rests on the next benchmark passage."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"))
    b = table(spark, sf, "benchmark")
    n = b.agg((F.max("item_id") + 1).alias("n"))
    got = d.join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(b.select("item_id", "text"), "item_id")
    return got.select("doc_id", "item_id", F.round(T.grounding(F.col("answer"), F.col("text")), 6).alias("grounding"))


GROUNDING_SQL = f"""WITH n AS (SELECT max(item_id) + 1 AS n FROM benchmark), d AS (SELECT doc_id, text AS answer, doc_id % n AS item_id FROM documents, n),
t AS (SELECT doc_id, item_id, list_distinct(list_filter({sql_tokens("answer")}, lambda t: length(t) > 3)) AS terms, {sql_tokens("text")} AS p FROM d JOIN benchmark USING (item_id))
SELECT doc_id, item_id, CASE WHEN len(terms) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(terms, list_distinct(p)))::DOUBLE / len(terms), 6) END AS grounding FROM t"""


def passage_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer with its citation, or an abstention, for every question: the best sentence if its support is ABSTAIN_BELOW or more."""
    q, best = _best(spark, sf)
    ok = F.coalesce(F.col("support"), F.lit(0.0)) >= ABSTAIN_BELOW
    return q.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.when(ok, "answered").otherwise("abstained").alias("status"), F.when(ok, F.col("sentence")).otherwise("").alias("text"), F.col("chunk_id").alias("cited_doc"),
        F.left("sentence", F.lit(300)).alias("quote"), F.bround(F.coalesce(F.col("support"), F.lit(0.0)), 3).alias("confidence"))


ANSWERS_SQL = f"""WITH {BEST_SQL} SELECT q.query_id, CASE WHEN support >= 0.8::DOUBLE THEN 'answered' ELSE 'abstained' END AS status, CASE WHEN support >= 0.8::DOUBLE THEN sentence ELSE '' END AS text,
  doc_id AS cited_doc, left(sentence, 300) AS quote, round_even(coalesce(support, 0), 3)::DOUBLE AS confidence FROM q LEFT JOIN best USING (query_id)"""

QUERIES = {
    "blocks": (blocks, BLOCKS_SQL),
    "oversize_split": (oversize_split, SPLIT_SQL),
    "chunks_no_overlap": (chunks_no_overlap, _chunks_sql(600, 0)),
    "chunks_overlap": (chunks_overlap, _chunks_sql(200, 80)),
    "doc_frequencies": (doc_frequencies, FREQUENCIES_SQL),
    "bm25_topk": (bm25_topk, BM25_SQL),
    "bm25_scoped_topk": (bm25_scoped_topk, SCOPED_SQL),
    "dense_topk": (dense_topk, _dense_sql("true")),
    "dense_scoped_topk": (dense_scoped_topk, _dense_sql("q.label = e.label")),
    "rrf_topk": (rrf_topk, RRF_SQL),
    "best_sentence": (best_sentence, BEST_SENTENCE_SQL),
    "grounding": (grounding, GROUNDING_SQL),
    "passage_answers": (passage_answers, ANSWERS_SQL),
}
