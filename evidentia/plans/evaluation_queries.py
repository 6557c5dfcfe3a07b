"""Queries of evaluation: facts from order lines, hits from benchmark passages, outcomes from labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import text as T
from evidentia.operators import evaluation as E, ledger as L, retrieval as R
from evidentia.plans.ledger_queries import FACTS_SQL, PROSE_PAIRS_SQL, _reviewed, _tagged, facts
from evidentia.plans.retrieval_queries import DOCS_SQL, QUESTIONS_SQL, _bm25_sql, corpus, questions
from evidentia.plans.text_queries import sql_collapse
from evidentia.sources.tables import table


def _own(f: DataFrame) -> DataFrame:
    """Every third concept has a wording of the document's own, by its name's length."""
    return f.where(F.length("concept") % 3 == 0).select("document_id", "concept", F.concat(F.lit("eigene "), "concept").alias("text")).distinct()


def _pool(f: DataFrame) -> DataFrame:
    return f.where(F.length("concept") % 3 == 1).select("concept", F.col("concept").alias("text")).distinct()


def questions_exact(spark: SparkSession, sf: str) -> DataFrame:
    f = _tagged(spark, sf)
    return E.exact_questions(f, _own(f), _pool(f)).withColumn("value", F.col("value").cast("decimal(18,2)"))


EXACT_SQL = f"""WITH {FACTS_SQL}, u AS (SELECT * FROM f WHERE length(concept) % 3 < 2 QUALIFY row_number() OVER (PARTITION BY document_id, concept, period ORDER BY seq) = 1),
s AS (SELECT *, CASE WHEN length(concept) % 3 = 0 THEN 'eigene ' || concept ELSE concept END AS subject FROM u QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY md5('20260730' || fact_id), fact_id) <= 40)
SELECT document_id || ':ef:' || fact_id AS question_id, document_id, 'Wie hoch war ' || subject || ' zum ' || strftime(period[9:]::DATE, '%d.%m.%Y') || '?' AS text, fact_id, value, CASE WHEN length(concept) % 3 = 0 THEN 'own' ELSE 'pooled' END AS label_source FROM s"""


def questions_narrative(spark: SparkSession, sf: str) -> DataFrame:
    return E.narrative_questions(_reviewed(spark, sf))


NARRATIVE_Q_SQL = rf"""{PROSE_PAIRS_SQL}, q AS (SELECT document_id, ord, fs, regexp_replace({sql_collapse(r"regexp_replace(sentence, '-?\p{Nd}[\p{Nd}.,]*\s*(?:%|Mio\.?|Mrd\.?|Tsd\.?|TEUR|EUR|€)?', ' ', 'g')")}, '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS text FROM k WHERE fs % 5 <> 0 AND ord % 4 = 0)
SELECT document_id || ':nr:o' || arg_min(fs, ord) AS question_id, document_id, text, count(*) AS n_gold FROM q GROUP BY document_id, text"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brands as documents: they tag the types of their parts, and declare the names as labels of all their parts' types but those of even size."""
    p = table(spark, sf, "part")
    labels = p.where("p_size % 4 = 0").groupBy(F.col("p_brand").alias("document_id"), F.col("p_type").alias("concept")).agg(F.min("p_name").alias("text"))
    return labels, p.where("p_size % 5 = 0").select(F.col("p_brand").alias("document_id"), F.col("p_type").alias("concept"))


def foreign_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return E.foreign_labels(*_parts(spark, sf))


FOREIGN_SQL = """WITH l AS (SELECT p_brand AS d, p_type AS c, min(p_name) AS t FROM part WHERE p_size % 4 = 0 GROUP BY ALL), g AS (SELECT DISTINCT p_brand AS d, p_type AS c FROM part WHERE p_size % 5 = 0), ds AS (SELECT DISTINCT d FROM g),
r AS (SELECT DISTINCT g.d, l.t FROM g JOIN l ON g.c = l.c)
SELECT ds.d AS document_id, l.d AS other, l.c AS concept, l.t AS label FROM ds JOIN l ON ds.d <> l.d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.d = ds.d AND g.c = l.c) AND NOT EXISTS (SELECT 1 FROM r WHERE r.d = ds.d AND r.t = l.t)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    f = _tagged(spark, sf)
    labels = _own(f).unionByName(f.where(F.length("concept") % 3 == 1).where("document_id % 2 = 0").select("document_id", "concept", F.col("concept").alias("text")).distinct())
    return E.cases(f, labels).withColumn("expected_value", F.col("expected_value").cast("decimal(18,2)"))


CASES_SQL = f"""WITH {FACTS_SQL}, lb AS (SELECT DISTINCT document_id, concept, CASE WHEN length(concept) % 3 = 0 THEN 'eigene ' || concept ELSE concept END AS label FROM f WHERE length(concept) % 3 = 0 OR (length(concept) % 3 = 1 AND document_id % 2 = 0)),
pl AS (SELECT concept, min(label) AS pooled FROM lb GROUP BY concept), kn AS (SELECT f.document_id, f.concept, period, count(DISTINCT value) AS nv, min(value) AS value, coalesce(min(lb.label), min(pooled)) AS label, f.concept || '|' || period AS key
  FROM f LEFT JOIN lb ON f.document_id = lb.document_id AND f.concept = lb.concept LEFT JOIN pl ON f.concept = pl.concept GROUP BY f.document_id, f.concept, period), ky AS (SELECT * FROM kn WHERE label IS NOT NULL),
tg AS (SELECT DISTINCT document_id, concept FROM f), dd AS (SELECT DISTINCT document_id FROM f), rc AS (SELECT DISTINCT tg.document_id, label FROM tg JOIN lb ON tg.concept = lb.concept),
fo AS (SELECT DISTINCT dd.document_id, lb.concept || '|' || label AS key, label FROM dd JOIN lb ON dd.document_id <> lb.document_id WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.document_id = dd.document_id AND tg.concept = lb.concept)
  AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.document_id = dd.document_id AND rc.label = lb.label)),
un AS (SELECT document_id, key, 'Wie hoch war ' || label || ' zum ' || strftime(period[9:]::DATE, '%d.%m.%Y') || '?' AS question, 'answer_from_ledger' AS expectation, value AS expected_value, 'answerable' AS note FROM ky WHERE nv = 1
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY md5('answer' || key), key) <= 20
  UNION ALL SELECT document_id, key, 'Wie hoch war ' || label || ' zum ' || strftime(period[9:]::DATE, '%d.%m.%Y') || '?', 'abstain', NULL, 'ambiguous concept' FROM ky WHERE nv > 1 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY md5('ambiguous' || key), key) <= 10
  UNION ALL SELECT document_id, key, 'Wie hoch war ' || label || ' im Geschäftsjahr ' || [2009, 2011, 2013][('0x' || left(md5(key), 4))::INT % 3 + 1] || '?', 'abstain', NULL, 'wrong period' FROM ky WHERE nv = 1 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY md5('trap' || key), key) <= 10
  UNION ALL SELECT document_id, key, 'Wie hoch war ' || label || ' zum 31.12.2022?', 'abstain', NULL, 'concept not tagged in this filing' FROM fo QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY md5('foreign' || key), key) <= 10)
SELECT document_id || '|' || note || '|' || key AS case_id, * EXCLUDE (key) FROM un"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Forty unambiguous keys, in the order of a hash, as example questions: a sample by definition."""
    return E.examples(facts(spark, sf))


EXAMPLES_SQL = f"WITH {FACTS_SQL}, g AS (SELECT document_id, concept, period FROM f GROUP BY ALL HAVING count(DISTINCT value) = 1) SELECT * FROM g ORDER BY md5(document_id || '|' || concept || '|' || period), document_id, concept, period LIMIT 40"


def _hits(spark: SparkSession, sf: str, *settings: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """Questions with their stratum, and hits under each (k1, b): a document is relevant if it holds the passage's last sentence (or the passage)."""
    c = corpus(spark, sf)
    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(T.sentences(F.col("text")), -1).alias("needle"), F.when(F.length("text") > 250, "long").otherwise("short").alias("stratum"))
    hits = R.bm25_each(questions(spark, sf), R.index(c), list(settings), 10)
    found = c.select("chunk_id", "text").join(F.broadcast(hits.select("setting", "query_id", "rank", "chunk_id").join(p, "query_id")), "chunk_id")
    return p, found.select("setting", "query_id", "rank", F.contains("text", "needle").alias("relevant"))


def _hits_sql(name: str, k1: float, b: float) -> str:
    return f"{_bm25_sql('text', k1, b, name, 10)}, {name}r AS (SELECT {name}.query_id, {name}.rank, contains(d.text, needle) AS relevant FROM {name} JOIN d USING (doc_id) JOIN nd USING (query_id))"


NEEDLE_SQL = r"nd AS (SELECT item_id AS query_id, string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))[-1] AS needle, CASE WHEN length(text) > 250 THEN 'long' ELSE 'short' END AS stratum FROM benchmark)"
HITS_SQL = f"WITH {DOCS_SQL}, {QUESTIONS_SQL}, {NEEDLE_SQL}, {_hits_sql('h', 1.5, 0.75)}, rk AS (SELECT query_id, min(rank) FILTER (relevant) AS hit_rank, list_sort(coalesce(list(rank) FILTER (relevant), [])) AS ranks FROM hr GROUP BY query_id)"


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return E.hit_ranks(*_hits(spark, sf, (R.K1, R.B)))


def hit_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf).select("query_id", "stratum", F.col("hit_rank").cast("long").alias("hit_rank"), F.array_join("ranks", ",").alias("ranks"))


RANKS_SQL = f"{HITS_SQL} SELECT nd.query_id, stratum, hit_rank, coalesce(array_to_string(ranks, ','), '') AS ranks FROM nd LEFT JOIN rk USING (query_id)"


def hit_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf).select("query_id", F.when(F.col("hit_rank") <= 5, 1.0).otherwise(0.0).alias("hit_at_5"))


VECTOR_SQL = f"{HITS_SQL} SELECT nd.query_id, CASE WHEN hit_rank <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_5 FROM nd LEFT JOIN rk USING (query_id)"


def retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = E.retrieval_scores(_ranks(spark, sf))
    return s.select("stratum", "questions", *[F.round(c, 9).alias(c) for c in s.columns[2:]])


SCORES_SQL = f"""{HITS_SQL}, g AS (SELECT stratum, hit_rank, ranks, CASE WHEN len(ranks) > 0 THEN list_sum(list_transform(ranks, lambda r: 1 / log2(r + 1))) / list_sum(list_transform(range(1, len(ranks) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END AS n FROM nd LEFT JOIN rk USING (query_id)),
t AS (SELECT stratum, count(*) AS questions, avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END) AS r5, avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END) AS r10, avg(CASE WHEN hit_rank <= 10 THEN 1.0::DOUBLE / hit_rank ELSE 0 END) AS mrr, avg(n) AS ndcg FROM g GROUP BY stratum)
SELECT stratum, questions, round(r1, 9) AS recall_at_1, round(r5, 9) AS recall_at_5, round(r10, 9) AS recall_at_10, round(mrr, 9) AS mrr_at_10, round(ndcg, 9) AS ndcg_at_10, round(CASE WHEN r10 > 0 THEN r1 / r10 ELSE 0 END, 9) AS shown_first_when_found FROM t"""


def bootstrap_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Hits at rank 1 of one BM25 setting against another, all resamples."""
    p, hits = _hits(spark, sf, (R.K1, R.B), (0.5, 0.1))
    found = hits.where("relevant AND rank <= 1").groupBy("query_id").agg(*[F.max(F.when(F.col("setting") == i, 1.0)).alias(c) for i, c in enumerate(("baseline", "candidate"))])
    both = p.select("query_id").join(found, "query_id", "left").select("query_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("baseline", "candidate")])
    d = E.paired_bootstrap(both)
    return d.select(*[F.round(c, 9).alias(c) for c in ("baseline", "candidate", "delta", "low", "high")], "n", "discordant", "significant")


BOOTSTRAP_SQL = f"""WITH {DOCS_SQL}, {QUESTIONS_SQL}, {NEEDLE_SQL}, {_hits_sql('h', 1.5, 0.75)}, {_hits_sql('g', 0.5, 0.1)},
a AS (SELECT nd.query_id, CASE WHEN min(rank) FILTER (relevant) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS baseline FROM nd LEFT JOIN hr USING (query_id) GROUP BY ALL),
c AS (SELECT nd.query_id, CASE WHEN min(rank) FILTER (relevant) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS candidate FROM nd LEFT JOIN gr USING (query_id) GROUP BY ALL),
p AS (SELECT query_id, baseline, candidate, candidate - baseline AS dd, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM a JOIN c USING (query_id)),
x AS (SELECT r, (((r * 7919 + k * 104729 + 1) % 2147483647 * 48271 % 2147483647) * 69621 % 2147483647) % (SELECT count(*) FROM p) AS i FROM range({E.RESAMPLES}) t(r), range((SELECT count(*) FROM p)) u(k)),
m AS (SELECT r, round(avg(dd), 12) AS m FROM x JOIN p USING (i) GROUP BY r), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS z FROM m),
b AS (SELECT max(m) FILTER (z = {int(0.025 * E.RESAMPLES)}) AS low, max(m) FILTER (z = {int(0.975 * E.RESAMPLES)}) AS high FROM o)
SELECT round(avg(baseline), 9) AS baseline, round(avg(candidate), 9) AS candidate, round(avg(dd), 9) AS delta, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high, count(*) AS n, count(*) FILTER (dd <> 0) AS discordant,
  any_value(low) > 0 OR any_value(high) < 0 AS significant FROM p, b"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as outcomes of cases."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    i, n = F.col("doc_id"), F.col("n_chars")
    answered = n % 3 != 0
    return d.select(i.alias("case_id"), F.when(F.col("quality") == 1, "answer_from_ledger").otherwise("abstain").alias("expectation"), F.when(F.col("quality") == 1, "").when(F.col("toxic") == 1, "wrong period").otherwise("ambiguous concept").alias("note"),
                    answered.alias("answered"), F.when(i % 5 != 0, "ledger").otherwise("passage").alias("route"), (n % 4 != 0).alias("has_value"), (answered & (i % 7 != 0)).alias("exact_value"),
                    (n % 1001 / 1000.0).alias("confidence"), (n * 0.0375).alias("latency_ms"), "lang")


OUTCOMES_SQL = """oc AS (SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'answer_from_ledger' ELSE 'abstain' END AS expectation, CASE WHEN quality = 1 THEN '' WHEN toxic = 1 THEN 'wrong period' ELSE 'ambiguous concept' END AS note,
  n_chars % 3 <> 0 AS answered, CASE WHEN doc_id % 5 <> 0 THEN 'ledger' ELSE 'passage' END AS route, n_chars % 4 <> 0 AS has_value, n_chars % 3 <> 0 AND doc_id % 7 <> 0 AS exact_value, n_chars % 1001 / 1000.0::DOUBLE AS confidence, n_chars * 0.0375::DOUBLE AS latency_ms, lang
  FROM documents JOIN labels USING (doc_id))"""


def benchmark_report(spark: SparkSession, sf: str) -> DataFrame:
    r = E.report(outcomes(spark, sf))
    return r.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in r.dtypes])


def _share(hit: str, of: str) -> str:
    return f"round(coalesce(count(*) FILTER (({hit}) AND ({of}))::DOUBLE / nullif(count(*) FILTER ({of}), 0), 0), 9)"


_A, _B = "expectation = 'answer_from_ledger'", "expectation = 'abstain'"
REPORT_SQL = f"""WITH {OUTCOMES_SQL} SELECT count(*) AS cases, count(*) FILTER ({_A}) AS answerable, {_share("route = 'ledger'", _A)} AS routing_accuracy, {_share("exact_value", _A)} AS answer_exact_match, count(*) FILTER ({_B}) AS unanswerable,
  {_share("NOT answered", _B)} AS abstention_recall, {_share(_B, "NOT answered")} AS abstention_precision, {_share("answered", _B)} AS false_answer_rate, count(*) FILTER ({_B} AND note = 'wrong period') AS wrong_period_traps,
  {_share("NOT has_value", _B + " AND note = 'wrong period'")} AS trap_survival, count(*) FILTER ({_B} AND note = 'ambiguous concept') AS ambiguous_cases, {_share("NOT answered", _B + " AND note = 'ambiguous concept'")} AS ambiguity_detected FROM oc"""


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return E.latency(outcomes(spark, sf), "lang")


LATENCY_SQL = f"""WITH {OUTCOMES_SQL}, g AS (SELECT lang, quantile_cont(latency_ms, 0.5) AS p, list_sort(list(latency_ms)) AS l FROM oc GROUP BY lang)
SELECT lang, round_even(p, 2) AS p50, round_even(l[least(floor(len(l) * 0.95::DOUBLE)::BIGINT, len(l) - 1) + 1], 2) AS p95 FROM g"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).where("answered").select("confidence", (F.col("exact_value") & (F.col("expectation") == "answer_from_ledger")).alias("correct"))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibration_bins(_predictions(spark, sf)).withColumns({c: F.round(c, 9) for c in ("mean_confidence", "accuracy")})


def calibration_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibration(E.calibration_bins(_predictions(spark, sf)))


BINS_SQL = f"""WITH {OUTCOMES_SQL}, e AS (SELECT i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper, i FROM range(10) t(i)),
bn AS (SELECT lower, upper, count(*) AS count, avg(confidence) AS mc, avg(CASE WHEN exact_value AND {_A} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ac FROM oc JOIN e ON confidence >= lower AND (confidence < upper OR (i = 9 AND confidence = upper)) WHERE answered GROUP BY ALL)"""
CALIBRATION_SQL = f"""{BINS_SQL} SELECT sum(count)::BIGINT AS samples, round_even(sum(count * abs(mc - ac)) / sum(count), 4) AS expected_calibration_error, round_even(max(abs(mc - ac)), 4) AS max_calibration_error,
  round_even(sum(count * greatest(mc - ac, 0)) / sum(count), 4) AS overconfidence FROM bn"""
THRESHOLDS = (0.3, 0.5, 0.7, 0.8, 0.9)


def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return E.risk_coverage(outcomes(spark, sf), THRESHOLDS).withColumns({c: F.round(c, 9) for c in ("coverage", "false_answer_rate")})


RISK_SQL = f"""WITH {OUTCOMES_SQL}, e AS (SELECT *, answered AND (route = 'ledger' OR confidence >= t) AS given FROM oc, (VALUES {", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)}) v(t))
SELECT t AS threshold, CASE WHEN {_share("route = 'ledger'", _A)} = 0 THEN 0 ELSE {_share("exact_value AND given", _A)} END AS coverage, {_share("given", _B)} AS false_answer_rate FROM e GROUP BY t"""

QUERIES = {
    "questions_exact": (questions_exact, EXACT_SQL),
    "questions_narrative": (questions_narrative, NARRATIVE_Q_SQL),
    "foreign_concepts": (foreign_concepts, FOREIGN_SQL),
    "cases": (cases, CASES_SQL),
    "examples": (examples, EXAMPLES_SQL),
    "hit_ranks": (hit_ranks, RANKS_SQL),
    "hit_vector": (hit_vector, VECTOR_SQL),
    "retrieval_scores": (retrieval_scores, SCORES_SQL),
    "bootstrap_delta": (bootstrap_delta, BOOTSTRAP_SQL),
    "benchmark_report": (benchmark_report, REPORT_SQL),
    "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "calibration_bins": (calibration_bins, BINS_SQL + " SELECT lower, upper, count, round(mc, 9) AS mean_confidence, round(ac, 9) AS accuracy FROM bn"),
    "calibration_summary": (calibration_summary, CALIBRATION_SQL),
    "risk_coverage": (risk_coverage, RISK_SQL),
}
