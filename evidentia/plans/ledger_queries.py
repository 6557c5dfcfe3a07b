"""Queries of the ledger: order lines as tagged facts. A supplier is a document, a part's name the concept and its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import text as T, values as V
from evidentia.operators import ledger as L
from evidentia.plans.geometry_queries import BOXES_SQL, SHARED, _area, boxed, boxes
from evidentia.plans.text_queries import _sql_stems, sql_tokens
from evidentia.sources.shared import written
from evidentia.sources.tables import table


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """document_id, fact_id, seq, concept, period, value, displayed, unit, span."""
    x = boxed(table(spark, sf, "lineitem")).join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("concept")), "l_partkey")
    value = F.round(F.col("l_extendedprice").cast("decimal(18,4)"), 2).cast(V.DECIMAL)
    return x.select(F.col("l_suppkey").alias("document_id"), F.concat(F.lit("f"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), F.col("n").cast("string")).alias("fact_id"),
                    (F.col("l_orderkey") * 100 + F.col("n")).alias("seq"), "concept", F.concat(F.lit("instant:"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("period"), value.alias("value"),
                    V.format_figure(value, F.lit("")).alias("displayed"), F.lit("EUR").alias("unit"), V.span(*[F.col(c) for c in ("page", "x0", "y0", "x1", "y1")]).alias("span"))


FACTS_SQL = f"""{BOXES_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
f AS (SELECT z.l_suppkey AS document_id, 'f' || lpad(z.l_orderkey::VARCHAR, 9, '0') || '-' || z.n AS fact_id, z.l_orderkey * 100 + z.n AS seq, p_name AS concept, 'instant:' || strftime(l_shipdate, '%Y-%m-%d') AS period,
  round(l_extendedprice::DECIMAL(18,4), 2)::DECIMAL(18,2) AS value, z.l_orderkey, z.n, z.l_partkey, page, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM z JOIN b USING (l_orderkey, n) JOIN part ON p_partkey = z.l_partkey)"""


def ledger_locate(spark: SparkSession, sf: str) -> DataFrame:
    f = written(facts(spark, sf).select("document_id", "fact_id", "seq", "span"), "facts")
    found = f.where(F.floor(F.col("seq") / 100) % 7 != 0)
    # coverage and the places found, of one join
    got = f.select("document_id", "fact_id").join(L.first_places(found), ["document_id", "fact_id"], "left")
    c = got.groupBy("document_id").agg(F.count("*").alias("n_facts"), F.count("span").alias("n_located"), F.round(F.sum(V.area(F.col("span"))), 4).alias("area"))
    return c.select("document_id", "n_facts", "n_located", F.round(F.col("n_located") / F.col("n_facts"), 9).alias("coverage"), "area")


def unit_period_lookup(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("unit_ref"), F.col("o_orderstatus").alias("context_ref"))
    u = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("unit_ref"), F.col("c_mktsegment").alias("unit"))
    c = spark.createDataFrame([("F", "instant:1998-12-31"), ("O", "1998-01-01/1998-12-31")], "context_ref string, period string")
    return L.with_unit_and_period(f, u, c).select("o_orderkey", "unit", "period")


LOOKUP_SQL = """SELECT o_orderkey, coalesce(c_mktsegment, '') AS unit, CASE o_orderstatus WHEN 'F' THEN 'instant:1998-12-31' WHEN 'O' THEN '1998-01-01/1998-12-31' ELSE '' END AS period
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey"""
LOCATE_SQL = f"""WITH {FACTS_SQL}, h AS (SELECT *, l_orderkey % 7 <> 0 AS hit FROM f)
SELECT document_id, count(*) AS n_facts, count(*) FILTER (hit) AS n_located, round(count(*) FILTER (hit) / count(*)::DOUBLE, 9) AS coverage, round(sum(area) FILTER (hit), 4) AS area FROM h GROUP BY document_id"""


def _linkbase(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as locators, their brand as the file; two labels each, in two languages and four roles."""
    p = table(spark, sf, "part")
    loc = p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("seq"), F.concat(F.lit("l"), "p_partkey").alias("key"), F.concat(F.lit("a.xsd#ns_"), F.replace("p_name", F.lit(" "), F.lit(""))).alias("href"))
    both = p.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    k = (F.col("p_size") + F.col("v")) % 5
    role = F.when(k == 4, "other").otherwise(F.element_at(T.words_array(list(L.ROLES)), (k % 4 + 1).cast("int")))
    key = F.concat(F.lit("t"), "p_partkey", F.lit("_"), "v")
    label = both.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 2 + F.col("v")).alias("seq"), key.alias("key"), F.when(F.col("p_partkey") % 3 == 0, "EN").otherwise("De").alias("lang"), role.alias("role"),
                        F.concat(F.lit(" "), "p_type", F.lit(" "), "v").alias("text"))
    arc = both.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 2 + F.col("v")).alias("seq"), F.concat(F.lit("l"), "p_partkey").alias("from_key"), key.alias("to_key"))
    return L.linkbase_labels(loc, arc, label)


def label_linkbase(spark: SparkSession, sf: str) -> DataFrame:
    return _linkbase(spark, sf)


def label_merge(spark: SparkSession, sf: str) -> DataFrame:
    return L.merge_labels(_linkbase(spark, sf))


LINKBASE_SQL = """WITH x AS (SELECT p_brand AS file, p_partkey * 2 + v AS seq, 'ns:' || replace(p_name, ' ', '') AS concept, p_type || ' ' || v AS text, (p_size + v) % 5 + 1 AS rank FROM part, (VALUES (0), (1)) t(v) WHERE p_partkey % 3 <> 0),
y AS (SELECT file, concept, text FROM x QUALIFY row_number() OVER (PARTITION BY file, concept ORDER BY rank, seq) = 1)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as documents, types as concepts, names as wordings."""
    return table(spark, sf, "part").select(F.col("p_brand").alias("document_id"), F.col("p_type").alias("concept"), F.col("p_name").alias("text"))


def pooled_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.pool_labels(_labels(spark, sf)).select("concept", F.size("wordings").cast("long").alias("n"), F.array_join("wordings", "|").alias("wordings"))


POOLED_SQL = "SELECT p_type AS concept, count(DISTINCT p_name) AS n, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS wordings FROM part WHERE p_name <> '' GROUP BY p_type"


def concept_periods(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    _, p = L.concept_index(f, spark.createDataFrame([], "concept string, wordings array<string>"), spark.createDataFrame([], "document_id long, concept string, text string"))
    return p.groupBy("document_id", "concept").agg(F.count("*").alias("n_periods"), F.min("period").alias("first"), F.max("period").alias("last"))


PERIODS_SQL = f"WITH {FACTS_SQL} SELECT document_id, concept, count(DISTINCT period) AS n_periods, min(period) AS first, max(period) AS last FROM f GROUP BY ALL"


def ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    return L.values_per_key(facts(spark, sf)).where("n_values > 1")


AMBIGUITY_SQL = f"WITH {FACTS_SQL} SELECT document_id, concept, period, count(DISTINCT value) AS n_values, count(*) AS n_facts FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1"


def gold_spans(spark: SparkSession, sf: str) -> DataFrame:
    g = L.gold_spans(facts(spark, sf))
    return g.select(*L.KEY, F.size("spans").cast("long").alias("n"), F.round(F.aggregate("spans", F.lit(0.0), lambda s, x: s + V.area(x)), 9).alias("area"), F.col("spans")[0]["page"].alias("first_page"))


GOLD_SQL = f"WITH {FACTS_SQL} SELECT document_id, concept, period, count(*) AS n, round(sum(area), 9) AS area, arg_min(page, seq) AS first_page FROM f GROUP BY ALL"


def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return L.first_facts(facts(spark, sf)).select(*L.KEY, "fact_id", F.col("value").cast("decimal(18,2)").alias("value"))


DEDUP_SQL = f"WITH {FACTS_SQL} SELECT document_id, concept, period, fact_id, value FROM f QUALIFY row_number() OVER (PARTITION BY document_id, concept, period ORDER BY seq) = 1"


def fact_questions(f: DataFrame) -> DataFrame:
    """A question about every fact: exact, by the year, without a period, about something more."""
    k, year, day = F.col("seq") % 4, F.substring("period", 9, 4), V.describe_period(F.col("period"))
    text = (F.when(k == 0, F.concat(F.lit("Wie hoch war "), "concept", F.lit(" "), day, F.lit("?"))).when(k == 1, F.concat(F.lit("Wie hoch war "), "concept", F.lit(" im Geschäftsjahr "), year, F.lit("?")))
            .when(k == 2, F.concat(F.lit("Wie hoch war "), "concept", F.lit("?"))).otherwise(F.concat(F.lit("Wie hoch war der gesamte geplante Erwerb "), "concept", F.lit(" "), day, F.lit("?"))))
    return f.select(F.col("seq").alias("query_id"), "document_id", text.alias("text"), "fact_id")


QS_SQL = f"""{FACTS_SQL}, qs AS (SELECT seq AS query_id, document_id, fact_id, concept, seq % 4 AS k, period[9:12] AS year, strftime(period[9:]::DATE, '%d.%m.%Y') AS day,
  CASE k WHEN 0 THEN 'Wie hoch war ' || concept || ' zum ' || day || '?' WHEN 1 THEN 'Wie hoch war ' || concept || ' im Geschäftsjahr ' || year || '?' WHEN 2 THEN 'Wie hoch war ' || concept || '?'
  ELSE 'Wie hoch war der gesamte geplante Erwerb ' || concept || ' zum ' || day || '?' END AS text FROM f)"""


def _filled_sql(pattern: str, *columns: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in pattern.split("{}")]
    return " || ".join(x for i, p in enumerate(parts) for x in (p, *columns[i : i + 1]))


# All wordings here have two terms of over two letters, so a wording matches a question if both occur in it.
ROUTE_SQL = f"""{QS_SQL}, c AS (SELECT DISTINCT document_id, concept, {sql_tokens("concept")} AS ts FROM f), cp AS (SELECT DISTINCT document_id, concept, period FROM f),
qt AS (SELECT *, list_distinct({sql_tokens("text")}) AS said, list_filter(list_distinct({sql_tokens("text")}), lambda t: length(t) > 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.FRAMING)}], t) AND NOT regexp_matches(t, '^[0-9]')) AS asked FROM qs),
w AS (SELECT document_id, concept, len(list_filter(ts, lambda t: length(t) > 2)) AS size, unnest(list_filter(ts, lambda t: length(t) > 2)) AS term FROM c),
qm AS (SELECT query_id, document_id, unnest(said) AS term FROM qt),
pr AS (SELECT query_id, document_id, w.concept, size, count(*) AS present FROM qm JOIN w USING (document_id, term) GROUP BY ALL HAVING count(*)::DOUBLE / size >= 0.8::DOUBLE),
ti AS (SELECT * FROM pr QUALIFY rank() OVER (PARTITION BY query_id ORDER BY present DESC) = 1),
mm AS (SELECT query_id, list(concept ORDER BY concept) AS concepts, min(concept) AS label FROM ti GROUP BY query_id),
av AS (SELECT query_id, min(period) FILTER (k IN (0, 3) AND period = 'instant:' || strftime(strptime(day, '%d.%m.%Y'), '%Y-%m-%d')) AS exact, min(period) FILTER (period[9:12] = year) AS by_year
  FROM ti JOIN cp USING (document_id, concept) JOIN qs USING (query_id) GROUP BY query_id),
rt AS (SELECT q.query_id, q.document_id, q.k, concepts, label, len(asked) AS n, len(list_intersect(asked, list_distinct({sql_tokens("label")}))) AS covered, coalesce(exact, by_year) AS found FROM qt q LEFT JOIN mm USING (query_id) LEFT JOIN av USING (query_id)),
de AS (SELECT query_id, document_id, concepts, label, found, CASE WHEN label IS NULL THEN '{L.NO_CONCEPT}'
  WHEN n > 0 AND covered::DOUBLE / n < 0.6::DOUBLE THEN {_filled_sql(L.ASKS_MORE, 'label')}
  WHEN k = 2 THEN '{L.NO_PERIOD}' WHEN found IS NULL THEN '{L.PERIOD_UNTAGGED}' ELSE '' END AS reason FROM rt)"""


def _decisions(spark: SparkSession, f: DataFrame) -> DataFrame:
    tagged = f.where("concept <> ''").groupBy("document_id", "concept").agg(F.first("concept").alias("text"))
    words, periods = L.concept_index(f, spark.createDataFrame([], "concept string, wordings array<string>"), tagged)
    return L.route(fact_questions(f), words, periods)


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return written(facts(spark, sf).select("document_id", "fact_id", "seq", "concept", "period", "value", "unit"), "facts")


def router_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = _decisions(spark, _tagged(spark, sf))
    return d.select("query_id", "document_id", "route", F.array_join("concepts", "|").alias("concepts"), "period", "label", "reason")


ROUTER_SQL = f"""WITH {ROUTE_SQL} SELECT query_id, document_id, CASE WHEN reason = '' THEN 'ledger' ELSE 'passage' END AS route, coalesce(array_to_string(concepts, '|'), '') AS concepts,
  CASE WHEN reason = '' THEN found ELSE '' END AS period, coalesce(label, '') AS label, reason FROM de"""


def ledger_answers(spark: SparkSession, sf: str) -> DataFrame:
    f = _tagged(spark, sf)
    a = L.answer(_decisions(spark, f), f)
    return a.withColumns({"value": F.col("value").cast("decimal(18,2)"), "n_citations": F.col("n_citations").cast("long")})


ANSWER_SQL = f"""WITH {ROUTE_SQL}, e AS (SELECT query_id, document_id, found AS period, unnest(concepts) AS concept FROM de WHERE reason = ''),
g AS (SELECT query_id, e.period, count(*) AS n, count(DISTINCT value) AS nv, arg_min(value, seq) AS v FROM e JOIN f USING (document_id, concept, period) GROUP BY ALL)
SELECT query_id, CASE WHEN nv = 1 THEN 'answered' ELSE 'abstained' END AS status, CASE WHEN nv = 1 THEN CASE WHEN v < 0 THEN '-' ELSE '' END || translate(format('{{:,.2f}}', abs(v)::DOUBLE), ',.', '.,') || ' EUR' ELSE '' END AS text,
  CASE WHEN nv = 1 THEN v END AS value, CASE WHEN nv = 1 THEN 'EUR' END AS unit, CASE WHEN nv = 1 THEN period END AS period, CASE WHEN nv = 1 THEN n ELSE least(n, 5) END AS n_citations,
  CASE WHEN nv = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN nv = 1 THEN '' ELSE {_filled_sql(L.SEVERAL, 'nv', 'period')} END AS reason FROM g"""


def _order_facts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    v = F.round(F.col("o_totalprice").cast("decimal(18,4)"), 2).cast(V.DECIMAL)
    s = V.span(F.lit(0), F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2))
    return o.select((F.col("o_custkey") % 100).alias("document_id"), F.concat(F.lit("o"), "o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("concept"), F.lit("").alias("period"), v.alias("value"),
                    V.format_figure(v, F.lit("")).alias("displayed"), F.when(F.col("o_orderkey") % 5 != 0, s).alias("span"), F.floor(v / 100).cast("long").alias("hundreds"))


def resolve_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's price, rounded to hundreds and told in thousands, against all orders of its group of customers."""
    f = _order_facts(spark, sf)
    m = f.select("document_id", F.col("seq").alias("mention_id"), (F.col("hundreds").cast("decimal(18,1)") / 10).cast(V.DECIMAL).alias("value"), F.array(*[F.lit(s).cast("long") for s in T.ALL_SCALES]).alias("scales"))
    return L.resolve(m, f).select("document_id", "mention_id", "fact_id", F.round("error", 9).alias("error"))


RESOLVE_SQL = """WITH f AS (SELECT o_custkey % 100 AS document_id, o_orderkey AS seq, round(o_totalprice::DECIMAL(18,4), 2)::DOUBLE AS v, floor(round(o_totalprice::DECIMAL(18,4), 2) / 100)::BIGINT AS h FROM orders),
j AS (SELECT m.document_id, m.seq AS mention_id, f.seq, k, round(abs(m.h::DOUBLE / 10 * k - f.v) / abs(f.v), 12) AS error FROM f m JOIN f ON m.document_id = f.document_id, (VALUES (1), (1000), (1000000), (1000000000)) t(k)
  WHERE abs(m.h::DOUBLE / 10 * k - f.v) / abs(f.v) < 0.005::DOUBLE)
SELECT document_id, mention_id, 'o' || seq AS fact_id, round(error, 9) AS error FROM j QUALIFY row_number() OVER (PARTITION BY document_id, mention_id ORDER BY error, seq, k) = 1"""


def told(spark: SparkSession, sf: str) -> DataFrame:
    """A block of prose for every order that tells its price in thousands, as tenths."""
    f = _order_facts(spark, sf)
    figure = F.translate(F.format_number((F.col("hundreds").cast("decimal(18,1)") / 10).cast("decimal(18,1)"), 1), ",.", ".,")
    head = F.when(F.col("seq") % 2 == 0, F.lit("Die Gesellschaft war im Berichtsjahr erfolgreich. ")).otherwise(F.lit(""))
    text = F.concat(head, F.lit("Der Umsatz mit diesem Kunden belief sich auf rund TEUR "), figure, F.lit(" und wurde durch eine Bestellung der Stufe "), F.col("concept"), F.lit(" deutlich erhöht."))
    return f.select("document_id", F.lit(0).alias("page"), F.col("seq").alias("ord"), text.alias("text"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = _order_facts(spark, sf)
    labels = f.select("document_id", "concept").distinct().withColumn("text", F.substring("concept", 3, 20))
    return L.prose_pairs(told(spark, sf), f, labels)


def prose_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("document_id", "ord", "sentence", "mention", "fact_id", "concept", F.col("value").cast("decimal(18,2)").alias("value"), "names_concept")


PROSE_PAIRS_SQL = """WITH f AS (SELECT o_custkey % 100 AS document_id, o_orderkey AS seq, o_orderpriority AS concept, round(o_totalprice::DECIMAL(18,4), 2)::DECIMAL(18,2) AS value, round(o_totalprice::DECIMAL(18,4), 2)::DOUBLE AS v, floor(round(o_totalprice::DECIMAL(18,4), 2) / 100)::BIGINT AS h FROM orders),
m AS (SELECT *, translate(format('{:,.1f}', h::DOUBLE / 10), ',.', '.,') AS mention FROM f),
s AS (SELECT *, 'Der Umsatz mit diesem Kunden belief sich auf rund TEUR ' || mention || ' und wurde durch eine Bestellung der Stufe ' || concept || ' deutlich erhöht.' AS sentence FROM m
  WHERE length(replace(replace(mention, ',', ''), '.', '')) >= 4 AND h >= 1000),
j AS (SELECT s.document_id, s.seq AS ord, s.sentence, s.mention, f.seq AS fs, f.concept, f.value, s.concept AS own, round(abs(s.h::DOUBLE / 10 * 1000 - f.v) / abs(f.v), 12) AS error FROM s JOIN f ON s.document_id = f.document_id AND abs(s.h::DOUBLE / 10 * 1000 - f.v) / abs(f.v) < 0.005::DOUBLE),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY document_id, ord ORDER BY error, fs) = 1)"""
_PAIRS_OUT = """SELECT document_id, ord, sentence, mention, 'o' || fs AS fact_id, concept, value, CASE WHEN len(ts) = 0 THEN false ELSE len(list_filter(ts, lambda t: list_contains(said, t)))::DOUBLE / len(ts) >= 0.7::DOUBLE END AS names_concept
FROM (SELECT *, list_filter({tl}, lambda t: length(t) > 3) AS ts, {ts} AS said FROM k WHERE fs % 5 <> 0)""".format(tl=sql_tokens("concept[3:]"), ts=sql_tokens("sentence"))


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).withColumn("seq", F.col("ord")).withColumn("confirmed", F.col("ord") % 4 == 0)


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Unconfirmed pairs of each group, likeliest first, scored against three wordings of their concept."""
    p = _reviewed(spark, sf)
    words = spark.createDataFrame([("Umsatz mit Kunden",), ("Bestellung",), ("Rückstellungen",)], "wording string").join(F.broadcast(p.select("concept").distinct()))
    return L.review_queue(p, words).select("document_id", "ord", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


REVIEW_SQL = rf"""{PROSE_PAIRS_SQL}, w AS (SELECT document_id, ord, regexp_extract_all(sentence, '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS ws, len(regexp_extract_all(sentence, '-?\p{{Nd}}[\p{{Nd}}.,]*')) AS n, {_sql_stems("sentence")} AS c, unnest([{_sql_stems("'Umsatz mit Kunden'")}, {_sql_stems("'Bestellung'")}, {_sql_stems("'Rückstellungen'")}]) AS a
  FROM k WHERE fs % 5 <> 0 AND ord % 4 <> 0),
v AS (SELECT document_id, ord, max(len(list_intersect(a, c))::DOUBLE / len(a) * greatest(0::DOUBLE, 1 - 3 * n::DOUBLE / (n + len(ws)))
  * least(1::DOUBLE, len(list_intersect(list_distinct(list_transform(ws, lambda x: lower(x))), [{", ".join(f"'{x}'" for x in T.NARRATIVE)}]))::DOUBLE / 3)) AS score FROM w GROUP BY ALL)
SELECT document_id, ord, round(score, 9) AS score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ord) AS place FROM v WHERE score >= 0.15::DOUBLE"""


def review_apply(spark: SparkSession, sf: str) -> DataFrame:
    p = _reviewed(spark, sf)
    said = p.select("fact_id", "mention", "page", "sentence", F.when(F.col("ord") % 3 == 0, "y").when(F.col("ord") % 3 == 1, "n").otherwise("s").alias("decision"))
    return L.apply_review(p, said).select("document_id", "ord", "fact_id", "confirmed")


APPLY_SQL = f"""{PROSE_PAIRS_SQL}, p AS (SELECT * FROM k WHERE fs % 5 <> 0) SELECT document_id, ord, 'o' || fs AS fact_id, ord % 4 = 0 OR EXISTS (SELECT 1 FROM p r WHERE r.fs = p.fs AND r.mention = p.mention AND r.sentence = p.sentence AND r.ord % 3 = 0) AS confirmed FROM p"""


def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Facts and pairs of each document and, with document -1, of all."""
    return L.index_summary(_order_facts(spark, sf), _pairs(spark, sf)).withColumn("document_id", F.coalesce("document_id", F.lit(-1).cast("long")))


SUMMARY_SQL = f"""{PROSE_PAIRS_SQL}, n AS (SELECT document_id, count(*) AS facts FROM f GROUP BY ALL), p AS (SELECT document_id, count(*) AS pairs FROM k WHERE fs % 5 <> 0 GROUP BY ALL)
SELECT coalesce(document_id, -1)::BIGINT AS document_id, sum(facts)::BIGINT AS facts, coalesce(sum(pairs), 0)::BIGINT AS prose_pairs FROM n LEFT JOIN p USING (document_id) GROUP BY ROLLUP (document_id)"""


def confirmation(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's box against the other boxes of its page, as found places: best overlap per line, by order."""
    b = boxes(spark, sf).select(F.col("l_orderkey").alias("document_id"), "n", "page", V.span(*[F.col(c) for c in ("page", "x0", "y0", "x1", "y1")]).alias("span"))
    # every other box of the page, told apart by the number that it isn't
    each = b.select("document_id", "page", F.col("n").alias("m"), F.col("span").alias("other"))
    found = b.join(each, ["document_id", "page"]).where("n <> m").select("document_id", "n", F.col("other").alias("span"))
    got = L.confirmation(L.best_overlaps(b, found, ["document_id", "n"]))
    return got.select("document_id", "checked", "confirmed", F.round("confirmed_rate", 9).alias("confirmed_rate"), F.round("median_iou", 9).alias("median_iou"))


CONFIRM_SQL = f"""WITH {BOXES_SQL}, p AS (SELECT a.l_orderkey, a.n, {SHARED} AS s, {_area('a')} AS aa, {_area('c')} AS ac FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.page = c.page AND a.n <> c.n),
t AS (SELECT l_orderkey, n, coalesce(max(CASE WHEN s > 0 THEN s / (aa + ac - s) ELSE 0 END), 0) AS best FROM b LEFT JOIN p USING (l_orderkey, n) GROUP BY ALL),
g AS (SELECT l_orderkey, count(*) AS checked, count(*) FILTER (best > 0) AS confirmed, list_sort(list(best) FILTER (best > 0)) AS h FROM t GROUP BY ALL)
SELECT l_orderkey AS document_id, checked, confirmed, round(confirmed::DOUBLE / checked, 9) AS confirmed_rate, round(coalesce(h[len(h) // 2 + 1], 0), 9) AS median_iou FROM g"""

QUERIES = {
    "ledger_locate": (ledger_locate, LOCATE_SQL),
    "unit_period_lookup": (unit_period_lookup, LOOKUP_SQL),
    "label_linkbase": (label_linkbase, LINKBASE_SQL + " SELECT file, concept, text FROM y"),
    "label_merge": (label_merge, LINKBASE_SQL + " SELECT concept, arg_min(text, file) AS text FROM y GROUP BY concept"),
    "pooled_labels": (pooled_labels, POOLED_SQL),
    "concept_periods": (concept_periods, PERIODS_SQL),
    "ambiguity": (ambiguity, AMBIGUITY_SQL),
    "gold_spans": (gold_spans, GOLD_SQL),
    "fact_dedup": (fact_dedup, DEDUP_SQL),
    "router_decisions": (router_decisions, ROUTER_SQL),
    "ledger_answers": (ledger_answers, ANSWER_SQL),
    "resolve_facts": (resolve_facts, RESOLVE_SQL),
    "prose_pairs": (prose_pairs, PROSE_PAIRS_SQL + " " + _PAIRS_OUT),
    "review_queue": (review_queue, REVIEW_SQL),
    "review_apply": (review_apply, APPLY_SQL),
    "index_summary": (index_summary, SUMMARY_SQL),
    "confirmation": (confirmation, CONFIRM_SQL),
}
