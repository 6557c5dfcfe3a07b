"""Queries of the text, number and period functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import text as T, values as V
from evidentia.sources.tables import table

TOKEN = T.TOKEN
SPACE = r"\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)


def sql_tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '{TOKEN}'), lambda t: lower(t))"


def sql_sentences(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
                    F.md5(F.array_join("t", " ")).alias("tokens_md5"))


TOKENIZE_SQL = f"""WITH d AS (SELECT doc_id, {sql_tokens("text")} AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM d"""


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.cast("long").alias("words"), T.token_estimate(n).cast("long").alias("tokens"))


WORD_COUNTS_SQL = f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[^{SPACE}]+'))::BIGINT AS words FROM documents)
SELECT doc_id, words, floor(words::DOUBLE * 1.6::DOUBLE)::BIGINT AS tokens FROM d"""


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), T.collapse(F.col("s")).alias("sentence"))


SENTENCE_SQL = f"""WITH d AS (SELECT doc_id, {sql_sentences("text")} AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM d)
SELECT doc_id, pos::BIGINT AS pos, {sql_collapse("s")} AS sentence FROM e"""


def strip_figures(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    said = F.concat(F.lit("Der Wert stieg um "), F.col("o_totalprice").cast("string"), F.lit(" Mio. EUR auf TEUR "), F.col("o_custkey").cast("string"), F.lit(" (Vorjahr: -3,5 %). "), F.col("o_orderpriority"))
    return o.select("o_orderkey", T.strip_figures(said).alias("query"))


STRIP_SQL = rf"""WITH o AS (SELECT o_orderkey, 'Der Wert stieg um ' || o_totalprice::VARCHAR || ' Mio. EUR auf TEUR ' || o_custkey || ' (Vorjahr: -3,5 %). ' || o_orderpriority AS s FROM orders)
SELECT o_orderkey, regexp_replace({sql_collapse(r"regexp_replace(s, '-?\p{Nd}[\p{Nd}.,]*\s*(?:%|Mio\.?|Mrd\.?|Tsd\.?|TEUR|EUR|€)?', ' ', 'g')")}, '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS query FROM o"""


def content_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(T.content_terms(F.col("text"))), " ").alias("terms"))


CONTENT_SQL = f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({sql_tokens("text")},
  lambda t: length(t) > 2 AND NOT list_contains([{_quoted(T.FRAMING)}], t) AND NOT regexp_matches(t, '^\\p{{Nd}}')))), ' ') AS terms FROM conversations"""


def stems(spark: SparkSession, sf: str) -> DataFrame:
    s = F.array_sort(T.stems(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n_stems"), F.md5(F.array_join(s, " ")).alias("stems_md5"))


def _sql_stems(c: str) -> str:
    return rf"list_distinct(list_transform(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: length(w) > 3), lambda w: lower(w)[:6]))"


STEMS_SQL = f"WITH d AS (SELECT doc_id, list_sort({_sql_stems('text')}) AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n_stems, md5(array_to_string(s, ' ')) AS stems_md5 FROM d"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES_SQL = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def narrative_score(spark: SparkSession, sf: str) -> DataFrame:
    """How like narrative each benchmark item's sentence is to every item's whole text as a label, where they share a stem: all other scores are 0."""
    b = table(spark, sf, "benchmark")
    one = b.select("item_id", F.concat(F.lit("Der Betrag stieg und war mit "), F.col("item_id").cast("string"), F.lit(" höher als "), F.col("text")).alias("s"))
    label = b.select(F.col("item_id").alias("label_id"), F.col("text").alias("label"))
    said, asked = one.select("item_id", F.explode(T.stems(F.col("s"))).alias("stem")), label.select("label_id", F.explode(T.stems(F.col("label"))).alias("stem"))
    return said.join(asked, "stem").select("item_id", "label_id").distinct().join(one, "item_id").join(label, "label_id").select(
        "item_id", "label_id", F.round(T.narrative_score(F.col("s"), F.col("label")), 9).alias("score"))


NARRATIVE_SQL = rf"""WITH o AS (SELECT item_id, 'Der Betrag stieg und war mit ' || item_id || ' höher als ' || text AS s FROM benchmark),
b AS (SELECT item_id AS label_id, text AS label FROM benchmark),
p AS (SELECT item_id, label_id, {_sql_stems("label")} AS a, {_sql_stems("s")} AS c, regexp_extract_all(s, '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w,
  len(regexp_extract_all(s, '-?\p{{Nd}}[\p{{Nd}}.,]*')) AS n FROM o, b WHERE len(list_intersect(a, c)) > 0)
SELECT item_id, label_id, round(CASE WHEN len(a) = 0 OR len(w) < 6 THEN 0.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / len(a) * greatest(0::DOUBLE, 1 - 3 * n::DOUBLE / (n + len(w)))
  * least(1::DOUBLE, len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{_quoted(T.NARRATIVE)}]))::DOUBLE / 3) END, 9) AS score FROM p"""


def prose_filter(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("line")
    return _lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_prose(x)).alias("n_prose"), F.count_if(T.is_specific(x)).alias("n_specific"))


PROSE_SQL = rf"""WITH {LINES_SQL}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(line) >= 60 AND len(regexp_extract_all(line, '[\p{{L}}\p{{Nl}}\p{{No}}]{{3,}}')) >= 8
  AND len(regexp_extract_all(line, '\p{{Nd}}')) < 0.2::DOUBLE * length(line)) AS n_prose, count(*) FILTER (len(regexp_extract_all(line, '\p{{Nd}}')) >= 4) AS n_specific FROM l GROUP BY doc_id"""


def figure_filter(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "text", F.concat(F.lit("("), F.col("n_chars").cast("string"), F.lit(") -1.204,5 7 2022 A-1")), F.col("source")), " ")
    got = F.filter(words, T.looks_numeric)
    return table(spark, sf, "documents").select("doc_id", F.size(got).cast("long").alias("n_figures"), F.array_join(got, " ").alias("figures"))


FIGURE_SQL = r"""WITH d AS (SELECT doc_id, list_filter(string_split(text || ' (' || n_chars || ') -1.204,5 7 2022 A-1 ' || source, ' '),
  lambda w: regexp_matches(regexp_replace(w, '^\s+|\s+$', '', 'g'), '^-?\(?\p{Nd}[\p{Nd}.,]*\)?$') AND len(regexp_extract_all(w, '\p{Nd}')) >= 2) AS g FROM documents)
SELECT doc_id, len(g)::BIGINT AS n_figures, array_to_string(g, ' ') AS figures FROM d"""


def hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), V.chunk_id(F.col("doc_id"), F.lit(7), F.col("text")).alias("chunk_id"))


HASH_SQL = "SELECT doc_id, sha256(text) AS content_hash, doc_id || ':00007:' || left(sha256(doc_id || ':7:' || text), 12) AS chunk_id FROM documents"


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    year = F.left("d", F.lit(4))
    period = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("instant:"), "d")).when(F.col("o_orderkey") % 4 == 1, F.concat(year, F.lit("-01-01/"), year, F.lit("-12-31")))
              .when(F.col("o_orderkey") % 4 == 2, F.concat("d", F.lit("/"), year, F.lit("-12-31"))).otherwise(F.lit("")))
    return o.select("o_orderkey", "o_orderpriority", period.alias("period"))


PERIODS_SQL = """p AS (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS d, left(d, 4) AS y,
  CASE o_orderkey % 4 WHEN 0 THEN 'instant:' || d WHEN 1 THEN y || '-01-01/' || y || '-12-31' WHEN 2 THEN d || '/' || y || '-12-31' ELSE '' END AS period FROM orders),
q AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'zum ' || strftime(d::DATE, '%d.%m.%Y') WHEN 1 THEN 'im Geschäftsjahr ' || y
  WHEN 2 THEN CASE WHEN d = y || '-01-01' THEN 'im Geschäftsjahr ' || y ELSE 'für den Zeitraum ' || strftime(d::DATE, '%d.%m.%Y') || ' bis 31.12.' || y END ELSE '' END AS phrase FROM p),
r AS (SELECT *, replace('Wie hoch war ' || o_orderpriority || ' ' || phrase || '?', '  ', ' ') AS question FROM q)"""


def period_phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = _periods(spark, sf)
    return p.select("o_orderkey", V.describe_period(F.col("period")).alias("phrase"), V.phrase_question(F.col("o_orderpriority"), F.col("period")).alias("question"))


PHRASES_SQL = f"WITH {PERIODS_SQL} SELECT o_orderkey, phrase, question FROM r"


def period_markers(spark: SparkSession, sf: str) -> DataFrame:
    p = _periods(spark, sf)
    return p.select("o_orderkey", F.array_join(F.array_sort(V.periods_in(V.phrase_question(F.col("o_orderpriority"), F.col("period")))), " ").alias("markers"))


MARKERS_SQL = rf"""WITH {PERIODS_SQL}, m AS (SELECT o_orderkey, question, regexp_extract_all(question, '\b\d{{1,2}}\.\d{{1,2}}\.(?:19|20)\d{{2}}\b') AS ds FROM r)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_concat(
  list_transform(ds, lambda x: 'instant:' || string_split(x, '.')[3] || '-' || lpad(string_split(x, '.')[2], 2, '0') || '-' || lpad(string_split(x, '.')[1], 2, '0')),
  list_transform(ds, lambda x: string_split(x, '.')[3])), regexp_extract_all(question, '\b((?:19|20)\d{{2}})\b', 1)))), ' ') AS markers FROM m"""


def _printed(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as reports print them: German or English, signs, parentheses, units, bare."""
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice").cast("decimal(18,4)"), 2).alias("v"))
    english = F.format_number("v", 2)
    german = F.translate(english, ",.", ".,")
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, german).when(k == 1, F.concat(F.lit("("), english, F.lit(") EUR"))).when(k == 2, F.concat(F.lit("-"), german)).when(k == 3, F.col("v").cast("string"))
            .when(k == 4, F.concat(F.lit("EUR "), F.substring_index(german, ",", 1))).otherwise(F.lit("-")))
    return o.select("o_orderkey", text.alias("printed"))


PRINTED_SQL = """v AS (SELECT o_orderkey, o_orderkey % 6 AS k, round(o_totalprice::DECIMAL(18,4), 2) AS v, format('{:,.2f}', v::DOUBLE) AS e, translate(e, ',.', '.,') AS g FROM orders),
w AS (SELECT o_orderkey, CASE k WHEN 0 THEN g WHEN 1 THEN '(' || e || ') EUR' WHEN 2 THEN '-' || g WHEN 3 THEN v::DECIMAL(18,2)::VARCHAR WHEN 4 THEN 'EUR ' || string_split(g, ',')[1] ELSE '-' END AS printed FROM v)"""


def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    w = _printed(spark, sf)
    return w.select("o_orderkey", "printed", V.normalise_number(F.col("printed")).cast("decimal(18,2)").alias("value"),
                    V.normalise_number(F.col("printed"), F.lit("ixt:num-dot-decimal")).cast("decimal(38,10)").cast("double").alias("as_dot_decimal"))


PARSE_SQL = rf"""WITH {PRINTED_SQL}, c AS (SELECT *, regexp_replace(printed, '[^\p{{Nd}},.\-()]', '', 'g') AS kept, regexp_replace(kept, '^[()]+|[()]+$', '', 'g') AS bare,
  starts_with(bare, '-') AS minus, (starts_with(kept, '(') AND ends_with(kept, ')')) OR minus AS neg, CASE WHEN minus THEN bare[2:] ELSE bare END AS s,
  length(s) - length(replace(s, ',', '')) AS nc, length(s) - length(replace(s, '.', '')) AS nd FROM w),
m AS (SELECT *, CASE WHEN nc > 0 AND nd > 0 THEN CASE WHEN strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN ',' ELSE '.' END
  WHEN nc = 1 AND length(string_split(s, ',')[-1]) <> 3 THEN ',' WHEN nd = 1 AND nc = 0 AND length(string_split(s, '.')[-1]) <> 3 THEN '.' ELSE '' END AS mark FROM c),
p AS (SELECT *, CASE mark WHEN ',' THEN replace(replace(s, '.', ''), ',', '.') WHEN '.' THEN replace(s, ',', '') ELSE regexp_replace(s, '[.,]', '', 'g') END AS plain FROM m)
SELECT o_orderkey, printed, CASE WHEN neg THEN -try_cast(nullif(plain, '') AS DECIMAL(18,2)) ELSE try_cast(nullif(plain, '') AS DECIMAL(18,2)) END AS value,
  CASE WHEN regexp_matches(replace(s, ',', ''), '^(\d+\.?\d*|\.\d+)$') THEN CASE WHEN neg THEN -1 ELSE 1 END * replace(s, ',', '')::DOUBLE END AS as_dot_decimal FROM p"""


def fact_values(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    scale = (F.col("l_linenumber") - 4) * 2
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    v = V.fact_value(F.round(F.col("l_quantity").cast("decimal(18,4)"), 2), scale, sign)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.cast("decimal(28,8)").alias("value"))


FACT_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (round(l_quantity::DECIMAL(18,4), 2)::DECIMAL(10,2) * CASE (l_linenumber - 4) * 2 WHEN -6 THEN 0.000001::DECIMAL(18,6) WHEN -4 THEN 0.0001::DECIMAL(18,6)
  WHEN -2 THEN 0.01::DECIMAL(18,6) WHEN 0 THEN 1::DECIMAL(18,6) WHEN 2 THEN 100::DECIMAL(18,6) WHEN 4 THEN 10000::DECIMAL(18,6) WHEN 6 THEN 1000000::DECIMAL(18,6) END
  * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::DECIMAL(28,8) AS value FROM lineitem"""


def format_figures(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    v = F.round((F.col("o_totalprice") - 150000).cast("decimal(18,4)"), 2)
    return o.select("o_orderkey", V.format_figure(v, F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("EUR")).alias("figure"))


FORMAT_SQL = """WITH o AS (SELECT o_orderkey, round((o_totalprice - 150000)::DECIMAL(18,4), 2) AS v FROM orders)
SELECT o_orderkey, trim(CASE WHEN v < 0 THEN '-' ELSE '' END || translate(format('{:,.2f}', abs(v)::DOUBLE), ',.', '.,') || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'EUR' END) AS figure FROM o"""


def reply_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    k, a, n = F.col("event_id") % 7, F.col("event_type"), (F.col("user_id") % 5).cast("string")
    j = lambda answer, passage: F.concat(F.lit('Sure.\n```json\n{"answer": '), answer, F.lit(', "passage": '), passage, F.lit("}\n```"))
    quoted = F.concat(F.lit('" '), a, F.lit(' "'))
    reply = (F.when(k == 0, j(quoted, n)).when(k == 1, j(quoted, F.concat(F.lit('"'), n, F.lit('"')))).when(k == 2, j(quoted, F.lit("true"))).when(k == 3, j(n, n))
             .when(k == 4, F.concat(F.lit('{"answer": '), a)).when(k == 5, a).otherwise(j(quoted, F.lit("null"))))
    got = T.parse_reply(reply)
    return e.select("event_id", got["answer"].alias("answer"), got["passage"].cast("long").alias("passage"))


REPLY_SQL = """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 6) THEN event_type ELSE '' END AS answer, (CASE WHEN event_id % 7 IN (0, 1) THEN user_id % 5 ELSE 0 END)::BIGINT AS passage FROM events"""


def comparable_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    fields = {"confidence": F.round("value", 3), "status": F.col("event_type"), "text": F.col("props"), "value": F.col("user_id")}
    return e.select("event_id", F.md5(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]))).alias("digest"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.md5(T.prompt(F.concat(F.lit("What of "), F.col("conv_id").cast("string")), F.transform("t", lambda x: x["text"]))).alias("prompt_md5"))


PROMPTS_SQL = """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
SELECT conv_id, md5(string_agg('<passage number="' || n || '">' || chr(10) || text || chr(10) || '</passage>', chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question: What of ' || conv_id) AS prompt_md5
FROM c GROUP BY conv_id"""

QUERIES = {
    "tokenize_documents": (tokenize_documents, TOKENIZE_SQL),
    "word_counts": (word_counts, WORD_COUNTS_SQL),
    "sentence_split": (sentence_split, SENTENCE_SQL),
    "strip_figures": (strip_figures, STRIP_SQL),
    "content_terms": (content_terms, CONTENT_SQL),
    "stems": (stems, STEMS_SQL),
    "narrative_score": (narrative_score, NARRATIVE_SQL),
    "prose_filter": (prose_filter, PROSE_SQL),
    "figure_filter": (figure_filter, FIGURE_SQL),
    "hash_ids": (hash_ids, HASH_SQL),
    "period_phrases": (period_phrases, PHRASES_SQL),
    "period_markers": (period_markers, MARKERS_SQL),
    "parse_numbers": (parse_numbers, PARSE_SQL),
    "fact_values": (fact_values, FACT_SQL),
    "format_figures": (format_figures, FORMAT_SQL),
    "reply_parse": (reply_parse, REPLY_SQL),
    "comparable_json": (comparable_json, None),
    "prompts": (prompts, PROMPTS_SQL),
}
