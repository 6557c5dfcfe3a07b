"""Questions, cases, and the measures of a run."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidentia.functions import text as T, values as V
from evidentia.operators import ledger as L

# Seeds, sizes and years of the cases.
SEED, QUESTIONS, CASES, YEARS, RESAMPLES, BINS = 20260730, 40, 20, (2009, 2011, 2013), 10_000, 10
BOOTSTRAP_SEED = 20260729


def sample(rows: DataFrame, key: str, by: str, most: int, salt: str = "") -> DataFrame:
    """At most so many rows of each by, those of the smallest MD5 of salt and key: reproducible, and spread over all tasks."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def sample_exact(rows: DataFrame, key: str, by: str, most: int, seed: int = SEED) -> DataFrame:
    """As sample, but the rows that Python's random.Random(seed).sample picks from each by's rows in the order of key. One group is one task."""
    kind = rows.schema[by].dataType.simpleString()
    keyed = rows.schema[key].dataType.simpleString()

    def pick(x: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(x[key].tolist())
        got = random.Random(seed).sample(keys, most) if len(keys) > most else keys
        return pd.DataFrame({by: x[by].iloc[0], key: got})

    return rows.join(rows.select(by, key).groupBy(by).applyInPandas(pick, f"`{by}` {kind}, `{key}` {keyed}"), [by, key], "left_semi")


def exact_questions(facts: DataFrame, own: DataFrame, pooled: DataFrame, most: int = QUESTIONS) -> DataFrame:
    """question_id, document_id, text, fact_id, value, label_source: one for each key with a label, own before pooled, of a sample per document."""
    first = L.first_facts(facts).join(own.select("document_id", "concept", F.col("text").alias("own")), ["document_id", "concept"], "left").join(
        pooled.select("concept", F.col("text").alias("pool")), "concept", "left")
    subject = F.coalesce(F.nullif("own", F.lit("")), F.nullif("pool", F.lit("")))
    rows = first.withColumns({"subject": subject, "label_source": F.when(F.coalesce("own", F.lit("")) != "", "own").otherwise("pooled")}).where(subject.isNotNull())
    picked = sample(rows, "fact_id", "document_id", most, str(SEED))
    return picked.select(F.concat(F.col("document_id").cast("string"), F.lit(":ef:"), "fact_id").alias("question_id"), "document_id", V.phrase_question(F.col("subject"), F.col("period")).alias("text"), "fact_id", "value", "label_source")


def narrative_questions(pairs: DataFrame) -> DataFrame:
    """question_id, document_id, text, n_gold: confirmed pairs(document_id, seq, sentence, fact_id, confirmed) that read alike without figures are one question."""
    q = pairs.where("confirmed").withColumn("text", T.strip_figures(F.col("sentence"))).where("text <> ''")
    got = q.groupBy("document_id", "text").agg(F.min_by("fact_id", "seq").alias("fact_id"), F.count("*").alias("n_gold"))
    return got.select(F.concat(F.col("document_id").cast("string"), F.lit(":nr:"), "fact_id").alias("question_id"), "document_id", "text", "n_gold")


def _lacking(facts: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """document_id, concept of declared(concept, label) that a document does not tag, and document_id, label of the wordings of those that it tags."""
    tagged = facts.select("document_id", "concept").distinct()
    # what each document lacks: one row for each document and concept of the corpus, not for each label
    lacking = tagged.select("document_id").distinct().join(declared.select("concept").distinct()).join(tagged, ["document_id", "concept"], "left_anti")
    return lacking, tagged.join(declared.select("concept", "label").distinct(), "concept").select("document_id", "label").distinct()


def foreign_wordings(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """document_id, concept, label of foreign_labels, without naming the other documents: a wording that many declare is one row."""
    declared = labels.where("text <> ''").groupBy("concept", F.col("text").alias("label")).agg(F.min("document_id").alias("_first"), F.max("document_id").alias("_last"))
    lacking, reachable = _lacking(facts, declared)
    others = lacking.join(declared, "concept").where("_first <> document_id OR _last <> document_id")
    return others.join(reachable, ["document_id", "label"], "left_anti").select("document_id", "concept", "label")


def foreign_labels(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """document_id, other, concept, label: labels that other documents declare for concepts that this one does not tag, worded as none of its own tagged concepts."""
    declared = labels.where("text <> ''").select("concept", F.col("document_id").alias("other"), F.col("text").alias("label"))
    lacking, reachable = _lacking(facts, declared)
    return lacking.join(declared, "concept").where("other <> document_id").join(reachable, ["document_id", "label"], "left_anti").select("document_id", "other", "concept", "label")


def cases(facts: DataFrame, labels: DataFrame, most: int = CASES) -> DataFrame:
    """case_id, document_id, question, expectation, expected_value, note: answerable, wrong period, ambiguous and foreign cases, a sample of each per document.

    A concept is asked for by the document's own label or else by another document's, the first of the pooled wordings.
    """
    own = labels.where("text <> ''").groupBy("document_id", "concept").agg(F.min("text").alias("own"))
    pooled = L.pool_labels(labels).select("concept", F.col("wordings")[0].alias("pooled"))
    keys = facts.where("period <> ''").groupBy(*L.KEY).agg(F.countDistinct("value").alias("n"), F.min("value").alias("value")).join(own, ["document_id", "concept"], "left").join(pooled, "concept", "left")
    keys = keys.withColumn("label", F.coalesce("own", "pooled")).where("label IS NOT NULL").withColumn("key", F.concat_ws("|", "concept", "period"))
    asked = V.phrase_question(F.col("label"), F.col("period"))
    none = F.lit(None).cast(V.DECIMAL)
    out = lambda df, question, expectation, value, note: df.select(F.concat_ws("|", F.col("document_id").cast("string"), F.lit(note), "key").alias("case_id"), "document_id", question.alias("question"),
                                                                   F.lit(expectation).alias("expectation"), value.alias("expected_value"), F.lit(note).alias("note"))
    single = keys.where("n = 1")
    digit = F.conv(F.left(F.md5("key"), F.lit(4)), 16, 10).cast("int")
    year = F.element_at(F.array(*[F.lit(y) for y in YEARS]), digit % len(YEARS) + 1)
    # years of periods with a start and an end; an instant is no business year
    known = facts.where("period LIKE '%/%'").select("document_id", F.explode(V.years_of(F.col("period"))).alias("y")).distinct()
    traps = sample(single, "key", "document_id", most // 2, "trap").withColumn("year", year.cast("string")).join(known.withColumnRenamed("y", "year"), ["document_id", "year"], "left_anti")
    foreign = foreign_wordings(labels, facts).select("document_id", F.concat_ws("|", "concept", "label").alias("key"), "label").distinct()
    return (out(sample(single, "key", "document_id", most, "answer"), asked, "answer_from_ledger", F.col("value"), "answerable")
            .unionByName(out(traps, F.concat(F.lit("Wie hoch war "), "label", F.lit(" im Geschäftsjahr "), "year", F.lit("?")), "abstain", none, "wrong period"))
            .unionByName(out(sample(keys.where("n > 1"), "key", "document_id", most // 2, "ambiguous"), asked, "abstain", none, "ambiguous concept"))
            .unionByName(out(sample(foreign, "key", "document_id", most // 2, "foreign"), F.concat(F.lit("Wie hoch war "), "label", F.lit(" zum 31.12.2022?")), "abstain", none, "concept not tagged in this filing")))


def examples(facts: DataFrame, most: int = QUESTIONS) -> DataFrame:
    """KEY of some unambiguous keys in the order of a hash: what is shown as example questions, a sample by definition."""
    keys = L.values_per_key(facts).where("n_values = 1").select(*L.KEY, F.md5(F.concat_ws("|", F.col("document_id").cast("string"), "concept", "period")).alias("h"))
    return keys.orderBy("h", *L.KEY).limit(most).select(*L.KEY)


def deltas(runs: DataFrame, measures: list[str], order: str = "rung") -> DataFrame:
    """runs(rung, stratum, measures) with d_<measure>: the change from the rung before, in each stratum; null for the first."""
    before = Window.partitionBy("stratum").orderBy(order)
    return runs.withColumns({f"d_{m}": F.col(m) - F.lag(m).over(before) for m in measures})


def hit_ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, stratum, hit_rank (null: none), relevant ranks; questions without hits are misses. hits(query_id, rank, relevant boolean)."""
    got = hits.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("hit_rank"), F.array_sort(F.collect_list(F.when(F.col("relevant"), F.col("rank")))).alias("ranks"))
    return questions.select("query_id", "stratum").join(got, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def ndcg(ranks: Column, k: int = 10) -> Column:
    """Binary gains at the relevant ranks up to k over those of as many ranks from the top."""
    gain = lambda rs: F.aggregate(rs, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r.cast("double") + 1))
    near = F.filter(ranks, lambda r: r <= k)
    return F.when(F.size(near) > 0, gain(near) / gain(F.sequence(F.lit(1), F.size(near)))).otherwise(F.lit(0.0))


def retrieval_scores(ranks: DataFrame) -> DataFrame:
    """One row for each stratum that has questions: recall at 1, 5, 10, MRR, nDCG at 10, shown first when found."""
    within = lambda k: F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0))
    got = ranks.groupBy("stratum").agg(F.count("*").alias("questions"), within(1).alias("recall_at_1"), within(5).alias("recall_at_5"), within(10).alias("recall_at_10"),
                                       F.avg(F.when(F.col("hit_rank") <= 10, 1.0 / F.col("hit_rank")).otherwise(0.0)).alias("mrr_at_10"), F.avg(ndcg(F.col("ranks"))).alias("ndcg_at_10"))
    return got.withColumn("shown_first_when_found", F.coalesce(F.try_divide("recall_at_1", "recall_at_10"), F.lit(0.0)))


def citation_scores(results: DataFrame, coverage: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Per stratum, of results(stratum, gold, top, cited, hit_rank), arrays of spans: coverage of the top passage, its tightness, overlap of what is cited."""
    covered = V.best_of(V.covers, F.col("gold"), F.col("top"))
    tight = F.coalesce(F.array_max(F.flatten(F.transform("top", lambda s: F.transform(F.filter("gold", lambda g: V.covers(s, g) >= coverage), lambda g: V.tightness(s, g))))), F.lit(0.0))
    rows = results.withColumns({"_c": covered, "_t": tight, "_i": V.best_of(V.iou, F.col("gold"), F.col("cited"))})
    right = F.col("_c") >= coverage
    first = F.col("hit_rank") == 1
    return rows.groupBy("stratum").agg(
        F.avg(right.cast("double")).alias("citation_coverage_at_1"), F.coalesce(F.avg(F.when(right, F.col("_t"))), F.lit(0.0)).alias("mean_tightness"), F.avg((F.col("_i") >= overlap).cast("double")).alias("citation_iou_at_50"),
        F.avg("_i").alias("mean_citation_iou"), F.coalesce(F.avg(F.when(first, (F.col("_i") >= overlap).cast("double"))), F.lit(0.0)).alias("citation_iou_given_rank_1"), F.count_if(first).alias("questions_at_rank_1"))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counts and shares of outcomes(expectation, note, answered, route, has_value, exact_value); shares over nothing are 0."""
    answerable, abstain = F.col("expectation") == "answer_from_ledger", F.col("expectation") == "abstain"
    trap, unclear, given = abstain & (F.col("note") == "wrong period"), abstain & (F.col("note") == "ambiguous concept"), F.col("answered")
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit & of), F.count_if(of)), F.lit(0.0))
    return outcomes.agg(F.count("*").alias("cases"), F.count_if(answerable).alias("answerable"), share(F.col("route") == "ledger", answerable).alias("routing_accuracy"), share(F.col("exact_value"), answerable).alias("answer_exact_match"),
                        F.count_if(abstain).alias("unanswerable"), share(~given, abstain).alias("abstention_recall"), share(abstain, ~given).alias("abstention_precision"), share(given, abstain).alias("false_answer_rate"),
                        F.count_if(trap).alias("wrong_period_traps"), share(~F.col("has_value"), trap).alias("trap_survival"), F.count_if(unclear).alias("ambiguous_cases"), share(~given, unclear).alias("ambiguity_detected"))


def latency(outcomes: DataFrame, *by: str) -> DataFrame:
    """p50 (interpolated median) and p95 (the value at position 0.95 n, from 0) of latency_ms, rounded to two places half to even."""
    at = lambda q: F.bround(F.percentile("latency_ms", F.lit(q)), 2)
    order = Window.partitionBy(*by).orderBy("latency_ms")
    place = outcomes.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*by))})
    p95 = place.where(F.col("_r") == F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1) + 1).select(*by, F.bround("latency_ms", 2).alias("p95"))
    return outcomes.groupBy(*by).agg(at(0.5).alias("p50")).join(p95, list(by))


def calibration_bins(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """lower, upper, count, mean_confidence, accuracy of each bin with predictions(confidence, correct); a confidence of 1 is in the last."""
    edges = [i / bins for i in range(bins + 1)]
    at = F.lit(None).cast("int")
    for i in range(bins):
        inside = (F.col("confidence") >= edges[i]) & ((F.col("confidence") < edges[i + 1]) | (F.lit(i == bins - 1) & (F.col("confidence") == edges[i + 1])))
        at = F.when(inside, i).otherwise(at)
    lower, upper = (F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + k) for k in (1, 2))
    got = predictions.withColumn("bin", at).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return got.select(lower.alias("lower"), upper.alias("upper"), "count", "mean_confidence", "accuracy")


def calibration(bins: DataFrame) -> DataFrame:
    """samples, expected and largest gap, overconfidence, of calibration_bins; rounded to four places half to even."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy"))
    over = F.greatest(F.col("mean_confidence") - F.col("accuracy"), F.lit(0.0))
    weighed = lambda v: F.coalesce(F.bround(F.try_divide(F.sum(F.col("count") * v), F.sum("count")), 4), F.lit(0.0))
    return bins.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("samples"), weighed(gap).alias("expected_calibration_error"), F.coalesce(F.bround(F.max(gap), 4), F.lit(0.0)).alias("max_calibration_error"), weighed(over).alias("overconfidence"))


def draw(resample: Column, i: Column, n: Column) -> Column:
    """A place from 0 to n - 1, by two rounds of multiplication modulo 2^31 - 1."""
    m = 2_147_483_647
    x = (resample * 7_919 + i * 104_729 + 1) % m
    return (x * 48_271 % m) * 69_621 % m % n


def paired_bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, confidence: float = 0.95) -> DataFrame:
    """baseline, candidate, delta, low, high, n, discordant, significant of pairs(query_id, baseline, candidate).

    Draws are hashed, so resamples are spread over all tasks. No pairs: no row.
    """
    rows = pairs.select("query_id", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("d")).withColumn("i", F.row_number().over(Window.orderBy("query_id")) - 1)
    n = rows.agg(F.count("*").alias("n"))
    spread = pairs.sparkSession.range(resamples).withColumnRenamed("id", "resample").join(F.broadcast(n)).where("n > 0")
    drawn = spread.select("resample", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("resample", draw(F.col("resample"), F.col("k"), F.col("n")).alias("i"))
    means = drawn.join(rows.select("i", "d"), "i").groupBy("resample").agg(F.round(F.avg("d"), 12).alias("m"))
    tail = (1 - confidence) / 2
    low, high = int(tail * resamples), min(int((1 - tail) * resamples), resamples - 1)
    placed = means.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)
    bounds = placed.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high"))
    whole = rows.agg(F.avg("baseline").alias("baseline"), F.avg("candidate").alias("candidate"), F.avg("d").alias("delta"), F.count("*").alias("n"), F.count_if(F.col("d") != 0).alias("discordant")).where("n > 0")
    return whole.join(F.broadcast(bounds)).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def paired_bootstrap_exact(pairs: DataFrame, resamples: int = RESAMPLES, confidence: float = 0.95, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """As paired_bootstrap, with the draws of Python's random.Random(seed).choices over pairs by query_id. All pairs are one task: they are one run's questions."""
    def run(batches):
        x = pd.concat([*batches, pd.DataFrame({"query_id": [], "baseline": [], "candidate": []})]).sort_values("query_id")
        if len(x):
            d = (x["candidate"] - x["baseline"]).tolist()
            rng, n = random.Random(seed), len(d)
            means = sorted(sum(rng.choices(d, k=n)) / n for _ in range(resamples))
            tail = (1 - confidence) / 2
            low, high = means[int(tail * resamples)], means[min(int((1 - tail) * resamples), resamples - 1)]
            yield pd.DataFrame([(x["baseline"].mean(), x["candidate"].mean(), sum(d) / n, low, high, n, sum(v != 0 for v in d), low > 0 or high < 0)],
                               columns=["baseline", "candidate", "delta", "low", "high", "n", "discordant", "significant"])

    return pairs.select("query_id", "baseline", "candidate").coalesce(1).mapInPandas(run, "baseline double, candidate double, delta double, low double, high double, n long, discordant long, significant boolean")


def risk_coverage(outcomes: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, coverage, false_answer_rate: passage answers below the threshold become abstentions; ledger answers stay. One pass over the outcomes."""
    each = outcomes.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    given = F.col("answered") & ((F.col("route") == "ledger") | (F.col("confidence") >= F.col("threshold")))
    answerable, abstain = F.col("expectation") == "answer_from_ledger", F.col("expectation") == "abstain"
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit & of), F.count_if(of)), F.lit(0.0))
    got = each.groupBy("threshold").agg(share(F.col("route") == "ledger", answerable).alias("routed"), share(F.col("exact_value") & given, answerable).alias("exact"), share(given, abstain).alias("false_answer_rate"))
    return got.select("threshold", F.when(F.col("routed") == 0, 0.0).otherwise(F.col("exact")).alias("coverage"), "false_answer_rate")
