"""Mixing to target weights by soft domain membership. DataFrame operations only.

A naive Bayes classifier, fitted on labelled documents, gives every document a posterior over
domains. Its features are bins of a few shape figures (capitals, symbols, repetition, ..) and the
presence of the words that tell the domains apart best. Nonnegative document rates are then
fitted so that the expected tokens of each domain, sum of rate x tokens x posterior, match the
target shares of a budget: projected gradient descent on least squares from rate 1, with
residuals measured in the norm of the domains' token-weighted second moments, in which the
gradient's Lipschitz constant is 1. A step changes every rate by the product of its posterior and one
vector, so the rates are an expression of posteriors and the few vectors that the sums over all documents gave.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidentia.llm.common import bounded_sample, drop_staged, staged, table

#: Labelled documents the classifier is fitted on at most, and the documents of these that a word must be in.
LABELLED, LEAST_DOCS = 6000, 5
#: Likelihood ratio statistic that a word needs: a word that says nothing reaches it once in 100,000 times.
LEAST_G = 24.0
TARGETS = {"high": 0.9, "low": 0.1, "toxic": 0.0}
STEPS, CLOSE, CHAIN, BINS = 40, 1e-4, 10, 12
_SMOOTH = 0.5
#: What \s stands for beside the space; runs of characters that are neither capitals nor symbols nor digits.
_WHITE, _PLAIN = "\t\n\x0b\f\r", r"[a-z\s.,;:'-]+"


def domain(quality: Column, toxic: Column) -> Column:
    """toxic, else high or low; null where the labels don't tell."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "high").when((toxic == 0) & (quality == 0), "low")


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """Adds _words (distinct lower-case words), _bins (shape features) and _tokens of docs(text).

    Regular expressions see little of a text: white space is parted as spaces, words are sought in its distinct parts, and odd characters in
    what _PLAIN leaves. Each is a column of its own, so that it is computed once.
    """
    t = F.coalesce("text", F.lit(""))
    spaced = t
    for c in _WHITE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    rows = docs.withColumns({"_spaced": spaced, "_odd": F.regexp_replace(t, _PLAIN, ""), "_n": F.greatest(F.length(t), F.lit(1))})
    rows = rows.withColumn("_split", F.array_remove(F.split("_spaced", " "), ""))
    rows = rows.withColumns({"_own": F.array_distinct("_split"), "_tokens": F.size("_split").cast("long")})
    n = F.col("_n")
    size = F.greatest("_tokens", F.lit(1))
    held = lambda chars: (F.length("_odd") - F.length(F.regexp_replace("_odd", chars, ""))) / n
    # white space at an end parts nothing from the rest, which counts as one more
    ends = (F.col("_spaced").startswith(" ") | F.col("_spaced").endswith(" ") | (F.col("_spaced") == "")).cast("int")
    shape = {
        "capitals": held(r"\p{Lu}+"),
        "symbols": held(r"[^\p{L}\p{N}\s.,;:'’-]+"),
        "digits": held(r"\p{N}+"),
        "new": (F.size("_own") + ends) / size,
        "length": F.log2(n) / 20,
        "word": F.length(t) / size / 20,
        "lines": F.size(F.split(t, "\n")) / size,
    }
    bins = [F.concat(F.lit(f"{k}="), F.least(F.floor(F.sqrt(v) * BINS), F.lit(BINS)).cast("string")) for k, v in shape.items()]
    words = F.array_distinct(F.split(F.lower(F.array_join("_own", " ")), r"[^\p{L}]+"))
    return rows.select(*docs.columns, "_tokens", F.array(*bins).alias("_bins"), words.alias("_words"))


def fit_classifier(labelled: DataFrame, domains: list[str]) -> tuple[list[float], dict[str, list[float]]]:
    """Start log-weights of the domains, and for each feature what it adds, from labelled(domain, _bins, _words).

    labelled is a bounded sample; what comes to the driver are counts of the bins and of the words that reach LEAST_G.
    """
    rows = staged(labelled.select("domain", "_bins", "_words"), "labelled")
    per = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [per.get(d, 0) for d in domains]
    total = sum(n)
    one = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    rates = [(F.col(f"n{i}") + _SMOOTH) / (n[i] + 2 * _SMOOTH) for i in range(len(domains))]
    # the information that a word's presence has about the domain: pairs of rates apart, weighted by how common the word is
    mean = reduce(lambda a, b: a + b, (rates[i] * (n[i] / max(1, total)) for i in range(len(domains))))
    gain = reduce(lambda a, b: a + b, ((n[i] / max(1, total)) * (rates[i] * F.log(rates[i] / mean) + (1 - rates[i]) * F.log((1 - rates[i]) / (1 - mean))) for i in range(len(domains))))
    words = rows.select("domain", F.explode("_words").alias("f")).where("f <> ''").groupBy("f").agg(F.count("*").alias("n"), *one).where(F.col("n") >= LEAST_DOCS)
    words = words.where((mean < 1) & (2 * total * gain >= LEAST_G)).orderBy("f").collect()
    bins = rows.select("domain", F.explode("_bins").alias("f")).groupBy("f").agg(*one).collect()
    drop_staged(rows)
    start = [float(np.log((c + _SMOOTH) / (total + _SMOOTH * len(domains)))) for c in n]
    weights: dict[str, list[float]] = {}
    for r in bins:
        weights[r["f"]] = [float(np.log((r[f"n{i}"] + _SMOOTH) / (n[i] + _SMOOTH * (BINS + 1)))) for i in range(len(domains))]
    for r in words:
        p = [(r[f"n{i}"] + _SMOOTH) / (n[i] + 2 * _SMOOTH) for i in range(len(domains))]
        weights[f"word:{r['f']}"] = [float(np.log(x / (1 - x))) for x in p]
        start = [s + float(np.log(1 - x)) for s, x in zip(start, p, strict=True)]
    return start, weights


def slot_count(n: int) -> int:
    """Slots for n words: most of the words that are looked up find an empty one."""
    return 1 << (8 * n).bit_length()


def word_slots(words: dict[str, list[float]]) -> Column:
    """A literal array of slots, each an array of words (w) and their weights (v), by the words' xxhash64: a map's literal is searched from its start for every word."""
    slots: list[list[dict]] = [[] for _ in range(slot_count(len(words)))]
    for w, v in words.items():
        slots[(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) & (len(slots) - 1))].append({"w": w, "v": v})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<w:string,v:array<double>>>>")


def with_posteriors(rows: DataFrame, start: list[float], weights: dict[str, list[float]]) -> DataFrame:
    """Adds p0, p1, .. over the domains to rows with _bins and _words. The features' table is a literal: its size is bounded by the sample it was fitted on.

    The log-weights are a column of their own, so they are summed once for each row.
    """
    row = lambda v: F.array(*[F.lit(x) for x in v])
    add = lambda s, v: F.zip_with(s, v, lambda a, b: a + b)
    logit = row(start)
    bins = {k: v for k, v in weights.items() if not k.startswith("word:")}
    if bins:
        held = F.create_map(*[x for k, v in bins.items() for x in (F.lit(k), row(v))])
        none = row([0.0] * len(start))
        logit = F.aggregate("_bins", logit, lambda s, f: add(s, F.coalesce(F.try_element_at(held, f), none)))
    words = {k.removeprefix("word:"): v for k, v in weights.items() if k.startswith("word:")}
    if words:
        slots = word_slots(words)
        slot = lambda w: slots[F.pmod(F.xxhash64(w), F.lit(slot_count(len(words)))).cast("int")]
        logit = F.aggregate("_words", logit, lambda s, w: F.aggregate(slot(w), s, lambda t, e: F.when(e["w"] == w, add(t, e["v"])).otherwise(t)))
    rows = rows.withColumn("_logit", logit).withColumn("_most", F.array_max("_logit"))
    rows = rows.withColumns({f"p{i}": F.exp(F.col("_logit")[i] - F.col("_most")) for i in range(len(start))})
    total = reduce(lambda x, y: x + y, (F.col(f"p{i}") for i in range(len(start))))
    return rows.withColumn("_sum", total).withColumns({f"p{i}": F.col(f"p{i}") / F.col("_sum") for i in range(len(start))}).drop("_logit", "_most", "_sum")


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS) -> list[list[float]]:
    """The vectors of the descent, from rows(n_tokens, p0, p1, ..). Every step is one sum over all rows.

    The budget is the largest that needs no more than the tokens there are of any domain with a target. Unreachable targets
    are matched as nearly as nonnegative rates allow. No tokens, no steps.
    """
    d = len(domains)
    w = np.array([max(0.0, targets.get(k, 0.0)) for k in domains])
    if w.sum() <= 0:
        raise ValueError("a target must be positive")
    w /= w.sum()
    p = [F.col(f"p{i}") for i in range(d)]
    n = F.col("n_tokens")
    got = rows.agg(*[F.sum(n * p[i]).alias(f"e{i}") for i in range(d)], *[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    start = np.array([got[f"e{i}"] or 0.0 for i in range(d)])
    total = start.sum()
    if total <= 0:
        return []
    m = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / total
    inverse = np.linalg.inv(m + 1e-6 * np.trace(m) * np.eye(d))
    goal = w * min(start[i] / w[i] for i in range(d) if w[i] > 0)
    vectors: list[list[float]] = []
    now, base, best = start, rows.withColumn("_rate", F.lit(1.0)), None
    pending: list[list[float]] = []
    for _ in range(steps):
        v = (inverse @ (now - goal) / total).tolist()
        vectors.append(v)
        pending.append(v)
        rate = apply_rates(F.col("_rate"), p, pending)
        if len(pending) == CHAIN:  # a longer expression is slower than a table of the rates so far
            base = staged(base.withColumn("_rate", rate), "rates")
            pending, rate = [], F.col("_rate")
        got = base.agg(*[F.sum(rate * n * p[i]).alias(f"e{i}") for i in range(d)]).first()
        before, now = now, np.array([got[f"e{i}"] for i in range(d)])
        if abs(now - goal).max() <= CLOSE * total or abs(now - before).max() <= 1e-7 * total:
            break
    return vectors


def apply_rates(rate: Column, p: list[Column], vectors: list[list[float]]) -> Column:
    """rate after projected steps along the vectors. They are one literal, so all steps run the same generated code."""
    if not vectors:
        return rate
    held = F.array(*[F.array(*map(F.lit, v)) for v in vectors])
    return F.aggregate(held, rate, lambda r, v: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (x * v[i] for i, x in enumerate(p)))))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = LABELLED, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """docs with n_tokens, p_<domain> for each domain, rate and copies, from labels(doc_id, quality, toxic).

    copies is the rate's whole part, and one more with the chance of its fraction (by a hash of doc_id and text, so equal rows fare
    alike). Null and empty texts have no tokens and keep their rate. Null labels and ids don't teach; without labels the
    posteriors are equal. No shuffle of the documents: labels come to them as a broadcast of at most max_labelled rows.
    keep: the columns of docs that are wanted (all, if not given). Columns of the names above are replaced; whole: instead of those
    columns, only doc (a struct of docs' columns, whatever their names) and copies. Every text is read into features once.
    """
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    names = set() if whole else {"n_tokens", "rate", "copies", *(f"p_{k}" for k in domains)}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    given = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    picked = bounded_sample(given, max_labelled, "doc_id", "domain")
    labelled = with_features(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    start, weights = fit_classifier(labelled, domains)

    p = [F.col(f"p{i}") for i in range(len(domains))]
    u = F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    rows = with_features(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), u.alias("u"), "text"))
    rows = staged(with_posteriors(rows, start, weights).select("doc", "u", F.col("_tokens").alias("n_tokens"), *p), "posteriors")
    vectors = fit_rates(rows.select("n_tokens", *p), domains, targets)
    out = rows.withColumn("rate", apply_rates(F.lit(1.0), p, vectors))
    copies = (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int")).cast("long")
    if whole:
        return out.select("doc", copies.alias("copies"))
    return out.select("doc.*", "n_tokens", *[x.alias(f"p_{k}") for x, k in zip(p, domains, strict=True)], "rate", copies.alias("copies"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
