"""Steps of the ledger whose work does not grow with the square of a document."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from evidentia.operators import ledger as L


def test_resolve_equals_brute_force_and_pairs_no_bands(spark):
    rng = random.Random(3)
    facts = [(rng.choice("ab"), f"f{i}", i, Decimal(rng.choice(["1000", "-1000", "1e6", "3.5e9"])) + Decimal(rng.randrange(900)) / rng.choice([100, 10_000_000_000]) if i % 50 else Decimal(0)) for i in range(900)]
    scales = [[1, 1000, 1_000_000], [1000], [1]]
    mentions = [(rng.choice("abc"), i, Decimal(rng.choice(["1000", "-1000", "1", "3500", "1004.99", "995.03"])) + Decimal(rng.randrange(-90, 90)) / rng.choice([100, 10_000_000_000]), rng.choice(scales)) for i in range(300)]
    f = spark.createDataFrame(facts, "document_id string, fact_id string, seq long, value decimal(38,10)").repartition(3)
    m = spark.createDataFrame(mentions, "document_id string, mention_id long, value decimal(38,10), scales array<bigint>").repartition(3)
    expected = {}
    for d, i, value, ks in mentions:
        found = []
        for k, scale in enumerate(ks):
            v = float((value * scale).quantize(Decimal("1e-6"), ROUND_HALF_UP))  # Spark keeps six places of this product
            for e, name, seq, w in facts:
                if e == d and v and w and (v > 0) == (w > 0) and (error := abs(v - float(w)) / abs(float(w))) < 0.005:
                    found.append((Decimal(repr(error)).quantize(Decimal("1e-12"), ROUND_HALF_UP), seq, k, name))
        if found:
            expected[i] = min(found)[3], float(min(found)[0])
    got = L.resolve(m, f)
    assert {r["mention_id"]: (r["fact_id"], r["error"]) for r in got.collect()} == expected and len(expected) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "band" in x]


def test_resolve_many_near_values_of_one_document(spark):
    """40,000 mentions and facts within the tolerance of each other: 1.6 thousand million pairs."""
    n = 40_000
    f = spark.range(n).select(F.lit(1).alias("document_id"), F.concat(F.lit("f"), "id").alias("fact_id"), F.col("id").alias("seq"), (F.lit(1_000_000) + F.col("id") / 10).cast("decimal(38,10)").alias("value"))
    m = f.select("document_id", F.col("seq").alias("mention_id"), (F.col("value") + F.lit("0.01").cast("decimal(38,10)")).cast("decimal(38,10)").alias("value"), F.array(F.lit(1).cast("long")).alias("scales"))
    assert L.resolve(m, f).where("fact_id = concat('f', mention_id)").count() == n


def test_labels_are_merged_not_broadcast(spark):
    loc = spark.createDataFrame([("a", 1, "l1", "x#ns_One"), ("a", 2, "l2", "x#ns_Two")], "file string, seq long, key string, href string")
    arc = spark.createDataFrame([("a", 1, "l1", "t1"), ("a", 2, "l1", "t2"), ("a", 3, "l2", "t3")], "file string, seq long, from_key string, to_key string")
    label = spark.createDataFrame([("a", 1, "t1", "de", "other", "late"), ("a", 2, "t2", "DE", L.ROLES[3], "best"), ("a", 3, "t3", "de", None, "two"), ("a", 4, "t3", "en", None, "no")], "file string, seq long, key string, lang string, role string, text string")
    got = L.linkbase_labels(loc, arc, label)
    assert {(r["concept"], r["text"]) for r in got.collect()} == {("ns:One", "best"), ("ns:Two", "two")}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_questions_make_no_row_for_each_wording_or_period(spark):
    words = spark.createDataFrame([(1, "c1", "umsatz gesamt"), (1, "c1", "erlös"), (1, "c2", "umsatz inland"), (1, "c3", "eins zwei drei vier fünf"), (1, "c4", "umsatz umsatz gesamt"), (2, "c1", "umsatz gesamt"), (1, "c5", "ab")], "document_id int, concept string, wording string")
    periods = spark.createDataFrame([(1, "c1", "instant:2020-12-31"), (1, "c1", "2021-01-01/2021-12-31"), (1, "c3", "instant:2022-01-01"), (1, "c4", "instant:2019-12-31")], "document_id int, concept string, period string")
    q = spark.createDataFrame([(1, 1, "umsatz gesamt zum 31.12.2020"), (2, 1, "zwei drei vier fünf 2022"), (3, 1, "zwei vier fünf 2022"), (4, 3, "umsatz gesamt 2020"), (5, 2, "umsatz gesamt 2020"), (6, 1, ""), (7, 1, "umsatz gesamt")], "query_id int, document_id int, text string")
    got = L.route(q, words, periods)
    rows = {r["query_id"]: (r["route"], r["concepts"], r["period"]) for r in got.collect()}
    assert rows == {1: ("passage", ["c4"], ""), 2: ("ledger", ["c3"], "instant:2022-01-01"), 3: ("passage", [], ""), 4: ("passage", [], ""), 5: ("passage", ["c1"], ""), 6: ("passage", [], ""), 7: ("passage", ["c4"], "")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and ("term" in x or "concept" in x and "query_id" in x)] and "groupBy(query_id" not in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(query_id" in x]


def test_facts_number_order_lines_once(spark, sf):
    from evidentia.plans import ledger_queries

    plan = ledger_queries.facts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Relation") == 2


def test_foreign_wordings_are_one_row_for_all_who_declare_them(spark):
    from evidentia.operators import evaluation as E

    labels = spark.createDataFrame([(1, "a", "A"), (2, "a", "A"), (3, "a", "A"), (1, "b", "B"), (4, "c", "A"), (4, "d", "D"), (5, "e", "")], "document_id int, concept string, text string")
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x")], "document_id int, concept string")
    expected = {tuple(r) for r in E.foreign_labels(labels, facts).select("document_id", "concept", "label").collect()}
    got = [tuple(r) for r in E.foreign_wordings(labels, facts).collect()]
    assert set(got) == expected and len(got) == len(set(got)) > 3
