from decimal import Decimal

from evidentia.operators import evaluation as E


def test_no_trap_in_a_year_that_the_document_reports(spark):
    spans = [f"{y}-01-01/{y}-12-31" for y in E.YEARS]
    instants = [f"instant:{y}-12-31" for y in E.YEARS]
    periods = {"spans": spans, "instants": instants, "one": [spans[0], "instant:2022-12-31"]}
    facts = [(d, f"c{i}", p, Decimal(i)) for d, ps in periods.items() for i in range(12) for p in ps]
    labels = [(d, f"c{i}", f"Posten {i}") for d in periods for i in range(12)]
    got = E.cases(spark.createDataFrame(facts, "document_id string, concept string, period string, value decimal(38,10)"),
                  spark.createDataFrame(labels, "document_id string, concept string, text string")).where("note = 'wrong period'").collect()
    asked = {d: {int(r["question"].split()[-1].rstrip("?")) for r in got if r["document_id"] == d} for d in periods}
    assert not asked["spans"]
    assert asked["instants"] and asked["instants"] <= set(E.YEARS)
    assert asked["one"] and E.YEARS[0] not in asked["one"]
