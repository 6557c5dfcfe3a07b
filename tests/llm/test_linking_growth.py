"""Rows that are sent when the members of a crowded key meet."""

from pyspark.sql import functions as F

from evidentia.llm import linking
from evidentia.llm.linking import dealt


def open_rows(spark, n):
    rows = spark.range(n).select(F.lit(5).cast("long").alias("key"), "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("main"))
    return rows.unionByName(rows.where("id < 3").withColumn("key", F.lit(6).cast("long")))


def test_rows_sent_grow_as_a_key_does(spark):
    sent = [dealt(open_rows(spark, n), 16).count() / n for n in (200, 2000)]
    assert max(sent) <= 2 * linking.WAYS + 1


def test_every_row_outside_the_main_root_asks_every_other(spark, monkeypatch):
    monkeypatch.setattr(linking, "HELD", 40)  # blocks of 40 rows, more than WAYS of them
    got = dealt(open_rows(spark, 300), 16)
    tasks = {}
    for r in got.collect():
        tasks.setdefault((r["task"], r["key"]), ([], []))[r["asks"]].append(r["id"])
    met = {(key, a, b) for (_, key), (held, asks) in tasks.items() for a in asks for b in held}
    assert met == {(5, a, b) for a in range(1, 300) for b in range(300)} | {(6, a, b) for a in (1, 2) for b in range(3)}
    assert all(len(held) < 100 and len(asks) < 100 for held, asks in tasks.values())
