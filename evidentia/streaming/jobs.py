"""Streaming forms of the counters and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators.operations import counters
from evidentia.sources.shared import shared_path


def run_counters(answers: DataFrame, out: str | None = None) -> DataFrame:
    """Counters over a stream answers(route, status, latency_ms), run until its input at hand is used; the last totals."""
    spark = answers.sparkSession
    out = out or shared_path(spark, "counters")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n % 2}")
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").json(f"{out}/last")

    query = counters(answers).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", shared_path(spark, "counters-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    n = spark.read.json(f"{out}/last").first()["n"]
    return spark.read.parquet(f"{out}/{n % 2}")


def limited(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """caller, event_id, accepted, remaining of a stream requests(caller, ts double, event_id): state is each caller's accepted times within the window.

    Requests of one caller must arrive in order of ts across batches; within one batch they are sorted. The state
    is as many times as the limit for each caller that had one accepted; a caller without any is forgotten. (A timeout by the clock would keep a stream over
    all input at hand from ending.)
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        x = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(x["ts"], x["event_id"], strict=True):
            held = [t for t in held if ts - t <= window_seconds]
            ok = limit <= 0 or len(held) < limit
            if ok and limit > 0:
                held.append(float(ts))
            out.append((key[0], event, ok, limit - len(held) if ok else None))
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["caller", "event_id", "accepted", "remaining"]).astype({"remaining": "Int32"})

    kind = requests.schema["caller"].dataType
    rows = T.StructType().add("caller", kind).add("event_id", "long").add("accepted", "boolean").add("remaining", "integer")
    return requests.groupBy("caller").applyInPandasWithState(step, rows, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def run_limited(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """The decisions on all input at hand, as a table."""
    spark: SparkSession = requests.sparkSession
    out = shared_path(spark, "limited")
    query = limited(requests, limit, window_seconds).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "limited-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
