"""Shared helpers: reading tables, staging results in the shared folder, row hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_STAGED: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="evidentia-"))
    return _OWN[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"staged": path})


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = (df.schema.fields[0].metadata or {}).get("staged")
    if path:
        _delete(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


def release() -> None:
    """Delete every staged table of this process; call it once their results have been written."""
    while _STAGED:
        _delete(*_STAGED.pop())


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remainder(column: str, n: int) -> F.Column:
    """crc32 of a column's text, modulo n; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first most rows by a hash of the key columns, then the keys; all rows if there are no more.

    Only rows below a hash bound, about twice as many as wanted, reach the final sort: the bound follows from the count.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(1 << 40))
    near = df if n <= most else df.where(h < int((1 << 40) * min(1.0, (2 * most + 1000) / n)))
    return near.orderBy(h, *keys).limit(most)


def placed(docs: DataFrame, name: str) -> DataFrame:
    """doc (a struct of all columns), file and row, which name a row alike in every scan, whatever its splits.

    Rows read from Parquet are named by their file and their place in it; any others are numbered and written to the shared folder once.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if node.getClass().getSimpleName() == "LogicalRelation" and "parquet" in node.relation().toString().lower():
        return docs.select(doc, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return staged(docs.select(doc, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")), name)


def joined_hot(rows: DataFrame, table_: DataFrame, key: str, size: str, total: int, share: float = 0.001) -> DataFrame:
    """rows left-joined with table_(key unique, size, ..) where some keys may hold a large part of the rows.

    Keys whose size, their number of rows, is at least that share of the total are 1 / share at most: they come to the rows by
    broadcast. All others meet in a shuffle.
    """
    hot = F.broadcast(staged(table_.where(F.col(size) >= max(2.0, share * total)), "hot"))
    cold = table_.where(F.col(size) < max(2.0, share * total))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    The threads of the listener bus hold the event they saw last, with the plan of the query that has just ended: a job without tasks takes its place.
    """
    gc.collect()
    sc = spark.sparkContext
    sc._jsc.emptyRDD().count()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc._jvm.System.gc()
