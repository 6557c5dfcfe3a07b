"""Ledger and audit tables as JSON, review lists as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SPAN = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
LEDGER = f"""document_id string, content_hash string, builder_version string, coverage double, concept_labels map<string,string>,
facts array<struct<fact_id:string,seq:int,concept:string,displayed:string,value:decimal(38,10),scale:int,sign:int,unit:string,context:string,period:string,span:{SPAN}>>,
prose_pairs array<struct<seq:int,sentence:string,mention:string,page:int,fact_id:string,concept:string,value:decimal(38,10),gold_span:{SPAN},names_concept:boolean,confirmed:boolean>>"""
AUDIT = f"""record_id string, recorded_at string, question string, document_id string, snapshot_id string, document_version string, pipeline_version string,
answer struct<status:string,route:string,text:string,value:string,unit:string,period:string,confidence:double,citations:array<struct<document_id:string,page:int,spans:array<{SPAN}>,quote:string,exact:boolean>>>"""


def write_ledgers(ledgers: DataFrame, path: str) -> None:
    """Ledgers, one JSON object a line, a folder for each document."""
    ledgers.withColumn("_folder", F.col("document_id")).write.mode("overwrite").partitionBy("_folder").json(path)


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def ledger_facts(ledgers: DataFrame) -> DataFrame:
    return ledgers.select("document_id", F.inline("facts"))


def ledger_labels(ledgers: DataFrame) -> DataFrame:
    return ledgers.select("document_id", F.explode("concept_labels").alias("concept", "text"))


def empty_corpus(spark: SparkSession) -> DataFrame:
    """A corpus without documents: valid, with nothing to find."""
    return spark.createDataFrame([], LEDGER)


def append_audit(records: DataFrame, path: str) -> None:
    """Adds records to the log; files are only ever added."""
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All records; none where nothing was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(AUDIT).json(path) if there else spark.createDataFrame([], AUDIT)


def find_record(log: DataFrame, record_id: str) -> DataFrame:
    return log.where(F.col("record_id") == record_id).limit(1)


def write_review_csv(pairs: DataFrame, path: str) -> bool:
    """Candidates for review, of each document those first that name their concept. Nothing is written without any; returns whether there was one."""
    if pairs.isEmpty():
        return False
    rows = pairs.select(F.lit("").alias("confirmed"), F.when(F.col("names_concept"), "y").otherwise("n").alias("names_concept"), "document_id", "mention", "concept", F.col("value").cast("string").alias("value"), "page", "fact_id", "sentence", "seq")
    rows.orderBy("document_id", F.desc("names_concept"), "seq").drop("seq").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return True


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """fact_id, mention, page, sentence, decision of a review list with its first column filled in."""
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return got.select("fact_id", "mention", F.col("page").cast("int").alias("page"), "sentence", F.lower(F.trim("confirmed")).alias("decision"))
