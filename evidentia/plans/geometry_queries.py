"""Queries of rectangles over order lines: each line is a box on a page of its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidentia.functions import values as V
from evidentia.operators import citation
from evidentia.sources.tables import table


def boxed(lines: DataFrame) -> DataFrame:
    """Order lines with n, their place in the order, and their box: page, x0, y0, x1, y1."""
    x0, y0 = (F.col("l_partkey") % 80) / F.lit(100.0), (F.col("l_suppkey") % 80) / F.lit(100.0)
    w, h = (F.col("l_orderkey") % 15 + 1) / F.lit(100.0), (F.col("l_linenumber") % 5 + 3) / F.lit(100.0)
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    page = F.floor((F.col("n") - 1) / 3).cast("int")
    return lines.withColumn("n", line).withColumns({"page": page, "x0": x0, "y0": y0, "x1": x0 + w, "y1": y0 + h})


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(table(spark, sf, "lineitem")).select("l_orderkey", "n", "page", "x0", "y0", "x1", "y1")


BOXES_SQL = """x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, (l_partkey % 80) / 100.0::DOUBLE AS x0,
  (l_suppkey % 80) / 100.0::DOUBLE AS y0, (l_orderkey % 15 + 1) / 100.0::DOUBLE AS w, (l_linenumber % 5 + 3) / 100.0::DOUBLE AS h FROM lineitem),
b AS (SELECT l_orderkey, n, ((n - 1) // 3)::INT AS page, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM x)"""
SHARED = "CASE WHEN least(a.x1, c.x1) > greatest(a.x0, c.x0) AND least(a.y1, c.y1) > greatest(a.y0, c.y0) THEN (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) ELSE 0 END"
_area = lambda t: f"({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0)"


def _span(prefix: str = "") -> F.Column:
    return V.span(*[F.col(f"{prefix}{c}") for c in ("page", "x0", "y0", "x1", "y1")])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).select("l_orderkey", "n", "page", _span().alias("a"))
    return b.join(b.select("l_orderkey", "page", F.col("n").alias("m"), F.col("a").alias("c")), ["l_orderkey", "page"]).where("n < m")


PAIRS_SQL = f"WITH {BOXES_SQL}, p AS (SELECT a.l_orderkey, a.n, c.n AS m, {SHARED} AS s, {_area('a')} AS aa, {_area('c')} AS ac FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.page = c.page AND a.n < c.n)"


def span_normalise(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    s = V.from_rect(F.col("page"), F.col("x0") * 700 - 20, F.col("y0") * 900, F.col("x1") * 700, F.col("y1") * 900 + 60, F.lit(595.0), F.lit(842.0))
    return b.select("l_orderkey", "n", s.alias("s")).select("l_orderkey", "n", *[F.round(F.col(f"s.{c}"), 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


NORMALISE_SQL = f"""WITH {BOXES_SQL} SELECT l_orderkey, n, round(least(greatest((x0 * 700 - 20) / 595, 0), 1), 9) AS x0, round(least(greatest(y0 * 900 / 842, 0), 1), 9) AS y0,
  round(least(greatest(x1 * 700 / 595, 0), 1), 9) AS x1, round(least(greatest((y1 * 900 + 60) / 842, 0), 1), 9) AS y1 FROM b"""


def span_iou(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("l_orderkey", "n", "m", F.round(V.iou(F.col("a"), F.col("c")), 9).alias("iou"))


IOU_SQL = f"{PAIRS_SQL} SELECT l_orderkey, n, m, round(CASE WHEN s > 0 THEN s / (aa + ac - s) ELSE 0 END, 9) AS iou FROM p"


def span_tightness(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("l_orderkey", "n", "m", F.round(V.tightness(F.col("a"), F.col("c")), 9).alias("tightness"))


TIGHT_SQL = f"{PAIRS_SQL} SELECT l_orderkey, n, m, round(least(ac / aa, 1), 9) AS tightness FROM p"


def span_coverage_join(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that lie by half or more in another box of the page."""
    got = _pairs(spark, sf).where(V.covers(F.col("a"), F.col("c")) >= 0.5)
    return got.select("l_orderkey", F.col("n").alias("outer_n"), F.col("m").alias("inner_n"), F.round(V.covers(F.col("a"), F.col("c")), 9).alias("covered"))


COVER_SQL = f"{PAIRS_SQL} SELECT l_orderkey, n AS outer_n, m AS inner_n, round(s / ac, 9) AS covered FROM p WHERE s / ac >= 0.5::DOUBLE"


def span_union(spark: SparkSession, sf: str) -> DataFrame:
    got = citation.union_spans(boxes(spark, sf).select("l_orderkey", "page", _span().alias("span")), ["l_orderkey", "page"])
    return got.select("l_orderkey", "page", *[F.col(f"span.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], "n")


UNION_SQL = f"WITH {BOXES_SQL} SELECT l_orderkey, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY ALL"


def header_above(spark: SparkSession, sf: str) -> DataFrame:
    """For each box the nearest box above it on the page that overlaps it by over 0.3 of its width; of equally near ones the first."""
    b = boxes(spark, sf).select("l_orderkey", "page", F.col("n").alias("seq"), F.col("n").cast("string").alias("word"), _span().alias("span"))
    got = citation.headers_above(b.drop("word"), b, ["l_orderkey", "page"], ["l_orderkey", "seq"])
    return got.select("l_orderkey", F.col("seq").alias("n"), F.col("header.seq").alias("header"))


HEADER_SQL = f"""WITH {BOXES_SQL}, j AS (SELECT a.l_orderkey, a.n, c.n AS header, row_number() OVER (PARTITION BY a.l_orderkey, a.n ORDER BY c.y1 DESC, c.n) AS r FROM b a JOIN b c
  ON a.l_orderkey = c.l_orderkey AND a.page = c.page AND a.n <> c.n AND c.y1 <= a.y0 AND (least(a.x1, c.x1) - greatest(a.x0, c.x0)) / greatest(a.x1 - a.x0, 1e-9) > 0.3::DOUBLE)
SELECT l_orderkey, n, header FROM j WHERE r = 1"""


def region_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Regions written as text, parsed and padded for drawing."""
    o = table(spark, sf, "orders")
    n = F.col("o_orderkey") % 50
    raw = F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"), F.lit(",0.1, 0.95 ,0."), F.lpad((n + 20).cast("string"), 2, "0"), F.lit(";;0,0,1,1; "))
    r = V.outline(V.parse_regions(raw, F.col("o_custkey") % 7)[0])
    return o.select("o_orderkey", F.size(V.parse_regions(raw, F.lit(0))).cast("long").alias("regions"), r.alias("r")).select(
        "o_orderkey", "regions", F.col("r.page").alias("page"), *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


REGION_SQL = """SELECT o_orderkey, 2::BIGINT AS regions, (o_custkey % 7)::INT AS page, round(greatest((o_orderkey % 50) / 100.0::DOUBLE - 0.004::DOUBLE, 0), 6) AS x0, round(0.1::DOUBLE - 0.004::DOUBLE, 6) AS y0,
  round(0.95::DOUBLE + 0.004::DOUBLE, 6) AS x1, round((o_orderkey % 50 + 20) / 100.0::DOUBLE + 0.004::DOUBLE, 6) AS y1 FROM orders"""

QUERIES = {
    "span_normalise": (span_normalise, NORMALISE_SQL),
    "span_iou": (span_iou, IOU_SQL),
    "span_tightness": (span_tightness, TIGHT_SQL),
    "span_coverage_join": (span_coverage_join, COVER_SQL),
    "span_union": (span_union, UNION_SQL),
    "header_above": (header_above, HEADER_SQL),
    "region_parse": (region_parse, REGION_SQL),
}
