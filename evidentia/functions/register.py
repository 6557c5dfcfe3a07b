"""The main scalar functions under SQL names: register(spark), then SELECT parse_figure(text, '') FROM ..

They are SQL functions: their bodies are inlined and optimised like any expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from evidentia.functions import text as T, values as V

SPAN = "STRUCT<page: INT, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
_AREA = "greatest({0}.x1 - {0}.x0, 0D) * greatest({0}.y1 - {0}.y0, 0D)"
_SHARED = """CASE WHEN a.page = b.page AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
 THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) ELSE 0D END"""
_A, _B = _AREA.format("a"), _AREA.format("b")
_DATE = "concat_ws('.', substring({0}, 9, 2), substring({0}, 6, 2), left({0}, 4))"
_START, _END = "substring_index(p, '/', 1)", "substring_index(p, '/', -1)"

#: name -> (parameters, result type, body)
FUNCTIONS = {
    "tokens": ("t STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(coalesce(t, ''), r'{T.TOKEN}', 0), x -> lower(x))"),
    "word_total": ("t STRING", "INT", r"regexp_count(coalesce(t, ''), r'(?U)\S+')"),
    "span_area": (f"a {SPAN}", "DOUBLE", _A),
    "span_covers": (f"a {SPAN}, b {SPAN}", "DOUBLE", f"coalesce(try_divide({_SHARED}, nullif({_B}, 0D)), 0D)"),
    "span_iou": (f"a {SPAN}, b {SPAN}", "DOUBLE", f"coalesce(try_divide({_SHARED}, nullif({_A} + {_B} - {_SHARED}, 0D)), 0D)"),
    "print_figure": ("v DECIMAL(38,10), u STRING", "STRING", "trim(concat(CASE WHEN v < 0 THEN '-' ELSE '' END, translate(format_number(abs(bround(v, 2)), 2), ',.', '.,'), ' ', coalesce(u, '')))"),
    "describe_period": ("p STRING", "STRING", f"""CASE WHEN startswith(p, 'instant:') THEN concat('zum ', {_DATE.format("substring(p, 9)")})
 WHEN contains(p, '/') AND endswith({_START}, '-01-01') AND endswith({_END}, '-12-31') AND left({_START}, 4) = left({_END}, 4) THEN concat('im Geschäftsjahr ', left({_START}, 4))
 WHEN contains(p, '/') THEN concat('für den Zeitraum ', {_DATE.format(_START)}, ' bis ', {_DATE.format(_END)}) ELSE '' END"""),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session, and parse_figure(text, format) beside them; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_figure(t STRING, f STRING) RETURNS {V.DECIMAL} RETURN {PARSE}")
    return [*FUNCTIONS, "parse_figure"]


_KEPT = r"regexp_replace(coalesce(t, ''), r'[^\p{Nd},.\-()]', '')"
_BARE = f"regexp_replace({_KEPT}, r'^[()]+|[()]+$', '')"
_DIGITS = f"regexp_replace({_BARE}, '^-', '')"
_FORMAT = "replace(lower(coalesce(f, '')), '_', '-')"
_COMMA, _DOT = f"contains({_DIGITS}, ',')", f"contains({_DIGITS}, '.')"
_TAIL = lambda c: f"length(substring_index({_DIGITS}, '{c}', -1))"
_LONE = lambda c: f"length({_DIGITS}) - length(replace({_DIGITS}, '{c}', '')) = 1 AND {_TAIL(c)} <> 3"
_MARK = f"""CASE WHEN {_FORMAT} RLIKE 'comma-?decimal' THEN ',' WHEN {_FORMAT} RLIKE 'dot-?decimal' THEN '.'
 WHEN {_COMMA} AND {_DOT} THEN CASE WHEN {_TAIL(",")} < {_TAIL(".")} THEN ',' ELSE '.' END WHEN {_COMMA} AND {_LONE(",")} THEN ',' WHEN {_DOT} AND {_LONE(".")} THEN '.' END"""
_PLAIN = f"CASE {_MARK} WHEN ',' THEN translate(replace({_DIGITS}, '.', ''), ',', '.') WHEN '.' THEN replace({_DIGITS}, ',', '') ELSE regexp_replace({_DIGITS}, '[.,]', '') END"
_SIGN = f"CASE WHEN startswith({_BARE}, '-') OR ({_KEPT} LIKE '(%)') THEN -1 ELSE 1 END"
PARSE = rf"CAST(CASE WHEN {_PLAIN} RLIKE r'^(\d+\.?\d*|\.\d+)$' THEN try_cast({_PLAIN} AS {V.DECIMAL}) * {_SIGN} END AS {V.DECIMAL})"
