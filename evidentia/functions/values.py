"""Numbers, periods, rectangles and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DECIMAL = "decimal(38,10)"
# How dates and years are written.
GERMAN_DATE = r"\b(\d{1,2})\.(\d{1,2})\.((?:19|20)\d{2})\b"
YEAR = r"\b((?:19|20)\d{2})\b"


# --- numbers


def decimal_mark(cleaned: Column, fmt: Column) -> Column:
    """',' or '.' or null: which separator stands before the fraction.

    A declared format decides. With both present it is the last one. One that is repeated, or has exactly three digits behind it, groups.
    """
    declared = F.replace(F.lower(F.coalesce(fmt, F.lit(""))), F.lit("_"), F.lit("-"))
    comma, dot = F.contains(cleaned, F.lit(",")), F.contains(cleaned, F.lit("."))
    lone = F.when(comma, F.lit(",")).when(dot, F.lit("."))
    tail = F.length(F.when(comma, F.substring_index(cleaned, ",", -1)).otherwise(F.substring_index(cleaned, ".", -1)))
    count = F.length(cleaned) - F.length(F.replace(cleaned, F.coalesce(lone, F.lit(".")), F.lit("")))
    return (
        F.when(declared.rlike("comma-?decimal"), F.lit(","))
        .when(declared.rlike("dot-?decimal"), F.lit("."))
        .when(comma & dot, F.when(F.length(F.substring_index(cleaned, ",", -1)) < F.length(F.substring_index(cleaned, ".", -1)), F.lit(",")).otherwise(F.lit(".")))
        .when(lone.isNotNull() & (count == 1) & (tail != 3), lone)
    )


def normalise_number(text: Column, fmt: Column | None = None) -> Column:
    """DECIMAL(38,10) of a figure as printed, null if it holds none. Parentheses around it or a leading minus: negative."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Nd},.\-()]", "")
    bare = F.regexp_replace(kept, r"^[()]+|[()]+$", "")
    minus = bare.startswith("-")
    negative = (kept.startswith("(") & kept.endswith(")")) | minus
    digits = F.when(minus, F.substring(bare, 2, 1 << 30)).otherwise(bare)
    mark = decimal_mark(digits, F.lit("") if fmt is None else fmt)
    plain = (
        F.when(mark == ",", F.translate(F.replace(digits, F.lit("."), F.lit("")), ",", "."))
        .when(mark == ".", F.replace(digits, F.lit(","), F.lit("")))
        .otherwise(F.regexp_replace(digits, "[.,]", ""))
    )
    value = F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), plain.try_cast(DECIMAL))
    return F.when(negative, -value).otherwise(value).cast(DECIMAL)


def fact_value(base: Column, scale: Column, sign: Column) -> Column:
    """base x 10^scale x sign in decimals; null where that is beyond DECIMAL."""
    powers = F.create_map(*[x for k in range(-9, 13) for x in (F.lit(k), F.lit(f"{10**k}" if k >= 0 else f"0.{'0' * (-k - 1)}1").cast("decimal(23,9)"))])
    k = F.coalesce(scale, F.lit(0)).cast("int")
    usual = base.cast("decimal(28,9)") * F.try_element_at(powers, k) * F.coalesce(sign, F.lit(1))
    rare = F.concat(F.when(F.coalesce(sign, F.lit(1)) < 0, "-").otherwise(""), base.cast("string"), F.lit("E"), k.cast("string"))
    rare = F.when(base.isNotNull(), F.regexp_replace(rare, "^--", "").try_cast(DECIMAL))
    return F.when(k.between(-9, 12), usual.cast(DECIMAL)).otherwise(rare)


def format_figure(value: Column, unit: Column) -> Column:
    """1.204.000,00 EUR: two places, half to even, points group, a comma before the fraction."""
    figure = F.translate(F.format_number(F.abs(F.bround(value, 2)), 2), ",.", ".,")
    return F.trim(F.concat(F.when(value < 0, "-").otherwise(""), figure, F.lit(" "), F.coalesce(unit, F.lit(""))))


# --- periods: 'instant:2022-12-31' or '2022-01-01/2022-12-31' or ''


def german_date(iso: Column) -> Column:
    parts = F.split(iso, "-")
    return F.when(F.size(parts) == 3, F.concat_ws(".", parts[2], parts[1], parts[0])).otherwise(iso)


def describe_period(period: Column) -> Column:
    start, end = F.substring_index(period, "/", 1), F.substring(period, F.instr(period, "/") + 1, F.lit(1 << 30))
    year = start.endswith("-01-01") & end.endswith("-12-31") & (F.left(start, F.lit(4)) == F.left(end, F.lit(4)))
    return (
        F.when(period.startswith("instant:"), F.concat(F.lit("zum "), german_date(F.substring(period, 9, 1 << 30))))
        .when(F.contains(period, F.lit("/")) & year, F.concat(F.lit("im Geschäftsjahr "), F.left(start, F.lit(4))))
        .when(F.contains(period, F.lit("/")), F.concat(F.lit("für den Zeitraum "), german_date(start), F.lit(" bis "), german_date(end)))
        .otherwise(F.lit(""))
    )


def phrase_question(label: Column, period: Column) -> Column:
    return F.replace(F.concat(F.lit("Wie hoch war "), label, F.lit(" "), describe_period(period), F.lit("?")), F.lit("  "), F.lit(" "))


def periods_in(question: Column) -> Column:
    """Distinct markers: 'instant:Y-M-D' of each German date, and every year from 1900 to 2099."""
    q = F.coalesce(question, F.lit(""))
    dates = F.regexp_extract_all(q, F.lit(GERMAN_DATE), F.lit(0))
    part = lambda d, i: F.lpad(F.split(d, r"\.")[i], 2, "0")
    instants = F.transform(dates, lambda d: F.concat(F.lit("instant:"), F.split(d, r"\.")[2], F.lit("-"), part(d, 1), F.lit("-"), part(d, 0)))
    years = F.concat(F.transform(dates, lambda d: F.split(d, r"\.")[2]), F.regexp_extract_all(q, F.lit(YEAR), F.lit(1)))
    return F.array_distinct(F.concat(instants, years))


def years_of(period: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(period, F.lit("")), F.lit(YEAR), F.lit(1)))


def match_period(wanted: Column, available: Column) -> Column:
    """The smallest available period that is wanted literally, else the smallest that shares a year, else ''."""
    literal = F.array_min(F.array_intersect(available, wanted))
    by_year = F.array_min(F.filter(available, lambda p: F.arrays_overlap(years_of(p), wanted)))
    return F.coalesce(literal, by_year, F.lit(""))


# --- rectangles: struct<page int, x0, y0, x1, y1 double>, corners in 0..1


def span(page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corners = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
    return F.struct(page.cast("int").alias("page"), *[c.cast("double").alias(n) for n, c in corners.items()])


def from_rect(page: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Page units to shares of the page, clamped to it. A page without extent is an error."""
    share = lambda x, size: F.least(F.greatest(x / size, F.lit(0.0)), F.lit(1.0))
    ok = span(page, share(x0, width), share(y0, height), share(x1, width), share(y1, height))
    return F.when((width > 0) & (height > 0), ok).otherwise(F.raise_error(F.lit("page size must be positive")))


def area(s: Column) -> Column:
    return F.greatest(s["x1"] - s["x0"], F.lit(0.0)) * F.greatest(s["y1"] - s["y0"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((a["page"] == b["page"]) & (w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = shared_area(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def covers(outer: Column, inner: Column) -> Column:
    """Share of inner's area that lies in outer."""
    return F.when(area(inner) > 0, shared_area(outer, inner) / area(inner)).otherwise(F.lit(0.0))


def tightness(outer: Column, inner: Column) -> Column:
    return F.when(area(outer) > 0, F.least(area(inner) / area(outer), F.lit(1.0))).otherwise(F.lit(0.0))


def best_of(measure, golds: Column, found: Column) -> Column:
    """Largest measure(found, gold) over two arrays of spans; 0 if one is empty."""
    each = F.flatten(F.transform(found, lambda f: F.transform(golds, lambda g: measure(f, g))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def parse_regions(raw: Column, page: Column) -> Column:
    """array<span> of 'x0,y0,x1,y1;..'; blanks are skipped; wrong counts, numbers or ranges are errors."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), ";"), lambda p: F.length(F.trim(p)) > 0)

    def one(p: Column) -> Column:
        v = F.transform(F.split(p, ","), lambda x: F.trim(x).try_cast("double"))
        fine = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull() | (x < 0) | (x > 1)) & (v[0] <= v[2]) & (v[1] <= v[3])
        return F.when(F.coalesce(fine, F.lit(False)), span(page, v[0], v[1], v[2], v[3])).otherwise(F.raise_error(F.concat(F.lit("not a region: "), p)))

    return F.transform(parts, one)


def outline(s: Column, pad: float = 0.004) -> Column:
    """The region drawn around a span: padded and clamped to the page."""
    low, high = (lambda x: F.greatest(x - pad, F.lit(0.0))), (lambda x: F.least(x + pad, F.lit(1.0)))
    return span(s["page"], low(s["x0"]), low(s["y0"]), high(s["x1"]), high(s["y1"]))


# --- hashes


def short_hash(length: int, *parts: Column) -> Column:
    """First hexadecimal digits of the SHA-256 of the parts joined by a bar."""
    return F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(length))


def chunk_id(document_id: Column, order: Column, text: Column) -> Column:
    digest = F.left(F.sha2(F.concat_ws(":", document_id.cast("string"), order.cast("string"), text), 256), F.lit(12))
    return F.concat(document_id.cast("string"), F.lit(":"), F.lpad(order.cast("string"), 5, "0"), F.lit(":"), digest)
