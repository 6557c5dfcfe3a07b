"""Homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs. Every paragraph hashes to a wide vector; the
fingerprint is the sum of these vectors, lane by lane, modulo powers of two. Sums do not
depend on the order, and inserting or deleting a paragraph adds or subtracts its vector.

Lanes: 1 counter of pieces (modulo 2^32), DENSE lanes that every paragraph adds 48 hashed bits
to (equality), and LEVELS groups of SPARSE lanes. A paragraph's part in the sparse lanes is itself the
sum over its sentences, each adding 32 hashed bits to one lane chosen by its hash. Half of all
sentences go to the first group, a quarter to the second, and so on. Two documents differ in
about as many lanes as they have sentences apart while there are few of them; linear counting
over the groups that aren't full turns the lanes that differ into a likeness. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidentia.llm.common import table

DENSE, SPARSE, LEVELS = 4, 64, 12
#: A group with more lanes apart is taken as full.
FULL = 48
_M32, _M48 = (1 << 32) - 1, (1 << 48) - 1
#: Ranges of ids at most (a power of two), and rows of a range that are aimed at.
RANGES, ROWS = 1 << 14, 2048


def _add(a: Column, b: Column, mask: int) -> Column:
    return (a + b).bitwiseAND(F.lit(mask))


def _in_group(z: int) -> Callable[[Column], Column]:
    """Whether a piece's hash belongs to group z: a share of 2^-(z + 1) of all, the last group takes the rest."""
    last = z == LEVELS - 1
    mask, bit = ((1 << z) - 1, 0) if last else ((2 << z) - 1, 1 << z)
    return lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(mask)) == bit


def vector(text: Column) -> Column:
    """array<bigint> of 1 + DENSE + LEVELS * SPARSE lanes of a text (null: empty, all lanes 0)."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) > 0)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?])\s+")))  # none runs across paragraphs, so their order doesn't matter
    pieces = F.filter(sentences, lambda p: F.length(F.trim(p)) > 0)
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    hashed = F.transform(paragraphs, lambda p: F.array(*[F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(_M48)) for i in range(DENSE)]))
    dense = F.aggregate(hashed, zeros(DENSE), lambda s, h: F.zip_with(s, h, lambda a, b: _add(a, b, _M48)))
    keys = F.transform(pieces, lambda p: F.xxhash64(F.lit(-1), p))
    put = lambda s, h: F.transform(
        s, lambda v, i: F.when(i == F.pmod(h, F.lit(SPARSE)), _add(v, F.shiftrightunsigned(h, 32), _M32)).otherwise(v))
    groups = lambda ks: F.concat(*[F.aggregate(F.filter(ks, _in_group(z)), zeros(SPARSE), put) for z in range(LEVELS)])
    sparse = F.element_at(F.transform(F.array(keys), groups), 1)  # as a lambda's argument, the keys are made once
    return F.concat(F.array(F.size(pieces).cast("long").bitwiseAND(F.lit(_M32))), dense, sparse)


def added(fingerprint: Column, text: Column, sign: int = 1) -> Column:
    """The fingerprint after inserting (sign 1) or deleting (-1) the paragraphs of a text."""
    masks = F.array(*[F.lit(m).cast("long") for m in [_M32] + [_M48] * DENSE + [_M32] * (LEVELS * SPARSE)])
    moved = F.zip_with(fingerprint, vector(text), lambda a, b: a + sign * b)
    return F.zip_with(moved, masks, lambda a, m: a.bitwiseAND(m))


def text_of(fingerprint: Column) -> Column:
    """Hexadecimal lanes joined by dots; zero lanes are empty."""
    return F.array_join(F.transform(fingerprint, lambda v: F.when(v == 0, F.lit("")).otherwise(F.lower(F.hex(v)))), ".")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: shared pieces over all pieces, estimated from the lanes that differ.

    Equal fingerprints give 1. With d of the L lanes of a group apart, -L ln(1 - d/L) of its pieces are expected on one
    side only. The first group that isn't full and those after it hold 2^-j of all pieces. With n pieces in both sums
    together and m of them on one side, the likeness is (n - m) / (n + m).
    """
    def estimate(a: Column, b: Column) -> Column:
        def apart(z: Column) -> Column:
            at = 2 + DENSE + z * SPARSE
            return F.aggregate(F.zip_with(F.slice(a, at, F.lit(SPARSE)), F.slice(b, at, F.lit(SPARSE)), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)

        def one_side(ds: Column) -> Column:
            first = F.array_position(F.transform(ds, lambda d: d <= FULL), True)
            first = F.when(first > 0, first.cast("int")).otherwise(LEVELS)
            counts = F.transform(F.slice(ds, first, F.lit(LEVELS)), lambda d: -SPARSE * F.log(1 - F.least(d.cast("double"), F.lit(SPARSE - 0.5)) / SPARSE))
            return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) * F.pow(F.lit(2.0), first - 1)

        m = F.element_at(F.transform(F.array(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), apart)), one_side), 1)
        n = (F.element_at(a, 1) + F.element_at(b, 1)).cast("double")
        got = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (n - m) / (n + m)))
        return F.when(a == b, 1.0).otherwise(F.least(got, F.lit(1.0)))

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: estimate(s["a"], s["b"])), 1)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs(doc_id, *columns) with next_<column> of the next row by descending doc_id; after the last comes the first.

    Rows of equal doc_id follow in order of a hash of the columns; null ids come last. Ids are cut at approximate quantiles, so far-out
    ids make no range large, null ids by their hashes. Each of at most 2 * RANGES ranges is a window partition, and the first row
    of each range is also sent to the range before it. Only the ranges' bounds and first ids are broadcast.
    """
    n = docs.count()
    parts = 1
    while parts < RANGES and parts * ROWS < n:
        parts *= 2
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 16 * parts).alias("cuts")).first()["cuts"] if parts > 1 else None
    bounds = F.lit(cuts or []).cast("array<long>")
    steps, half = [], parts // 2
    while half:
        steps.append(half)
        half //= 2
    # how many bounds are no larger than the id, by bisection
    found = F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if cuts else F.lit(0)
    tie = F.xxhash64(*columns)
    slot = F.when(F.col("doc_id").isNull(), F.shiftright(tie, 50) - RANGES).otherwise(found).cast("long")
    rows = docs.select("doc_id", *columns).withColumn("_slot", slot)
    keyed = rows.withColumn("_tie", tie)
    firsts = keyed.groupBy("_slot").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("_id"), "_tie")).alias("_first"))
    heads = firsts.withColumn("_to", F.coalesce(
        F.lag("_slot").over(Window.orderBy(F.desc("_slot"))), F.first("_slot").over(Window.orderBy("_slot")))) \
        .select(F.col("_slot").alias("_at"), F.col("_first._id").alias("_first_id"), F.col("_first._tie").alias("_first_tie"), "_to")
    is_head = (F.col("_slot") == F.col("_at")) & (F.coalesce("doc_id", F.lit(0)) == F.col("_first_id")) & (F.col("_tie") == F.col("_first_tie"))
    sent = keyed.join(F.broadcast(heads), is_head, "left").withColumn(
        "_where", F.explode(F.when(F.col("_to").isNotNull(), F.array(
            F.struct(F.col("_slot").alias("slot"), F.lit(0).alias("guest")), F.struct(F.col("_to").alias("slot"), F.lit(1).alias("guest"))))
            .otherwise(F.array(F.struct(F.col("_slot").alias("slot"), F.lit(0).alias("guest"))))))
    order = Window.partitionBy("_where.slot").orderBy(F.col("_where.guest"), F.desc_nulls_last("doc_id"), F.desc("_tie"), *columns)
    out = sent.select("doc_id", *columns, "_where.*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where("guest = 0").drop("slot", "guest")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses.

    Edited: the last floor(n/2) code points give way to the first as many of the next
    document (all, if fewer). Null texts count as empty; repeated rows give repeated rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    v = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", "next_text")
    v = v.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                 vector(F.col("text")).alias("a"), vector(F.col("edited")).alias("e"), vector(F.col("next_text")).alias("b"))
    return v.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"), text_of(F.col("e")).alias("edited_fingerprint"),
                    likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"))
