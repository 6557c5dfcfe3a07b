"""Near-duplicate documents by improved consistent weighted sampling (Ioffe 2010).

A document is a weighted set of its shingles of SHINGLE words (letters and digits, lower case; a
shorter text is one shingle): term frequency times inverse document frequency, which is
1 + ln((1 + documents) / (1 + documents that hold the shingle)), counted over all rows. Without frequencies
(near_duplicates' default) only a share beyond COMMON counts against a shingle: its weight falls from 1 to 0 as log(1 / share).

Frequencies come in lots of neighbouring rows: each lot sends its shingles to the tasks that count them, and gets back those
that another row holds as well. Shingles of one row alone never come back. Lots and tasks both grow in number with the input, so
lots grow as well: a lot has FULL shingles or more for each part of the tasks, and rows of the shuffle grow as the shingles do.

BANDS x ROWS consistent samples make a sketch; two documents of weighted Jaccard
similarity s agree in each with probability s. Documents that agree in all rows of a band are
candidates, and links are verified by their exact weighted Jaccard similarity, SIMILARITY or
more. At 0.8 a pair shares no band with probability 0.0002, at 0.85 with 0.00001.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.llm.common import drop_staged, free, joined_hot, placed, staged, table
from evidentia.llm.hashing import GAMMA, mix, mix_into, runs
from evidentia.llm.linking import PAIRS, dealt, link, met

SHINGLE, SIMILARITY, BANDS, ROWS, COMMON, SEED = 5, 0.8, 16, 4, 0.4, 11
#: Share of a sketch's samples that must agree before texts are compared: at a similarity of 0.8 a pair falls short with probability 0.0003.
LEAST_AGREED = 0.625
#: Rows of a crowded bucket that meet in one task, and documents whose texts do.
BLOCK, TEXTS = 2048, 1000
#: Shingles of documents that are counted together; common shingles that are broadcast at most, beyond them a shuffle counts.
COUNTED, FEW = 1_000_000, 1_000_000
#: Neighbouring rows whose frequencies are sent together, shingles for each part that makes more of them, bytes of text that make fewer; shingles that are
#: held before they are sent, shingles that a task counts.
LOT, FULL, LOT_BYTES, HELD, TASK_SHINGLES = 512, 64, 1 << 24, 2_000_000, 1_000_000
#: Ids of texts that are broadcast at most; beyond them a shuffle finds the texts.
IDS = 2_000_000
#: Bytes of text for a shingle, about.
SHINGLE_BYTES = 5
_WORD = re.compile(r"[^\W_]+")
_NOT_WORD = np.array([not chr(i).isalnum() for i in range(128)] + [False] * 128)
#: UTF-8 bytes from which on a text may hold marks beyond ASCII: all but those of Latin letters with accents.
_MARKS = np.array([i == 0xC2 or i > 0xC9 for i in range(256)])


class Shingler:
    """Hashes of a text's shingles, ascending, with their counts."""

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        text = text.lower()
        raw = text.encode("utf-8", "surrogatepass")
        if not text.isascii() and (_MARKS[np.frombuffer(raw, np.uint8)].any() or b"\xc3\x97" in raw or b"\xc3\xb7" in raw):
            raw = " ".join(_WORD.findall(text)).encode("utf-8", "surrogatepass")
        h = runs(raw, _NOT_WORD[np.frombuffer(raw, np.uint8)])[1]
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = max(1, len(h) - SHINGLE + 1)
        k = min(SHINGLE, len(h))
        s = np.full(n, len(h) if len(h) < SHINGLE else 0, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                s = mix(s * GAMMA + h[i : i + n])
        return np.unique(s, return_counts=True)


class Weights:
    """tf-idf weights of shingles; common: ascending hashes of the shingles beyond the share COMMON, with their idf."""

    def __init__(self, common: np.ndarray, idf: np.ndarray) -> None:
        self.common, self.idf = common, idf

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts.astype(float)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
            w = np.where(self.common[at] == shingles, w * self.idf[at], w)
        return w


def sketch(shingles: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """(size,) int64: consistent weighted samples; each is a hash of the sampled shingle and its level. Needs one positive weight.

    For a sample k and a shingle, r and c are Gamma(2, 1) and beta is uniform, all from two hashes of both. With
    t = floor(log(w) / r + beta), the shingle of the smallest log(c) - r (t - beta + 1) is sampled, at level t.
    """
    if not (weights > 0).all():
        shingles, weights = shingles[weights > 0], weights[weights > 0]
    log_w = np.log(weights).astype(np.float32)[:, None]
    low, got = np.full(size, np.inf, np.float32), np.zeros(size, np.uint64)
    columns = np.arange(size)

    def product(x: np.ndarray) -> np.ndarray:
        """Of two uniform numbers in (0, 1), from the upper 23 bits of both halves of x: they become the fractions of numbers from 1 to 2."""
        u = x.view(np.uint32) >> np.uint32(9)
        u |= np.uint32(0x3F800000)
        u = u.view(np.float32)
        u -= np.float32(1 - 2.0**-24)
        return u[:, ::2] * u[:, 1::2]

    with np.errstate(over="ignore"):
        salt = mix((columns.astype(np.uint64) + np.uint64(1)) * GAMMA + np.uint64(SEED))
        for i in range(0, len(shingles), 256):  # blocks that stay in the processor's cache
            s = shingles[i : i + 256, None]
            a = s ^ salt
            spare = np.empty_like(a)
            mix_into(a, spare)
            r = product(a)
            np.negative(np.log(r, out=r), out=r)
            np.right_shift(np.multiply(a, GAMMA, out=spare), np.uint64(40), out=spare)
            beta = spare.astype(np.uint32).astype(np.float32)
            beta *= np.float32(2.0**-24)
            a += GAMMA
            mix_into(a, spare)
            value = product(a)
            np.log(np.negative(np.log(value, out=value), out=value), out=value)
            t = log_w[i : i + 256] / r
            t += beta
            np.floor(t, out=t)
            value -= r * (t - beta + 1)
            at = value.argmin(axis=0)
            best = value[at, columns]
            better = best < low
            level = t[at, columns].astype(np.int64).view(np.uint64)
            low, got = np.where(better, best, low), np.where(better, mix(s[at, 0] * GAMMA + level), got)
    return got.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending shingles, weights); two sets without weight are alike only if they hold the same shingles."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][x], b[1][y]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most > 0 else float(len(a[0]) == len(b[0]) == len(x))


class Counts:
    """Counts of shingles over documents, and those that pass a test in every lot of documents with COUNTED shingles."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, shingles: np.ndarray) -> bool:
        self.held.append(shingles)
        self.size += len(shingles)
        return self.size >= COUNTED

    def take(self, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in more than COMMON of the documents so far (or those of only), and in how many; starts anew."""
        n, held, self.held, self.size = len(self.held), self.held, [], 0
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, c = np.unique(np.concatenate(held), return_counts=True)
        keep = c > COMMON * n if only is None else np.isin(s, only)
        return s[keep].view(np.int64), c[keep]


def common_shingles(docs: DataFrame, candidates: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and idf of the shingles that a share of more than COMMON of all rows of docs(text) hold.

    Such a shingle is in that share of some task's documents too. These candidates(shingle) are counted over all documents, so the
    frequencies are exact. At most (shingles of a document) / COMMON of them come to the driver.
    """
    def counted(batches: Iterator[pd.DataFrame], only: np.ndarray | None) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(), Counts()
        for x in batches:
            for t in x["text"]:
                if counts.add(shingler(t)[0]):
                    yield pd.DataFrame(dict(zip(("shingle", "n"), counts.take(only), strict=True)))
        yield pd.DataFrame(dict(zip(("shingle", "n"), counts.take(only), strict=True)))

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    if candidates is None:
        candidates = staged(texts.mapInPandas(lambda b: counted(b, None), "shingle long, n long").select("shingle").distinct(), "candidates")
    n = candidates.count()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0)
    total = docs.count()
    if n <= FEW:
        shared = docs.sparkSession.sparkContext.broadcast(candidates.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))
        rows = texts.mapInPandas(lambda b: counted(b, shared.value), "shingle long, n long")
    else:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingler = Shingler()
            for x in batches:
                for t in x["text"]:
                    yield pd.DataFrame({"shingle": shingler(t)[0].view(np.int64), "n": 1})

        rows = texts.mapInPandas(each, "shingle long, n long").join(candidates, "shingle")
    got = rows.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON * total).toPandas()
    s = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], (np.log(total / got["n"].to_numpy(float)) / math.log(1 / COMMON))[order]


def idf(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return 1 + np.log((1 + documents) / (1 + np.asarray(frequencies, float)))


def lot_rows(size: int, documents: int, parts: int) -> int:
    """Neighbouring rows to a lot, of so many documents of size bytes in all."""
    mean = max(1.0, size / max(1, documents))
    return max(1, int(min(max(LOT, FULL * parts * SHINGLE_BYTES / mean), LOT_BYTES / mean)))


def lot(rows: int) -> Column:
    return F.xxhash64("file", F.floor(F.col("row") / rows))


def frequencies(texts: DataFrame, documents: int) -> tuple[DataFrame, Column]:
    """lot, shingles and n (arrays): the shingles of each lot of texts(file, row, text) that two rows or more hold, and how many of all rows do; and the lot of a row of texts."""
    conf = texts.sparkSession.conf
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), -(-size // 4 // TASK_SHINGLES))
    parts = 2 * tasks
    of = lot(lot_rows(size, documents, parts))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, last, n_held = Shingler(), [], 0, 0

        def sent() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = (mix(s) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, s, n = part[order], s[order].view(np.int64), n[order].astype(np.int32)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            at = pa.array(np.append(starts, len(part)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), last)), *[pa.ListArray.from_arrays(at, pa.array(x)) for x in (s, n)]], names=["part", "lot", "shingles", "n"])

        for x in batches:
            for i, mine in enumerate(x.column(0).to_pylist()):
                if held and (mine != last or n_held > HELD):  # a lot may be sent in pieces: they are summed like lots
                    yield sent()
                    n_held = 0
                last = mine
                held.append(shingler(x.column(1)[i].as_py())[0])
                n_held += len(held[-1])
        if held:
            yield sent()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.repeat(x.column(1).to_numpy(), np.diff(x.column(2).offsets.to_numpy())), x.column(2).flatten().to_numpy(), x.column(3).flatten().to_numpy()) for x in batches if len(x)]
        if not rows:
            return
        lots, s, n = (np.concatenate(x) for x in zip(*rows))
        _, at = np.unique(s, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)[at]
        keep = np.flatnonzero(total > 1)
        keep = keep[np.argsort(lots[keep], kind="stable")]
        lots = lots[keep]
        starts = np.flatnonzero(np.concatenate([[True], lots[1:] != lots[:-1]])) if len(lots) else lots
        for first in range(0, len(starts), 1000):
            mine = starts[first : first + 1000]
            end = starts[first + 1000] if first + 1000 < len(starts) else len(lots)
            offsets = pa.array((np.append(mine, end) - mine[0]).astype(np.int32))
            cells = [pa.ListArray.from_arrays(offsets, pa.array(x[keep[mine[0] : end]])) for x in (s, total)]
            yield pa.RecordBatch.from_arrays([pa.array(lots[mine]), *cells], names=["lot", "shingles", "n"])

    sent = texts.select(of.alias("lot"), "text").mapInArrow(parted, "part int, lot long, shingles array<long>, n array<int>")
    return staged(sent.repartition(tasks, "part").mapInArrow(counted, "lot long, shingles array<long>, n array<long>"), "frequencies"), of


def text_id(text: Column) -> Column:
    """First half of a text's SHA-256, as binary."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of texts(text) for each of ids(text_id, ..), with ids' columns. Of up to IDS ids only the texts found are shuffled, not all."""
    rows = texts.select(text_id(F.col("text")).alias("text_id"), "text")
    if ids.count() <= IDS:
        rows = rows.withColumn("_h", F.xxhash64("text_id")).join(F.broadcast(ids.select(F.xxhash64("text_id").alias("_h"))), "_h", "left_semi").drop("_h")
    return rows.join(ids, "text_id").dropDuplicates(["text_id"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, every: bool = False) -> DataFrame:
    """file, row, doc_id, text_id, class (binary), class_id, n_class and kept boolean for every row of docs(file, row, doc_id, text).

    file and row name a row. Equal texts are of one class, so are texts linked by a chain of similar ones. Null texts count as empty, and all
    texts without a word are of the class of their own text. One row of each class is kept, the first by doc_id (null
    last), then file and row. Repeated rows are documents of their own, of which one stays. every: shingles are weighed by the
    inverse document frequency of every one of them, not only of those beyond COMMON.
    """
    spark = docs.sparkSession
    size = bands * rows
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("file", "row")], T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("text_id", T.BinaryType()), T.StructField("mark", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    texts = docs.select("file", "row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def sketched(common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """A row for each document with its sketch, and rows without text_id whose mark holds candidates for common shingles."""
        shared = spark.sparkContext.broadcast(common)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, weigh, counts = Shingler(), Weights(*shared.value), Counts()

            def candidates() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(arrow)[:-2]], pa.array([counts.take()[0]], arrow.field("mark").type), pa.nulls(1, arrow.field("n").type)], schema=arrow)

            for x in batches:
                for at in range(0, len(x), 256):
                    y = x.slice(at, 256)
                    ids, marks = [], []
                    for i in range(len(y)):  # one text at a time as a Python object
                        t = y.column(3)[i].as_py()
                        ids.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16])
                        s, c = shingler(t)
                        if counts.add(s):
                            yield candidates()
                        w = weigh(s, c)
                        marks.append(sketch(s, w, size) if (w > 0).any() else None)
                    keys = [y.column(i).cast(arrow.field(i).type) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(ids, pa.binary()), pa.array(marks, arrow.field("mark").type), pa.nulls(len(y), arrow.field("n").type)], schema=arrow)
            yield candidates()

        return staged(texts.mapInArrow(run, schema), "sketches")

    def weighed(documents: int) -> DataFrame:
        """A row for each document with its sketch, and in how many rows each of its shingles is (n)."""
        held, of_lot = frequencies(texts, documents)
        free(spark)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            shingler, ids, marks, counts = Shingler(), [], [], []
            known, n = (right.column(c).combine_chunks().flatten().to_numpy() for c in ("shingles", "n"))
            known = known.view(np.uint64)
            order = np.argsort(known)
            known, n = np.append(known[order], np.uint64(2**64 - 1)), np.append(n[order], 1)
            for i in range(len(left)):
                t = left.column("text")[i].as_py()
                ids.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16])
                s, c = shingler(t)
                at = np.searchsorted(known, s)
                of = np.where(known[at] == s, n[at], 1)
                marks.append(sketch(s, c * idf(of, documents), size) if len(s) else None)
                counts.append(of.astype(np.int32))
            keys = [left.column(c).cast(arrow.field(c).type) for c in ("file", "row", "doc_id")]
            return pa.table([*keys, pa.array(ids, pa.binary()), pa.array(marks, arrow.field("mark").type), pa.array(counts, arrow.field("n").type)], schema=arrow)

        got = texts.withColumn("lot", of_lot).groupBy("lot").cogroup(held.groupBy("lot")).applyInArrow(lambda a, b: run(a, b), schema)
        got = staged(got, "sketches")
        drop_staged(held)
        return got

    documents, none = 0, (np.zeros(0, np.uint64), np.zeros(0))
    if every:
        documents = docs.count()
        found, frequent = weighed(documents), none
    else:
        # most corpora have no common shingle: then the sketches made beside the counting stand
        found = sketched(none)
        frequent = common_shingles(docs, found.where("text_id IS NULL").select(F.explode("mark").alias("shingle")).distinct())
    common = spark.sparkContext.broadcast(frequent)
    if len(frequent[0]):
        drop_staged(found)
        found = sketched(frequent)
    free(spark)

    def weights() -> Callable[[str, np.ndarray | None], tuple[np.ndarray, np.ndarray]]:
        """A text's shingles and weights, by the text and in how many rows each shingle is."""
        shingler, weigh = Shingler(), Weights(*common.value)

        def run(text: str, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            s, c = shingler(text)
            return s, c * idf(n, documents) if every else weigh(s, c)

        return run

    rows_ = found.where("text_id IS NOT NULL")
    each = staged(rows_.where("mark IS NOT NULL").groupBy("text_id").agg(F.any_value("mark").alias("mark"), F.any_value("n").alias("n")).withColumnRenamed("text_id", "id"), "texts")
    key = lambda m: F.array(*[F.xxhash64(F.lit(b), *[m[b * rows + i] for i in range(rows)]) for b in range(bands)])
    buckets = each.select(F.explode(key(F.col("mark"))).alias("key"), "id")

    def near(a: Column, b: Column) -> Column:
        same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return same >= LEAST_AGREED * size

    passing: list[DataFrame] = []  # what verify has written

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        ids = staged(pairs.select(F.col("a").alias("text_id")).unionByName(pairs.select(F.col("b").alias("text_id"))).distinct(), "ids")
        held = staged(texts_of(texts, ids).join(each.select(F.col("id").alias("text_id"), "n"), "text_id"), "held")
        drop_staged(ids)
        free(spark)
        passing.extend([pairs, held])

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weigh = weights()
            last: tuple[bytes, tuple] = (b"", ())
            for x in batches:
                keep = []
                for a, ta, na, tb, nb in zip(x["a"], x["ta"], x["na"], x["tb"], x["nb"], strict=True):
                    if last[0] != a:
                        last = (a, weigh(ta, na))
                    keep.append(weighted_jaccard(last[1], weigh(tb, nb)) >= similarity - 1e-12)
                yield x.loc[keep, ["a", "b"]]

        a, b = (held.select(F.col("text_id").alias(c), F.col("text").alias(f"t{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "na", "tb", "nb").mapInPandas(check, "a binary, b binary")

    held_ = each.select("id", "n", "mark")

    def cross(open_: DataFrame) -> DataFrame:
        while passing:  # its links are a table by now
            drop_staged(passing.pop())
        return crossing(open_, texts, held_, weights, similarity, rows)

    roots = link(buckets, each.select("id", "mark"), near, verify, cross)
    drop_staged(each)
    free(spark)
    per = rows_.groupBy("text_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("first"), F.count("*").alias("n"))
    per = staged(per.join(roots.withColumnRenamed("id", "text_id"), "text_id", "left").select("text_id", F.coalesce("root", "text_id").alias("class"), "first", "n"), "per")
    classes = staged(per.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("n_class"), F.count("*").alias("n_texts")), "classes")
    total = classes.agg(F.sum("n_class").alias("rows"), F.sum("n_texts").alias("texts")).first()
    per = joined_hot(per.select("text_id", "class", "n"), classes, "class", "n_texts", total["texts"] or 0)
    got = joined_hot(rows_.select("file", "row", "doc_id", "text_id"), per, "text_id", "n", total["rows"] or 0)
    return got.select("file", "row", "doc_id", "text_id", "class", F.col("first.doc_id").alias("class_id"), "n_class", ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"))


def crossing(open_: DataFrame, texts: DataFrame, held: DataFrame, weights: Callable, similarity: float, rows: int) -> DataFrame:
    """Links(a, b) between the open rows(key, id, root, main, mark) of different roots that share a key; enough to join all roots that links join.

    A key's rows outside its main root meet all its rows, in blocks of BLOCK rows, and name the ids that have another near to them. Pairs are
    never rows: texts of TEXTS documents each meet, block against block, where such ids are, and only those that are named; there the pairs are
    found again by their marks, held(id, n, mark). A document already joined to a root in its task isn't compared with that root's others.
    """
    ids = staged(open_.groupBy("id").agg(F.min("root").alias("root"), F.min("key").alias("near")), "ids")
    n = ids.count()
    if not n:
        return open_.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # texts of one smallest key share a home; a key of more than TEXTS texts has several
    crowd = ids.groupBy("near").agg(F.count("*").alias("crowd")).where(F.col("crowd") > TEXTS)
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("crowd") / TEXTS), F.lit(1)))
    homes = max(1, -(-n // TEXTS))
    ids = staged(ids.join(crowd, "near", "left").select("id", "root", F.pmod(F.xxhash64("near", part), F.lit(homes)).cast("int").alias("home")), "homes")

    def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a == b).sum(axis=-1) >= LEAST_AGREED * a.shape[-1]

    def named(x: pa.Table) -> pa.Table:
        home, rows = x.column("home").to_numpy().astype(np.int64), [np.zeros(0, np.int64)]
        for a, b in met(x, agree):
            spot = (np.minimum(home[a], home[b]) * homes + np.maximum(home[a], home[b])) * len(x)
            rows.append(np.unique(np.concatenate([spot + a, spot + b])))
        spot, at = np.divmod(np.unique(np.concatenate(rows)), len(x))
        return pa.table({"h": (spot // homes).astype(np.int32), "o": (spot % homes).astype(np.int32), "id": x.column("id").take(pa.array(at))})

    asked = dealt(open_.join(ids.select("id", "home"), "id"), BLOCK)
    spots = staged(asked.groupBy("task").applyInArrow(lambda x: named(x), "h int, o int, id binary").distinct(), "spots")
    free(texts.sparkSession)
    found = staged(ids.join(spots.select("id").distinct(), "id").withColumnRenamed("id", "text_id"), "named")
    with_texts = staged(texts_of(texts, found).withColumnRenamed("text_id", "id").join(held, "id"), "held")
    drop_staged(found)
    free(texts.sparkSession)

    def compare(x: pa.Table) -> pa.Table:
        weigh, up, links = weights(), {}, []
        id_, root, home = (x.column(c).to_numpy() for c in ("id", "root", "home"))
        text, n, marks = x.column("text"), x.column("n"), x.column("mark").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        sets: dict[int, tuple] = {}

        def top(r: bytes) -> bytes:
            while up.setdefault(r, r) != r:
                up[r] = r = up[up[r]]
            return r

        def weighed(i: int) -> tuple:
            if i not in sets:
                sets[i] = weigh(text[i].as_py(), n[i].values.to_numpy() if n[i].is_valid else None)
            return sets[i]

        left = np.flatnonzero(home == x.column("h")[0].as_py())
        right = np.flatnonzero(home == x.column("o")[0].as_py())
        step = max(1, PAIRS // len(right))
        for i in (left[k : k + step] for k in range(0, len(left), step)):
            same = marks[i][:, None] == marks[right][None]
            hit = (same.sum(axis=-1) >= LEAST_AGREED * marks.shape[1]) & same.reshape(*same.shape[:2], -1, rows).all(axis=-1).any(axis=-1)
            hit &= (root[i][:, None] != root[right][None]) & ((home[i][:, None] != home[right][None]) | (i[:, None] < right[None]))
            for a, b in zip(*(m.tolist() for m in np.nonzero(hit)), strict=True):
                p, q = i[a], right[b]
                y, z = top(root[p]), top(root[q])
                if y != z and weighted_jaccard(weighed(p), weighed(q)) >= similarity - 1e-12:
                    up[y] = z
                    links.append((id_[p], id_[q]))
        return pa.table({c: pa.array([pair[k] for pair in links], pa.binary()) for k, c in enumerate("ab")})

    sent = with_texts.join(spots, "id").select("h", "o", "id", "root", "home", "text", "n", "mark")
    return sent.groupBy("h", "o").applyInArrow(lambda x: compare(x), "a binary, b binary")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: class_id is the smallest doc_id of its class, n_class the class's rows, kept marks the one that stays."""
    docs = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), "docs").select("file", "row", "doc.doc_id", "doc.text")
    return near_duplicates(docs, every=True).select("doc_id", "class_id", "n_class", "kept")


def keep_one(docs: DataFrame, every: bool = False) -> DataFrame:
    """The columns and rows of docs without all but one row of each class of near duplicates (see there for every). No other column name matters."""
    rows = placed(docs, "docs")
    kept = near_duplicates(rows.select("file", "row", "doc.doc_id", "doc.text"), every=every).where("kept").select("file", "row")
    return rows.join(kept, ["file", "row"], "left_semi").select("doc.*")
