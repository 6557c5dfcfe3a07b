"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree splits space by hyperplanes between two sampled points of a node, at the median
of the sample's projections, to one depth. Every vector is indexed in a leaf of each tree. A
query walks all trees through one shared priority queue: the branch with the smallest margin
against it is taken next, until the leaves taken hold enough vectors. For a batch of queries the queue is
one sort of all trees' leaves by the largest margin against the query on their way: the order in which a
queue gives them. The candidates in these leaves are reranked by the exact inner product of the original
vectors in double precision.

Largest inner product is turned into nearest direction by one added coordinate,
sqrt(M^2 - |v|^2), with M the largest norm of all vectors; for queries it is 0.

Copies of one vector tie for every query, and ties go to smaller ids, so the index holds of each
distinct vector only its k + 1 smallest ids: the result is the same, and a vector that fills a third of
the table is no hot leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidentia.llm.common import bounded_sample, drop_staged, staged, table

#: Rows the splits are fitted on at most (by hash order), trees, distinct vectors of a leaf aimed at,
#: levels of leaves that meet queries together, and vectors and queries of such a group that meet in one task.
SAMPLE, TREES, LEAF, GROUP_LEVELS, BLOCK, ASKED = 32_768, 4, 64, 5, 4096, 8192
#: A query's leaves hold so large a share of all vectors, counted once per tree, as gave RECALL among the sample.
SHARES, RECALL, TRIED = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0), 0.95, 256
#: Queries that walk the trees, or meet a block, together; queries whose finds are merged in one task.
WALKED, MERGED = 128, 500


def usable(vector: str) -> F.Column:
    """Not null or empty, without null or non-finite components, not zero."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    """planes (trees, nodes, dim + 1) and cuts (trees, nodes) of complete trees of one depth, nodes in heap order."""

    def __init__(self, sample: np.ndarray, top: float, depth: int, trees: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        x = lifted(sample, top)
        self.top, self.depth, self.trees = top, depth, trees
        self.planes = np.zeros((trees, (1 << depth) - 1, x.shape[1]))
        self.cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node >= len(self.cuts[t]):
                    continue
                a, b = x[rng.choice(rows, 2)] if len(rows) else (rng.standard_normal(x.shape[1]), np.zeros(x.shape[1]))
                way = a - b if np.any(a != b) else rng.standard_normal(x.shape[1])
                way /= np.linalg.norm(way)
                at = x[rows] @ way
                self.planes[t, node], self.cuts[t, node] = way, np.median(at) if len(rows) else 0.0
                right = at > self.cuts[t, node]
                todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each row's leaf in each tree."""
        x, out = lifted(x, self.top), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.planes[t, node]) > self.cuts[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """(queries, trees, leaves): the largest margin against the query on the way to each leaf, 0 on its own way."""
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        q *= self.top / np.linalg.norm(q, axis=1, keepdims=True)
        out = np.zeros((len(q), self.trees, 1 << self.depth))
        for t in range(self.trees):
            margin = q @ self.planes[t].T - self.cuts[t]
            worst = np.zeros((len(q), 1))
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1 : (2 << level) - 1]
                far = np.maximum(worst, np.abs(m))
                worst = np.stack([np.where(m > 0, far, worst), np.where(m > 0, worst, far)], axis=2).reshape(len(q), -1)
            out[:, t] = worst
        return out

    def search(self, queries: np.ndarray, counts: np.ndarray, wants: list[int]) -> list[np.ndarray]:
        """For each wanted number of vectors a boolean (queries, trees, leaves): the leaves taken; counts (trees, leaves): vectors in each."""
        worst = self.priorities(queries)
        flat = worst.reshape(len(worst), -1)
        order = np.argsort(flat, axis=1, kind="stable")
        held = counts.ravel()[order]
        before = np.cumsum(held, axis=1) - held
        out = []
        for want in wants:
            taken = np.zeros(flat.shape, bool)
            np.put_along_axis(taken, order, before < want, axis=1)
            out.append((taken | (flat == 0)).reshape(worst.shape) & (counts > 0))
        return out


def needed_share(forest: Forest, sample: np.ndarray, k: int) -> float:
    """The first of SHARES at which TRIED queries from the sample find RECALL of their nearest among the sample."""
    if len(sample) < 2:
        return 1.0
    at = forest.leaves(sample)
    counts = np.stack([np.bincount(at[:, t], minlength=1 << forest.depth) for t in range(forest.trees)])
    tried = sample[:TRIED]
    scores = tried @ sample.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    for share, taken in zip(SHARES, forest.search(tried, counts, [int(forest.trees * s * len(sample)) for s in SHARES]), strict=True):
        rows = np.arange(len(tried))[:, None]
        if np.mean(np.any([taken[rows, t, at[near, t]] for t in range(forest.trees)], axis=0)) >= RECALL:
            return share
    return 1.0


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top**2 - (x**2).sum(1, keepdims=True)))])


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and v in double precision, each summed in one order wherever its row stands, so equal vectors tie."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += v[:, j] * q[:, j]
    return out


def best(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, ids and scores of the k nearest of v among the allowed (queries, vectors), a query's own id left out; ties go to the smaller id."""
    rough = q @ v.T
    ok = allowed & (v_ids[None, :] != q_ids[:, None])
    rough[~ok] = -np.inf
    if rough.shape[1] > k:
        low = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        top = np.abs(np.where(ok, rough, 0)).max(axis=1)
        ok &= rough >= np.where(np.isfinite(low), low - 1e-9 * (1 + top), -np.inf)[:, None]
    row, at = np.nonzero(ok)
    return first_k(row, v_ids[at], exact_scores(q[row], v[at]), k)


def first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and scores in the order of rows, then of falling scores, then of ids: k of each row, repeated ids once."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])]) if len(row) else np.zeros(0, bool)  # one id has one score
    row, ids, scores = row[new], ids[new], scores[new]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], scores[keep]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for queries(vec_id, embedding) in vectors(vec_id, embedding).

    Ties go to the smaller vec_id; a query's own id is no candidate. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part on either side, nor do null ids and vectors not of the commonest length (of equally common ones
    the largest). Repeated rows of one id count once; of different vectors of one id the smallest counts, component by component.
    Fewer candidates than k give fewer rows; empty tables give none. Other columns are ignored.

    share: what part of all vectors a query's leaves hold, counted once per tree; None: as much as RECALL needs among the sample.
    The splits are fitted on SAMPLE rows at most; all rows are indexed. What is broadcast or collected has a fixed bound:
    the sample, the forest, and the leaves' sizes (trees x 2^depth, depth at most 12). Leaves under one node some levels up
    meet their queries in one task; beyond BLOCK vectors or ASKED queries such a group is cut into blocks by hash, which meet block by block.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    clean = lambda df: df.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = clean(vectors).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size["dim"]
    one = lambda df: clean(df).where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    q = staged(one(queries), "queries")
    asked_n = q.count()
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    v = staged(one(vectors).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    stats = v.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    n, top = stats["n"], math.sqrt(stats["top"]) * (1 + 1e-9)
    sample = np.array(bounded_sample(v, SAMPLE, "vec_id").toPandas()["embedding"].tolist(), float)
    depth = max(0, min(12, round(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(sample) / 8)))))
    above = min(depth, GROUP_LEVELS)
    built = Forest(sample, top, depth, trees, seed)
    share = needed_share(built, sample, k) if share is None else share
    forest = spark.sparkContext.broadcast(built)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                at = forest.value.leaves(matrix(x.column(1), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), lists(at.ravel(), np.full(len(at), trees))], names=["vec_id", "embedding", "leaves"])

    placed = staged(v.mapInArrow(place, "vec_id long, embedding array<double>, leaves array<int>"), "leaves")
    drop_staged(v)
    counts = np.zeros((trees, 1 << depth), np.int64)
    for t, at, c in placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        counts[t, at] = c
    groups = 1 << (depth - above)
    blocks = -(-counts.reshape(trees, groups, 1 << above).sum(axis=2) // BLOCK)  # of each group of leaves
    sides = max(1, -(-asked_n // ASKED))
    shared = spark.sparkContext.broadcast((counts, blocks))
    want = int(trees * share * n)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = shared.value
        for x in batches:
            for i in range(0, len(x), WALKED):
                y = x.slice(i, WALKED)
                taken = forest.value.search(matrix(y.column(1), dim), held, [want])[0].reshape(len(y), trees, groups, 1 << above)
                row, tree, part = np.nonzero(taken.any(axis=3))
                times = cut[tree, part]
                row, tree, part = (np.repeat(z, times) for z in (row, tree, part))
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                hit = taken[row, tree, part]
                leaves = (np.nonzero(hit)[1]).astype(np.int32)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([y.column(0).take(at), y.column(1).take(at), *[pa.array(z, pa.int32()) for z in (tree, part, block)], lists(leaves, hit.sum(axis=1))],
                                                 names=["vec_id", "embedding", "tree", "part", "block", "leaves"])

    asked = q.repartition(parts).mapInArrow(walk, "vec_id long, embedding array<double>, tree int, part int, block int, leaves array<int>")
    asked = asked.withColumn("side", F.pmod(F.xxhash64("vec_id"), F.lit(sides)).cast("int"))
    rows = [(t, g, int(c)) for (t, g), c in np.ndenumerate(blocks)]  # trees x 2^7 rows at most
    cuts = F.broadcast(spark.createDataFrame(rows, "tree int, part int, cut int"))
    held = placed.select("vec_id", "embedding", F.posexplode("leaves").alias("tree", "leaf")).withColumn("part", F.shiftright("leaf", above)).join(cuts, ["tree", "part"])
    held = held.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest("cut", F.lit(1))).cast("int")).drop("cut").withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids, leaf_of = right.column("vec_id").to_numpy(), right.column("leaf").to_numpy() & ((1 << above) - 1)
            vs = matrix(right.column("embedding"), dim)
            for i in range(0, len(left), WALKED):
                y = left.slice(i, WALKED)
                taken = np.zeros((len(y), 1 << above), bool)
                wide = y.column("leaves").combine_chunks()
                taken[np.repeat(np.arange(len(y)), np.diff(wide.offsets.to_numpy())), wide.flatten().to_numpy()] = True
                q_ids = y.column("vec_id").to_numpy()
                row, at, score = best(q_ids, matrix(y.column("embedding"), dim), ids, vs, taken[:, leaf_of], k)
                used, first = np.unique(row, return_index=True)
                size = np.diff(np.append(first, len(row)))
                found.append((q_ids[used], lists(at, size), lists(score, size)))
        columns = [pa.concat_arrays([pa.array(f[0]) for f in found]), *[pa.concat_arrays([f[j] for f in found]) for j in (1, 2)]] if found else [pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))]
        return pa.table(dict(zip(("query_id", "ids", "scores"), columns, strict=True)))

    key = ["tree", "part", "block", "side"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, "query_id long, ids array<long>, scores array<double>")

    def merge(x: pa.Table) -> pa.Table:
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in x.column("ids").chunks])
        ids, scores = (np.concatenate([c.flatten().to_numpy() for c in x.column(c).chunks]) for c in ("ids", "scores"))
        row, ids, scores = first_k(np.repeat(x.column("query_id").to_numpy(), sizes), ids, scores, k)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return pa.table({"query_id": row, "rank": pa.array(rank, pa.int32()), "vec_id": ids, "score": scores})

    # a query gets k rows at most from each block of a group of leaves
    lots = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked_n // MERGED)))).cast("int")
    return found.withColumn("lot", lots).groupBy("lot").applyInArrow(lambda x: merge(x), schema)


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
