"""Linking of like items that share a bucket, and connected components of the links.

All pairs of a bucket would grow with the square of a group of near copies. Instead every
member of a bucket is first compared with the bucket's smallest id. Members that are in one
component by then need no further comparison; only pairs of one bucket whose components
differ are left, and they are all compared. The components are the same as with all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.common import drop_staged, free, staged


#: Pairs whose marks are compared at a time.
PAIRS = 1 << 16
#: Blocks that a crowded key is cut into, and rows that a block holds at most.
WAYS, HELD = 4, 1 << 15
#: Pairs that wait for their texts to be compared together, at least.
WAITING = 2048


def components(edges: DataFrame) -> DataFrame:
    """id and root (the component's smallest id) of every id in edges(a, b), by alternating large and small stars.

    Edges are tables on the shared folder in every round; nothing is collected but their number and a checksum. Loops
    and null ends take no part, repeated edges count once. Without edges there are no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = staged(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hub = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(hub, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small.unionByName(hub.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_staged(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    # now every edge leads from a node to its component's smallest id
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def link(buckets: DataFrame, marks: DataFrame, near: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id and root of all items that are linked to another one.

    buckets(key, id): items that share a key are candidates. marks(id, mark): what near(mark, mark) decides by, once for each
    item. verify(pairs(a, b)) returns the pairs that are links. Both must be symmetrical. cross, if given, finds the links between
    items of different roots from the open rows (key, id, root, main, mark) without a join of the pairs; main is a key's largest root.
    A bucket's head is its member with most company over all its buckets: in a group of copies the one that most others are near to.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(buckets.join(sizes, "key"), "buckets")
    free(buckets.sparkSession)
    company = shared.groupBy("id").agg(F.sum("n").alias("company"))
    heads = shared.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", "id")).alias("head"))

    def tested(pairs: DataFrame) -> DataFrame:
        a = marks.select(F.col("id").alias("a"), F.col("mark").alias("_a"))
        b = marks.select(F.col("id").alias("b"), F.col("mark").alias("_b"))
        return verify(pairs.distinct().join(a, "a").join(b, "b").where(near(F.col("_a"), F.col("_b"))).select("a", "b"))

    met = shared.select("key", "id").join(heads, "key").where("id <> head")
    first = staged(tested(met.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))), "links")
    roots = staged(components(first), "roots")
    rows = shared.where("n > 2").select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    crowd = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    open_ = staged(rows.join(crowd.select("key", "main"), "key").join(marks, "id"), "open")
    drop_staged(shared)
    free(buckets.sparkSession)
    if cross:
        more = staged(cross(open_), "links")
    else:
        rest = open_.where("root <> main").select("key", F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("mark").alias("_mark"))
        apart = open_.join(rest, "key").where((F.col("root") != F.col("_root")) & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("_id"))) & near(F.col("mark"), F.col("_mark")))
        more = staged(verify(apart.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()), "links")
    drop_staged(open_)
    if more.isEmpty():
        return roots
    # the first components stand for their links
    out = staged(components(more.unionByName(roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))), "roots")
    drop_staged(roots)
    return out


def dealt(open_: DataFrame, block: int) -> DataFrame:
    """task, asks and the columns of rows(key, id: long, root, main, ..), so that in some task each row outside its key's main root asks every row of the key.

    Both sides of a key are cut into blocks: no task holds more than two blocks of one key. A row is sent once for each block of the other side,
    so blocks grow with their key: it has WAYS of them at most, until one would hold more than HELD rows.
    """
    size = F.least(F.greatest(F.ceil(F.count("*") / WAYS), F.lit(block)), F.lit(max(block, HELD)))
    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("root") != F.col("main")) / size).cast("int").alias("sides"))
    rows = open_.join(sizes, "key")
    few = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-open_.count() // block))))  # keys of one block share tasks
    at, side = (F.pmod(F.xxhash64(F.lit(i), "id"), F.col(c)).cast("int") for i, c in enumerate(("blocks", "sides")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = rows.withColumn("block", at).withColumn("side", every("sides")).withColumn("asks", F.lit(False))
    asks = rows.where("root <> main").withColumn("side", side).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    task = F.when(F.col("blocks") * F.col("sides") == 1, few).otherwise(F.xxhash64("key", "block", "side"))
    return held.unionByName(asks).select(task.alias("task"), "asks", *open_.columns)


def met(x: pa.Table, near: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (asking, asked) of the near pairs of different roots in the rows of one of dealt's tasks, a bounded number of pairs at a time."""
    key, asking, ids, roots, main = (x.column(c).to_numpy() for c in ("key", "asks", "id", "root", "main"))
    marks = x.column("mark").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
    order = np.lexsort((asking, key))
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    for rows in np.split(order, starts[1:]):
        held = len(rows) - int(asking[rows].sum())
        v, q = rows[:held], rows[held:]
        for at in range(0, len(q), max(1, PAIRS // max(1, held))):
            i = q[at : at + max(1, PAIRS // max(1, held)), None]
            hit = (roots[v] != roots[i]) & ((roots[v] == main[v]) | (ids[v] < ids[i])) & near(marks[v][None], marks[i[:, 0]][:, None])
            a, b = np.nonzero(hit)
            if len(a):
                yield i[a, 0], v[b]


def open_pairs(open_: DataFrame, near: Callable, block: int = 2048) -> DataFrame:
    """Distinct pairs(a < b) of ids of different roots in the rows(key, id, root, main: long, mark: array<long> of one length) that share a key and are near.

    near(a, b) compares arrays of marks, of which the last axis is the mark. What is not near is never a row; what is near is one, so
    the pairs of a group of near ids that aren't linked grow with its square: open_links gives the links alone.
    """
    def meet(x: pa.Table) -> pa.Table:
        ids = x.column("id").to_numpy()
        found = [np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]) for a, b in met(x, near)]
        a, b = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    return dealt(open_, block).groupBy("task").applyInArrow(lambda x: meet(x), "a long, b long").distinct()


def open_links(open_: DataFrame, held: DataFrame, near: Callable, verify: Callable, block: int = 8192, texts: int = 1024) -> DataFrame:
    """Links(a, b) between ids of different roots in open_'s rows (as open_pairs takes them) that share a key; enough to join all roots that links join.

    held(id, mark, text) has what verify(texts, texts, marks, marks) tells the links by. Pairs are never rows: first each block names the ids that have
    somebody near, then the texts of these meet, in blocks of so many. Of the keys that a pair shares one is its own, and there alone
    the pair is compared, unless its ids are joined by then. So a task gives fewer links than it has rows.
    """
    def named(x: pa.Table) -> pa.Table:
        rows = [np.unique(np.concatenate(pair)) for pair in met(x, near)]
        rows = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
        return x.select(["key", "id", "root", "main"]).take(pa.array(rows))

    some = staged(dealt(open_, block).groupBy("task").applyInArrow(lambda x: named(x), "key long, id long, root long, main long").distinct(), "near")
    free(open_.sparkSession)
    own = held.join(some.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    rows = staged(some.join(own, "id"), "open")
    drop_staged(some)
    free(open_.sparkSession)

    def compare(x: pa.Table) -> pa.Table:
        key, ids, root = (x.column(c).to_pylist() for c in ("key", "id", "root"))
        marks, text = x.column("mark").combine_chunks().flatten().to_numpy().reshape(len(x), -1), x.column("text")
        keys = [set(k) for k in x.column("keys").to_pylist()]
        up: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        waiting: list[tuple[int, int]] = []

        def top(r: int) -> int:
            while up.setdefault(r, r) != r:
                up[r] = r = up[up[r]]
            return r

        def settle() -> None:
            pairs = [(i, j) for i, j in waiting if top(root[i]) != top(root[j])]
            waiting.clear()
            if pairs:
                i, j = zip(*pairs)
                for at in np.flatnonzero(verify([text[k].as_py() for k in i], [text[k].as_py() for k in j], marks[list(i)], marks[list(j)])):
                    a, b = top(root[i[at]]), top(root[j[at]])
                    if a != b:
                        up[a] = b
                        found.append((ids[i[at]], ids[j[at]]))

        for a, b in met(x, near):
            for i, j in zip(a.tolist(), b.tolist()):
                if top(root[i]) != top(root[j]):
                    both = keys[i] & keys[j]
                    if len(both) == 1 or sorted(both)[(ids[i] ^ ids[j]) % len(both)] == key[i]:
                        waiting.append((i, j))
            if len(waiting) >= WAITING:
                settle()
        settle()
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    got = staged(dealt(rows, texts).groupBy("task").applyInArrow(lambda x: compare(x), "a long, b long").distinct(), "links")
    drop_staged(rows)
    return got
