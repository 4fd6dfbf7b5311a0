"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

1. A tree of centroids is fitted on a bounded sample (``leaves * SAMPLE_PER_LEAF`` vectors of the smallest id hashes, at most
   ``SAMPLE_BYTES``). Every vector then descends to its leaf; the index is a table (leaf, vec_id, vector).
2. A query opens nodes from a priority queue, nearest centroid first, and so visits leaves in order of promise.
3. How many leaves is calibrated: for ``CALIBRATION`` queries the true neighbours are found against all rows, and visits are doubled
   until ``TARGET`` of those neighbours lie in visited leaves.
4. Queries meet the rows of their leaves in cells. A leaf with many rows or many visitors is split both ways, so a cell is
   bounded whatever a leaf holds, copies of one vector included. Each cell keeps its best per query, then the best of all are ranked.

Distances are Euclidean, of the original vectors in double precision; equal ones rank by the smaller id. Vectors that are null, zero,
of another length than most, or hold null or non-finite components take no part, nor do rows without id. Of rows that share an id the
nearest counts, once. A query never finds its own id. Tables of up to ``LEAF_ROWS`` rows are one leaf, so their results are exact. An empty
table gives an empty result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.llm.stages import settle

K = 10
LEAF_ROWS = 400
MAX_LEAVES = 4096
SAMPLE_PER_LEAF = 16
SAMPLE_BYTES = 64 << 20
BRANCH = 8
CALIBRATION = 64
TARGET = 0.97
CELL_ROWS, CELL_QUERIES = 8192, 2048


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def nearest(ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids other than ``own``. A matrix product screens, with room for its rounding; the measure itself decides."""
    rough = square - 2.0 * (rows @ query)
    rough[ids == own] = np.inf
    slack = 1e-9 * (square.max(initial=0) + float(query @ query))
    usable = int(np.isfinite(rough).sum())
    take = min(k, usable)
    while True:
        if take == 0:
            return np.zeros(0, np.int64), np.zeros(0)
        limit = np.partition(rough, take - 1)[take - 1]
        near = np.flatnonzero(rough <= limit + slack)
        d = distances(rows[near], query)
        order = np.lexsort((ids[near], d))
        first = np.unique(ids[near][order], return_index=True)[1]  # an id once, at its nearest
        order = order[np.sort(first)]
        if len(order) >= k or len(near) >= usable:
            return ids[near][order[:k]], d[order[:k]]
        take = min(2 * take, usable)


# ---------------------------------------------------------------- the tree


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: children of node i are ``first[i] .. first[i] + count[i]``; a node without children is leaf ``leaf[i]``."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), np.int64)
        moving = np.flatnonzero(self.count[at] > 0)
        while len(moving):
            order = moving[np.argsort(at[moving], kind="stable")]
            nodes, head = np.unique(at[order], return_index=True)
            for node, rows in zip(nodes.tolist(), np.split(order, head[1:]), strict=True):
                a = self.first[node]
                c = self.centroids[a : a + self.count[node]]
                at[rows] = a + np.argmin((c**2).sum(1) - 2.0 * (x[rows] @ c.T), axis=1)
            moving = moving[self.count[at[moving]] > 0]
        return self.leaf[at]

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            n = int(self.count[node])
            if n == 0:
                yield int(self.leaf[node])
                continue
            a = int(self.first[node])
            d = ((self.centroids[a : a + n] - query) ** 2).sum(1).tolist()
            for i, v in enumerate(d):
                heapq.heappush(queue, (v, a + i))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's k-means; empty clusters are dropped."""
    c = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    c = c[rng.permutation(len(c))[:k]]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmin((c**2).sum(1) - 2.0 * (x @ c.T), axis=1)
        used = np.unique(own)
        c = np.stack([x[own == j].mean(0) for j in used])
    own = np.argmin((c**2).sum(1) - 2.0 * (x @ c.T), axis=1)
    return c, own


def grow(sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 11) -> Tree:
    """Split the largest cluster by k-means until there are enough leaves."""
    rng = np.random.default_rng(seed)
    centroids, first, count = [sample.mean(0)], [0], [0]
    queue = [(-len(sample), 0, np.arange(len(sample)))]
    n = 1
    while queue and n < leaves:
        size, node, rows = heapq.heappop(queue)
        if -size < 2:
            break
        c, own = _means(sample[rows], min(branch, leaves - n + 1), rng)
        if len(c) < 2:
            continue
        first[node], count[node] = len(centroids), len(c)
        for j in range(len(c)):
            centroids.append(c[j])
            first.append(0)
            count.append(0)
            members = rows[own == j]
            heapq.heappush(queue, (-len(members), len(centroids) - 1, members))
        n += len(c) - 1
    counts = np.array(count)
    leaf = np.full(len(counts), -1)
    leaf[counts == 0] = np.arange((counts == 0).sum())
    return Tree(np.stack(centroids), np.array(first), counts, leaf, int((counts == 0).sum()))


# ---------------------------------------------------------------- on the tables


def usable_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) with finite, non-zero vectors of the most frequent length, and that length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    clean = clean.filter(~bad & F.exists("v", lambda x: x != 0.0))
    top = clean.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    dim = top["n"] if top else 0
    return clean.filter(F.size("v") == dim), dim


def _calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, target: float) -> int:
    """Leaf visits that reach the target recall on some queries, whose true neighbours come from all rows."""
    rows = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toArrow()
    if rows.num_rows == 0:
        return 1
    own, q = rows.column("vec_id").to_numpy(), matrix(rows.column("v"), dim)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = matrix(batch.column(2), dim)
            square = (x**2).sum(1)
            at = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            for i in range(len(own)):
                found, d = nearest(ids, x, own[i], q[i], k, square)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), i, np.int32)), pa.array(found), pa.array(d), pa.array(np.array([at[f] for f in found.tolist()], np.int32))],
                    names=["q", "vec_id", "d", "leaf"],
                )

    true = indexed.select("leaf", "vec_id", "v").mapInArrow(best, "q int, vec_id long, d double, leaf int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    true = true.withColumn("r", rank).filter(F.col("r") <= k).select("q", "leaf").collect()  # k rows for each calibration query
    if not true:
        return 1
    order = [{leaf: n for n, leaf in enumerate(tree.visits(q[i]))} for i in range(len(own))]
    needed = np.array([order[r["q"]][r["leaf"]] for r in true])
    visits = 1
    while visits < tree.leaves and (needed < visits).mean() < target:
        visits *= 2
    return min(visits, tree.leaves)


def search(df: DataFrame, is_query: Column, k: int = K, target: float = TARGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score for the rows that ``is_query`` (on vec_id) selects, against all rows."""
    spark = df.sparkSession
    vectors, dim = usable_vectors(df)
    result = "query_id long, vec_id long, score double"
    rows = vectors.count()
    if rows == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    leaves = max(1, min(rows // leaf_rows, MAX_LEAVES))
    take = max(min(leaves * SAMPLE_PER_LEAF, SAMPLE_BYTES // (8 * dim)), 1)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).select("v").toArrow()
    tree = grow(matrix(sample.column("v"), dim), leaves)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(matrix(batch.column(1), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "vec_id", "v"])

    indexed = settle(vectors.mapInArrow(assign, "leaf int, vec_id long, v array<double>"))
    sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most MAX_LEAVES rows
    queries = indexed.filter(is_query).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    visits = _calibrate(indexed, queries, tree, dim, k, target)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to = [], []
            for i, q in enumerate(matrix(batch.column(1), dim)):
                seen = 0
                for n, leaf in enumerate(tree.visits(q)):
                    if n >= visits and seen > 4 * k:
                        break
                    seen += sizes.get(leaf, 0)
                    at.append(i)
                    to.append(leaf)
            picked = pa.array(np.array(at, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(to, np.int32)), batch.column(0).take(picked), batch.column(1).take(picked)], names=["leaf", "query_id", "q"]
            )

    visited = settle(queries.mapInArrow(plan, "leaf int, query_id long, q array<double>"))
    visitors = visited.groupBy("leaf").agg(F.count("*").alias("m"))
    cells = (
        indexed.groupBy("leaf")
        .agg(F.count("*").alias("n"))
        .join(visitors, "leaf")
        .select("leaf", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("rows_in"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("queries_in"))
    )
    some = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = F.broadcast(cells)  # at most MAX_LEAVES rows
    left = indexed.join(cells, "leaf").select("leaf", some("vec_id", "rows_in").alias("a"), every("queries_in").alias("b"), "vec_id", "v")
    right = visited.join(cells, "leaf").select("leaf", every("rows_in").alias("a"), some("query_id", "queries_in").alias("b"), "query_id", "q")

    def meet(key: tuple, here: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x = here.column("vec_id").to_numpy(), matrix(here.column("v"), dim)
        square = (x**2).sum(1)
        own, q = asked.column("query_id").to_numpy(), matrix(asked.column("q"), dim)
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(ids):
            for i in range(len(own)):
                found, d = nearest(ids, x, own[i], q[i], k, square)
                for column, value in zip(out, (np.full(len(found), own[i]), found, d), strict=True):
                    column.append(value)
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.groupBy("leaf", "a", "b").cogroup(right.groupBy("leaf", "a", "b")).applyInArrow(meet, result)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
