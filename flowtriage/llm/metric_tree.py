"""Exact top-k inner-product search by best-first search in a paged M-tree.

With one more coordinate, sqrt(M - |x|^2) for M the largest squared norm, all
rows lie on a sphere and the largest inner product with a query is the smallest
Euclidean distance to it; that is the metric of the tree. Rows are dealt to the
nearest of some pivots and packed into nodes of bounded size (a table, one row
a node); a node keeps its routing row, covering radius and leaves, a leaf its
own routing row, radius, distance to the node's, and for every entry the stored
distance to the leaf's.

Each node is searched best-first for a block of queries: leaves in order of
their lower bounds until the bound passes the k-th best score; a leaf's
distance is not computed where the stored distance to its parent already rules
it out, nor an entry's. Bounds carry a margin for rounding; scores are exact
integers, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowtriage.sources.workspace import durable

#: Results per query; queries searched at a time; rows of a node and of a leaf; pivots.
TOP, BLOCK, NODE, LEAF, PIVOTS = 10, 8_192, 4_096, 128, 64
SCALE = 1_024
_NODES = "dims int, ids binary, vectors binary"
#: Relative margin of all bounds, far above the rounding of 64-bit floats.
_MARGIN = 1e-9


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and components floor(scale * x); without null ids, null vectors and non-finite components."""
    value = F.col(vector).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    floored = F.transform(value, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return df.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), floored.alias("vector"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, shorter ones filled up with zeros."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Node:
    """One page of the tree: leaves around routing rows inside one covering ball."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors = ids, vectors
        points = vectors.astype(np.float64)
        norms = (points * points).sum(axis=1)
        self.points = np.column_stack([points, np.sqrt(np.maximum(largest - norms, 0.0))])
        routing = self._routing(max(1, -(-len(ids) // LEAF)))
        gaps = self._distances(self.points, self.points[routing])
        owner = gaps.argmin(axis=1)
        self.root = self.points[routing[0]]
        self.leaves = []
        for leaf, at in enumerate(routing):
            rows = np.flatnonzero(owner == leaf)
            if not len(rows):
                continue
            apart = gaps[rows, leaf]
            to_root = float(np.linalg.norm(self.points[at] - self.root))
            self.leaves.append((self.points[at], float(apart.max()), to_root, rows, apart))
        self.radius = max((p + r for _, r, p, _, _ in self.leaves), default=0.0)

    def _routing(self, n: int) -> np.ndarray:
        """Rows far from each other: each next one is the farthest from those chosen."""
        chosen = [0]
        far = np.linalg.norm(self.points - self.points[0], axis=1)
        while len(chosen) < n and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(self.points - self.points[chosen[-1]], axis=1))
        return np.array(chosen)

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0.0))

    def search(self, best: Best) -> None:
        """Offer this node's entries to all queries whose bound they can pass."""
        slack = best.slack
        to_root = self._distances(best.points, self.root[None, :])[:, 0]
        open_ = np.flatnonzero(to_root - self.radius <= best.reach() + slack)
        if not len(open_):
            return
        routing = np.array([p for p, *_ in self.leaves])
        radius = np.array([r for _, r, *_ in self.leaves])
        parent = np.array([p for _, _, p, *_ in self.leaves])
        # Stored parent distances first: |d(q, root) - d(leaf, root)| - r bounds from below.
        bound = np.abs(to_root[open_][:, None] - parent[None, :]) - radius[None, :]
        maybe = bound <= (best.reach()[open_] + slack)[:, None]
        to_leaf = np.full(bound.shape, np.inf)
        for leaf in range(len(self.leaves)):
            rows = np.flatnonzero(maybe[:, leaf])
            if len(rows):
                to_leaf[rows, leaf] = self._distances(best.points[open_[rows]], routing[leaf][None, :])[:, 0]
        bound = np.where(maybe, np.maximum(bound, to_leaf - radius[None, :]), np.inf)
        order = bound.argsort(axis=1, kind="stable")
        for step in range(order.shape[1]):
            leaf_of = order[:, step]
            wanted = bound[np.arange(len(open_)), leaf_of] <= best.reach()[open_] + slack
            if not wanted.any():
                break
            for leaf in np.unique(leaf_of[wanted]):
                rows = np.flatnonzero(wanted & (leaf_of == leaf))
                _, _, _, members, apart = self.leaves[leaf]
                queries = open_[rows]
                near = np.abs(to_leaf[rows, leaf][:, None] - apart[None, :])
                possible = near <= (best.reach()[queries] + slack)[:, None]
                some = np.flatnonzero(possible.any(axis=0))
                if len(some):
                    best.offer(queries, self.ids[members[some]], self.vectors[members[some]])


class Best:
    """The k best scores so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, largest: float, top: int):
        self.ids, self.vectors, self.top, self.largest = ids, vectors, top, largest
        self.scored = vectors.astype(np.float64)
        self.points = np.column_stack([self.scored, np.zeros(len(ids))])
        self.norms = (self.scored * self.scored).sum(axis=1)
        self.floor = floor.copy()
        self.slack = _MARGIN * (np.sqrt(self.norms.max(initial=0.0)) + np.sqrt(largest)) + 1e-6
        # Integer inner products below 2^53 are exact in 64-bit floats, whatever the order of the sums.
        self.exact = float(np.sqrt(self.norms.max(initial=0.0) * max(largest, 1.0))) * vectors.shape[1] < 2**52
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = np.full((len(ids), top), np.iinfo(np.int64).min, dtype=np.int64)

    def reach(self) -> np.ndarray:
        """Distance within which a row can still have a score of at least the k-th best."""
        squares = self.norms + self.largest - 2.0 * self.floor.astype(np.float64)
        return np.where(self.floor == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum(squares, 0.0)))

    def offer(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if self.exact:
            scores = (self.scored[queries] @ vectors.T.astype(np.float64)).astype(np.int64)
        else:
            scores = self.vectors[queries] @ vectors.T
        scores[self.ids[queries][:, None] == ids[None, :]] = np.iinfo(np.int64).min
        good = (scores >= self.floor[queries][:, None]) & (scores > np.iinfo(np.int64).min)
        rows, columns = np.nonzero(good)
        if not len(rows):
            return
        self.found.append((queries[rows], ids[columns], scores[rows, columns]))
        k = min(self.top, scores.shape[1])
        ahead = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]
        held = np.concatenate([self.held[queries], ahead], axis=1)
        self.held[queries] = np.partition(held, held.shape[1] - self.top, axis=1)[:, -self.top :]
        self.floor[queries] = np.maximum(self.floor[queries], self.held[queries].min(axis=1))
        if sum(len(f[0]) for f in self.found) > 64 * self.top * len(self.ids) + 100_000:
            self.found = [self.result()]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best so far, at most k a query."""
        if not self.found:
            return (np.empty(0, dtype=np.int64),) * 3
        query, ids, scores = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.top
        return query[kept], ids[kept], scores[kept]


def build_nodes(vectors: DataFrame, dims: int, pivots: np.ndarray) -> DataFrame:
    """The table of nodes: rows near one pivot packed by at most NODE, one row a node, no row left out.

    Rows are dealt by pivot and a hash of their id over many tasks, so rows
    crowded around one pivot, or all equal, fill many nodes in many tasks.
    """
    centre = vectors.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = centre.value.astype(np.float64)
        for batch in batches:
            matrix = _matrix(batch, dims)
            gaps = (points * points).sum(axis=1)[None, :] - 2 * (matrix @ points.T)
            packed = [row.tobytes() for row in matrix]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gaps.argmin(axis=1).astype(np.int64)), batch.column("vec_id"), pa.array(packed, type=pa.binary())],
                names=["pivot", "vec_id", "vector"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []

        def page() -> pa.RecordBatch:
            columns = [[dims], [np.array(ids, dtype=np.int64).tobytes()], [b"".join(rows)]]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["dims", "ids", "vectors"])

        for batch in batches:
            for pivot, vec_id, row in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (pivot != now or len(ids) >= NODE):
                    yield page()
                    ids, rows = [], []
                now = pivot
                ids.append(vec_id)
                rows.append(row)
        if ids:
            yield page()

    dealt = vectors.mapInArrow(deal, "pivot long, vec_id long, vector binary")
    # Nearest pivots stay together within a task; the salt parts what crowds around one.
    dealt = dealt.repartition("pivot", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    return dealt.sortWithinPartitions("pivot").mapInArrow(pack, _NODES)


#: Largest squared norm of the integer vectors that keeps every score within 64 bits (with room for rounding).
_LIMIT = 2.0**62


def search(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query=None,
    top: int = TOP,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best rows of each query among all others.

    ``query`` is the condition on vec_id that makes a row a query (default: id
    divisible by 100). All rows with the query's id are left out of its
    candidates; a query id on several rows is answered once, for its least
    vector. Repeated candidate rows count each, ties go to the smaller id. Null
    ids, null vectors and vectors with null or non-finite components take no
    part; a shorter vector counts as filled up with zeros. No rows or no queries
    give no rows. Queries go in blocks of ``block``, whose size bounds what the
    driver and a task hold of them. Vectors whose largest squared norm reaches
    2^62 raise OverflowError, as their scores could leave 64 bits.
    """
    spark = rows.sparkSession
    condition = (F.col("vec_id") % 100 == 0) if query is None else query
    vectors = durable(integer_vectors(rows, vec_id, vector), "tree-vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    dims, largest = vectors.agg(F.max(F.size("vector")), F.max(norm)).first()
    out = "query_id long, rank int, vec_id long, score long"
    if dims is None:
        return spark.createDataFrame([], out)
    dims = max(1, dims)
    largest = float(largest)
    if largest >= _LIMIT:  # |x . y| and every partial sum of it are at most the largest squared norm
        raise OverflowError(f"inner products may pass 64 bits: largest squared norm {largest:.3g}")
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(PIVOTS).toArrow()
    pivots = _matrix(sample.combine_chunks().to_batches()[0], dims)
    nodes = durable(build_nodes(vectors, dims, pivots), "tree-nodes")
    asked = vectors.where(condition).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = durable(asked.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "tree-queries")
    n_blocks = -(-asked.count() // block)
    # Blocks by hash: their sizes vary a little, none is left out.
    blocked = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, n_blocks))))
    found = []
    for number in range(n_blocks):
        part = blocked.where(F.col("_block") == number).select("vec_id", "vector").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        batch = part.to_batches()[0]
        ids, matrix = batch.column("vec_id").to_numpy(), _matrix(batch, dims)
        floor = _first_floor(ids, matrix, top)
        shared = spark.sparkContext.broadcast((ids, matrix, floor))
        found.append(durable(nodes.mapInArrow(_searcher(shared, dims, largest, top), "query_id long, vec_id long, score long"), "tree-found"))
    if not found:
        return spark.createDataFrame([], out)
    offered = found[0]
    for more in found[1:]:
        offered = offered.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def _first_floor(ids: np.ndarray, matrix: np.ndarray, top: int, rows: int = 1_024) -> np.ndarray:
    """A first lower bound of each query's k-th best score, from some other queries as candidates."""
    floor = np.full(len(ids), np.iinfo(np.int64).min, dtype=np.int64)
    others = slice(0, rows)
    if len(ids[others]) <= top:
        return floor
    for start in range(0, len(ids), 1_024):
        part = slice(start, start + 1_024)
        scores = matrix[part] @ matrix[others].T
        scores[ids[part][:, None] == ids[others][None, :]] = np.iinfo(np.int64).min
        floor[part] = np.partition(scores, scores.shape[1] - top, axis=1)[:, -top]
    return floor


def _searcher(shared, dims: int, largest: float, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, floor = shared.value
        best = Best(ids, matrix, floor, largest, top)
        for batch in batches:
            for i in range(batch.num_rows):
                held = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int64)
                values = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64).reshape(len(held), dims)
                Node(held, values, largest).search(best)
        query, found, scores = best.result()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"]
        )

    return run
