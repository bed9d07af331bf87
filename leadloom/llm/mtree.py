"""Exact search for the greatest inner products with M-trees.

Greatest inner product becomes least distance: every vector gets one more component that lifts all vectors of
a tree to one length. The data are dealt into blocks by a hash of the id; each block is bulk-loaded into an
M-tree of paged nodes (pivot, covering radius, distances to the parent's pivot) and asked every query of a
bounded chunk of queries by best-first search; the block's best are merged by (score, id). Triangle inequality
over the stored distances spares most distance computations of a page; scores themselves are exact integers.

Vectors that are null, hold a null or a component that is not finite, or have no id take no part. A shorter
vector counts as filled up with zeros. Of rows that repeat an id the least vector counts.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
QUERY_EVERY = 100
TOP = 10
LEAF = 64
FANOUT = 16
#: Rows of a block: grows with the data between these bounds, so that small inputs too use many tasks.
BLOCK_ROWS = (1024, 65_536)
BLOCKS_AIMED = 64
#: Queries asked of a tree in one task.
CHUNK_QUERIES = 4096
#: Scores are ranked up to 38 digits and shown within a long.
WIDEST = 10**38 - 1
LONG = (-(2**63), 2**63 - 1)


class MTree:
    """Bulk-loaded over integer vectors (rows of ``vectors``, kept exactly) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        squares = np.array((vectors * vectors).sum(axis=1), np.float64)
        self.lift = squares.max(initial=0.0)
        self.points = np.c_[vectors.astype(np.float64), np.sqrt(np.maximum(0, self.lift - squares))]
        self.pages: list[tuple] = []  # (children or None, member rows, radii, distances to the page's pivot)
        self.computed = 0
        self.root = self._load(np.arange(len(ids)), 0) if len(ids) else None

    def _distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        gap = self.points[rows] - point
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _load(self, rows: np.ndarray, depth: int) -> tuple[int, int, float]:
        """Load rows into pages; returns (page, pivot row, covering radius)."""
        middle = self.points[rows].mean(axis=0)
        pivot = int(rows[self._distances(rows, middle).argmin()])
        reach = self._distances(rows, self.points[pivot])
        if len(rows) <= LEAF:
            self.pages.append((None, rows, None, reach))
            return len(self.pages) - 1, pivot, float(reach.max())
        parts = [self._load(g, depth + 1) for g in self._split(rows, reach)]
        pivots = np.array([p for _, p, _ in parts])
        self.pages.append((
            [page for page, _, _ in parts], pivots, np.array([r for _, _, r in parts]),
            self._distances(pivots, self.points[pivot]),
        ))
        return len(self.pages) - 1, pivot, float(reach.max())

    def _split(self, rows: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        count = min(FANOUT, -(-len(rows) // LEAF))
        seeds = rows[np.random.default_rng(len(rows)).choice(len(rows), count, replace=False)]
        cross = self.points[rows] @ self.points[seeds].T
        near = (0.5 * (self.points[seeds] ** 2).sum(axis=1) - cross).argmin(axis=1)
        groups = [rows[near == g] for g in range(count)]
        if max(map(len, groups)) > 0.8 * len(rows):  # equal or nearly equal vectors: shells of equal size
            return np.array_split(rows[np.argsort(reach, kind="stable")], count)
        return [g for g in groups if len(g)]

    def search(self, own_id: int, query: np.ndarray, top: int) -> list[tuple[int, int]]:
        """The ``top`` (score, id) of all rows but the query's own, by score falling, then id rising."""
        if self.root is None:
            return []
        point = np.append(query.astype(np.float64), 0.0)
        base = float(point @ point) + self.lift
        slack = 1e-9 * base + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -id)

        def bound(distance):
            """Greatest score at a distance of at least so much."""
            return (base - np.maximum(0.0, distance) ** 2) / 2 + slack

        page, pivot, radius = self.root
        reach = float(self._distances(np.array([pivot]), point)[0])
        queue = [(-float(bound(reach - radius)), page, reach)]
        while queue:
            above, page, reach = heapq.heappop(queue)
            if len(best) == top and -above < best[0][0]:
                break
            children, rows, radii, to_pivot = self.pages[page]
            least = best[0][0] if len(best) == top else -np.inf
            apart = np.abs(reach - to_pivot)
            kept = np.flatnonzero(bound(apart if children is None else apart - radii) >= least)
            self.computed += len(kept)
            if children is None:
                scores = self.vectors[rows[kept]] @ query
                for s, i in zip(scores.tolist(), self.ids[rows[kept]].tolist()):
                    if i == own_id or (len(best) == top and (s, -i) <= best[0]):
                        continue
                    (heapq.heappush if len(best) < top else heapq.heapreplace)(best, (int(s), -i))
                continue
            distances = self._distances(rows[kept], point)
            for k, d, b in zip(kept.tolist(), distances.tolist(), bound(distances - radii[kept]).tolist()):
                if b >= least:
                    heapq.heappush(queue, (-b, children[k], d))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integers(vectors: list[list[float]], size: int) -> np.ndarray:
    """floor(1024 * x); doubles while every inner product is exact in them, else Python integers."""
    out = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    out = np.floor(SCALE * out)
    if size * max(1.0, np.abs(out).max(initial=0.0)) ** 2 < 2.0**53:
        return out
    return np.array([[int(x) for x in row] for row in out.tolist()], object).reshape(out.shape)


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, one per id."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    x = F.col("v")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_products(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, top: int = TOP,
    block_rows: tuple[int, int] = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` inner products of each row whose id ``every`` divides."""
    rows = valid(df, id_col, vector_col)
    counts = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks = max(1, -(-counts[0] // min(max(counts[0] // BLOCKS_AIMED, block_rows[0]), block_rows[1])))
    chunks = max(1, -(-counts[1] // chunk_queries))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")
    data = rows.select("vec_id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = rows.filter(F.col("vec_id") % every == 0).select(
        "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk.alias("chunk")
    )

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        vectors, wanted = own.column("v").to_pylist(), queries.column("v").to_pylist()
        size = max([1, *map(len, vectors), *map(len, wanted)])
        both = integers(vectors + wanted, size)
        tree = MTree(own.column("vec_id").to_numpy(), both[:len(vectors)])
        out = [
            (q, i, Decimal(min(max(s, -WIDEST), WIDEST)))
            for q, v in zip(queries.column("vec_id").to_pylist(), both[len(vectors):])
            for s, i in tree.search(q, v, top)
        ]
        columns = list(zip(*out)) or [[], [], []]
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.decimal128(38, 0)}
        return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(kinds.items(), columns)})

    found = (
        data.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk"))
        .applyInArrow(search, "query_id long, vec_id long, score decimal(38,0)")
    )
    shown = F.greatest(F.least("score", F.lit(Decimal(LONG[1]))), F.lit(Decimal(LONG[0]))).cast("long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", shown.alias("score"))
    )
