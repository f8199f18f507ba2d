"""Nearest neighbours by vantage-point trees, one for each shard.

An index row is one shard: at most `shard_rows` vectors (in the mean) in tree order, with a vantage
point and the distances at which its two halves begin and end for each inner node. A query enters
the leaf with its least triangle bound first and skips others if `relax` times their bound exceeds
the distance of its k-th best so far; queries of a block are compared with a leaf together. `relax` 1 skips nothing that could matter, so the
result is exact; larger values prune more and may lose neighbours (`recall` measures it).

Queries meet shards in blocks of bounded size and each shard answers with k rows a query at most.

Rows: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows
without an id. Vectors of different lengths are never neighbours. Every row is a candidate and may be
a query, also where ids repeat: a query leaves out one row of its own id and vector and finds all
others, those of its id included. Rows alike in both are one entry that counts as many times. Equal
distances go to the smaller id. A query with fewer than k candidates gets them all; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import saved

SHARD_ROWS = 8192
LEAF = 256
QUERY_BLOCK = 1024
#: Squares of differences held at once, at most.
PAIR_NUMBERS = 1 << 21
#: Slack for rounding of the triangle bound.
SLACK = 1e-9


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean, by differences in double precision, rows of `points` to one vector."""
    return np.sqrt(((points - to) ** 2).sum(axis=1))


class Tree:
    """Vectors in tree order; a node is (lo, hi, vantage, inner and outer bounds, children). An entry
    stands for `copies` rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, copies: np.ndarray | None = None):
        self.ids, self.vectors, self.nodes = ids.copy(), vectors.copy(), []
        self.copies = np.ones(len(ids), dtype=np.int64) if copies is None else copies.copy()
        self._build(0, len(ids), leaf)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if hi - lo <= leaf:
            self.nodes[at] = (lo, hi)
            return at
        some = self.vectors[lo:hi].astype(np.float64)
        far = distances(some, some.mean(axis=0)).argmax()  # a corner makes a good vantage point
        point = some[far]
        d = distances(some, point)
        order = np.argsort(d, kind="stable")
        for held in (self.ids, self.vectors, self.copies):
            held[lo:hi] = held[lo:hi][order]
        d, mid = d[order], (hi - lo) // 2
        near = self._build(lo, lo + mid, leaf)
        rest = self._build(lo + mid, hi, leaf)
        self.nodes[at] = (lo, hi, point, (d[0], d[mid - 1], near), (d[mid], d[-1], rest))
        return at

    def bounds(self, queries: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The leaves (lo, hi), and what each query's distance to their vectors is at least: queries x leaves."""
        least = np.zeros((len(self.nodes), len(queries)))
        for at, node in enumerate(self.nodes):  # children come after their parent
            if len(node) > 2:
                d = distances(queries, node[2])
                for low, high, child in node[3:]:
                    least[child] = np.maximum(least[at], np.maximum(low - d, d - high))
        leaves = [at for at, node in enumerate(self.nodes) if len(node) == 2]
        return [self.nodes[at] for at in leaves], least[leaves].T

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the queries, distances, ids) of the k nearest that the search finds of each,
        nearest first; one row of a query's own id and vector stays out. Each query enters the leaf of its
        least bound first, then every leaf that its k-th best so far doesn't exclude."""
        leaves, bounds = self.bounds(queries)
        first = bounds.argmin(axis=1)
        best_d, best = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)  # distances and places so far

        def enter(at: int, some: np.ndarray) -> None:
            if len(some):
                found = self._nearer(*leaves[at], queries[some], own[some], k, best_d[some, -1])
                best_d[some], best[some] = self._first(best_d[some], best[some], *found)

        for at in range(len(leaves)):
            enter(at, np.flatnonzero(first == at))
        for at in range(len(leaves)):
            excluded = relax * bounds[:, at] > best_d[:, -1] * (1 + SLACK)
            enter(at, np.flatnonzero((first != at) & ~excluded))
        row, _ = found = np.nonzero(best >= 0)
        d, place = best_d[found], best[found]
        times = np.minimum(self.copies[place] - ((self.ids[place] == own[row]) & (d == 0)), k)
        row, d, ids = (np.repeat(x, times) for x in (row, d, self.ids[place]))
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], d[kept], ids[kept]

    def _nearer(self, lo: int, hi: int, queries: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray) -> tuple:
        """(query, distance, place) of a leaf's entries that may be among the k nearest, given the k-th best
        so far. A matrix product leaves out only what is farther by more than its rounding."""
        points = self.vectors[lo:hi].astype(np.float64)
        sizes, norms = (points**2).sum(axis=1), (queries**2).sum(axis=1)
        near = sizes + norms[:, None] - 2 * (queries @ points.T)
        limit = reach**2
        if hi - lo > k:  # the query's own row may be one of k + 1
            limit = np.minimum(limit, np.partition(near, k, axis=1)[:, k])
        limit = limit + 16 * queries.shape[1] * np.finfo(np.float64).eps * (norms + sizes.max())
        row, place = np.nonzero(~(near > limit[:, None]))
        d, step = np.empty(len(row)), max(1, PAIR_NUMBERS // queries.shape[1])
        for i in range(0, len(row), step):  # squares summed one after the other, as any plain loop does
            squares = (points[place[i : i + step]] - queries[row[i : i + step]]) ** 2
            d[i : i + step] = np.sqrt(np.cumsum(squares, axis=1)[:, -1])
        place += lo
        others = ~((self.ids[place] == own[row]) & (self.copies[place] == 1) & (d == 0))
        return row[others], d[others], place[others]

    def _first(self, best_d: np.ndarray, best: np.ndarray, row: np.ndarray, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first k of each query by (distance, id), of the best so far (queries x k) and of those found."""
        n, k = best.shape
        row = np.concatenate([np.repeat(np.arange(n), k), row])
        d, place = np.concatenate([best_d.ravel(), d]), np.concatenate([best.ravel(), place])
        order = np.lexsort((self.ids[place], place < 0, d, row))
        top = order[np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(k)]
        return d[top], place[top]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, copies) of the rows that take part."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.filter(F.col("id").isNotNull() & fine & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


def build_index(rows: DataFrame, key: str, vector: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: (shard, dim, tree). Every vector is in one tree; an id's vectors are
    dealt apart."""
    parts = saved(usable(rows, key, vector), "vectors")
    shards = max(1, math.ceil(parts.count() / shard_rows))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("dim", F.size("v"))

    def tree(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group["v"].to_list())
        order = np.lexsort((*vectors.T[::-1], group["id"]))
        ids, copies = (group[c].to_numpy(np.int64)[order] for c in ("id", "copies"))
        made = Tree(ids, vectors[order], copies=copies)
        return pd.DataFrame([(keys[0], keys[1], pickle.dumps(made, protocol=5))], columns=["shard", "dim", "tree"])

    return saved(
        dealt.groupBy("shard", "dim").applyInPandas(tree, "shard int, dim int, tree binary"), "trees"
    )


def search(
    index: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    relax: float = 1.0,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, over all shards."""
    asked = usable(queries, key, vector).withColumn("dim", F.size("v"))
    asked = saved(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    own = F.struct("id", "v", F.xxhash64("v").alias("mark"), "copies")
    packed = asked.groupBy("dim", "block").agg(F.sort_array(F.collect_list(own)).alias("rows"))
    # each block goes to every shard by number: with one length of vectors, `dim` alone is one join key
    last = index.agg(F.max("shard")).first()[0] or 0
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    met = index.join(packed, ["dim", "shard"]).withColumn("cell", F.concat_ws("/", "shard", "dim", "block"))

    def answer(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, rows in zip(group["tree"], group["rows"]):
            own, mark, copies = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("id", "mark", "copies"))
            asked = np.array([r["v"] for r in rows], dtype=np.float64)
            at, d, ids = pickle.loads(tree).search(asked, own, k, relax)
            row = {"query_id": own[at], "mark": mark[at], "copies": copies[at], "vec_id": ids, "score": d}
            out.append(pd.DataFrame(row))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "mark", "copies", "vec_id", "score"])

    ddl = "query_id long, mark long, copies long, vec_id long, score double"
    found = met.groupBy("cell").applyInPandas(answer, ddl)
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))  # alike queries, alike answers
    return found.withColumn("_copy", again).select("query_id", "rank", "vec_id", "score")


def nearest(
    rows: DataFrame,
    asked: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    relax: float = 1.0,
) -> DataFrame:
    """Index all rows and search those for which `asked` holds."""
    return search(build_index(rows, key, vector), rows.filter(asked), key, vector, k, relax)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows' (query, neighbour) pairs that were found."""
    pairs = exact.select("query_id", "vec_id")
    hits = pairs.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, pairs.count())
