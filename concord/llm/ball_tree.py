"""Exact top-k by inner product: ball-tree branch and bound in every shard.

Candidates are dealt by a hash into shards of about ``shard_rows`` rows; a task builds a
ball tree over one shard at a time. A query q can't score above q.c + |q| r in a ball with
centre c and radius r; balls are visited with the highest bound first, and those whose bound
is below the query's current k-th score are skipped. Each query first searches its home
shard; the k-th score found there is the bound it starts with in all other shards, so
shards share it. Vectors are integers (``floor(scale * x)``), so scores are exact.

Vectors that are null, empty or hold null or non-finite components, and rows without an id,
take no part; nor do vectors of another length than most. Of rows that repeat an id the
smallest vector stays. The zero vector is a vector like others. Fewer candidates than k
give fewer ranks. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import ship, written
from concord.llm.vectors import HITS, candidates, in_blocks, ranked, valid

ship(__name__)


class BallTree:
    """Nodes over ``x`` as ranges of ``order``; children are halves along the widest direction."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # centre, radius, lo, hi, left, right
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = self.order[lo:hi]
            part = x[own]
            centre = part.mean(axis=0)
            away = part - centre
            radius = float(np.sqrt((away * away).sum(axis=1).max()))
            me = len(self.nodes)
            self.nodes.append([centre, radius, lo, hi, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if hi - lo > leaf and radius > 0:
                far = away[int((away * away).sum(axis=1).argmax())]
                mid = (hi - lo) // 2
                self.order[lo:hi] = own[np.argpartition(away @ far, mid)]
                todo += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]

    def search(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple:
        """(query row, id, score) of the k best for each query that reach its ``bound``, without its own id; ties to smaller ids."""
        top = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        kth = bound.astype(np.float64).copy()
        norm = np.sqrt((q * q).sum(axis=1))
        stack = [(0, np.arange(len(q)), np.full(len(q), np.inf))]
        while stack:
            node, rows, limit = stack.pop()
            open_ = limit >= kth[rows]
            rows = rows[open_]
            if not len(rows):
                continue
            _, _, lo, hi, left, right = self.nodes[node]
            if left >= 0:
                kids = []
                for child in (left, right):
                    c, r = self.nodes[child][:2]
                    reach = q[rows] @ c + norm[rows] * r
                    kids.append((float(reach.mean()), child, reach + 1e-6 * (1 + np.abs(reach))))
                for _, child, reach in sorted(kids, key=lambda e: e[0]):  # the higher bound is on top of the stack
                    stack.append((child, rows, reach))
                continue
            member = self.order[lo:hi]
            score = q[rows] @ x[member].T
            score[own[rows][:, None] == ids[member][None, :]] = -np.inf
            hit = score.max(axis=1) >= kth[rows]
            rows, score = rows[hit], score[hit]
            if not len(rows):
                continue
            score[score < kth[rows][:, None]] = -np.inf
            s = np.concatenate([top[rows], score], axis=1)
            w = np.concatenate([who[rows], np.broadcast_to(ids[member], score.shape)], axis=1)
            best = np.lexsort((w, -s), axis=1)[:, :k]
            top[rows], who[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(w, best, 1)
            kth[rows] = np.maximum(kth[rows], top[rows][:, -1])
        row, col = np.nonzero(np.isfinite(top))
        return row, who[row, col], top[row, col]


def _search(k: int, leaf: int):
    def build(ids, x):
        tree = BallTree(x, leaf)
        return lambda own, q, bound: tree.search(x, ids, q, own, bound, k)

    return build


def top_k(rows: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, shard_rows: int = 16_384, leaf: int = 128, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k highest inner products; queries are the rows whose id ``every`` divides."""
    exact = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * scale).cast("double")))
    base = written(valid(rows.select(F.col(id_col).alias("vec_id"), exact.alias("v")), "vec_id", "v", True), "vectors")
    shards = max(1, -(-base.count() // shard_rows))
    deal = F.pmod(F.xxhash64(F.col("vec_id")), F.lit(shards)).cast("int")
    none = F.lit(float("-inf"))
    held = written(candidates(base, k).select(deal.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", none.alias("bound")), "candidates")
    asked = base.where(F.col("vec_id") % every == 0).select(deal.alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", none.alias("bound"))
    task = in_blocks(_search(k, leaf))

    def find(queries):
        return held.union(queries).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(task, HITS)

    home = written(find(asked), "home-hits")
    if shards == 1:
        return ranked(home, k, F.col("score").cast("long"))
    worst = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("b"))
    away = asked.join(worst, F.col("vec_id") == F.col("query_id"), "left")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard")))
    away = away.select(others.alias("shard"), "kind", "vec_id", "v", F.coalesce("b", none).alias("bound"))
    return ranked(home.union(find(away)), k, F.col("score").cast("long"))
