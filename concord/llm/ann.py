"""Approximate nearest neighbours with learned partitions.

A bounded sample gives a neighbour graph (largest inner products). Its nodes are split into
partitions of equal size: balanced halving along principal directions, then balanced label
propagation over the graph. A classifier with one hidden layer learns a vector's partition;
offsets on its outputs, found on the sample, keep the partitions of the index even. A second
one, the router, learns in which partitions of that index a vector's neighbours lie. Every
row is indexed in one partition; a query goes to the ``probes`` most probable ones, where
its inner products with all rows are ranked exactly. The partitions are asked in rounds,
most probable first, and the k-th score so far bounds what later rounds report. ``probes``
is the smallest number that reaches ``want_recall`` on the sample, where every row's true
neighbours in the sample are known.

The number of partitions grows with the table, from ``least_partitions`` up to one for each
``rows_per_label`` rows of the sample; then partitions grow. A partition is searched in
blocks of about ``block_rows`` rows, so its size doesn't matter.

Vectors that are null, empty, zero or hold null or non-finite components, rows without an
id and vectors of another length than most take no part. Of rows that repeat an id the
smallest vector stays. Ties go to the smaller id. A query with fewer candidates than k in
the partitions it is sent to gets fewer ranks. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import bounded_sample, ship, written
from concord.llm.vectors import HITS, candidates, in_blocks, matrix, ranked, valid

ship(__name__)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds what the driver gathers to fit the index."""

    sample_rows: int = 6144
    rows_per_partition: int = 1500
    least_partitions: int = 8
    rows_per_label: int = 24
    neighbours: int = 40
    hidden: int = 128
    epochs: int = 20
    rate: float = 0.5
    want_recall: float = 0.95
    rounds: tuple[int, ...] = (1, 4)
    block_rows: int = 8192
    seed: int = 4


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row with the others."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 8, slack: float = 1.1) -> np.ndarray:
    """Labels below ``parts`` with nearly equal counts and few graph edges between labels."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or not len(rows):
            label[rows] = first
            continue
        away = x[rows] - x[rows].mean(axis=0)
        direction = rng.normal(size=x.shape[1])
        for _ in range(12):  # power iteration: the principal direction
            direction = away.T @ (away @ direction)
            direction /= np.linalg.norm(direction) + 1e-12
        order = rows[np.argsort(away @ direction, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    limit = int(slack * len(x) / parts) + 1
    n, k = graph.shape
    src = np.repeat(np.arange(n), k)
    for _ in range(sweeps if k else 0):
        votes = np.zeros((n, parts))
        np.add.at(votes, (src, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[src]), 1)
        size = np.bincount(label, minlength=parts)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if size[to] < limit:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Classifier:
    """Softmax over partitions from a hidden layer of rectified units."""

    shift: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.shift[0]) / self.shift[1]) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranking(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable partitions, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


@dataclass
class Index:
    """``home`` gives the partition a row stands in, ``router`` those to ask, of which ``probes`` are asked."""

    home: Classifier
    router: Classifier
    parts: int
    probes: int


def classify(x: np.ndarray, target: np.ndarray, settings: Settings, rng: np.random.Generator) -> Classifier:
    """Fit ``target``, a row of weights over the partitions for each row of x, by gradient descent with momentum."""
    parts = target.shape[1]
    target = target / np.maximum(1, target.sum(axis=1, keepdims=True))
    shift = np.stack([x.mean(axis=0), np.full(x.shape[1], x.std() + 1e-12)])
    z = (x - shift[0]) / shift[1]
    r = Classifier(shift, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], settings.hidden)), np.zeros(settings.hidden), rng.normal(0, settings.hidden**-0.5, (settings.hidden, parts)), np.zeros(parts))
    size, steps, done = 64, settings.epochs * -(-len(x) // 64), 0
    speed = {n: np.zeros_like(getattr(r, n)) for n in ("w1", "b1", "w2", "b2")}
    for _ in range(settings.epochs if parts > 1 else 0):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), size):
            rate = settings.rate * 0.1 * (1 - done / steps)
            done += 1
            own = order[lo : lo + size]
            h = np.maximum(z[own] @ r.w1 + r.b1, 0)
            o = h @ r.w2 + r.b2
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - target[own]) / len(own)
            back = (p @ r.w2.T) * (h > 0)
            for n, g in (("w2", h.T @ p), ("b2", p.sum(axis=0)), ("w1", z[own].T @ back), ("b1", back.sum(axis=0))):
                speed[n] = 0.9 * speed[n] + g
                setattr(r, n, getattr(r, n) - rate * speed[n])
    return r


def even_offsets(logits: np.ndarray, steps: int = 400) -> np.ndarray:
    """Offsets to add to ``logits`` so that as many rows as can be fall to each partition."""
    n, parts = logits.shape
    off, best, least = np.zeros(parts), np.zeros(parts), n + 1
    for k in range(steps):
        load = np.bincount((logits + off).argmax(axis=1), minlength=parts)
        if load.max() < least:
            best, least = off.copy(), load.max()
        off -= (1 - k / steps) * 0.5 * np.log((load + 1) / (n / parts + 1))
    return best


def fit(x: np.ndarray, settings: Settings, rows: int) -> Index:
    """Partition the sample's neighbour graph and fit the index; ``rows`` is the size of the table to be indexed."""
    rng = np.random.default_rng(settings.seed)
    parts = int(max(1, min(max(settings.least_partitions, rows // settings.rows_per_partition), len(x) // settings.rows_per_label)))
    graph = neighbour_graph(x, settings.neighbours) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    label = balanced_partition(x, graph, parts, rng)
    each = np.arange(len(x))

    def votes(label, own):
        target = np.zeros((len(x), parts))
        np.add.at(target, (each, label), own)
        if graph.shape[1]:
            np.add.at(target, (np.repeat(each, graph.shape[1]), label[graph.ravel()]), 1)
        return target

    home = classify(x, votes(label, graph.shape[1] or 1), settings, rng)
    home.b2 = home.b2 + even_offsets(home.logits(x))
    stands = home.ranking(x, 1)[:, 0]
    router = classify(x, votes(stands, 1), settings, rng)
    # a row stands in its home; a neighbour is found if that is among the partitions asked
    truth = neighbour_graph(x, 20) if len(x) > 1 else graph
    rank = np.argsort(router.ranking(x, parts), axis=1)
    probes = parts
    for n in range(1, parts + 1):
        if not truth.shape[1] or (np.take_along_axis(rank, stands[truth], 1) < n).mean() >= settings.want_recall:
            probes = n
            break
    return Index(home, router, parts, probes)


def _search(k: int):
    def build(ids, x):
        def ask(own, q, bound):
            score = q @ x.T
            score[own[:, None] == ids[None, :]] = -np.inf
            near = min(k, score.shape[1])
            low = np.partition(score, score.shape[1] - near, axis=1)[:, score.shape[1] - near]
            low = np.maximum(low, bound)
            row, col = np.nonzero(score >= np.where(np.isfinite(low), low - 1e-9 * (1 + np.abs(low)), low)[:, None])  # rounding may hide a tie
            row, col = row[fin := np.isfinite(score[row, col])], col[fin]
            exact = (q[row] * x[col]).sum(axis=1)
            order = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < k
            return row[best], ids[col[best]], exact[best]

        return ask

    return build


def search(rows: DataFrame, k: int = 20, every: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): each query's k nearest found; queries are the rows whose id ``every`` divides."""
    base = written(valid(rows, id_col, vec_col, False), "vectors")
    count = base.count()
    sample = bounded_sample(base, [F.lit(settings.seed), "vec_id"], settings.sample_rows)
    if not sample:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    fitted = fit(np.unique(np.array([r["v"] for r in sample]), axis=0), settings, count)

    def route(chosen, n):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    best = chosen.ranking(matrix(b.column("v")), n).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(list(best), pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

        return run

    routed = "vec_id long, v array<double>, parts array<int>"
    index = candidates(base, k).mapInArrow(route(fitted.home, 1), routed).select("vec_id", "v", F.col("parts")[0].alias("part"))
    index = written(index, "index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row a partition
    blocks = F.element_at(F.array(*[F.lit(-(-sizes.get(p, 0) // settings.block_rows)) for p in range(fitted.parts)]), F.col("part") + 1)
    none = F.lit(float("-inf"))
    block = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    held = index.select("part", block.alias("block"), F.lit(0).alias("kind"), "vec_id", "v", none.alias("bound"))
    routes = written(base.where(F.col("vec_id") % every == 0).mapInArrow(route(fitted.router, fitted.probes), routed), "routes")
    task = in_blocks(_search(k), keys=2)

    def find(asked):
        each = asked.withColumn("blocks", blocks).where("blocks > 0").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "bound")
        return held.union(each).repartition("part", "block").sortWithinPartitions("part", "block", "kind").mapInArrow(task, HITS)

    found, at = None, 0
    for width in (*settings.rounds, fitted.probes):
        if at >= fitted.probes:
            break
        asked = routes.withColumn("bound", none)
        if found is not None:
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
            worst = found.where(F.col("_n") == k).select("query_id", F.col("score").alias("b"))
            asked = routes.join(worst, F.col("vec_id") == F.col("query_id"), "left").withColumn("bound", F.coalesce("b", none))
            found = found.drop("_n")
        width = min(width, fitted.probes - at)
        hits = find(asked.select("vec_id", "v", F.explode(F.slice("parts", at + 1, width)).alias("part"), "bound"))
        at += width
        found = hits if found is None else found.union(hits)
        if at < fitted.probes:
            found = written(found, "hits")
    return ranked(found, k, F.col("score"))
