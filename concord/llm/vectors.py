"""What both vector searches share: valid rows, copies of a vector, reading blocks, the last ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import ship

ship(__name__)

HITS = "query_id long, vec_id long, score double"


def valid(rows: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """vec_id, v (array<double>): a row an id, without vectors that are null, empty, of another length than most, or hold null or non-finite components (or are all zero, unless ``zero``).

    Rows without an id take no part; of rows that repeat an id the smallest vector stays.
    """
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if not zero:
        ok = ok & F.exists("v", lambda x: x != 0)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(ok)
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    same = good.where(F.size("v") == (most["d"] if most else 0))
    return same.groupBy("vec_id").agg(F.min("v").alias("v"))


def candidates(base: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors only the k + 1 smallest ids can be among a query's k nearest; the partial limit drops the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return base.withColumn("_n", rank).where(F.col("_n") <= k + 1).drop("_n")


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def ranked(hits: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k best hits of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def in_blocks(search: Callable[[np.ndarray, np.ndarray], Callable], keys: int = 1, queries: int = 1024) -> Callable[[Iterator], Iterator]:
    """A task over rows (key columns, kind, vec_id, v, bound) sorted by key and kind.

    Rows of kind 0 are a block's candidates; ``search`` makes of them a function from query
    ids, vectors and bounds to (query row, candidate id, score). Rows of kind 1 are its queries and pass
    in chunks. A task holds one block's candidates and one chunk of queries.
    """

    def run(batches):
        key, ids, vecs, ask = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([np.asarray(batch.column(i)) for i in range(keys + 1)], axis=1)
            own, v, bound = np.asarray(batch.column("vec_id")), matrix(batch.column("v")), np.asarray(batch.column("bound"))
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
                if key is None or (k[lo, :keys] != key).any():
                    key, ids, vecs, ask = k[lo, :keys].copy(), [], [], None
                if k[lo, keys] == 0:
                    ids.append(own[lo:hi])
                    vecs.append(v[lo:hi])
                    continue
                if ask is None and ids:
                    ask = search(np.concatenate(ids), np.concatenate(vecs))
                if ask is None:
                    continue
                for at in range(lo, hi, queries):
                    s = slice(at, min(hi, at + queries))
                    row, cand, score = ask(own[s], v[s], bound[s])
                    yield pa.RecordBatch.from_arrays([pa.array(own[s][row]), pa.array(cand), pa.array(score)], ["query_id", "vec_id", "score"])

    return run
