"""Plumbing shared by the corpus operators: shipping code, durable cuts, batch slicing."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into words at a time; bounds its memory.
SLICE_BYTES = 4 << 20


def ship(name: str) -> None:
    """Pickle the functions of a module by value, so that executors need no copy of the repository."""
    register_pickle_by_value(sys.modules[name])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-JVM session may do without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/concord-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/concord/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null as empty."""
    return column.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose texts have about ``limit`` bytes; a longer text stands alone."""
    ends, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            ends.append((start, i))
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        ends.append((start, len(texts)))
    return ends


def row_key(id_col: str, text_col: str) -> list:
    """Columns that tell rows apart where an id repeats with another text."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key")]


def training_part(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the text '' (0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, key: list, n: int) -> list:
    """At most n rows, those with the smallest hash of ``key``; only about that many leave the executors.

    A first count turns n into a bound on the hash, so tasks don't each send n rows.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*key))
    total = rows.count()
    share = (n + 4 * n**0.5 + 16) / max(1, total)
    if share < 0.9:
        hashed = hashed.where(F.col("_h") < int(-(1 << 63) + share * (1 << 64)))
    return hashed.orderBy("_h", *[c for c in rows.columns]).limit(n).collect()


def bounded_sample_by(rows: DataFrame, group: str, key: list, n: int) -> list:
    """At most n rows of each value of ``group``, those with the smallest hash of ``key``; any part of the list holds all values in about their shares.

    Counts by value, one row each, first give a bound on the hash, so that only about n rows of a value are shuffled.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(group).count().collect()
    if not counts:
        return []
    share = {r[group]: (n + 4 * n**0.5 + 16) / r["count"] for r in counts}
    top = {g: int(-(1 << 63) + x * (1 << 64)) if x < 0.9 else (1 << 63) - 1 for g, x in share.items()}
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in top.items() for x in kv]), F.col(group))
    few = rows.withColumn("_h", F.xxhash64(*key)).where(F.col("_h") <= bound)
    order = Window.partitionBy(group).orderBy("_h", *rows.columns)
    got = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).collect()
    size = {r[group]: min(n, r["count"]) for r in counts}
    return sorted(got, key=lambda r: (r["_n"] / size[r[group]], r["_h"]))


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of rows; empty segments give zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def hash_range(h: str, buckets: int):
    """Which of ``buckets`` equal ranges of the longs a hash falls in; follows the hash's order."""
    return F.least(F.floor((F.col(h) / float(1 << 64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")


def numbered(df: DataFrame, groups: list[str], order: list[str], size: str | None, seed: int, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``rank`` (gapless from 0) and, with ``size``, ``start`` (sum of the sizes before), by group.

    A group may hold any share of the rows: it is dealt into buckets by ranges of a hash, of
    about ``rows_per_bucket`` rows, bucket totals are summed first, and only a bucket is ever
    ordered in one task. The order within a group is that of the hash, then ``order``,
    whatever the number of buckets.
    """
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    rows = df.count()
    buckets = max(1, rows // rows_per_bucket)
    dealt = df.withColumn("_h", h).withColumn("_b", hash_range("_h", buckets))
    sums = [F.count("*").alias("_n")] + ([F.sum(size).alias("_s")] if size else [])
    totals = dealt.groupBy(*groups, "_b").agg(*sums)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0")] if size else []))
    match = F.col("_b") == F.col("_gb")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *order)
    out = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    if size:
        out = out.withColumn("_c", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    out = out.join(offsets, match).withColumn("rank", (F.col("_r") + F.col("_n0")).cast("long"))
    if size:
        out = out.withColumn("start", (F.col("_c") + F.col("_s0")).cast("long"))
    return out.drop("_h", "_b", "_n0", "_s0", "_r", "_c", "_gb", *[f"_g{i}" for i in range(len(groups))])
