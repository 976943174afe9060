"""Clustering metric labels: which are new, batches to name, recorded names, a lexical fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.text import metric_key, metric_similarity
from concord.thresholds import DEFAULTS, Thresholds


def new_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """key, label: the first raw label of each key that has no canonical name."""
    first = labels.where("metric_key <> ''").groupBy(F.col("metric_key").alias("key")).agg(F.min_by("metric_raw", "id").alias("label"))
    return first.join(known.select("key"), "key", "left_anti")


def batches(labels: DataFrame, size: int = 60) -> DataFrame:
    """Labels with batch and index, in order; a row a distinct label, so the one ordered partition is small."""
    n = F.row_number().over(Window.orderBy("label")) - 1
    return labels.withColumn("n", n).select("key", "label", F.floor(F.col("n") / size).cast("int").alias("batch"), (F.col("n") % size).cast("int").alias("index"))


def assign(batched: DataFrame, answers: DataFrame, existing: DataFrame, settings: Thresholds = DEFAULTS) -> DataFrame:
    """key, label, canonical: the recorded answer (batch, index, canonical), else the most similar existing name, else the label itself."""
    given = batched.join(answers.select("batch", "index", F.substring(F.lower(F.trim("canonical")), 1, 120).alias("given")), ["batch", "index"], "left")
    open_ = given.where(F.coalesce("given", F.lit("")) == "").select("key", "label", F.explode(F.split("key", " ")).alias("token"))
    names = existing.select(F.col("canonical").alias("name"), F.explode(F.array_distinct(F.split(metric_key(F.col("canonical")), " "))).alias("token"))
    near = open_.join(names, "token").select("key", "label", "name").distinct().withColumn("s", metric_similarity(F.col("label"), F.col("name")))
    best = near.where(F.col("s") >= settings.lexical_cluster).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("s"), "name"))).where("r = 1").select("key", "name")
    return given.join(best, "key", "left").select("key", "label", F.coalesce(F.nullif("given", F.lit("")), "name", F.lower("label")).alias("canonical"))


def apply_clusters(facts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Facts with metric_cluster from the canonical name of their label."""
    c = assigned.select(F.col("key").alias("_k"), metric_key(F.col("canonical")).alias("_c"))
    return facts.join(c, F.col("metric_key") == F.col("_k"), "left").withColumn("metric_cluster", F.coalesce(F.nullif("_c", F.lit("")), "metric_cluster")).drop("_k", "_c")


def known_names(existing: DataFrame, assigned: DataFrame) -> DataFrame:
    """canonical: the names that the next batch may choose from, those before and those just given, each once."""
    return existing.select("canonical").union(assigned.select("canonical")).where("canonical <> ''").distinct()
