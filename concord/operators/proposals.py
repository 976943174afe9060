"""Proposed facts: validation, duplicates, and a heuristic that proposes without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.text import normalize_ws
from concord.functions.units import CURRENCIES


def rejection(metric: Column, value: Column, evidence: Column) -> Column:
    """Why a proposal is refused, first reason first; null if it passes."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(empty(metric), "missing_metric").when(empty(value), "missing_value").when(F.length(F.trim(F.coalesce(evidence, F.lit("")))) < 12, "evidence_too_short").when(F.length(metric) > 160, "metric_too_long")


def split_valid(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals that pass, and those for quarantine with their reason and payload (8000 characters at most)."""
    judged = proposals.withColumn("reason", rejection(F.col("metric"), F.col("value"), F.col("evidence")))
    bad = judged.where("reason IS NOT NULL").withColumn("payload", F.substring(F.to_json(F.struct(*proposals.columns)), 1, 8000))
    return judged.where("reason IS NULL").drop("reason"), bad.select("doc_id", "reason", "payload")


def drop_duplicates(facts: DataFrame) -> DataFrame:
    """The first of the facts that say the same on one page, in order of chunk and position."""
    key = ["doc_id", "subject_key", "metric_key", "value_raw", "period_canonical", "page"]
    order = Window.partitionBy(*key).orderBy("chunk_ordinal", "pos", "id")
    return facts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def heuristic_facts(chunks: DataFrame, limit: int = 12) -> DataFrame:
    """doc_id, ordinal, pos, page, metric, value, evidence, confidence from chunk text with [[page N]] marks: the first amount or percentage of a sentence and the words before it."""
    lines = chunks.select("doc_id", "ordinal", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    page = F.nullif(F.regexp_extract("line", r"^\[\[page (\d+)\]\]", 1), F.lit("")).cast("int")
    before = Window.partitionBy("doc_id", "ordinal").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("page", F.last(page, ignorenulls=True).over(before)).where(page.isNull())
    said = marked.select("doc_id", "ordinal", "ln", "page", F.posexplode(F.split("line", r"(?<=[.;])\s+(?=[A-Z(])")).alias("sn", "s")).withColumn("s", normalize_ws(F.col("s")))
    said = said.where(F.length("s").between(40, 400) & ~F.lower("s").rlike(r"^(table|figure|source|note|chart)\b"))
    signs = "|".join(r"\Q" + s + r"\E" for s, _ in sorted(CURRENCIES, key=lambda x: -len(x[0])))
    amount = rf"(?i)((?:{signs})\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:crore|lakh|million|billion|mn|bn|cr))?|\d[\d,]*(?:\.\d+)?\s*(?:%|per cent|percent))"
    said = said.withColumn("value", F.regexp_extract("s", amount, 1)).where("value <> ''")
    lead = F.trim(F.regexp_extract("s", rf"^(.*?){amount}", 1))
    w = F.filter(F.split(lead, r"\s+"), lambda x: x != "")
    last = F.slice(w, F.greatest(F.size(w) - 5, F.lit(1)), F.lit(6))
    name = F.array_join(F.when(F.lower(F.get(last, F.lit(0))).isin("and", "of", "the", "in", "to", "with", "at", "by", "for"), F.slice(last, 2, 6)).otherwise(last), " ")
    said = said.withColumn("metric", F.trim(name, F.lit(" ,.;:()"))).where((F.size(F.split("metric", " ")) >= 2) & (F.length("metric") >= 4))
    order = Window.partitionBy("doc_id", "ordinal").orderBy("ln", "sn")
    return said.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("doc_id", "ordinal", "pos", "page", "metric", "value", F.col("s").alias("evidence"), F.lit(0.35).alias("confidence"))
