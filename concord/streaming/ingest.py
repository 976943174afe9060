"""Incremental linking: micro-batches of written facts into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import periods, text
from concord.operators import linking, proposals
from concord.sources.store import Store

RAW_SCHEMA = "id string, doc_id string, subject_raw string, metric_raw string, value_raw string, unit_hint string, period_text string, qualifiers map<string,string>, evidence_text string, page int, match_ratio double, grounded boolean, confidence double"


def ingest_batch(store: Store, raw: DataFrame) -> None:
    """Normalise a batch, store what is new by id, and link what isn't marked as linked to everything stored.

    Facts are stored first, then their relations, then the marks; each step ignores what it
    finds, so a batch that failed between any two of them is made whole when it is repeated.
    """
    store.insert_facts(linking.normalize_facts(raw.dropDuplicates(["id"])))
    open_ = store.unlinked()
    if not open_.isEmpty():
        store.insert_relations(linking.relations(linking.link(store.read("facts"), open_)))
        store.append("linked", open_.select("id"))


def ingest_proposals(store: Store, proposed: DataFrame, primary: DataFrame | None = None, start_months: DataFrame | None = None) -> None:
    """Proposals (doc_id, chunk_ordinal, pos, subject, metric, value, unit_hint, evidence, qualifiers, page, match_ratio, grounded, confidence) to facts and relations; refused ones go to quarantine.

    Qualifiers are cleaned, the period is the first that a qualifier or the evidence names, and
    of proposals that say the same on one page the first stays.
    """
    good, bad = proposals.split_valid(proposed)
    store.refuse(bad)
    q = text.clean_qualifiers(F.col("qualifiers"))
    good = good.withColumn("qualifiers", q)
    good = good.withColumn("_named", periods.pick_period(F.col("qualifiers"), F.col("evidence")))
    named = F.col("_named")
    raw = good.select(
        text.content_id("fact", *[F.col(c) for c in ("doc_id", "chunk_ordinal", "pos", "metric", "value")]).alias("id"), "doc_id", F.col("subject").alias("subject_raw"), F.col("metric").alias("metric_raw"), F.col("value").alias("value_raw"),
        "unit_hint", F.when(named["kind"] != "UNKNOWN", named["label"]).otherwise("").alias("period_text"), "qualifiers", F.col("evidence").alias("evidence_text"), "page", "match_ratio", "grounded", "confidence",
    )
    order = good.select(text.content_id("fact", *[F.col(c) for c in ("doc_id", "chunk_ordinal", "pos", "metric", "value")]).alias("id"), "chunk_ordinal", "pos").dropDuplicates(["id"])
    facts = linking.normalize_facts(raw.dropDuplicates(["id"]), primary, start_months).join(order, "id")
    store.insert_facts(proposals.drop_duplicates(facts).drop("chunk_ordinal", "pos"))
    open_ = store.unlinked()
    if not open_.isEmpty():
        store.insert_relations(linking.relations(linking.link(store.read("facts"), open_)))
        store.append("linked", open_.select("id"))


def relink(store: Store) -> None:
    """Link all stored facts anew; earlier relations go."""
    facts = store.read("facts")
    store.replace("relations", store.read("relations").where("false"))
    store.insert_relations(linking.relations(linking.link(facts)))
    store.replace("linked", facts.select("id"))


def renormalize(store: Store, raw: DataFrame, primary: DataFrame | None = None, start_months: DataFrame | None = None) -> None:
    """Work out all facts again from the written ones and link them anew."""
    store.upsert_facts(linking.normalize_facts(raw.dropDuplicates(["id"]), primary, start_months))
    relink(store)


def stream(spark: SparkSession, source: str, store: Store, checkpoint: str):
    """A stream over JSON files of written facts in ``source``; each micro-batch is ingested once or, after a failure, again."""
    rows = spark.readStream.schema(RAW_SCHEMA).json(source)
    return rows.writeStream.foreachBatch(lambda df, _: ingest_batch(store, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
