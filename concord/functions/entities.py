"""Names of entities: keys, references back to the document's subject, the subject itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that the rules name.
LEGAL = "limited ltd private pvt inc incorporated corp corporation company co plc llp llc group holdings sa nv ag gmbh".split()
ARTICLES = "the our its their".split()
ANAPHORIC = [
    "the company", "our company", "the group", "our group", "the bank", "the issuer", "the corporation", "the organisation", "the organization", "we", "us",
    "the firm", "company", "group", "the entity", "the parent", "the reserve bank", "the fund", "the staff", "staff",
]


def _plain(name: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s&]", " "), r"(?U)\s+", " "))


def normalize_entity(name: Column) -> Column:
    """A stable key: lower case, no punctuation, articles and legal suffixes; a name of suffixes alone stays."""
    clean = _plain(name)
    front = F.regexp_replace(clean, rf"^(?:(?:{'|'.join(ARTICLES)})(?: |$))+", "")
    core = F.regexp_replace(front, rf"(?:(?:^| )(?:{'|'.join(LEGAL)}))+$", "")
    return F.when(core == "", clean).otherwise(core)


def is_anaphoric(name: Column) -> Column:
    """Whether a name refers back to the document's subject, however it is punctuated; none does too."""
    return (F.trim(F.coalesce(name, F.lit(""))) == "") | _plain(name).isin(ANAPHORIC)


def resolve_subject(raw: Column, primary: Column) -> Column:
    """The subject meant: the document's own for a reference back, else the name as written."""
    own = F.nullif(F.trim(raw), F.lit(""))
    return F.when((F.coalesce(primary, F.lit("")) != "") & is_anaphoric(raw), primary).otherwise(F.coalesce(own, primary, F.lit("unknown")))


def entities_match(a: Column, b: Column) -> Column:
    return (a == b) & (a != "")


def primary_entity(subjects: DataFrame, fronts: DataFrame | None = None) -> DataFrame:
    """doc_id, primary_entity from (doc_id, pos, subject) and optional (doc_id, front): the name that is used most, stands in front and looks like one."""
    rows = subjects.where(~is_anaphoric(F.col("subject"))).withColumn("key", normalize_entity(F.col("subject"))).where(F.length("key") >= 3)
    by = rows.groupBy("doc_id", "key").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.max_by("subject", F.struct(F.length("subject"), -F.col("pos"))).alias("display"),
        F.max(F.exists(F.split(F.lower("subject"), r"(?U)[^\w&]+"), lambda w: w.isin(LEGAL))).alias("legal"),
    )
    by = by.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    if fronts is not None:
        by = by.join(fronts.select(F.col("doc_id").alias("_d"), F.lower("front").alias("front")), F.col("doc_id") == F.col("_d"), "left")
    else:
        by = by.withColumn("front", F.lit(None).cast("string"))
    score = F.sqrt(F.col("n") / F.col("total")) + F.when(F.contains("front", "key"), 1.5).otherwise(0.0) + F.when(F.col("legal"), 0.4).otherwise(0.0)
    score = score + 0.02 * F.least(F.size(F.split("key", " ")), F.lit(4))
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "first")
    ranked = by.withColumn("score", score).withColumn("r", F.row_number().over(best)).where("r = 1")
    return ranked.select("doc_id", F.col("display").alias("primary_entity"), "key", F.round("score", 6).alias("score"))
