"""Documents as pages and chunks: readers, digests, text-layer reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions.text import normalize_ws
from concord.thresholds import DEFAULTS


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """sha256, id, filename and content of binary files."""
    df = spark.read.format("binaryFile").load(path)
    digest = F.sha2("content", 256)
    return df.select(digest.alias("sha256"), F.concat(F.lit("doc_"), F.substring(digest, 1, 12)).alias("id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Recorded model answers: key, task, response, provider, model, created_at, usage."""
    schema = "key string, response string, created_at double, provider string, model string, task string, usage struct<input: long, output: long>"
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema).json(path)


def cache_key(version: Column, task: Column, system: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\0", version, task, system, prompt), 256)


def pages_of(documents: DataFrame, id_col: str, text_col: str, chars: int) -> DataFrame:
    """doc_id, page, text: whole texts cut into pages of lines, about ``chars`` characters each, for sources without pages."""
    lines = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("n", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("n")) - F.length("line") - 1
    paged = lines.withColumn("page", (F.floor(before / chars) + 1).cast("int"))
    return paged.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def chunk_pages(pages: DataFrame, pages_per_chunk: int = DEFAULTS.pages_per_chunk, char_budget: int = DEFAULTS.chunk_chars) -> DataFrame:
    """doc_id, ordinal, page_start, page_end, pages, text: pages packed in order until a chunk is full; blank chunks go after numbering."""
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("p"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<struct<page:int,chunk:int>>").alias("out"))

    def step(acc, x):
        full = (acc["count"] > 0) & ((acc["count"] >= pages_per_chunk) | (acc["chars"] + x["n"] > char_budget))
        chunk = F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(full, 1).otherwise(acc["count"] + 1).alias("count"), F.when(full, x["n"].cast("long")).otherwise(acc["chars"] + x["n"]).alias("chars"), F.concat(acc["out"], F.array(F.struct(x["page"].cast("int").alias("page"), chunk.alias("chunk")))).alias("out"))

    where = docs.select("doc_id", F.explode(F.aggregate("p", start, step, lambda a: a["out"])).alias("e")).select(F.col("doc_id").alias("_d"), F.col("e.page").alias("_p"), F.col("e.chunk").alias("ordinal"))
    rows = pages.join(where, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")))
    marked = F.concat(F.lit("[[page "), F.col("page"), F.lit("]]\n"), F.coalesce("text", F.lit("")))
    out = rows.groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("page", marked.alias("text"), F.trim(F.coalesce("text", F.lit(""))).alias("own")))).alias("p"))
    out = out.where(F.exists("p", lambda x: x["own"] != ""))
    return out.select("doc_id", "ordinal", F.array_min("p.page").alias("page_start"), F.array_max("p.page").alias("page_end"), F.col("p.page").alias("pages"), F.array_join("p.text", "\n").alias("text"))


def text_layer(pages: DataFrame, sample: int = 12, least: int = 40) -> DataFrame:
    """doc_id, chars_per_page, has_text, scanned from the first pages (doc_id, page, text, images)."""
    g = pages.where(F.col("page") <= sample).groupBy("doc_id").agg(F.avg(F.length(normalize_ws(F.coalesce("text", F.lit(""))))).alias("chars_per_page"), F.sum("images").alias("images"))
    return g.select("doc_id", F.round("chars_per_page", 1).alias("chars_per_page"), (F.col("chars_per_page") >= least).alias("has_text"), ((F.col("chars_per_page") < least) & (F.col("images") > 0)).alias("scanned"))


def title_guess(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, title: metadata title, else the two largest spans, else the file stem."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("size"), "pos")
    top = spans.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ").alias("large"))
    meta = F.when((F.length(F.trim("meta_title")) > 4) & ~F.lower("meta_title").contains("untitled"), F.trim("meta_title"))
    return documents.join(top, "doc_id", "left").select("doc_id", F.coalesce(meta, F.nullif(F.trim("large"), F.lit("")), F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"))
