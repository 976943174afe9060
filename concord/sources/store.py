"""A store of Parquet tables: facts, relations, quarantine; upserts and cascades as rewrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.linking import FACT_SCHEMA, append_new


class Store:
    """Tables below ``root``. A rewrite goes to a new folder and its name is then recorded, so a failed job leaves the old table."""

    SCHEMAS = {
        "documents": "id string, sha256 string, filename string, title string, primary_entity string, status string",
        "facts": FACT_SCHEMA,
        "relations": "id string, fact_a string, fact_b string, kind string, score double, dimension string, method string, rationale string, cross_doc boolean, similarity double, overturned boolean, observation string",
        "quarantine": "id string, doc_id string, reason string, payload string, created_at timestamp",
        "linked": "id string",
        "events": "doc_id string, stage string, message string",
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_names/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema("n long, folder string").parquet(path.toString()) if fs.exists(path) else None

    def read(self, name: str) -> DataFrame:
        v = self._versions(name)
        last = v.orderBy(F.desc("n")).first() if v is not None else None
        if last is None:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.root}/{last['folder']}")

    def _record(self, name: str, folder: str) -> None:
        v = self._versions(name)
        n = (v.agg(F.max("n")).first()[0] or 0) + 1 if v is not None else 1
        self.spark.createDataFrame([(n, folder)], "n long, folder string").write.mode("append").parquet(f"{self.root}/_names/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.select(*self.spark.createDataFrame([], self.SCHEMAS[name]).columns).write.parquet(f"{self.root}/{folder}")
        self._record(name, folder)

    def append(self, name: str, df: DataFrame) -> None:
        v = self._versions(name)
        if v is None:
            return self.replace(name, df)
        folder = v.orderBy(F.desc("n")).first()["folder"]
        df.select(*self.read(name).columns).write.mode("append").parquet(f"{self.root}/{folder}")

    def upsert_facts(self, new: DataFrame) -> None:
        """Insert or replace by id."""
        self.replace("facts", self.read("facts").join(new.select("id"), "id", "left_anti").unionByName(new.select(*self.read("facts").columns)))

    def insert_facts(self, new: DataFrame) -> None:
        """Insert or ignore by id; stored files stay as they are."""
        self.append("facts", new.dropDuplicates(["id"]).join(self.read("facts").select("id"), "id", "left_anti"))

    def insert_relations(self, new: DataFrame) -> None:
        """Insert or ignore by pair; what was observed is kept as JSON."""
        if "overturned" not in new.columns:
            new = new.withColumn("overturned", F.lit(False))
        if dict(new.dtypes).get("observation", "string") != "string":
            new = new.withColumn("observation", F.to_json("observation"))
        elif "observation" not in new.columns:
            new = new.withColumn("observation", F.lit(None).cast("string"))
        self.append("relations", append_new(self.read("relations"), new))

    def refuse(self, bad: DataFrame) -> None:
        """Quarantine refused proposals (doc_id, reason, payload), each once."""
        row = F.concat(F.lit("q_"), F.substring(F.sha2(F.concat_ws("\x1f", "doc_id", "reason", "payload"), 256), 1, 12))
        known = self.read("quarantine").select("id")
        self.append("quarantine", bad.withColumns({"id": row, "created_at": F.current_timestamp()}).dropDuplicates(["id"]).join(known, "id", "left_anti"))

    def unlinked(self) -> DataFrame:
        """Stored facts that no finished link has taken as probes."""
        return self.read("facts").join(self.read("linked"), "id", "left_anti")

    def new_files(self, files: DataFrame) -> DataFrame:
        """Files (sha256, ...) of which no document is stored as ready."""
        return files.join(self.read("documents").where("status = 'ready'").select("sha256"), "sha256", "left_anti")

    def delete_document(self, doc_id: str) -> None:
        """A document with its facts and their relations; quarantine and events stay."""
        facts = self.read("facts")
        gone = facts.where(F.col("doc_id") == doc_id).select("id")
        r = self.read("relations")
        for side in ("fact_a", "fact_b"):
            r = r.join(gone, F.col(side) == gone["id"], "left_anti")
        self.replace("relations", r)
        self.replace("linked", self.read("linked").join(gone, "id", "left_anti"))
        self.replace("facts", facts.where(F.col("doc_id") != doc_id))
        self.replace("documents", self.read("documents").where(F.col("id") != doc_id))
