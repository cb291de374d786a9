"""The store: Parquet tables that only grow, and views of their current state.

What a database would update is appended here, and the latest row of a key counts: sources and their health, the status
of relations (their last confirmation or rejection), runs (their last state). One writer at a time gives out ids.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import relational
from skyloom.schemas import FEEDBACK_KINDS, RATINGS, TABLES
from skyloom.session import cut


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table's rows; none where nothing was written yet."""
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])
        out.write.mode("append").parquet(f"{self.root}/{name}")

    def next_id(self, name: str, column: str = "id") -> int:
        return int(self.table(name).agg(F.max(column)).first()[0] or 0) + 1

    def add(self, name: str, values: dict) -> int:
        """One row with the next id."""
        row = {"id": self.next_id(name)} | values
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        self.append(name, self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema))
        return row["id"]

    # --- sources ---

    def upsert_sources(self, sources: DataFrame, at: dt.datetime) -> None:
        """Every column of a known source is replaced, but not its health. What was is kept; the latest version counts."""
        new = sources.join(self.table("source_health"), F.col("id") == F.col("source_id"), "left_anti")
        self.append("source_health", new.select(F.col("id").alias("source_id"), F.lit('{"ok": true}').alias("health"), F.lit(at).alias("checked_at")))
        self.append("sources", sources.withColumn("version", F.lit(self.next_id("sources", "version"))))

    def update_health(self, health: DataFrame, at: dt.datetime) -> None:
        self.append("source_health", health.withColumn("checked_at", F.lit(at)))

    def sources(self) -> DataFrame:
        columns = [c for c in self.table("sources").columns if c not in ("id", "version")]
        latest = self.table("sources").groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("s")).select("id", "s.*")
        last = self.table("source_health").groupBy("source_id").agg(F.max_by("health", "checked_at").alias("health"))
        return latest.join(last, F.col("id") == F.col("source_id"), "left").drop("source_id")

    # --- articles and events ---

    def insert_articles(self, articles: DataFrame, *order: str) -> DataFrame:
        """Stores the articles whose URL isn't stored yet, numbered in the order given; returns those with their ids."""
        new = relational.insert_if_absent(articles, self.table("articles"), "url_hash")
        start = self.next_id("articles")
        self.append("articles", relational.numbered(new.drop("id"), start, *order))
        return self.table("articles").where(F.col("id") >= start)

    def articles_since(self, now: dt.datetime, hours: int) -> DataFrame:
        """The articles of the last hours and the day before these, by time."""
        cutoff = now - dt.timedelta(hours=hours + 24)
        return self.table("articles").where(F.col("published_at") >= F.lit(cutoff)).orderBy("published_at", "id")

    def save_events(self, events: DataFrame, *order: str | Column) -> DataFrame:
        """Stores events with their articles; returns (cluster_id, event_id)."""
        placed = cut(relational.numbered(events.withColumnRenamed("id", "cluster_id"), self.next_id("events"), *order))
        counts = placed.withColumn("article_count", F.size("article_ids")).withColumn("source_count", F.size(F.array_distinct("source_ids"))).withColumn("status", F.lit("open"))
        self.append("events", counts)
        self.append("event_articles", placed.select(F.col("id").alias("event_id"), F.explode("article_ids").alias("article_id"), F.lit("origin").alias("relation")).dropDuplicates(["event_id", "article_id"]))
        return placed.select("cluster_id", F.col("id").alias("event_id"))

    # --- relations and feedback ---

    def save_relations(self, relations: DataFrame, at: dt.datetime) -> int:
        rows = cut(relational.numbered(relations, self.next_id("event_relations"), "target_event_id", "rank").withColumn("created_at", F.lit(at)))
        self.append("event_relations", rows)
        return rows.count()

    def set_relation_status(self, relation_id: int, status: str, at: dt.datetime) -> bool:
        """Whether there is such a relation; its status is this one from now on."""
        known = not self.table("event_relations").where(F.col("id") == relation_id).isEmpty()
        if known:
            self.add("relation_status", {"relation_id": relation_id, "status": status, "set_at": at})
        return known

    def relations(self) -> DataFrame:
        last = self.table("relation_status").groupBy("relation_id").agg(F.max_by("status", "id").alias("_status"))
        told = self.table("event_relations").join(last, F.col("id") == F.col("relation_id"), "left")
        return told.withColumn("status", F.coalesce("_status", "status")).drop("relation_id", "_status")

    def save_feedback(self, kind: str, target_id: int, rating: str, at: dt.datetime, note: str = "", ref: str = "") -> tuple[int, bool]:
        """(the feedback's id, whether a relation's status follows from it)."""
        if kind not in FEEDBACK_KINDS or rating not in RATINGS:
            raise ValueError(f"kinds are {FEEDBACK_KINDS}, ratings {RATINGS}")
        new = self.add("feedback", {"kind": kind, "target_id": target_id, "ref": ref, "rating": rating, "note": note, "created_at": at})
        status = relational.VERDICTS.get(rating) if kind == "event_relation" else None
        return new, status is not None and self.set_relation_status(target_id, status, at)

    def feedback(self, kind: str | None = None, limit: int = 50) -> DataFrame:
        rows = self.table("feedback")
        return (rows.where(F.col("kind") == kind) if kind else rows).orderBy(F.desc("id")).limit(limit)

    # --- briefs, citations, runs ---

    def save_brief(self, date: str, kind: str, title: str, body: str, at: dt.datetime) -> int:
        return self.add("briefs", {"date": date, "kind": kind, "title": title, "body_md": body, "published_at": at})

    def save_citations(self, brief_id: int, citations: DataFrame, at: dt.datetime) -> int:
        rows = cut(relational.numbered(citations, self.next_id("citations"), "item_id", "pos").withColumn("brief_id", F.lit(brief_id)).withColumn("created_at", F.lit(at)))
        self.append("citations", rows)
        return rows.count()

    def start_run(self, kind: str, trigger: str, at: dt.datetime) -> int:
        return self.add("runs", {"kind": kind, "trigger": trigger, "status": "running", "created_at": at, "checkpoint": "{}"})

    def finish_run(self, run_id: int, status: str, checkpoint: dict, at: dt.datetime) -> None:
        row = self.table("runs").where(F.col("id") == run_id).first()
        self.append("runs", self.spark.createDataFrame([(run_id, row["kind"], row["trigger"], status, at, json.dumps(checkpoint, ensure_ascii=False))], TABLES["runs"]))

    def runs(self) -> DataFrame:
        columns = [c for c in self.table("runs").columns if c != "id"]
        last = self.table("runs").groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("created_at", F.col("status") != "running")).alias("r"))
        return last.select("id", "r.*")

    def record_steps(self, run_id: int, steps: list[tuple[str, str, str, str]], at: dt.datetime) -> None:
        """Steps as (agent, input digest, output, error)."""
        if steps:
            self.append("steps", self.spark.createDataFrame([(run_id, *s, at, at) for s in steps], TABLES["steps"]))

    def stats(self) -> DataFrame:
        """(name, n): how many rows the main tables have."""
        out = None
        for name in ("sources", "articles", "events", "briefs", "citations", "event_relations", "feedback", "runs"):
            rows = {"runs": self.runs, "sources": self.sources}.get(name, lambda name=name: self.table(name))()
            one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionAll(one)
        return out
