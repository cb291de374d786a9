"""Fetching as a stream: files of feed documents are parsed, deduplicated and stored, micro-batch by micro-batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skyloom.plans.daily import arrivals, ingest
from skyloom.plans.store import Store
from skyloom.sources import feeds


def payload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stored feed documents (Parquet: source_id, payload) as a stream."""
    return spark.readStream.schema("source_id string, payload binary").parquet(folder)


def ingest_stream(payloads: DataFrame, store: Store, checkpoint: str, clock=lambda: dt.datetime.now(dt.timezone.utc)) -> StreamingQuery:
    """Stores the articles of all documents that are there, and ends; run it daily. Articles stored before are skipped, so
    a micro-batch that is run again adds nothing."""

    def batch(raw: DataFrame, _: int) -> None:
        now = clock()
        ingest(store, arrivals(feeds.to_articles(feeds.parse_payloads(raw), now)))

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
