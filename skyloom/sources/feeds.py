"""Feeds: RSS 2.0, Atom and RDF documents as rows, and articles of them.

Fetching happens on executors, one source a row; a source that fails becomes a row with its error and doesn't disturb
the others.
"""

from __future__ import annotations

import time
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.dates import parse_date
from skyloom.functions.text import detect_lang, extract_entities, strip_html
from skyloom.functions.url import url_hash
from skyloom.schemas import FEED_ITEM

_FIELD = {"link": "link", "title": "title", "description": "desc", "summary": "desc", "content": "desc", "encoded": "desc", "pubdate": "date", "date": "date", "published": "date", "updated": "date"}


def _name(element: ET.Element) -> str:
    return str(element.tag).rpartition("}")[2].lower()


def parse_feed(payload: bytes) -> list[dict[str, str]]:
    """link, title, desc and date of every item or entry, wherever it stands and whatever the namespaces.

    The last title counts, but the first of everything else; a link is its href or else its text. Items without a link
    or title are left out.
    """
    found = []
    for item in ET.fromstring(payload).iter():
        if _name(item) not in ("item", "entry"):
            continue
        record: dict[str, str] = {}
        for child in item:
            field = _FIELD.get(_name(child))
            if field is None or field != "title" and field in record:
                continue
            value = child.text or ""
            if field == "link":
                value = child.get("href") or value
            record[field] = value.strip()
        if record.get("link") and record.get("title"):
            found.append(record)
    return found


def fetch(url: str, timeout: float = 20, retries: int = 2, pause: Callable[[float], None] = time.sleep) -> bytes:
    """The resource, tried up to 1 + retries times with growing pauses."""
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": "skyloom", "Accept": "application/rss+xml, application/xml, text/xml, */*"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read()
        except Exception as e:  # any failure counts
            if attempt == retries:
                raise RuntimeError(f"not fetched in {retries + 1} attempts: {url} ({e})") from e
            pause(1.5 * (attempt + 1))
    raise AssertionError


def collect(sources: DataFrame, fetch_fn: Callable[[str], bytes] = fetch, error_chars: int = 300) -> DataFrame:
    """The feed items of all sources (id, url), with `error` where a source failed (its only row then)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(source, i, r["link"], r["title"], r.get("desc"), r.get("date"), None) for i, r in enumerate(parse_feed(fetch_fn(url)))]
                except Exception as e:  # one source's failure is its own
                    rows.append((source, 0, None, None, None, None, str(e)[:error_chars]))
            kinds = (pa.string(), pa.int32(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["source_id", "item", "link", "title", "desc", "date", "error"])

    return sources.select("id", "url").mapInArrow(of, FEED_ITEM)


def parse_payloads(raw: DataFrame) -> DataFrame:
    """Feed items of stored documents: raw has source_id and payload (binary)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(source, i, r["link"], r["title"], r.get("desc"), r.get("date"), None) for i, r in enumerate(parse_feed(payload))]
                except Exception as e:
                    rows.append((source, 0, None, None, None, None, str(e)[:300]))
            kinds = (pa.string(), pa.int32(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["source_id", "item", "link", "title", "desc", "date", "error"])

    return raw.select("source_id", "payload").mapInArrow(of, FEED_ITEM)


def to_articles(items: DataFrame, batch_time) -> DataFrame:
    """Articles of feed items: plain title and text, language and entities of both, canonical URL hash, date."""
    good = items.where("error is null").withColumn("title", strip_html(F.col("title"))).withColumn("desc", strip_html(F.col("desc")))
    both = F.when(F.col("desc") != "", F.concat("title", F.lit(". "), "desc")).otherwise(F.col("title"))
    return good.select(
        "source_id",
        "item",
        F.col("link").alias("url"),
        url_hash(F.col("link")).alias("url_hash"),
        "title",
        F.when(F.col("desc") != "", F.col("desc")).otherwise(F.col("title")).alias("content_text"),
        detect_lang(both).alias("lang"),
        parse_date(F.col("date"), batch_time).alias("published_at"),
        F.lit(batch_time).cast("timestamp").alias("fetched_at"),
        extract_entities(both, 12).alias("entities"),
        F.lit("").alias("topic"),
    )


def health(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, health): ok and the number of items, or the error, as JSON."""
    per = items.groupBy("source_id").agg(F.count_if(F.col("error").isNull()).alias("items"), F.first("error", ignorenulls=True).alias("error"))
    joined = sources.select(F.col("id").alias("source_id")).join(per, "source_id", "left")
    ok = F.to_json(F.struct(F.lit(True).alias("ok"), F.coalesce("items", F.lit(0)).alias("items")))
    return joined.select("source_id", F.when(F.col("error").isNull(), ok).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), F.left("error", F.lit(200)).alias("error")))).alias("health"))
