"""Deduplication of a stream of articles: by URL within the watermark, then by title within a language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyloom.operators.dedup import THRESHOLD, similarity

STATE = "titles array<string>, times array<bigint>"


def dedup_stream(articles: DataFrame, horizon: str = "72 hours", threshold: float = THRESHOLD) -> DataFrame:
    """The articles kept, in the columns url_hash, lang, title, published_at and source_id.

    articles: a stream with these. An URL counts once within the horizon; a title is dropped if one of its language that
    was kept within the horizon (by event time) is alike. In a micro-batch articles are taken in order of time and URL.
    """
    span = int(pd.Timedelta(horizon).total_seconds() * 1000)
    unique = articles.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["url_hash"])
    out = "url_hash string, lang string, title string, published_at timestamp, source_id string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        titles, times = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.sort_values(["published_at", "url_hash"], kind="stable")
        keep = []
        for i, title, at in zip(rows.index, rows["title"], rows["published_at"]):
            low, now = (title or "").lower(), int(pd.Timestamp(at).timestamp() * 1000)
            if not any(abs(now - t) <= span and similarity(old, low) >= threshold for old, t in zip(titles, times)):
                keep.append(i)
                titles.append(low)
                times.append(now)
        last = max(times, default=0)
        live = [(a, t) for a, t in zip(titles, times) if last - t <= span]
        state.update(([a for a, _ in live], [t for _, t in live]))
        yield rows.loc[keep, ["url_hash", "lang", "title", "published_at", "source_id"]]

    return unique.withColumn("lang", F.coalesce("lang", F.lit(""))).groupBy("lang").applyInPandasWithState(fold, out, STATE, "append", GroupStateTimeout.NoTimeout)
