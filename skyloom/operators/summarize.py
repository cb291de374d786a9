"""Brief items by rule: leads of the heaviest articles, their first sentences as quotes, their ids as citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import sentences
from skyloom.lexicon import IMPACT_OTHER, IMPACTS


def valid_citations(citations, article_ids):
    """The citations among the articles, in order; if there are none, the first article."""
    known = F.filter(citations, lambda c: F.array_contains(article_ids, c))
    return F.when(F.size(known) > 0, known).otherwise(F.slice(article_ids, 1, 1))


def summarize(events: DataFrame, articles: DataFrame) -> DataFrame:
    """One item per event: headline, summary, impact, key_quotes, citation_ids, topic, severity, score, source_count, mode.

    events: id, title, category, severity, score. articles: event_id, position, id, source_id, title, text, weight.
    """
    row = F.struct((-F.coalesce("weight", F.lit(1.0))).alias("w"), "position", "id", "title", "text")
    grouped = articles.groupBy("event_id").agg(
        F.array_sort(F.collect_list(row)).alias("r"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("ids"),
        F.count_distinct("source_id").alias("source_count"),
    )
    lead = lambda a: sentences(F.when(F.coalesce(a["text"], F.lit("")) != "", a["text"]).otherwise(a["title"]), 2)
    leads = F.filter(F.transform(F.slice(F.col("r"), 1, 2), lead), lambda s: F.size(s) > 0)
    joined = events.alias("e").join(grouped, F.col("e.id") == F.col("event_id"), "left")
    joined = joined.withColumn("leads", F.coalesce(leads, F.array().cast("array<array<string>>"))).withColumn("headline", F.left(F.coalesce(F.col("r")[0]["title"], "e.title", F.lit("")), F.lit(80)))
    summary = F.array_join(F.transform("leads", lambda s: F.array_join(s, " ")), "\n")
    impact = F.lit(IMPACT_OTHER)
    for least, words in reversed(IMPACTS):
        impact = F.when(F.col("severity") >= least, F.lit(words)).otherwise(impact)
    citations = F.transform(F.slice(F.col("r"), 1, 4), lambda a: a["id"])
    nothing = F.col("ids").isNull()
    return joined.select(
        F.col("e.id").alias("event_id"),
        "headline",
        F.when(nothing, "").when(summary != "", summary).otherwise(F.col("headline")).alias("summary"),
        F.when(nothing, "").otherwise(impact).alias("impact"),
        F.slice(F.transform("leads", lambda s: s[0]), 1, 3).alias("key_quotes"),
        F.coalesce(valid_citations(citations, F.col("ids")), F.array().cast("array<bigint>")).alias("citation_ids"),
        F.coalesce("e.category", F.lit("other")).alias("topic"),
        "severity",
        "score",
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        F.lit("rule").alias("mode"),
    )
