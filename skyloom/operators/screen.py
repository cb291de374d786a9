"""Screening and scoring of events by keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.relational import top_per_key
from skyloom.functions.dates import hours_since
from skyloom.functions.text import keyword_hits
from skyloom.lexicon import Rules


def strong(title: Column, body: Column, keywords: tuple[str, ...]) -> Column:
    """A keyword in the title, or two different ones in the body."""
    return (keyword_hits(title, keywords) >= 1) | (keyword_hits(body, keywords) >= 2)


def classify(title: Column, body: Column, rules: Rules = Rules()) -> tuple[Column, Column]:
    """(topic, severity): the first of each list with a strong signal, else 'other' and 1.0."""
    topic, severity = F.lit("other"), F.lit(1.0)
    for name, keywords in reversed(rules.topics):
        topic = F.when(strong(title, body, keywords), F.lit(name)).otherwise(topic)
    for value, keywords in reversed(rules.severities):
        severity = F.when(strong(title, body, keywords), F.lit(value)).otherwise(severity)
    return topic, severity


def screen(cards: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """cards (id, title, text) with relevant, topic, severity and reason."""
    title, body = F.coalesce("title", F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(1200))
    topic, severity = classify(title, body, rules)
    out = cards.withColumn("topic", topic).withColumn("severity", severity).withColumn("relevant", F.col("topic") != "other")
    return out.withColumn("reason", F.concat(F.lit("rule: topic="), "topic", F.lit(", severity="), F.col("severity").cast("string")))


def card_text(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, text): the leads of an event's two articles of the heaviest sources, and the titles of ten more.

    articles: event_id, position (in the event), source_id, title, content_text. sources: id, weight; others weigh 1.
    """
    weighed = articles.join(sources.select(F.col("id").alias("source_id"), "weight"), "source_id", "left")
    own = weighed.select("event_id", (-F.coalesce("weight", F.lit(1.0))).alias("w"), "position", "title", F.left(F.coalesce("content_text", F.lit("")), F.lit(400)).alias("lead"))
    row = F.struct("w", "position", "title", "lead")
    top = top_per_key(own, "event_id", 12, "w", "position", "title", "lead").groupBy("event_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    leads = F.array_join(F.transform(F.slice("r", 1, 2), lambda a: F.trim(F.concat(a["title"], F.lit(". "), a["lead"]))), " ")
    others = F.array_join(F.transform(F.slice("r", 3, 10), lambda a: a["title"]), " ; ")
    text = F.when(others == "", leads).otherwise(F.concat(leads, F.lit(" || 其他报道标题: "), others))
    return top.select("event_id", F.left(text, F.lit(1600)).alias("text"))


def hot_score(weight: Column, sources: Column, articles: Column, severity: Column, last_seen: Column, now: Column) -> Column:
    """Weight of the heaviest source, times breadth, volume, severity and recency; four decimals."""
    breadth, volume = 1.0 + 0.25 * (sources - 1), F.log1p(F.when(articles > 0, articles).otherwise(1).cast("double"))
    return F.round(weight * breadth * volume * F.greatest(severity, F.lit(0.1)) * F.exp(-hours_since(last_seen, now) / 48.0), 4)


def scored(events: DataFrame, screened: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """events with their screened topic and the higher severity, the hot score, and only those not screened out.

    A source that isn't in sources (enabled ones) weighs 1.
    """
    exploded = events.select("id", F.explode_outer("source_ids").alias("source_id"))
    weight = exploded.join(sources.select(F.col("id").alias("source_id"), "weight"), "source_id", "left").groupBy("id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("w"))
    r = screened.select("id", F.col("topic").alias("_topic"), F.col("severity").alias("_severity"), F.col("relevant").alias("_relevant"))
    joined = events.join(r, "id", "left").join(weight, "id", "left")
    out = joined.withColumn("category", F.coalesce("_topic", "category")).withColumn("severity", F.greatest("severity", F.coalesce("_severity", "severity")))
    out = out.withColumn("score", hot_score(F.coalesce("w", F.lit(1.0)), F.size(F.array_distinct("source_ids")), F.size("article_ids"), F.col("severity"), F.col("last_seen"), now))
    return out.where(F.coalesce("_relevant", F.lit(True))).drop("_topic", "_severity", "_relevant", "w")
