"""Verification of brief items: every quote must stand in a cited article, every citation must exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import normalize_texts, snapshot_text, span_in

CITATION = "struct<article_id:bigint,span:string,url:string,verified:boolean>"


def snapshots(articles: DataFrame, text: str = "text") -> DataFrame:
    """(article_id, url, title, snapshot): each article normalized once."""
    return articles.select(F.col("id").alias("article_id"), "url", "title", snapshot_text(F.col("title"), F.col(text)).alias("snapshot"))


def review(items: DataFrame, articles: DataFrame, text: str = "text") -> DataFrame:
    """items with unknown citations and unfounded quotes removed, and quote_citations, issues, confidence and counts.

    items: item_id (unique), summary, key_quotes, citation_ids. A quote is bound to the first cited article, in order of
    citation, that contains it. Issues: citation_unknown, citation_missing, quote_span_missing (one per quote),
    summary_empty. Any issue makes the confidence low.
    """
    empty = F.array().cast("array<bigint>")
    asked = items.withColumn("_spans", normalize_texts("key_quotes")).select("item_id", "_spans", F.posexplode("citation_ids").alias("cpos", "article_id"))
    # only cited articles are normalized, and their texts travel once, to the spans that are looked up in them
    cited = articles.join(asked.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    found = asked.join(snapshots(cited, text).select("article_id", "snapshot"), "article_id", "left")
    place = F.struct("cpos", "article_id", F.col("snapshot").isNotNull().alias("known"), F.transform("_spans", lambda s: span_in(s, F.col("snapshot"))).alias("hits"))
    per_item = found.groupBy("item_id").agg(F.array_sort(F.collect_list(place)).alias("c"))
    joined = items.join(per_item, "item_id", "left")
    joined = joined.withColumn("known", F.coalesce(F.transform(F.filter("c", lambda x: x["known"]), lambda x: x["article_id"]), empty))
    joined = joined.withColumn("n_unknown", F.size(F.coalesce("citation_ids", empty)) - F.size("known"))
    first = lambda i: F.get(F.transform(F.filter("c", lambda x: F.get(x["hits"], i)), lambda x: x["article_id"]), F.lit(0))
    bound = F.transform(F.coalesce("key_quotes", F.array().cast("array<string>")), lambda q, i: F.struct(i.alias("qpos"), q.alias("quote"), first(i).alias("article_id")))
    joined = joined.withColumn("kept", F.filter(bound, lambda x: x["article_id"].isNotNull()))
    missing = F.size(F.coalesce("key_quotes", F.array().cast("array<string>"))) - F.size("kept")
    issues = F.concat(
        F.when(F.coalesce("n_unknown", F.lit(0)) > 0, F.array(F.lit("citation_unknown"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("known") == 0, F.array(F.lit("citation_missing"))).otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit("quote_span_missing"), missing),
        F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", F.array(F.lit("summary_empty"))).otherwise(F.array().cast("array<string>")),
    )
    out = joined.withColumn("issues", issues).withColumn("quotes_total", F.size(F.coalesce("key_quotes", F.array().cast("array<string>")))).withColumn("citations_stripped", F.coalesce("n_unknown", F.lit(0)))
    return out.withColumns(
        {
            "citation_ids": F.col("known"),
            "key_quotes": F.transform("kept", lambda x: x["quote"]),
            "quote_citations": F.transform("kept", lambda x: x["article_id"]),
            "confidence": F.when(F.size("issues") > 0, "low").otherwise("high"),
        }
    ).drop("known", "n_unknown", "c", "kept")


def report(reviewed: DataFrame) -> DataFrame:
    """One row: items, quotes_total, quotes_kept, quotes_stripped, citations_stripped, low_confidence."""
    kept = F.coalesce(F.sum(F.size("key_quotes")), F.lit(0))
    total = F.coalesce(F.sum("quotes_total"), F.lit(0))
    return reviewed.agg(
        F.count("*").alias("items"),
        total.alias("quotes_total"),
        kept.alias("quotes_kept"),
        (total - kept).alias("quotes_stripped"),
        F.coalesce(F.sum("citations_stripped"), F.lit(0)).alias("citations_stripped"),
        F.count_if(F.col("confidence") == "low").alias("low_confidence"),
    )


def citations(reviewed: DataFrame, articles: DataFrame) -> DataFrame:
    """(item_id, event_id, pos, article_id, span, url, verified): the quotes first, then each other citation by its title."""
    quoted = F.transform(F.arrays_zip("quote_citations", "key_quotes"), lambda x: F.struct(x["quote_citations"].alias("article_id"), x["key_quotes"].alias("span")))
    others = F.transform(F.array_except("citation_ids", "quote_citations"), lambda c: F.struct(c.alias("article_id"), F.lit(None).cast("string").alias("span")))
    rows = reviewed.select("item_id", "event_id", F.posexplode(F.concat(quoted, others)).alias("pos", "c")).select("item_id", "event_id", "pos", "c.*")
    known = articles.select(F.col("id").alias("article_id"), "title", "url")
    span = F.coalesce("span", F.coalesce("title", F.lit("")))
    return rows.join(known, "article_id").select("item_id", "event_id", "pos", "article_id", span.alias("span"), F.coalesce("url", F.lit("")).alias("url"), (span != "").alias("verified"))
