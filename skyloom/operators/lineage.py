"""Lineage: which earlier events may stand behind an event, and with what evidence.

Recall is a similarity join with a time band. A pair counts only if the two events share an entity or a title token or
have the same category, so candidates are the distinct union of three equi-joins; no pair is missed, and history isn't
crossed with the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.dates import days_between
from skyloom.session import cut
from skyloom.functions.text import jaccard, sentences, span_in, normalize_text, snapshot_text, token_set

NEAR_DUPLICATE = 0.60
LEAST_LEXICAL, LEAST_RELEVANCE = 0.15, 0.15
WEIGHTS = {"entity": 0.45, "lexical": 0.25, "time": 0.15, "topic": 0.15}
RELATION_TYPES = ("causal", "escalation", "de_escalation", "response", "background", "same_actor", "thematic_parallel")
DIRECTED = ("causal", "escalation")
AUTO = 0.7
NAMED, BROADCAST_PAST = 2_000, 10_000
"""Up to so many ids are named in the plan; up to so many earlier events (ids, entities and title tokens of each) are broadcast."""


def history(events: DataFrame, event_articles: DataFrame, articles: DataFrame, now: Column, days: int = 180, exclude: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """The newest events of the last `days`, each with its first eight articles and their entities.

    events: id, title, category, severity, first_seen, last_seen, ...; exclude: (id).
    """
    recent = events.where(F.unix_micros("first_seen") >= F.unix_micros(now) - int(days * 86400e6))
    if exclude is not None:
        recent = recent.join(exclude.select("id"), "id", "left_anti")
    recent = recent.orderBy(F.desc("first_seen"), F.desc("id")).limit(limit)
    w = Window.partitionBy("event_id").orderBy("article_id")
    bridge = event_articles.join(recent.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    first = bridge.join(articles.withColumnRenamed("id", "article_id"), "article_id").withColumn("_n", F.row_number().over(w)).where("_n <= 8")
    row = F.struct(F.col("article_id").alias("id"), "title", "url", "source_id", F.coalesce("content_text", F.lit("")).alias("text"))
    grouped = first.groupBy("event_id").agg(
        F.array_sort(F.collect_list(row)).alias("articles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("entities", F.array().cast("array<string>")))))).alias("entities"),
    )
    return recent.join(grouped, recent["id"] == grouped["event_id"], "left").drop("event_id").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def recall(targets: DataFrame, past: DataFrame, top_k: int = 6, window_days: int = 180, tokens=token_set) -> DataFrame:
    """(target_id, prior_id, rel, score, shared_entities, rank): the top_k relevant earlier events of each target.

    targets and past: id, title, category, first_seen (timestamp), entities. Later by a day at most, window_days apart at
    most, and not the same story (title similarity below NEAR_DUPLICATE). Ties go to the newer event.
    """

    def prepared(df: DataFrame, prefix: str) -> DataFrame:
        e = F.array_distinct(F.coalesce("entities", F.array().cast("array<string>")))
        return df.select(*(c.alias(f"{prefix}_{n}") for n, c in {"id": F.col("id"), "at": F.col("first_seen"), "category": F.col("category"), "entities": e, "tokens": tokens(F.col("title"))}.items()))

    p = cut(prepared(past, "p"))
    n, first, last = p.agg(F.count("*"), F.min(F.unix_micros("p_at")), F.max(F.unix_micros("p_at"))).first()
    few = n <= BROADCAST_PAST
    # a target that no earlier event is near enough to in time has no partner: its entities and tokens aren't needed
    at, day = F.unix_micros("first_seen"), 86400000000
    t = cut(prepared(targets.where(at.between((first or 0) - day, (last or 0) + window_days * day)), "t"))
    p = F.broadcast(p) if few else p
    delta = (F.unix_micros("p_at") - F.unix_micros("t_at")) / F.lit(86400e6)
    band = (delta <= 1.0) & (F.abs(delta) <= window_days)

    def meeting(a: Column, b: Column) -> DataFrame:
        x = t.select("t_id", "t_at", a.alias("key"))
        y = p.select("p_id", "p_at", b.alias("key"))
        y = F.broadcast(y) if few else y
        return x.join(y, "key").where(band).select("t_id", "p_id")

    pairs = meeting(F.explode("t_entities"), F.explode("p_entities")).unionAll(meeting(F.explode("t_tokens"), F.explode("p_tokens")))
    pairs = pairs.unionAll(meeting(F.when(F.col("t_category") != "", F.col("t_category")), F.col("p_category"))).distinct()
    joined = pairs.join(t, "t_id").join(p, "p_id")
    entity, lexical = jaccard(F.col("t_entities"), F.col("p_entities")), jaccard(F.col("t_tokens"), F.col("p_tokens"))
    days = days_between(F.col("t_at"), F.col("p_at"))
    topic = F.when((F.col("t_category") != "") & (F.col("t_category") == F.col("p_category")), 1.0).otherwise(0.0)
    decay = F.greatest(F.lit(0.0), 1.0 - days / max(window_days, 1))
    shared = F.array_sort(F.array_intersect("t_entities", "p_entities"))
    out = joined.select(
        F.col("t_id").alias("target_id"),
        F.col("p_id").alias("prior_id"),
        "p_at",
        shared.alias("shared"),
        lexical.alias("lexical"),
        topic.alias("topic"),
        (WEIGHTS["entity"] * entity + WEIGHTS["lexical"] * lexical + WEIGHTS["time"] * decay + WEIGHTS["topic"] * topic).alias("rel"),
    )
    channel = (F.size("shared") > 0) | (F.col("lexical") >= LEAST_LEXICAL) | (F.col("topic") > 0)
    out = out.where(channel & (F.col("lexical") < NEAR_DUPLICATE) & (F.col("rel") >= LEAST_RELEVANCE))
    w = Window.partitionBy("target_id").orderBy(F.desc("rel"), F.desc("p_at"), F.desc("prior_id"))
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return ranked.select("target_id", "prior_id", "rel", F.round("rel", 4).alias("score"), F.slice("shared", 1, 8).alias("shared_entities"), "rank")


def _lead(articles: Column) -> Column:
    first = articles[0]
    return sentences(F.when(F.coalesce(first["text"], F.lit("")) != "", first["text"]).otherwise(first["title"]), 1)[0]


def _those(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df with one of the ids. Up to NAMED ids become a condition, which is tested before what df computes of its
    texts, and up to BROADCAST_PAST are broadcast, so that df isn't shuffled with its texts."""
    ids = cut(ids.where(F.col("id").isNotNull()).distinct())
    n = ids.count()
    if n <= NAMED:
        return df.where(F.col("id").isin([r[0] for r in ids.collect()]))
    return df.join(F.broadcast(ids) if n <= BROADCAST_PAST else ids, "id", "left_semi")


def trace_by_rule(recalled: DataFrame, targets: DataFrame, past: DataFrame) -> DataFrame:
    """(target_id, prior_id, type, narrative, confidence, evidence): what shared entities suggest, before validation.

    Two military events of rising severity are an escalation, others background. Evidence is the first sentence of each
    event's first article. targets and past also have severity and articles (array of id, title, url, source_id, text).
    """
    t = _those(targets, recalled.select(F.col("target_id").alias("id"))).select(F.col("id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in ("title", "category", "severity", "entities", "articles")])
    p = _those(past, recalled.select(F.col("prior_id").alias("id"))).select(F.col("id").alias("prior_id"), *[F.col(c).alias(f"p_{c}") for c in ("title", "category", "severity", "entities", "articles")])
    pairs = recalled.select("target_id", "prior_id", "rank").join(t, "target_id").join(p, "prior_id")
    shared = F.array_sort(F.array_intersect("t_entities", "p_entities"))
    pairs = pairs.withColumn("shared", shared).where((F.size("shared") > 0) & (jaccard(token_set(F.col("t_title")), token_set(F.col("p_title"))) < NEAR_DUPLICATE))
    rising = (F.col("t_severity") >= F.col("p_severity") + 0.2) & (F.col("t_category") == "military") & (F.col("p_category") == "military")

    def evidence(articles: str) -> Column:
        lead = _lead(F.col(articles))
        return F.when(lead.isNotNull(), F.struct(F.col(articles)[0]["id"].alias("article_id"), lead.alias("span")))

    narrative = F.concat(F.lit("规则关联：共享实体 "), F.array_join(F.slice("shared", 1, 3), "、"), F.lit("；"), F.left(F.coalesce("p_title", F.lit("")), F.lit(60)), F.lit(" 为当前事件的相关背景。"))
    out = pairs.select(
        "target_id",
        "prior_id",
        "rank",
        F.when(rising, "escalation").otherwise("background").alias("type"),
        narrative.alias("narrative"),
        F.round(F.least(F.lit(0.6), 0.3 + 0.1 * F.least(F.size("shared"), F.lit(3))), 2).alias("confidence"),
        F.array_compact(F.array(evidence("p_articles"), evidence("t_articles"))).alias("evidence"),
    )
    return out.where(F.size("evidence") > 0)


def validate(relations: DataFrame, recalled: DataFrame, targets: DataFrame, past: DataFrame, articles: DataFrame) -> DataFrame:
    """The relations that hold: up to three per target, the most confident first.

    The prior event must be a candidate; unknown types become background; causes later than a day after become
    parallels; of the first three pieces of evidence those found verbatim in their articles stay, two at most, and a
    relation without any goes. articles: id, title, url, text.
    """
    t = targets.select(F.col("id").alias("target_id"), F.col("first_seen").alias("_t_at"))
    p = past.select(F.col("id").alias("prior_id"), F.left(F.coalesce("title", F.lit("")), F.lit(100)).alias("prior_title"), F.col("first_seen").alias("_p_at"))
    known = relations.join(recalled.select("target_id", "prior_id"), ["target_id", "prior_id"], "left_semi").join(t, "target_id").join(p, "prior_id")
    kind = F.when(F.col("type").isin(*RELATION_TYPES), F.col("type")).otherwise("background")
    late = F.unix_micros("_p_at") > F.unix_micros("_t_at") + 86400000000
    known = known.withColumn("type", F.when(kind.isin(*DIRECTED) & late, "thematic_parallel").otherwise(kind))
    known = cut(known)
    told = known.select("target_id", "prior_id", F.posexplode(F.slice("evidence", 1, 3)).alias("pos", "e")).select("target_id", "prior_id", "pos", "e.*").withColumn("_span", normalize_text(F.col("span")))
    cited = _those(articles, told.select(F.col("article_id").alias("id")))  # only these are normalized
    shots = cited.select(F.col("id").alias("article_id"), F.coalesce("url", F.lit("")).alias("url"), snapshot_text(F.col("title"), F.col("text")).alias("_shot"))
    found = told.join(shots, "article_id").where(span_in(F.col("_span"), F.col("_shot")))
    row = F.struct("pos", "article_id", "span", "url", F.lit(True).alias("verified"))
    kept = found.groupBy("target_id", "prior_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(row)), 1, 2), lambda x: F.struct(x["article_id"].alias("article_id"), x["span"].alias("span"), x["url"].alias("url"), x["verified"].alias("verified"))).alias("evidence"))
    out = known.drop("evidence").join(kept, ["target_id", "prior_id"])
    confidence = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    w = Window.partitionBy("target_id").orderBy(F.desc("confidence"), "rank", "prior_id")
    out = out.withColumn("confidence", confidence).withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    return out.select(
        F.col("prior_id").alias("prior_event_id"),
        F.col("target_id").alias("target_event_id"),
        "type",
        F.left("narrative", F.lit(200)).alias("narrative"),
        "evidence",
        "confidence",
        "prior_title",
        F.date_format("_p_at", "yyyy-MM-dd").alias("prior_date"),
        F.when(F.col("confidence") >= AUTO, "auto").otherwise("review").alias("status"),
        F.col("_n").alias("rank"),
    )


def trace(targets: DataFrame, past: DataFrame, articles: DataFrame, top_k: int = 6, window_days: int = 180) -> DataFrame:
    """Recall, rules and validation in one."""
    recalled = cut(recall(targets, past, top_k, window_days))
    return validate(trace_by_rule(recalled, targets, past), recalled, targets, past, articles)
