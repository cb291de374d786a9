"""The daily run: collect, deduplicate, store, cluster, screen, score, summarize, verify, trace, render.

Stages up to the scored events are one lazy plan over the window's articles; from the top events on there are a few rows.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import itertools
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import cluster, dedup, lineage, screen, summarize, verify
from skyloom.plans import backends, brief
from skyloom.plans.store import Store
from skyloom.session import cut
from skyloom.sources import feeds


@dataclasses.dataclass
class Options:
    hours: int = 24
    top_n: int = 6
    trace_n: int = 3
    trace_days: int = 180
    trigger: str = "manual"
    cards_per_prompt: int = 200
    title: str = brief.TITLE


def ingest(store: Store, collected: DataFrame) -> tuple[int, int, DataFrame]:
    """Deduplicates and stores articles (with seq, their arrival): (how many came, how many the batch repeats, those stored)."""
    collected = cut(collected)
    kept = cut(dedup.dedup_batch(collected))
    total = collected.count()
    return total, total - kept.count(), cut(store.insert_articles(kept, "seq"))


def arrivals(articles: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """articles with seq: by the order of the sources, and of the items in each."""
    from skyloom.operators.relational import numbered

    if sources is None:
        return articles if "seq" in articles.columns else numbered(articles, 0, "source_id", "item", name="seq")
    place = sources.select(F.col("id").alias("source_id"), "place")
    return numbered(articles.join(place, "source_id"), 0, "place", "item", name="seq")


def fetch(store: Store, sources: DataFrame, now: dt.datetime, fetch_fn=feeds.fetch) -> dict:
    """Collects and stores only."""
    store.upsert_sources(sources.drop("place"), now)
    items = cut(feeds.collect(sources, fetch_fn))
    total, _, stored = ingest(store, arrivals(feeds.to_articles(items, now), sources if "place" in sources.columns else None))
    errors = [r.asDict() for r in items.where("error is not null").select("source_id", "error").collect()]
    return {"fetched": total, "new": stored.count(), "errors": errors}


def run(store: Store, sources: DataFrame, now: dt.datetime, out_dir: str, options: Options = Options(), injected: DataFrame | None = None, fetch_fn=feeds.fetch, backend=None) -> str:
    """The whole run; returns the brief's path. sources: enabled ones (schemas.SOURCE). injected: articles in place of
    collected ones. A run that fails is recorded as failed."""
    run_id = store.start_run("daily", options.trigger, now)
    try:
        path, counts = _run(store, run_id, sources, now, out_dir, options, injected, fetch_fn, backend)
    except Exception as e:
        store.finish_run(run_id, "failed", {"error": str(e)[:300]}, now)
        raise
    store.finish_run(run_id, "done", counts, now)
    return path


def _run(store, run_id, sources, now, out_dir, options, injected, fetch_fn, backend) -> tuple[str, dict]:
    spark = store.spark
    sources = cut(sources)
    store.upsert_sources(sources, now)
    name = backend.name if backend else "rule"
    steps: list[tuple[str, str, str, str]] = []
    errors: list[dict] = []
    if injected is None:
        items = cut(feeds.collect(sources, fetch_fn))
        errors = [r.asDict() for r in items.where("error is not null").select("source_id", "error").collect()]
        steps += [("collector", e["source_id"], "", json.dumps(e, ensure_ascii=False)) for e in errors]
        arrived = arrivals(feeds.to_articles(items, now))
    else:
        arrived = arrivals(injected)
    total, repeated, stored = ingest(store, arrived)

    window = store.articles_since(now, options.hours)
    window = cut((stored if window.isEmpty() else window))
    events = cut(cluster.to_events(window, cluster.cluster_articles(window)))

    members = cut(events.select(F.col("id").alias("event_id"), F.posexplode("article_ids").alias("position", "article_id")).join(window.withColumnRenamed("id", "article_id"), "article_id"))
    cards = events.select("id", "title").join(screen.card_text(members, sources).withColumnRenamed("event_id", "id"), "id", "left")
    screened = screen.screen(cards)
    if backend:
        told = []
        rest = cards.orderBy("id").toLocalIterator()
        while batch := [r.asDict() for r in itertools.islice(rest, options.cards_per_prompt)]:
            told += backends.screened(backend, batch) or []
        judged = spark.createDataFrame(told, "id bigint, relevant boolean, topic string, severity double, reason string")
        by_rule = screened.join(judged.select("id"), "id", "left_anti").select(judged.columns)
        screened = cut(judged.unionAll(by_rule))
    at = F.lit(now).cast("timestamp")
    ranked = cut(screen.scored(events, screened, sources, at).orderBy(F.desc("score"), "id"))
    n_events = ranked.count()
    top = cut(ranked.limit(options.top_n))

    weights = sources.select(F.col("id").alias("source_id"), "weight")
    own = members.join(top.select(F.col("id").alias("event_id")), "event_id", "left_semi").join(weights, "source_id", "left")
    own = cut(own.select("event_id", "position", F.col("article_id").alias("id"), "source_id", "title", F.col("content_text").alias("text"), "url", "lang", "entities", F.coalesce("weight", F.lit(1.0)).alias("weight")))
    drafted = summarize.summarize(top, own)
    if backend:
        drafted = _asked(spark, backend, top, own, drafted, steps)
    saved = store.save_events(top, F.desc("score"), F.col("cluster_id"))
    drafted = drafted.withColumnRenamed("event_id", "cluster_id").join(saved, "cluster_id").withColumn("item_id", F.col("event_id"))

    snapshots = window.select("id", "title", "url", "source_id", F.col("content_text").alias("text"))
    reviewed = cut(verify.review(drafted, snapshots).orderBy(F.desc("score"), "cluster_id"))
    counts = verify.report(reviewed).first().asDict()
    steps.append(("reviewer", f"items:{counts['items']}", json.dumps(counts), ""))

    relations, extra = [], []
    if options.trace_n > 0:
        relations, extra = _trace(store, backend, options, now, saved, top, own, snapshots, steps)
    rows = reviewed.collect()
    articles = {r["id"]: r.asDict() for r in snapshots.join(_cited(spark, rows, relations), "id", "left_semi").collect()}
    for a in extra:
        articles.setdefault(a["id"], a)
    by_target: dict[int, list[dict]] = {}
    for r in relations:
        by_target.setdefault(r["target_event_id"], []).append(r)
    items = [r.asDict(recursive=True) | {"lineage": by_target.get(r["event_id"], []), "traced": i < options.trace_n} for i, r in enumerate(rows)]
    window_counts = window.agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("s")).first()
    llm = sum(i["mode"] == name for i in items) if backend else 0
    meta = {"generated_at": now.isoformat(timespec="seconds"), "backend": name, "articles": window_counts["n"], "events": n_events, "sources": window_counts["s"], "llm_count": llm, "item_count": len(items)}
    names = {r["id"]: r["name"] for r in sources.select("id", "name").collect()}
    date = now.date().isoformat()
    body = brief.render(date, items, articles, names, meta | counts, options.title)
    path = Path(out_dir, f"{date}.md")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")
    brief_id = store.save_brief(date, "daily", f"{options.title} {date}", body, now)
    n_citations = store.save_citations(brief_id, verify.citations(reviewed, snapshots), now)
    store.record_steps(run_id, steps, now)
    return str(path), {
        "fetched": total, "stored": stored.count(), "duplicates": repeated, "events": n_events, "brief": str(path), "errors": len(errors),
        "llm_items": llm, "total_items": len(items), "quotes_kept": counts["quotes_kept"], "quotes_total": counts["quotes_total"],
        "low_confidence_items": counts["low_confidence"], "citations": n_citations, "traced_items": min(max(options.trace_n, 0), len(items)), "lineage_relations": len(relations),
    }


def _cited(spark, rows, relations) -> DataFrame:
    ids = {c for r in rows for c in r["citation_ids"]} | {e["article_id"] for r in relations for e in r["evidence"]}
    return spark.createDataFrame([(i,) for i in sorted(ids)], "id bigint")


def _asked(spark, backend, top, own, by_rule, steps) -> DataFrame:
    """The items as the backend tells them; by rule where it fails."""
    articles: dict[int, list[dict]] = {}
    for r in own.orderBy("event_id", "position").collect():
        articles.setdefault(r["event_id"], []).append({k: r[k] for k in ("id", "title", "text", "source_id", "lang", "weight")})
    out = []
    rules = {r["event_id"]: r.asDict() for r in by_rule.collect()}
    for e in top.select("id", "title", "category", "severity", "score").collect():
        own_articles = articles.get(e["id"], [])
        data, error = backends.summarized(backend, e.asDict(), own_articles)
        row = rules[e["id"]]
        if data is None:
            steps.append(("summarizer", f"event:{e['id']}", "", f"fallback:rule | {error}"[:250]))
        else:
            ids = [a["id"] for a in own_articles]
            cited = [c for c in data.pop("citations") if c in ids] or ids[:1]
            row = row | data | {"citation_ids": cited, "mode": backend.name}
        out.append({k: row[k] for k in by_rule.columns})
    return spark.createDataFrame(out, by_rule.schema)


def _trace(store, backend, options, now, saved, top, own, snapshots, steps) -> tuple[list[dict], list[dict]]:
    """Stores and returns the relations of the first events, and the articles they cite from history."""
    at = F.lit(now).cast("timestamp")
    past = cut(lineage.history(store.table("events"), store.table("event_articles"), store.table("articles"), at, options.trace_days, saved.select(F.col("event_id").alias("id"))))
    first = top.orderBy(F.desc("score"), "id").limit(options.trace_n).join(saved, F.col("id") == F.col("cluster_id")).drop("id").withColumnRenamed("event_id", "id")
    row = F.struct("position", "id", "title", "url", "source_id", "text")
    leads = own.groupBy("event_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(row)), 1, 2), lambda x: x.dropFields("position")).alias("articles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("entities", F.array().cast("array<string>")))))).alias("entities"),
    )
    targets = cut(first.join(leads, F.col("cluster_id") == leads["event_id"]).drop("event_id"))
    recalled = cut(lineage.recall(targets, past, 6, options.trace_days))
    told = lineage.trace_by_rule(recalled, targets, past)
    if backend:
        told = _told(store.spark, backend, recalled, targets, past, told, steps)
    old = past.select(F.explode_outer("articles").alias("a")).where("a is not null").select("a.*")
    known = cut(snapshots.unionByName(old.join(snapshots.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*snapshots.columns)))
    valid = cut(lineage.validate(told, recalled, targets, past, known))
    relations = [r.asDict(recursive=True) for r in valid.orderBy("target_event_id", "rank").collect()]
    if relations:
        store.save_relations(valid, now)
    ids = store.spark.createDataFrame([(e["article_id"],) for r in relations for e in r["evidence"]], "id bigint").distinct()
    for r in targets.select("id").collect():
        steps.append(("tracer", f"event:{r['id']}", json.dumps({"relations": sum(x["target_event_id"] == r["id"] for x in relations)}), ""))
    return relations, [r.asDict() for r in known.join(ids, "id", "left_semi").collect()]


def _told(spark, backend, recalled, targets, past, by_rule, steps) -> DataFrame:
    prior = {r["id"]: r.asDict(recursive=True) for r in past.join(recalled.select(F.col("prior_id").alias("id")).distinct(), "id", "left_semi").collect()}
    found = recalled.orderBy("target_id", "rank").collect()
    out, rules = [], {}
    for r in by_rule.collect():
        rules.setdefault(r["target_id"], []).append(r.asDict(recursive=True))
    for t in targets.collect():
        own = [f for f in found if f["target_id"] == t["id"]]
        candidates = [prior[f["prior_id"]] | {"shared_entities": f["shared_entities"], "score": f["score"]} for f in own]
        answer, error = backends.traced(backend, t.asDict(recursive=True), candidates)
        if answer is None:
            steps.append(("tracer", f"event:{t['id']}", "", error))
            out += rules.get(t["id"], [])
            continue
        for r in answer:
            evidence = [{"article_id": a, "span": s} for a, s in r["evidence"] if isinstance(a, int)]
            out.append(r | {"target_id": t["id"], "rank": len(out), "evidence": evidence})
    return spark.createDataFrame([{k: r[k] for k in by_rule.columns} for r in out], by_rule.schema)
