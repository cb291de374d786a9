"""Schemas of the store's tables and of what operators exchange."""

from __future__ import annotations

SOURCE = "id string, name string, url string, type string, language string, region string, perspective string, weight double, fetch_interval_minutes int, enabled boolean"
FEED_ITEM = "source_id string, item int, link string, title string, desc string, date string, error string"
ARTICLE = "id bigint, source_id string, url string, url_hash string, title string, content_text string, lang string, published_at timestamp, fetched_at timestamp, entities array<string>, topic string"
EVENT = "id bigint, title string, category string, severity double, first_seen timestamp, last_seen timestamp, article_count int, source_count int, score double, status string"
EVIDENCE = "array<struct<article_id:bigint,span:string,url:string,verified:boolean>>"

TABLES = {
    "sources": f"{SOURCE}, version bigint",
    "source_health": "source_id string, health string, checked_at timestamp",
    "articles": ARTICLE,
    "events": EVENT,
    "event_articles": "event_id bigint, article_id bigint, relation string",
    "briefs": "id bigint, date string, kind string, title string, body_md string, published_at timestamp",
    "citations": "id bigint, brief_id bigint, event_id bigint, article_id bigint, span string, url string, verified boolean, created_at timestamp",
    "event_relations": f"id bigint, prior_event_id bigint, target_event_id bigint, type string, narrative string, evidence {EVIDENCE}, confidence double, status string, created_at timestamp",
    "relation_status": "id bigint, relation_id bigint, status string, set_at timestamp",
    "feedback": "id bigint, kind string, target_id bigint, ref string, rating string, note string, created_at timestamp",
    "runs": "id bigint, kind string, trigger string, status string, created_at timestamp, checkpoint string",
    "steps": "run_id bigint, agent string, input_digest string, output_ref string, error_card string, started_at timestamp, ended_at timestamp",
}

FEEDBACK_KINDS = ("brief_item", "event_relation", "source")
RATINGS = ("good", "bad", "confirm", "reject")
