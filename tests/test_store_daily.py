"""The store, the daily run from injected articles and from feeds, sources, the brief, streaming."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions.url import url_hash
from skyloom.operators.cluster import Fold
from skyloom.plans import backends, brief, daily
from skyloom.plans.store import Store
from skyloom.schemas import TABLES
from skyloom.sources import config, feeds
from skyloom.streaming.cluster import cluster_stream
from skyloom.streaming.dedup import dedup_stream
from skyloom.streaming.ingest import ingest_stream, payload_stream

NOW = dt.datetime(2026, 9, 1, 12)
RSS = b"""<rss><channel><item><title>US &amp; China talks</title><link>https://a.com/1</link><description>&lt;p&gt;Trade talks resumed.&lt;/p&gt;</description><pubDate>Mon, 31 Aug 2026 10:00:00 GMT</pubDate></item>
<item><title>Second</title><link>https://a.com/2</link></item><item><title>No link</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom item</title><link href="https://b.com/x"/><updated>2026-08-31T10:00:00Z</updated></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>RDF item</title><link>https://c.com/1</link><dc:date>2026-08-30</dc:date></item></rdf:RDF>"""


def source_rows():
    return [config.Source("s1", "One", "feed1", weight=1.2), config.Source("s2", "Two", "feed2", weight=0.9)]


def article_frame(spark, rows):
    df = spark.createDataFrame([(i, s, f"https://x.org/{i}", t, c, NOW - dt.timedelta(hours=h), e) for i, (s, t, c, h, e) in enumerate(rows)], "item int, source_id string, url string, title string, content_text string, published_at timestamp, entities array<string>")
    return df.withColumn("url_hash", url_hash(F.col("url"))).withColumn("lang", F.lit("en")).withColumn("fetched_at", F.lit(NOW)).withColumn("topic", F.lit("")).withColumn("seq", F.col("item").cast("long"))


ARTICLES = [
    ("s1", "Missile strike hits city in Ukraine", "Missile strike hits the city centre in Ukraine. Many were killed.", 5, ["俄罗斯", "乌克兰"]),
    ("s2", "Ukraine city hit by missile strike", "A missile strike hit the city in Ukraine, officials said. War goes on.", 4, ["俄罗斯", "乌克兰"]),
    ("s1", "Tariff on chips raised", "The tariff on imported chips was raised. Markets fell.", 3, ["美国", "中国"]),
    ("s2", "Local bakery wins award", "The bakery in town won an award.", 2, []),
]


def test_feed_dialects():
    assert [r["title"] for r in feeds.parse_feed(RSS)] == ["US & China talks", "Second"]
    assert feeds.parse_feed(ATOM) == [{"title": "Atom item", "link": "https://b.com/x", "date": "2026-08-31T10:00:00Z"}]
    assert feeds.parse_feed(RDF)[0]["date"] == "2026-08-30"


def test_collect_isolates_failures(spark):
    payloads = {"feed1": RSS, "feed2": b"not xml"}
    items = feeds.collect(config.sources_frame(spark, source_rows()), payloads.__getitem__).persist()
    assert items.where("error is null").count() == 2 and items.where("error is not null").select("source_id").collect() == [("s2",)]
    a = feeds.to_articles(items, NOW).orderBy("item").collect()
    assert (a[0]["content_text"], str(a[0]["published_at"])) == ("Trade talks resumed.", "2026-08-31 10:00:00")
    assert "中国" in a[0]["entities"] and a[1]["content_text"] == "Second" and a[1]["published_at"] == NOW
    health = dict(feeds.health(items, config.sources_frame(spark, source_rows())).collect())
    assert health["s1"] == '{"ok":true,"items":2}' and health["s2"].startswith('{"ok":false')


def test_fetch_retries():
    waits = []
    with pytest.raises(RuntimeError, match="3 attempts"):
        feeds.fetch("file:///nowhere/at/all", retries=2, pause=waits.append)
    assert waits == [1.5, 3.0]


def test_yaml_round_trip(tmp_path):
    given = [config.Source("a", 'A: "quoted"', "https://x/?a=1&b", weight=0.5, enabled=False), config.Source("b", "B")]
    config.save_sources(given, tmp_path / "s.yaml")
    assert config.load_sources(tmp_path / "s.yaml") == given and config.load_sources(tmp_path / "s.yaml", True) == given[1:]
    text = "x: 1\nlist:\n  - one\n  - 2.5\n# note\nsources:\n  - id: q\n    enabled: no\n    name: 'Q'\nlast: null\n"
    assert config.parse_yaml(text) == {"x": 1, "list": ["one", 2.5], "sources": [{"id": "q", "enabled": False, "name": "Q"}], "last": None}


def test_env_and_prompts(tmp_path, monkeypatch):
    monkeypatch.setenv("HAVE_IT", "old")
    (tmp_path / ".env").write_text('# c\nHAVE_IT=new\nWANT_IT="v"\n')
    assert config.load_env(tmp_path / ".env") == {"WANT_IT": "v"}
    monkeypatch.delenv("WANT_IT")
    (tmp_path / "p.md.j2").write_text("a {{ x }} b {{x}}")
    assert config.load_prompt(tmp_path, "p", x="1") == "a 1 b 1"


def test_store_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.insert_articles(article_frame(spark, ARTICLES), "seq")
    assert [r["id"] for r in first.orderBy("id").collect()] == [1, 2, 3, 4]
    assert store.insert_articles(article_frame(spark, ARTICLES), "seq").count() == 0
    assert store.articles_since(NOW, 24).count() == 4
    old = article_frame(spark, [("s1", "old", "old", h, []) for h in (47, 49)]).withColumn("url_hash", F.concat("url_hash", F.lit("x")))
    store.insert_articles(old, "seq")
    assert store.articles_since(NOW, 24).count() == 5
    assert set(TABLES) >= {r["name"] for r in store.stats().collect()}


def test_feedback_closes_the_loop(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rel = spark.createDataFrame([(1, 2, "background", "n", [], 0.5, "review", 1)], "prior_event_id long, target_event_id long, type string, narrative string, evidence array<struct<article_id:long,span:string,url:string,verified:boolean>>, confidence double, status string, rank int")
    assert store.save_relations(rel, NOW) == 1
    assert store.save_feedback("event_relation", 1, "confirm", NOW) == (1, True)
    assert store.relations().first()["status"] == "confirmed"
    assert store.save_feedback("event_relation", 99, "reject", NOW) == (2, False)
    assert store.set_relation_status(1, "auto", NOW) and store.relations().first()["status"] == "auto"
    assert not store.set_relation_status(7, "auto", NOW)
    assert [r["id"] for r in store.feedback(limit=1).collect()] == [2]
    with pytest.raises(ValueError):
        store.save_feedback("other", 1, "good", NOW)


def test_sources_keep_their_health(spark, tmp_path):
    store, frame = Store(spark, str(tmp_path)), config.sources_frame(spark, source_rows())
    store.upsert_sources(frame, NOW)
    store.update_health(spark.createDataFrame([("s1", '{"ok":false}')], "source_id string, health string"), NOW + dt.timedelta(hours=1))
    store.upsert_sources(frame.withColumn("weight", F.lit(2.0)), NOW + dt.timedelta(hours=2))
    got = {r["id"]: (r["weight"], r["health"]) for r in store.sources().collect()}
    assert got == {"s1": (2.0, '{"ok":false}'), "s2": (2.0, '{"ok": true}')}


def test_daily_run_with_lineage(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    past = article_frame(spark, [("s1", "Troops gather on the border", "Troops gather on the border of Ukraine. Envoys worry.", 120, ["俄罗斯", "乌克兰"])]).withColumn("url_hash", F.lit("past"))
    old = store.insert_articles(past, "seq").first()["id"]
    before = spark.createDataFrame([(1, "Troops gather on the border", "military", 1.4, [old], ["s1"], NOW - dt.timedelta(days=5), NOW - dt.timedelta(days=5), 1.0)], "id long, title string, category string, severity double, article_ids array<long>, source_ids array<string>, first_seen timestamp, last_seen timestamp, score double")
    store.save_events(before, "cluster_id")
    path = daily.run(store, config.sources_frame(spark, source_rows()), NOW, str(tmp_path / "out"), injected=article_frame(spark, ARTICLES))
    body = open(path, encoding="utf-8").read()
    assert "Missile strike" in body and "bakery" not in body and "事件溯源" in body and "```mermaid" in body and "[1]" in body
    stats = {r["name"]: r["n"] for r in store.stats().collect()}
    assert stats["runs"] == 1 and stats["citations"] > 0 and stats["event_relations"] == 1 and stats["events"] == 3
    r = store.relations().first()
    assert (r["prior_event_id"], r["type"]) == (1, "escalation") and len(r["evidence"]) == 2
    assert store.runs().first()["status"] == "done"
    assert store.table("steps").where("agent = 'reviewer'").count() == 1
    assert store.table("articles").count() == 5


class Fake:
    name = "fake"

    def complete(self, prompt, context):
        if prompt == "summarizer":
            return {"headline": "H", "summary": "S", "impact": "I", "key_quotes": ["invented words nobody wrote"], "citations": [1, "x"]}
        raise ValueError("no answer")


def test_backend_falls_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    path = daily.run(store, config.sources_frame(spark, source_rows()), NOW, str(tmp_path / "out"), injected=article_frame(spark, ARTICLES), backend=Fake())
    body = open(path, encoding="utf-8").read()
    assert "### 1. H" in body and "引用待核" in body and "invented words" not in body and "LLM 分析 2/2" in body


def test_cards_are_asked_in_batches(spark, tmp_path):
    asked = []

    class Screener(Fake):
        def complete(self, prompt, context):
            if prompt != "screener":
                raise ValueError("no answer")
            cards = json.loads(context["items_json"])
            asked.append(len(cards))
            if len(asked) == 2:
                raise ValueError("no answer")
            return {"results": [{"id": c["id"], "relevant": True, "topic": "sports", "severity": 1.1} for c in cards]}

    store = Store(spark, str(tmp_path / "db"))
    path = daily.run(store, config.sources_frame(spark, source_rows()), NOW, str(tmp_path / "out"), daily.Options(cards_per_prompt=1), injected=article_frame(spark, ARTICLES), backend=Screener())
    assert asked == [1, 1, 1] and "sports" in open(path, encoding="utf-8").read()


def test_chat_backend_repairs_and_retries():
    answers = iter(["nothing", '{"a": "x "y" z"}'])
    b = backends.ChatBackend("k", "http://h/", "m", lambda name: name + " {{ v }}")
    asked = []
    b.post = lambda payload: asked.append(payload["messages"][0]["content"]) or {"choices": [{"message": {"content": next(answers)}}]}
    assert b.complete("p", {"v": "1"}) == {"a": 'x "y" z'} and asked[0] == "p 1" and asked[1].startswith("p 1") and len(asked[1]) > 10


def test_chat_backend_without_json_mode():
    import urllib.error

    b = backends.ChatBackend("k", "http://h/", "m", str)
    seen = []

    def post(payload):
        seen.append("response_format" in payload)
        if seen[-1]:
            raise urllib.error.HTTPError("u", 422, "no", None, None)
        return {"choices": [{"message": {"content": None, "reasoning_content": ' {"a": 1} '}}]}

    b.post = post
    assert b.complete("p", {}) == b.complete("p", {}) == {"a": 1} and seen == [True, False, False]
    b.post = lambda payload: (_ for _ in ()).throw(urllib.error.HTTPError("u", 500, "no", None, None))
    with pytest.raises(urllib.error.HTTPError):
        b.complete("p", {})


def test_a_failed_run_is_recorded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    with pytest.raises(Exception):
        daily.run(store, config.sources_frame(spark, source_rows()), NOW, "/proc/nowhere", injected=article_frame(spark, ARTICLES))
    assert store.runs().first()["status"] == "failed"


def test_render_numbers_by_appearance():
    item = {"headline": "Big event", "summary": "s", "impact": "", "key_quotes": [], "quote_citations": [], "topic": "tech", "severity": 1.0, "score": 1.0, "source_count": 1, "mode": "rule", "confidence": "high", "event_id": 1, "lineage": [], "traced": True}
    items = [item | {"citation_ids": [5, 7]}, item | {"citation_ids": [7, 9], "headline": "B"}, item | {"citation_ids": []}, item | {"citation_ids": [9], "headline": "D", "confidence": "low"}]
    articles = {i: {"title": t, "source_id": "s", "url": "u"} for i, t in ((5, "A"), (7, "B"), (9, "C"))}
    body = brief.render("2026-09-01", items, articles, {"s": "Source"}, {})
    assert "### 1. Big event [1][2]" in body and "### 2. B [2][3]" in body and "[3] C — Source — u" in body and "**[科技]** D [3]（1 源） ⚠️引用待核" in body and "新发/孤立事件" in body


def test_ingest_stream(spark, tmp_path):
    raw = spark.createDataFrame([("s1", bytearray(RSS)), ("s2", bytearray(ATOM)), ("s3", bytearray(b"broken"))], "source_id string, payload binary")
    raw.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "db"))
    for _ in range(2):
        ingest_stream(payload_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "check"), lambda: NOW).awaitTermination()
    assert store.table("articles").count() == 3


def test_dedup_stream(spark, tmp_path):
    rows = [("u1", "en", "US imposes new sanctions on Russia", NOW, "s"), ("u1", "en", "other words entirely here", NOW, "s"), ("u2", "en", "US imposes new sanctions over Russia", NOW, "s"), ("u3", "de", "US imposes new sanctions on Russia", NOW, "s")]
    schema = "url_hash string, lang string, title string, published_at timestamp, source_id string"
    spark.createDataFrame(rows[:1] + rows[2:], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = dedup_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["url_hash"] for r in spark.table("kept").collect()) == ["u1", "u3"]


def test_cluster_stream_is_the_fold(spark, tmp_path):
    rng, at, rows = random.Random(4), NOW, []
    for i in range(60):
        at += dt.timedelta(hours=rng.choice([0, 1, 30, 72, 73]))
        rows.append(("k", i, at, " ".join(rng.choices(["trade", "peace", "chips", "votes", "flood", "storm"], k=3)), "", rng.sample(["A", "B"], rng.randint(0, 2))))
    schema = "key string, id long, published_at timestamp, title string, content_text string, entities array<string>"
    for n, part in enumerate((rows[:20], rows[20:45], rows[45:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = cluster_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    fold = Fold()
    want = [(r[1], fold.add(r[2], set(r[5]), set(r[3].split())) + 1) for r in rows]
    assert sorted((r["id"], r["cluster"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
