"""Operators on small fixtures, and the folds against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.lexicon import Rules
from skyloom.operators import cluster, dedup, lineage, relational, screen, summarize, verify

NOW = dt.datetime(2026, 9, 1, 12)


def test_upsert_keeps_what_it_should(spark):
    stored = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, name string, health string")
    new = spark.createDataFrame([(2, None, "x"), (3, "c", "y")], "id int, name string, health string")
    got = relational.upsert(new, stored, "id", keep_stored=("health",)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "h1"), (2, None, "h2"), (3, "c", "y")]


def test_numbered_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = relational.numbered(df, 5, "k").orderBy("id").collect()
    assert [(r["id"], r["k"]) for r in got] == [(5 + i, i) for i in range(1000)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbered_loses_no_wide_rows(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        texts = spark.range(10_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("text"), (F.col("id") * 7919 % 500).alias("k")).withColumnRenamed("id", "own")
        wide = spark.range(400_000).select(F.col("id").alias("own"), (F.col("id") * 7919 % 90_001).alias("k"), *[F.xxhash64("id", F.lit(i)).alias(f"c{i}") for i in range(8)])
        for df, n in ((texts, 10_000), (wide, 400_000)):
            got = relational.numbered(df, 1, "k", "own")
            row = got.agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"), F.countDistinct("id").alias("d"), F.countDistinct("own").alias("o")).first()
            assert tuple(row) == (n, 1, n, n, n)
            pairs = got.alias("a").join(got.alias("b"), F.col("a.id") + 1 == F.col("b.id"))
            assert pairs.where("struct(a.k, a.own) >= struct(b.k, b.own)").isEmpty() and got.columns[-1] == "id"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_numbered_of_no_rows(spark):
    assert relational.numbered(spark.range(0).withColumnRenamed("id", "k"), 1, "k").count() == 0


def test_latest_status(spark):
    relations = spark.createDataFrame([(1, "review"), (2, "auto"), (3, "auto")], "id long, status string")
    feedback = spark.createDataFrame([(1, "event_relation", 1, "confirm"), (2, "event_relation", 1, "reject"), (3, "event_relation", 2, "bad"), (4, "brief_item", 3, "reject")], "id long, kind string, target_id long, rating string")
    got = relational.latest_status(relations, feedback).orderBy("id").collect()
    assert [r["status"] for r in got] == ["rejected", "auto", "auto"]


def dedup_plain(rows):
    seen, kept, out = set(), [], []
    for seq, url, lang, title in sorted(rows):
        if url in seen:
            continue
        seen.add(url)
        low = (title or "").lower()
        if any(k == lang and dedup.similarity(t, low) >= dedup.THRESHOLD for k, t in kept):
            continue
        kept.append((lang, low))
        out.append(seq)
    return out


def test_common_subsequences():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé 谈") for _ in range(n))
    pairs = [(text(rng.choice([0, 1, 5, 62, 63, 64, 80, 126, 127, 200])), text(rng.choice([0, 3, 63, 70, 140]))) for _ in range(120)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    assert dedup.common_subsequences(*map(list, zip(*pairs))).tolist() == [plain(a, b) for a, b in pairs]
    assert len(dedup.common_subsequences([], [])) == 0


def test_dedup_fixtures(spark):
    rows = [
        (0, "u0", "en", "US imposes new sanctions on Russia"), (1, "u1", "en", "US imposes new sanctions over Russia"), (2, "u1", "en", "Something else entirely"),
        (3, "u0", "en", "Again"), (4, "u4", "de", "US imposes new sanctions on Russia"), (5, "u5", "en", ""), (6, "u6", "en", ""), (7, "u7", "en", "Brazil election results"),
    ]
    df = spark.createDataFrame(rows, "seq long, url_hash string, lang string, title string")
    got = sorted(r["seq"] for r in dedup.dedup_batch(df).collect())
    assert got == dedup_plain(rows) == [0, 4, 5, 7]


@pytest.mark.parametrize("seed", range(3))
def test_dedup_is_the_fold(spark, seed):
    rng = random.Random(seed)
    words = ["trade", "talks", "war", "peace", "chip", "curb", "vote", "flood"]
    rows = [(i, f"u{rng.randrange(90)}", rng.choice(["en", "de"]), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, url_hash string, lang string, title string").repartition(3)
    assert sorted(r["seq"] for r in dedup.dedup_batch(df).collect()) == dedup_plain(rows)


def test_common_subsequence_bounds_the_matches():
    rng = random.Random(9)
    pairs = [["".join(rng.choices("abcé ", k=rng.randint(0, 30))) for _ in range(2)] for _ in range(400)]
    for (a, b), n in zip(pairs, dedup.common_subsequences(*map(list, zip(*pairs)))):
        assert 2 * n >= dedup.similarity(a, b) * (len(a) + len(b)) - 1e-9


@pytest.mark.parametrize("tile", [(256, 1 << 15, 1 << 23), (7, 64, 500)])
def test_possible_pairs_are_those_of_the_bound(monkeypatch, tile):
    for name, n in zip(("_WIDTH", "_CELLS", "_MASKS"), tile):
        monkeypatch.setattr(dedup, name, n)
    rng = random.Random(4)
    texts = lambda n, sizes: ["".join(rng.choice("abcdé 谈\0") for _ in range(rng.choice(sizes))) for _ in range(n)]
    one, two = texts(60, [0, 1, 5, 20, 62, 63, 64, 126, 127, 200]), texts(50, [0, 3, 63, 70, 140])
    for other in (two, one):
        pairs = [(i, j) for i in range(len(one)) for j in range(len(other)) if other is not one or i < j]
        common = dedup.common_subsequences([one[i] for i, _ in pairs], [other[j] for _, j in pairs])
        want = [p for p, n in zip(pairs, common) if 2 * n >= 0.6 * (len(one[p[0]]) + len(other[p[1]])) - 1e-9]
        got = [(int(i), int(j)) for i, j in zip(*dedup.possible_pairs(one, other, 0.6))]
        assert sorted((min(p), max(p)) if other is one else p for p in got) == want and want
    assert len(dedup.possible_pairs([], [])[0]) == 0


def test_dedup_compares_blocks_and_each_title_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rng, compared = random.Random(7), []
    words = ["trade", "talks", "war", "peace", "chip", "curb", "vote", "flood"]
    rows = [(i, f"u{i}", rng.choice(["en", None]), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(150)]
    rows += [(200 + i, f"v{i}", "en", "The same title, many times") for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, url_hash string, lang string, title string").repartition(3)
    pairs = dedup.alike_pairs
    monkeypatch.setattr(dedup, "alike_pairs", lambda titles, threshold: compared.append(titles.count()) or pairs(titles, threshold))
    got = sorted(r["seq"] for r in dedup.dedup_batch(df).collect())
    assert got == dedup_plain([(i, u, lang or "", t) for i, u, lang, t in rows])
    assert compared == [len({(lang, t.lower()) for _, _, lang, t in rows})]


def cluster_plain(rows):
    """Every article against every event, in order."""
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    events, out = [], []
    for i, at, e, k in sorted(rows, key=lambda r: (r[1], r[0])):
        e, k, best, top = set(e), set(k), None, 0.0
        for event in events:
            by_e, by_k = max(like(e, event["e"]), like(e, event["e0"])), max(like(k, event["k"]), like(k, event["k0"]))
            if by_k >= 0.35:
                s = by_k
            elif by_e >= 0.67 and max(len(e & event["e"]), len(e & event["e0"])) >= 2:
                s = by_e
            else:
                s = (by_e + by_k) / 2 if by_e >= 0.5 and by_k >= 0.15 else 0.0
            if abs(at - event["last"]) <= dt.timedelta(hours=72) and s > top:
                best, top = event, s
        if best is None or top < 0.30:
            best = {"n": len(events) + 1, "e0": e, "k0": k, "e": set(), "k": set(), "last": at}
            events.append(best)
        best["e"], best["k"], best["last"] = best["e"] | e, best["k"] | k, max(best["last"], at)
        out.append((i, best["n"]))
    return out


@pytest.mark.parametrize("in_order", [True, False])
def test_fold_with_an_index(in_order):
    rng, at, rows = random.Random(5), NOW, []
    for i in range(500):
        at += dt.timedelta(hours=rng.choice([0, 0, 1, 5, 30, 72, 73]))
        late = dt.timedelta(0) if in_order else dt.timedelta(hours=rng.choice([0, 0, 90]))
        rows.append((i, at - late, rng.sample("ABCDE", rng.randint(0, 3)), rng.sample([f"w{j}" for j in range(12)], rng.randint(0, 5))))
    fold, plain = cluster.Fold(in_order=in_order), cluster_plain(rows)
    assert [(i, fold.add(t, set(e), set(k)) + 1) for i, t, e, k in sorted(rows, key=lambda r: (r[1], r[0]))] == plain and len({n for _, n in plain}) > 20


def test_fold_compares_what_can_draw(monkeypatch):
    """Events that share an entity and a few tokens are counted, not compared, and forgotten after the window."""
    compared, strength = [], cluster.Fold.strength
    monkeypatch.setattr(cluster.Fold, "strength", lambda self, *a: compared.append(1) or strength(self, *a))
    fold = cluster.Fold(in_order=True)
    rows = [(NOW + dt.timedelta(hours=i), {"A"}, {"common", *(f"w{i}-{j}" for j in range(9))}) for i in range(200)]
    assert [fold.add(*r) for r in rows] == list(range(200)) and not compared
    assert len(fold.by_token["common"]) == len(fold.by_entity["A"]) == sum(e is not None for e in fold.events) == 73
    assert fold.add(rows[199][0], {"A"}, rows[150][2]) == 150 and len(compared) == 1


@pytest.mark.parametrize("in_order", [True, False])
def test_articles_without_a_time_stand_alone(in_order):
    fold = cluster.Fold(72, in_order=in_order)
    assert [fold.add(t, {"A", "B"}, {"same", "words"}) for t in (math.nan, math.nan, 1, 2, math.nan, 3)] == [0, 1, 2, 2, 3, 2]


def test_cluster_is_the_fold(spark):
    rng = random.Random(1)
    words = [a + b for a in ("tra", "wa", "pea", "chi") for b in ("de", "ce", "ps", "rs")]
    at, rows = NOW, []
    for i in range(150):
        at += dt.timedelta(hours=rng.choice([0, 1, 5, 30, 72, 73, 100]))
        rows.append((i, at, " ".join(rng.choices(words, k=4)), rng.sample(["A", "B", "C"], rng.randint(0, 3))))
    df = spark.createDataFrame([(i, t, title, "", e) for i, t, title, e in rows], "id long, published_at timestamp, title string, content_text string, entities array<string>")
    got = sorted((r["id"], r["cluster_id"]) for r in cluster.cluster_articles(df.repartition(5)).collect())
    assert got == sorted(cluster_plain([(i, t, e, title.split()) for i, t, title, e in rows]))


def test_sessions_are_folded_in_many_tasks(spark, monkeypatch):
    parts, cut = [], cluster.checkpointed
    monkeypatch.setattr(cluster, "checkpointed", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    rows = [(i, NOW + dt.timedelta(hours=100 * (i // 3)), "same title words here", "", ["A"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, published_at timestamp, title string, content_text string, entities array<string>")
    got = sorted((r["id"], r["cluster_id"]) for r in cluster.cluster_articles(df).collect())
    assert got == [(i, i // 3 + 1) for i in range(60)]
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]  # not merged for their few bytes


def test_window_is_72_hours(spark):
    def n(hours):
        rows = [(1, NOW, "same title words here", "", []), (2, NOW + hours, "same title words here", "", [])]
        df = spark.createDataFrame(rows, "id long, published_at timestamp, title string, content_text string, entities array<string>")
        return cluster.cluster_articles(df).select("cluster_id").distinct().count()

    assert n(dt.timedelta(hours=72)) == 1 and n(dt.timedelta(hours=72, seconds=1)) == 2


def test_to_events(spark):
    a = spark.createDataFrame([(1, NOW, "s1", "first"), (2, NOW + dt.timedelta(hours=1), "s2", "x"), (3, NOW + dt.timedelta(hours=2), "s1", "y")], "id long, published_at timestamp, source_id string, title string")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, cluster_id long")
    e = cluster.to_events(a, c).first()
    assert (e["title"], e["article_ids"], e["source_ids"], e["last_seen"] - e["first_seen"]) == ("first", [1, 2, 3], ["s1", "s2"], dt.timedelta(hours=2))


@pytest.mark.parametrize(
    ("title", "body", "topic", "severity"),
    [
        ("Russia missile strike on city", "", "military", 1.8),
        ("Ward wins warning award", "", "other", 1.0),
        ("", "missiles discussed; air strikes reported", "military", 1.0),
        ("", "he attacked", "other", 1.0),
        ("Poultry slaughterhouses planned", "", "other", 1.0),
        ("外长会谈", "", "diplomacy", 1.0),
    ],
)
def test_screen(spark, title, body, topic, severity):
    df = spark.createDataFrame([(1, title, body)], "id long, title string, text string")
    r = screen.screen(df).first()
    assert (r["topic"], r["severity"], r["relevant"]) == (topic, severity, topic != "other")


def test_screen_takes_any_lexicon(spark):
    df = spark.createDataFrame([(1, "der Hund", None)], "id long, title string, text string")
    assert screen.screen(df, Rules(topics=(("tiere", ("hund",)),), severities=())).first()["topic"] == "tiere"


def test_hot_score_grows_and_fades(spark):
    def score(sources, articles, age):
        last = F.lit(NOW - dt.timedelta(hours=age)).cast("timestamp")
        c = screen.hot_score(F.lit(1.0), F.lit(sources), F.lit(articles), F.lit(1.0), last, F.lit(NOW).cast("timestamp"))
        return spark.range(1).select(c).first()[0]

    assert score(2, 2, 0) > score(1, 2, 0) > score(1, 2, 48) > 0
    assert score(1, 0, 0) == score(1, 1, 0) == round(0.6931, 4)


def test_disabled_source_weighs_one(spark):
    e = spark.createDataFrame([(1, ["gone"], [1], NOW, "other", 1.0)], "id long, source_ids array<string>, article_ids array<long>, last_seen timestamp, category string, severity double")
    s = spark.createDataFrame([(1, "tech", 1.4, True)], "id long, topic string, severity double, relevant boolean")
    w = spark.createDataFrame([("other", 9.0)], "id string, weight double")
    r = screen.scored(e, s, w, F.lit(NOW).cast("timestamp")).first()
    assert (r["category"], r["severity"], r["score"]) == ("tech", 1.4, round(1.4 * 0.693147, 4))


def test_card_text(spark):
    rows = [(1, i, f"s{i}", f"T{i}", "x" * 500) for i in range(14)]
    a = spark.createDataFrame(rows, "event_id long, position long, source_id string, title string, content_text string")
    w = spark.createDataFrame([("s3", 2.0)], "id string, weight double")
    t = screen.card_text(a, w).first()["text"]
    assert t.startswith("T3. " + "x" * 400 + " T0. ") and t.endswith("其他报道标题: " + " ; ".join(f"T{i}" for i in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11)))


def test_summarize(spark):
    e = spark.createDataFrame([(1, "ev", "tech", 1.7, 2.0), (2, "empty", "other", 1.0, 1.0)], "id long, title string, category string, severity double, score double")
    a = spark.createDataFrame([(1, 0, 11, "s", "Low", "Low one. Low two.", 1.0), (1, 1, 12, "t", "High", "First sentence. Second. Third.", 2.0)], "event_id long, position long, id long, source_id string, title string, text string, weight double")
    one, two = summarize.summarize(e, a).orderBy("event_id").collect()
    assert (one["headline"], one["summary"], one["key_quotes"], one["citation_ids"], one["source_count"]) == ("High", "First sentence. Second.\nLow one. Low two.", ["First sentence.", "Low one."], [12, 11], 2)
    assert (two["headline"], two["summary"], two["citation_ids"]) == ("empty", "", [])


def articles(spark):
    return spark.createDataFrame([(1, "US acts", "u1", "They imposed new sanctions today on banks."), (3, "Talks", "u3", "Talks resumed in Geneva this week.")], "id long, title string, url string, text string")


def test_review(spark):
    items = spark.createDataFrame([(7, 7, "s", ["imposed new sanctions today", "this was never said at all"], [1, 99, 3]), (8, 8, " ", [], [99])], "item_id long, event_id long, summary string, key_quotes array<string>, citation_ids array<long>")
    reviewed = verify.review(items, articles(spark))
    one, two = reviewed.orderBy("item_id").collect()
    assert (one["citation_ids"], one["key_quotes"], one["quote_citations"], one["confidence"]) == ([1, 3], ["imposed new sanctions today"], [1], "low")
    assert one["issues"] == ["citation_unknown", "quote_span_missing"] and two["issues"] == ["citation_unknown", "citation_missing", "summary_empty"]
    r = verify.report(reviewed).first()
    assert (r["items"], r["quotes_total"], r["quotes_kept"], r["quotes_stripped"], r["citations_stripped"], r["low_confidence"]) == (2, 2, 1, 1, 2, 2)
    cited = verify.citations(reviewed, articles(spark)).orderBy("item_id", "pos").collect()
    assert [(c["article_id"], c["span"]) for c in cited] == [(1, "imposed new sanctions today"), (3, "Talks")]


STORY = "id long, title string, category string, severity double, first_seen timestamp, entities array<string>, articles array<struct<id:long,title:string,url:string,source_id:string,text:string>>"


def story(i, title, category, days, entities, severity=1.0):
    return (i, title, category, severity, NOW + dt.timedelta(days=days), entities, [(i * 11, title, f"u{i}", "s", f"{title} happened as reported. More.")])


def test_recall(spark):
    target = spark.createDataFrame([story(9, "sanctions on Russia widen", "diplomacy", 0, ["美国", "俄罗斯"])], STORY)
    past = spark.createDataFrame(
        [
            story(1, "Russia faces export limits", "diplomacy", -10, ["俄罗斯", "美国"]), story(2, "sanctions on Russia widen again", "diplomacy", -1, ["俄罗斯"]), story(3, "Football cup", "society", -5, ["巴西"]),
            story(4, "Russia later", "diplomacy", 2, ["俄罗斯"]), story(5, "Envoys meet", "diplomacy", -20, []), story(6, "Russia long ago", "diplomacy", -400, ["俄罗斯"]), story(7, "Russia next day", "diplomacy", 1, ["俄罗斯"]),
        ],
        STORY,
    )
    got = lineage.recall(target, past).orderBy("rank").collect()
    assert {r["prior_id"] for r in got} == {1, 5, 7} and got[0]["prior_id"] == 1 and got[0]["shared_entities"] == ["俄罗斯", "美国"]


def test_recall_prepares_only_targets_near_in_time(spark, monkeypatch):
    prepared, cut = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: prepared.append(out := cut(df)) or out)
    days = [-300, -11.001, -11, -10.5, 0, 100, 169.9, 170, 170.001, 400]
    targets = spark.createDataFrame([story(20 + i, "Sanctions on Russia widen", "diplomacy", d, ["美国"]) for i, d in enumerate(days)], STORY)
    past = spark.createDataFrame([story(1, "Envoys meet", "diplomacy", -10, ["美国"])], STORY)
    got = lineage.recall(targets, past, 6, 180)
    assert sorted(r["target_id"] for r in got.collect()) == list(range(22, 28))
    assert [df.count() for df in prepared] == [1, 6]
    assert lineage.recall(targets, past.limit(0), 6, 180).isEmpty()


def test_those_with_an_id(spark, monkeypatch):
    df, ids = spark.range(20), spark.createDataFrame([(3,), (3,), (5,), (None,), (99,)], "id long")
    for named, broadcast in ((2000, 10_000), (0, 10_000), (0, 0)):
        monkeypatch.setattr(lineage, "NAMED", named)
        monkeypatch.setattr(lineage, "BROADCAST_PAST", broadcast)
        assert sorted(r[0] for r in lineage._those(df, ids).collect()) == [3, 5]
        assert named == 0 or lineage._those(df, ids.limit(0)).isEmpty()


def test_trace_by_rule(spark):
    target = spark.createDataFrame([story(9, "Missile strike widens", "military", 0, ["美国", "俄罗斯"], 1.8)], STORY)
    past = spark.createDataFrame([story(1, "Troops gather near border", "military", -10, ["俄罗斯", "美国"], 1.4)], STORY)
    known = spark.createDataFrame([(99, "Missile strike widens", "u9", "Missile strike widens happened as reported. More."), (11, "Troops gather near border", "u1", "Troops gather near border happened as reported. More.")], "id long, title string, url string, text string")
    r = lineage.trace(target, past, known).first()
    assert (r["type"], r["confidence"], r["status"], {e["article_id"] for e in r["evidence"]}) == ("escalation", 0.5, "review", {99, 11})


def test_validate_distrusts(spark):
    target = spark.createDataFrame([story(9, "Now", "x", 0, ["a"])], STORY)
    past = spark.createDataFrame([story(i, f"Past {i}", "x", 1.5 if i == 3 else -1, ["a"]) for i in (1, 2, 3)], STORY)
    recalled = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "target_id long, prior_id long")
    told = spark.createDataFrame(
        [(9, 1, 1, "odd", "n", 1.7, [(11, "Past 1 happened as reported.")]), (9, 2, 2, "causal", "n", 0.9, [(22, "nobody ever said this")]), (9, 3, 3, "causal", "n", 0.2, [(33, "Past 3 happened as reported.")]), (9, 4, 4, "causal", "n", 0.9, [(11, "Past 1 happened as reported.")])],
        "target_id long, prior_id long, rank int, type string, narrative string, confidence double, evidence array<struct<article_id:long,span:string>>",
    )
    known = spark.createDataFrame([(i * 11, f"Past {i}", f"u{i}", f"Past {i} happened as reported. More.") for i in (1, 2, 3)], "id long, title string, url string, text string")
    got = lineage.validate(told, recalled, target, past, known).orderBy("rank").collect()
    assert [(r["prior_event_id"], r["type"], r["confidence"], r["status"]) for r in got] == [(1, "background", 1.0, "auto"), (3, "thematic_parallel", 0.2, "review")]
