"""DuckDB SQL for the registered queries. title_fuzzy_dedup has none, as DuckDB has no function like its
similarity; the tests compare it with plain Python. The clustering fold is a recursion over the articles of all sessions at once."""

from __future__ import annotations

from skyloom.lexicon import IMPACT_OTHER, IMPACTS, STOPWORDS, TRACKING_PARAMS
from skyloom.plans.queries import RULES, WORDS

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)

_CANONICAL = rf"""
canonical AS (
  SELECT page_id, url, 'https://' || host || path || CASE WHEN tail = '' THEN '' ELSE '?' || tail END AS canonical
  FROM (
    SELECT page_id, url, lower(regexp_extract(regexp_extract(regexp_extract(place, '^//([^/]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1)) AS host,
           CASE WHEN p = '' THEN '/' WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END AS path,
           array_to_string(list_sort(list_filter(string_split(query, '&'),
             lambda x: regexp_matches(x, '^[^=]*=.') AND NOT list_contains([{_quoted(TRACKING_PARAMS)}], string_split(x, '=')[1]))), '&') AS tail
    FROM (
      SELECT page_id, url, place, query, regexp_replace(place, '^//[^/]*', '') AS p
      FROM (SELECT page_id, url, regexp_extract(body, '^([^?]*)', 1) AS place, regexp_extract(body, '^[^?]*\?(.*)$', 1) AS query
            FROM (SELECT page_id, url, regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*:', ''), '^([^#]*)', 1) AS body FROM pages)))))"""

_TITLE = r"left(regexp_extract(text, '^([^\n]*)', 1), 80)"
_TOKENS = rf"list_filter(list_transform(regexp_extract_all(%s, '[a-zA-Z]{{2,}}|[0-9]+'), lambda x: lower(x)), lambda x: NOT list_contains([{_quoted(STOPWORDS)}], x))"


def _entities(column: str) -> str:
    cases = [f"CASE WHEN {' OR '.join(f'''regexp_matches(lower({column}), '(^|[^a-z0-9]){a}([^a-z0-9]|$)')''' for a in aliases)} THEN '{name}' END" for name, aliases in WORDS]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def _hits(column: str, words) -> str:
    return " + ".join(f"regexp_matches({column}, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_]){w}(s|es|ed|ing)?([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)')::INT" for w in words)


def _first(rules, otherwise: str, quote: str) -> str:
    cases = [f"WHEN ({_hits('title', w)}) >= 1 OR ({_hits('body', w)}) >= 2 THEN {quote}{name}{quote}" for name, w in rules]
    return f"CASE {' '.join(cases)} ELSE {otherwise} END"


_WEIGHTS = r"weights AS (SELECT DISTINCT source, 0.5 + regexp_extract(source, '(\d+)', 1)::INT % 10 / 10 AS weight FROM documents)"
_TIMED = r"timed AS (SELECT doc_id AS id, source, lang, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 30 + (doc_id // 100) * 4800) AS published_at FROM documents)"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(9) || chr(10) || chr(13) || ' ')), lambda s: s <> '')"
_NORMAL = r"trim(regexp_replace(replace(lower(%s), 'ß', 'ss'), '\s+', ' ', 'g'))"

_REVIEW = rf"""
a AS (SELECT doc_id AS id, {_TITLE} AS title, text FROM documents),
shot AS (SELECT id, {_NORMAL % "title || ' ' || text"} AS s FROM a),
cited AS (SELECT a.id AS item_id, c.pos, c.id AS cid, shot.s FROM a, LATERAL (VALUES (1, a.id), (2, a.id + 1), (3, -1)) c(pos, id) LEFT JOIN shot ON shot.id = c.id),
quote AS (SELECT id AS item_id, unnest(range(1, len(q) + 1)) AS qpos, unnest(q) AS quote
          FROM (SELECT id, list_concat(list_transform(list_slice({_SENTENCES}, 1, 2), lambda s: left(s, 220)), ['never said by any of these']) AS q FROM a)),
bound AS (SELECT q.item_id, q.qpos, q.quote, arg_min(c.cid, c.pos) FILTER (WHERE length({_NORMAL % "q.quote"}) >= 12 AND contains(c.s, {_NORMAL % "q.quote"})) AS article_id
          FROM quote q JOIN cited c ON c.item_id = q.item_id AND c.s IS NOT NULL GROUP BY ALL),
per AS (SELECT item_id, count(*) AS n, count(article_id) AS kept,
               string_agg(article_id::VARCHAR, ',' ORDER BY qpos) AS bound,
               repeat('quote_span_missing,', (count(*) - count(article_id))::INT) AS missing
        FROM bound GROUP BY item_id),
known AS (SELECT item_id, string_agg(cid::VARCHAR, ',' ORDER BY pos) FILTER (WHERE s IS NOT NULL) AS cited, count(*) FILTER (WHERE s IS NULL) AS unknown FROM cited GROUP BY item_id),
reviewed AS (
  SELECT a.id AS item_id, a.title, cited, coalesce(bound, '') AS bound, n, kept, unknown,
         rtrim('citation_unknown,' || missing || CASE WHEN trim(title) = '' THEN 'summary_empty' ELSE '' END, ',') AS issues
  FROM a JOIN known ON known.item_id = a.id JOIN per ON per.item_id = a.id)"""

_STORIES = rf"""
s AS (SELECT doc_id AS id, lang, list_distinct({_entities("text")}) AS e, list_distinct({_TOKENS % _TITLE}) AS t FROM documents),
h AS (SELECT * FROM s ORDER BY id DESC LIMIT 500),
j AS (SELECT a.id AS target_id, h.id AS prior_id, list_sort(list_intersect(a.e, h.e)) AS shared,
             CASE WHEN len(a.e) > 0 AND len(h.e) > 0 THEN len(list_intersect(a.e, h.e)) / len(list_distinct(list_concat(a.e, h.e))) ELSE 0 END AS ent,
             CASE WHEN len(a.t) > 0 AND len(h.t) > 0 THEN len(list_intersect(a.t, h.t)) / len(list_distinct(list_concat(a.t, h.t))) ELSE 0 END AS lex,
             (a.lang = h.lang)::INT AS topic, abs(a.id - h.id) * 3607 / 86400 AS days
      FROM s a JOIN h ON (h.id - a.id) * 3607 <= 86400 AND abs(h.id - a.id) * 3607 <= 180 * 86400),
r AS (SELECT *, 0.45 * ent + 0.25 * lex + 0.15 * greatest(0, 1 - days / 180) + 0.15 * topic AS rel FROM j),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rel DESC, prior_id DESC) AS n FROM r
  WHERE lex < 0.6 AND rel >= 0.15 AND (len(shared) > 0 OR lex >= 0.15 OR topic = 1))"""

_alike = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_CLUSTERS = rf"""
art AS (SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 30 + (doc_id // 100) * 4800) AS ts, list_distinct(list_slice({_entities("text")}, 1, 12)) AS e,
               list_distinct({_TOKENS % f"({_TITLE} || ' ' || left(text, 500))"}) AS t FROM documents),
cut AS (SELECT *, sum(new) OVER (ORDER BY ts, id) AS session FROM (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts, id)) > 72 * 3600, false)::INT AS new FROM art)),
turn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS k FROM cut),
fold(session, k, ev, pick) AS (
  SELECT DISTINCT session, 0::BIGINT, []::STRUCT(fe VARCHAR[], ft VARCHAR[], e VARCHAR[], t VARCHAR[], l TIMESTAMP)[], 0::BIGINT FROM turn
  UNION ALL
  SELECT session, k, CASE WHEN best > len(ev) THEN list_append(ev, {{'fe': e, 'ft': t, 'e': e, 't': t, 'l': ts}})
                     ELSE list_transform(ev, lambda x, i: CASE WHEN i = best THEN {{'fe': x.fe, 'ft': x.ft, 'e': list_distinct(list_concat(x.e, e)), 't': list_distinct(list_concat(x.t, t)), 'l': greatest(x.l, ts)}} ELSE x END) END, best
  FROM (SELECT *, CASE WHEN coalesce(list_max(scores), 0) >= 0.30 THEN list_position(scores, list_max(scores)) ELSE len(ev) + 1 END::BIGINT AS best
        FROM (SELECT a.*, ev, list_transform(list_transform(ev, lambda x: {{'in': abs(epoch(ts) - epoch(x.l)) <= 72 * 3600,
                       'e': greatest({_alike("a.e", "x.e")}, {_alike("a.e", "x.fe")}), 't': greatest({_alike("a.t", "x.t")}, {_alike("a.t", "x.ft")}),
                       'n': greatest(len(list_intersect(a.e, x.e)), len(list_intersect(a.e, x.fe)))}}),
                     lambda s: CASE WHEN NOT s['in'] THEN 0 WHEN s['t'] >= 0.35 THEN s['t'] WHEN s['e'] >= 0.67 AND s['n'] >= 2 THEN s['e'] WHEN s['e'] >= 0.5 AND s['t'] >= 0.15 THEN (s['e'] + s['t']) / 2 ELSE 0 END) AS scores
              FROM fold f JOIN turn a ON a.session = f.session AND a.k = f.k + 1))),
before AS (SELECT session, coalesce(sum(n) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0 FROM (SELECT session, max(pick) AS n FROM fold GROUP BY session)),
clustered AS (SELECT turn.id, turn.ts, (n0 + pick)::BIGINT AS cluster_id FROM turn JOIN fold USING (session, k) JOIN before USING (session))"""

ORACLES: dict[str, str] = {
    "url_canonicalize": f"WITH {_CANONICAL} SELECT page_id, canonical, sha256(canonical) AS url_hash FROM canonical",
    "url_dedup": f"WITH {_CANONICAL} SELECT min(page_id) AS page_id, sha256(canonical) AS url_hash FROM canonical GROUP BY canonical",
    "insert_if_absent": f"""WITH {_CANONICAL} SELECT page_id, sha256(canonical) AS url_hash FROM canonical
        WHERE NOT starts_with(url, 'https') AND canonical NOT IN (SELECT canonical FROM canonical WHERE starts_with(url, 'https'))""",
    "upsert_sources": """WITH new AS (SELECT s_nationkey AS id, 's' || count(*)::VARCHAR AS name FROM supplier GROUP BY 1)
        SELECT coalesce(new.id, n_nationkey) AS id, coalesce(new.name, n_name) AS name, CASE WHEN new.id IS NULL THEN 'old' ELSE 'new' END AS state,
               CASE WHEN n_nationkey IS NULL THEN 'unknown' ELSE 'ok' END AS health
        FROM nation FULL JOIN new ON new.id = n_nationkey""",
    "strip_html": r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'),
        '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS plain FROM pages""",
    "feed_articles": f"WITH {_CANONICAL} SELECT page_id::VARCHAR AS source_id, sha256(canonical) AS url_hash, '2024-01-01 10:00:00' AS published FROM canonical",
    "lang_detect": """SELECT doc_id, 'en' AS detected, round(length(regexp_replace(text, '[^À-ÿ]', '', 'g')) / greatest(length(text), 1), 6) AS accents,
        round(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(length(text), 1), 6) AS latin FROM documents""",
    "token_stats": f"SELECT doc_id, len({_TOKENS % 'text'})::INT AS n_tokens, len(list_distinct({_TOKENS % 'text'}))::INT AS n_different FROM documents",
    "entity_scan": f"SELECT doc_id, array_to_string(list_slice({_entities('text')}, 1, 3), ',') AS entities FROM documents",
    "title_tokens_jaccard": f"""WITH t AS (SELECT doc_id AS id, list_distinct({_TOKENS % _TITLE}) AS k FROM documents)
        SELECT a.id, round(CASE WHEN len(a.k) > 0 AND len(b.k) > 0 THEN len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) ELSE 0 END, 6) AS similarity
        FROM t a JOIN t b ON b.id = a.id + 1""",
    "topic_severity": f"""WITH c AS (SELECT doc_id AS id, {_TITLE} AS title, left(text, 1200) AS body FROM documents),
        k AS (SELECT id, {_first(RULES.topics, "'other'", "'")} AS topic, {_first(RULES.severities, "1.0", "")}::DOUBLE AS severity FROM c)
        SELECT id, topic, severity, topic <> 'other' AS relevant FROM k""",
    "hot_score_topk": f"""WITH {_WEIGHTS}, {_TIMED},
        e AS (SELECT lang || '-' || strftime(published_at, '%Y-%m-%d') AS id, lang, count(*) AS n, count(DISTINCT source) AS s, max(weight) AS w, max(published_at) AS seen FROM timed JOIN weights USING (source) GROUP BY 1, 2)
        SELECT id, lang AS category, round(w * (1 + 0.25 * (s - 1)) * ln(1 + n) * CASE lang WHEN 'en' THEN 1.0 ELSE 1.4 END
               * exp(-greatest(epoch(TIMESTAMP '2024-01-02') - epoch(seen), 0) / 3600 / 48), 4) AS score
        FROM e ORDER BY score DESC, id LIMIT 6""",
    "source_topn": f"""WITH h AS (SELECT source AS source_id, doc_id AS id, {_hits("text", ("the", "and", "les", "und", "los", "from"))} AS hits FROM documents)
        SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY hits DESC, id) <= 3""",
    "articles_window": "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-29'",
    "gap_sessions": """SELECT event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session
        FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > INTERVAL 24 HOUR, false)::INT AS new FROM events)""",
    "latest_status": """WITH f AS (SELECT user_id, arg_max(CASE WHEN value > 80 THEN 'confirmed' ELSE 'rejected' END, event_id) AS s FROM events WHERE value > 80 OR value < 10 GROUP BY user_id)
        SELECT DISTINCT e.user_id AS id, coalesce(s, 'review') AS status FROM events e LEFT JOIN f USING (user_id)""",
    "feedback_list": "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 20",
    "top8_per_group": """SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) <= 8""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "events", "labels", "orders", "customer")),
    "events_by_day": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS greatest, count_if(value > 50)::BIGINT AS large
        FROM events GROUP BY 1, 2""",
    "review_items": f"WITH {_REVIEW} SELECT item_id, cited, bound, issues, 'low' AS confidence FROM reviewed",
    "review_report": f"""WITH {_REVIEW} SELECT count(*) AS items, sum(n)::BIGINT AS quotes_total, sum(kept)::BIGINT AS quotes_kept, sum(n - kept)::BIGINT AS quotes_stripped,
        sum(unknown)::BIGINT AS citations_stripped, count(*) AS low_confidence FROM reviewed""",
    "reference_numbers": """WITH c AS (SELECT s_suppkey AS p, unnest([s_nationkey, 24 - s_nationkey])::BIGINT AS article_id, unnest([0, 1]) AS i FROM supplier),
        f AS (SELECT article_id, min((p, i)) AS place FROM c GROUP BY 1)
        SELECT article_id, row_number() OVER (ORDER BY place)::INT AS n FROM f""",
    "recall_join": f"WITH {_STORIES} SELECT target_id, prior_id, round(rel, 4) AS score, array_to_string(list_slice(shared, 1, 8), ',') AS shared FROM ranked WHERE n <= 6",
    "card_text": f"""WITH {_WEIGHTS},
        r AS (SELECT lang, {_TITLE} AS title, left(coalesce(text, ''), 400) AS lead, row_number() OVER (PARTITION BY lang ORDER BY coalesce(weight, 1) DESC, doc_id) AS n FROM documents LEFT JOIN weights USING (source)),
        e AS (SELECT lang, string_agg(trim(title || '. ' || lead), ' ' ORDER BY n) FILTER (WHERE n <= 2) AS leads, coalesce(string_agg(title, ' ; ' ORDER BY n) FILTER (WHERE n BETWEEN 3 AND 12), '') AS others FROM r GROUP BY lang)
        SELECT (ascii(lang) * 1000 + ascii(lang[2:2]))::BIGINT AS event_id, left(leads || CASE WHEN others = '' THEN '' ELSE ' || 其他报道标题: ' || others END, 1600) AS text FROM e""",
    "summaries": f"""WITH {_WEIGHTS},
        r AS (SELECT doc_id, source, {_TITLE} AS title, text, row_number() OVER (PARTITION BY source ORDER BY weight + length({_TITLE}) / 1000 DESC, doc_id) AS n FROM documents JOIN weights USING (source)),
        s AS (SELECT source, n, doc_id, left(title, 80) AS title, array_to_string(list_transform(list_slice({_SENTENCES}, 1, 2), lambda x: left(x, 220)), ' ') AS lead FROM r WHERE n <= 4),
        e AS (SELECT regexp_extract(source, '(\\d+)', 1)::BIGINT AS event_id, max(title) FILTER (WHERE n = 1) AS headline, coalesce(string_agg(lead, chr(10) ORDER BY n) FILTER (WHERE n <= 2 AND lead <> ''), '') AS summary, string_agg(doc_id::VARCHAR, ',' ORDER BY n) AS cited FROM s GROUP BY source)
        SELECT event_id, headline, sha256(CASE WHEN summary = '' THEN headline ELSE summary END) AS summary_sha256, cited, CASE WHEN event_id % 2 = 0 THEN '{IMPACTS[0][1]}' ELSE '{IMPACT_OTHER}' END AS impact, 1::BIGINT AS source_count FROM e""",
    "item_citations": f"""WITH {_REVIEW},
        c AS (SELECT item_id, 0 AS k, qpos AS p, article_id, quote AS span FROM bound WHERE article_id IS NOT NULL
              UNION ALL SELECT item_id, 1, pos, cid, coalesce(title, '') FROM cited JOIN a ON a.id = cid
              WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bound WHERE bound.item_id = cited.item_id AND bound.article_id = cid))
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY k, p) - 1)::INT AS pos, article_id, sha256(span) AS span_sha256, 'u' || article_id AS url, span <> '' AS verified FROM c""",
    "trace_relations": f"""WITH {_STORIES},
        lead AS (SELECT doc_id AS id, left(({_SENTENCES})[1], 220) AS q, {_NORMAL % f"{_TITLE} || ' ' || text"} AS s FROM documents),
        ok AS (SELECT id, coalesce(length({_NORMAL % "q"}) >= 12 AND contains(s, {_NORMAL % "q"}), false)::INT AS ok FROM lead)
        SELECT target_id AS target_event_id, prior_id AS prior_event_id, 'background' AS type, round(least(0.6, 0.3 + 0.1 * least(len(shared), 3)), 2)::DOUBLE AS confidence, 'review' AS status, (p.ok + t.ok)::INT AS n_evidence
        FROM ranked JOIN ok p ON p.id = prior_id JOIN ok t ON t.id = target_id WHERE n <= 6 AND len(shared) > 0 AND p.ok + t.ok > 0
        QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY least(len(shared), 3) DESC, n, prior_id) <= 3""",
    "numbered_documents": "SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS number, doc_id, md5(text) AS text_md5 FROM documents",
    "json_objects": rf"""SELECT doc_id AS id, md5('a "' || regexp_replace({_TITLE}, '[\x00-\x1f"\\]', '', 'g') || '" b') AS title_md5, doc_id AS read_id FROM documents""",
    "cjk_tokens": f"""WITH t AS (SELECT doc_id, lower({_TITLE}) AS t, regexp_extract_all(lower({_TITLE}), '[a-z]') AS c, regexp_extract_all({_TITLE}, '[0-9]+') AS n FROM documents)
        SELECT doc_id AS id, CASE WHEN len(c) / greatest(length(t), 1) > 0.15 THEN 'zh' ELSE 'en' END AS detected, (len(c) + len(n))::INT AS n_tokens,
               (len(list_distinct(c)) + len(list_distinct(n)) + len(list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]))))::INT AS n_different FROM t""",
    "online_cluster": f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster_id FROM clustered",
    "scored_events": f"""WITH RECURSIVE {_CLUSTERS}, {_WEIGHTS},
        ev AS (SELECT cluster_id AS id, arg_min({_TITLE}, (ts, c.id)) AS title, count(*) AS n, count(DISTINCT source) AS s, max(weight) AS w, max(ts) AS seen
               FROM clustered c JOIN documents d ON d.doc_id = c.id JOIN weights USING (source) GROUP BY cluster_id),
        card AS (SELECT *, left(title, 1200) AS body FROM ev),
        k AS (SELECT *, {_first(RULES.topics, "'other'", "'")} AS category, {_first(RULES.severities, "1.0", "")}::DOUBLE AS severity FROM card)
        SELECT id, title, category, severity, n::INT AS n_articles, s::INT AS n_sources,
               round(w * (1 + 0.25 * (s - 1)) * ln(1 + n) * severity * exp(-greatest(epoch(TIMESTAMP '2024-01-02') - epoch(seen), 0) / 3600 / 48), 4) AS score
        FROM k WHERE category <> 'other'""",
}
