"""The queries of this package in SQL, for a check against another engine."""

_CANDIDATES = r"""
c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS candidate_id, lang AS run_id,
        left(split_part(text, chr(10), 1), 280) || (CASE WHEN doc_id % 3 <> 2 THEN ' API v' || CAST(doc_id % 5 AS VARCHAR) ELSE '' END)
          || (CASE WHEN doc_id % 7 = 0 THEN ' may' ELSE '' END) AS title,
        left(text, 2400) AS summary, source, CAST(1 + doc_id % 3 AS INTEGER) AS source_tier,
        round(0.70 + 0.05 * (doc_id % 7), 2)::DOUBLE AS source_weight, (doc_id % 240)::BIGINT AS age,
        doc_id % 2 = 0 AS is_global, doc_id * 37 % 5000 AS stars FROM documents),
s AS (SELECT *, title || ' ' || summary AS body FROM c),
f AS (SELECT *, regexp_matches(body, '(?i)(^|[^\pL\pM\pN_])(api|sdk|model|benchmark|license|pricing|price|tokens?|parameters?|revenue|customers?|effective|v[0-9]+(\.[0-9]+)*)($|[^\pL\pM\pN_])|[0-9]+(\.[0-9]+)?\s*(%|x|b|m|k|usd|dollars?|tokens?|params?)') AS specific,
        regexp_matches(body, '(?i)(^|[^\pL\pM\pN_])(may|might|could|potential|future|有望|预示|潜力|值得关注)($|[^\pL\pM\pN_])') AS weak,
        regexp_matches(body, '(?i)[0-9]|(^|[^\pL\pM\pN_])(api|sdk|v[0-9])($|[^\pL\pM\pN_])') AS concrete FROM s),
r AS (SELECT *, round(CASE source_tier WHEN 1 THEN 40 WHEN 2 THEN 25 ELSE 10 END + greatest(0.0, 30 - greatest(0, age) / 4.0) + (CASE WHEN specific THEN 25 ELSE 0 END)
        + source_weight * 5 + least(10.0, log10(stars + 1) * 3), 6)::DOUBLE AS rough_score FROM f WHERE specific AND (NOT weak OR concrete)),
t AS (SELECT * FROM (SELECT run_id, candidate_id, source, age, rough_score, row_number() OVER (PARTITION BY run_id ORDER BY rough_score DESC, candidate_id) AS rank FROM r) WHERE rank <= 20)
"""

_SCORED = """
k AS (SELECT o_orderkey AS item, o_orderpriority AS run_id, o_custkey AS fingerprint, c_nationkey AS company, 'c' || CAST(o_orderkey % 5 AS VARCHAR) AS category,
        CAST(o_orderkey * 7 % 26 AS INTEGER) AS relevance, CAST(o_orderkey * 11 % 21 AS INTEGER) AS actionability, CAST(o_orderkey * 13 % 16 AS INTEGER) AS specificity,
        CAST(o_orderkey * 5 % 16 AS INTEGER) AS information_gain, CAST(o_orderkey * 3 % 16 AS INTEGER) AS evidence_quality, CAST(o_orderkey * 17 % 11 AS INTEGER) AS time_sensitivity,
        CAST(0 - o_orderkey % 3 * 10 AS INTEGER) AS penalties, o_orderkey % 4 <> 0 AS eligible_main, o_orderkey % 6 <> 1 AS eligible_watch,
        o_orderkey % 3 <> 0 AS resource_available, CAST(o_orderkey % 20 AS INTEGER) AS horizon, epoch(o_orderdate)::BIGINT AS published
      FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (SELECT *, CAST(greatest(0, relevance + actionability + specificity + information_gain + evidence_quality + time_sensitivity + penalties) AS INTEGER) AS total FROM k)
"""

_BY = "total DESC, information_gain DESC, evidence_quality DESC, published DESC, fingerprint, item"

_BOARDS = f"""
m1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY {_BY}) AS e FROM i WHERE eligible_main AND total >= 75 AND evidence_quality >= 12 AND information_gain >= 10),
m2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, company ORDER BY {_BY}) AS p FROM m1 WHERE e = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_BY}) AS rank FROM m2 WHERE p <= 2) WHERE rank <= 5),
u AS (SELECT run_id, company, count(*) AS used FROM m GROUP BY ALL),
t1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY {_BY}) AS e FROM i WHERE eligible_main AND total >= 62 AND actionability >= 14 AND resource_available AND horizon <= 7
        AND (run_id, fingerprint) NOT IN (SELECT (run_id, fingerprint) FROM m)),
t2 AS (SELECT t1.*, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY t1.run_id, t1.company ORDER BY {_BY}) AS p FROM t1 LEFT JOIN u USING (run_id, company) WHERE e = 1),
tn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_BY}) AS rank FROM t2 WHERE p <= 2 - used) WHERE rank <= 3),
w1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY {_BY}) AS e FROM i WHERE eligible_watch AND total >= 50
        AND (run_id, fingerprint) NOT IN (SELECT (run_id, fingerprint) FROM m UNION ALL SELECT (run_id, fingerprint) FROM tn)),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_BY}) AS rank FROM w1 WHERE e = 1) WHERE rank <= 3),
b AS (SELECT run_id, 'must_read' AS board, rank, item, fingerprint, company, total, category FROM m UNION ALL SELECT run_id, 'try_now', rank, item, fingerprint, company, total, category FROM tn
      UNION ALL SELECT run_id, 'watch', rank, item, fingerprint, company, total, category FROM w)
"""

_GLOBAL = """
ge AS (SELECT *, row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY total DESC, time_sensitivity DESC, evidence_quality DESC, published DESC, fingerprint, item) AS e FROM i WHERE total >= 65 AND item % 4 <> 0),
gc AS (SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY total DESC, time_sensitivity DESC, evidence_quality DESC, published DESC, fingerprint, item) AS n FROM ge WHERE e = 1),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, time_sensitivity DESC, evidence_quality DESC, published DESC, fingerprint, item) AS rank FROM gc WHERE n <= 2) WHERE rank <= 5)
"""

_URL = r"""
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), ':443$', '') AS site,
        regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
v AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
        AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'source')), '&') AS kept FROM u),
p AS (SELECT page_id, url, scheme || '://' || site || (CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END) || (CASE WHEN kept = '' THEN '' ELSE '?' || kept END) AS canonical, regexp_replace(site, ':[0-9]*$', '') AS host FROM v)
"""

_EVENTS = """
ev AS (SELECT event_id, 'technical' AS lane, 'user' || CAST(user_id AS VARCHAR) AS company, event_type AS product, coalesce(json_extract_string(props, '$.k'), '') AS version,
        event_id % 5 = 0 AS resource, event_id % 7 = 0 AS science, ts,
        'user' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || event_type || '|' || coalesce(json_extract_string(props, '$.k'), '') || '|' AS fp FROM events),
cu AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-25'),
hi AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-24' AND date_diff('day', CAST(ts + INTERVAL 8 HOUR AS DATE), CAST(TIMESTAMP '2024-01-24 23:59:59' + INTERVAL 8 HOUR AS DATE)) BETWEEN 0 AND 7)
"""

_HISTORY = "hs AS (SELECT canonical, max(page_id % 45) AS oldest, min(page_id % 45) AS newest FROM p GROUP BY canonical)"

_RECORD = """
q AS (SELECT item, run_id,
        CASE WHEN item % 12 = 0 THEN 'duplicate' WHEN item % 12 = 1 THEN 'minor_update' WHEN item % 12 = 2 THEN 'material_update' ELSE 'unique' END AS status,
        item % 5 NOT IN (0, 1) AS dated, item % 7 <> 0 AS verified, item % 3 = 0 AS secondary FROM i),
y AS (SELECT *, list_filter([
        CASE WHEN item % 11 = 0 THEN 'funding_only' END, CASE WHEN item % 13 = 0 THEN 'opinion_without_evidence' END,
        CASE WHEN item % 4 = 0 AND NOT (item % 6 <> 0 AND dated) THEN 'policy_without_terms_or_date' END, CASE WHEN item % 17 = 0 THEN 'vague_claim_without_evidence' END,
        CASE WHEN item % 19 = 0 THEN 'title_body_conflict' END, CASE WHEN item % 9 = 0 AND item % 2 <> 0 THEN 'scientific_claim_unverified' END,
        CASE WHEN item % 23 = 0 THEN 'missing_concrete_change' END, CASE WHEN item % 29 = 0 THEN 'missing_action' END,
        CASE WHEN item % 31 = 0 THEN 'missing_affected_audience' END, CASE WHEN item % 37 = 0 THEN 'missing_affected_area' END,
        CASE WHEN item % 41 = 0 OR item % 43 = 0 THEN 'invalid_evidence_anchor' END, CASE WHEN status IN ('duplicate', 'minor_update') THEN 'duplicate_without_material_update' END,
        CASE WHEN NOT verified OR secondary THEN 'unverified_primary_source' END], lambda x: x IS NOT NULL) AS why FROM q)
"""

ORACLE_SQL = {
    "w2_technical_shortlist": f"WITH {_CANDIDATES} SELECT run_id, candidate_id, rank, rough_score FROM t",
    "w3_global_shortlist": f"""WITH {_CANDIDATES} SELECT * FROM (SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id
        ORDER BY CASE WHEN age <= 48 THEN 0 ELSE 1 END, source_tier, source_weight DESC, age, candidate_id) AS rank, source_tier, source_weight FROM c WHERE is_global AND age <= 168) WHERE rank <= 20""",
    "w1_candidate_cap": f"WITH {_CANDIDATES} SELECT * FROM (SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY age, source_weight DESC, candidate_id) AS rank FROM c) WHERE rank <= 80",
    "w9_fallback_merge": f"""WITH {_CANDIDATES} SELECT * FROM (SELECT c.run_id, c.candidate_id, row_number() OVER (PARTITION BY c.run_id
        ORDER BY t.rank NULLS LAST, c.age, c.source_weight DESC, c.candidate_id) AS place FROM c LEFT JOIN t USING (candidate_id)) WHERE place <= 80""",
    "w10_adaptive_window": f"""WITH {_CANDIDATES}, e AS (SELECT DISTINCT run_id FROM r WHERE age <= 3),
        x AS (SELECT c.*, e.run_id IS NULL AS expanded FROM c LEFT JOIN e USING (run_id) WHERE age <= 168 AND (e.run_id IS NULL OR age <= 3))
        SELECT run_id, expanded, count(*) AS n, max(doc_id) AS last_doc FROM x GROUP BY ALL""",
    "w11_heuristic_rank": f"""WITH {_CANDIDATES}, h AS (SELECT run_id, candidate_id, round(source_weight * 50 + greatest(0.0, 1 - age / 168.0) * 25 + log10(stars + 1) * 8, 6)::DOUBLE AS score FROM c)
        SELECT * FROM (SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, candidate_id) AS rank, score FROM h) WHERE rank <= 10""",
    "f1_ai_window": f"""WITH {_CANDIDATES} SELECT candidate_id, run_id FROM c WHERE age <= 36 AND len(list_filter([' ai ', 'artificial intelligence', 'llm', 'large language model', 'gpt', 'openai', 'claude', 'anthropic', 'gemini',
        'deepmind', 'llama', 'qwen', 'deepseek', 'mistral', 'codex', 'copilot', 'cursor', 'agent', 'model context protocol', ' mcp ', 'skill', 'image generation', 'video generation', 'diffusion', 'comfyui', 'multimodal', 'transformer',
        'inference', '生成式', '人工智能', '大模型', '智能体'], lambda x: contains(lower(' ' || title || ' ' || summary || ' '), x))) > 0""",
    "f4_specific": f"WITH {_CANDIDATES} SELECT run_id, count(*) FILTER (specific) AS n_specific, count(*) FILTER (specific AND (NOT weak OR concrete)) AS n_shortlistable, count(*) AS n FROM f GROUP BY run_id",
    "f12_dashboard_filter": """SELECT p_partkey, p_brand, p_size FROM part WHERE (p_brand = 'Brand#1' OR p_partkey % 5 + 1 = 1) AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '1')""",
    "t3_canonical_url": f"WITH {_URL} SELECT page_id, canonical, left(sha256(canonical), 16) AS stable_id, host FROM p",
    "t6_truncate": r"""WITH x AS (SELECT doc_id, text, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS flat, length(regexp_replace(text, '[^㐀-鿿]', '', 'g')) AS wide FROM documents)
        SELECT doc_id, CASE WHEN length(flat) <= 120 THEN flat ELSE rtrim(left(flat, 119)) || '…' END AS short, CAST(wide + ceil((length(text) - wide) / 3.0) AS BIGINT) AS tokens,
        length(regexp_replace(text, '[^㐀-䶿一-鿿]', '', 'g')) >= 2 AS chinese FROM x""",
    "j1_unsent": f"WITH {_URL}, {_HISTORY} SELECT page_id FROM p WHERE canonical NOT IN (SELECT canonical FROM hs WHERE newest <= 30)",
    "k4_url_history": f"""WITH {_URL}, {_HISTORY}, z AS (SELECT canonical, page_id % 45 AS days FROM p UNION ALL SELECT canonical, 0 FROM hs WHERE newest > 30)
        SELECT canonical AS url, (epoch(TIMESTAMP '2026-07-14 12:00:00') - 86400 * min(days))::BIGINT AS recorded FROM z GROUP BY canonical HAVING min(days) <= 30""",
    "j6_event_classification": f"""WITH {_EVENTS},
        ex AS (SELECT fp, arg_max(resource, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS o_resource, arg_max(science, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS o_science,
               arg_max(ts, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS o_ts, any_value(company) AS company, any_value(product) AS product, any_value(version) AS version FROM hi GROUP BY fp),
        nr AS (SELECT c.event_id, x.fp, x.version, x.o_resource, x.o_science, row_number() OVER (PARTITION BY c.event_id ORDER BY x.o_ts DESC, x.fp DESC) AS n
               FROM cu c JOIN ex x ON c.company = x.company AND c.product = x.product WHERE c.fp NOT IN (SELECT fp FROM ex))
        SELECT c.event_id, c.fp AS fingerprint,
          CASE WHEN e.fp IS NOT NULL THEN CASE WHEN (c.resource AND NOT e.o_resource) OR (c.science AND NOT e.o_science) THEN 'material_update' ELSE 'duplicate' END
               WHEN n.fp IS NOT NULL THEN CASE WHEN c.version <> n.version OR (c.resource AND NOT n.o_resource) OR (c.science AND NOT n.o_science) THEN 'material_update' ELSE 'minor_update' END ELSE 'unique' END AS dup_status,
          CASE WHEN e.fp IS NOT NULL THEN CASE WHEN (c.resource AND NOT e.o_resource) OR (c.science AND NOT e.o_science) THEN e.fp END ELSE n.fp END AS update_of
        FROM cu c LEFT JOIN ex e ON c.fp = e.fp LEFT JOIN nr n ON c.event_id = n.event_id AND n.n = 1""",
    "f16_global_records": r"""WITH x AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, left(split_part(coalesce(text, ''), chr(10), 1), 200) AS title, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents),
        y AS (SELECT *, string_split(title, ' ')[1] LIKE '%s' AS crashes, regexp_matches(title, '[0-9]') AS digits, trim(regexp_replace(title, '\s+', ' ', 'g')) AS quote FROM x),
        z AS (SELECT *, CASE WHEN crashes THEN 'failed' WHEN NOT digits AND length(title) < 4 OR length(title) + 2 < 4 THEN 'bad_field' ELSE '' END AS failure,
                CAST(CASE WHEN NOT digits AND quote <> '' AND contains(lower(flat), lower(quote)) THEN 1 ELSE 0 END + CASE WHEN contains(lower(flat), lower(quote || ' ✗')) THEN 1 ELSE 0 END AS INTEGER) AS n FROM y)
        SELECT id AS candidate_id, CASE WHEN failure <> '' THEN '' WHEN doc_id % 3 = 0 THEN 'official_announcement' ELSE 'trusted_secondary' END AS source_type,
          CASE WHEN failure <> '' THEN '' WHEN length(flat) < 80 THEN 'insufficient' WHEN n = 0 THEN 'insufficient' ELSE 'verified' END AS status,
          CASE WHEN failure <> '' THEN -1 ELSE n END AS n_anchors, failure, CASE failure WHEN 'failed' THEN 'ValueError: no answer' WHEN 'bad_field' THEN '$.evidence_anchors[0].quote' ELSE '' END AS detail FROM z""",
    "y2_extraction": r"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS id, left(split_part(coalesce(text, ''), chr(10), 1), 200) AS title, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS n FROM documents),
        y AS (SELECT *, string_split(title, ' ') AS w FROM x),
        z AS (SELECT *, list_position([NOT (length(v) BETWEEN 1 AND 12) FOR v IN w[1:3]], true) AS bad FROM y),
        o AS (SELECT *, CASE WHEN regexp_matches(title, '[0-9]') THEN 'not_json' WHEN bad > 0 THEN 'bad_field' WHEN w[1] LIKE '%s' THEN 'other_id' ELSE 'ok' END AS outcome FROM z)
        SELECT id AS candidate_id, CAST(CASE WHEN outcome = 'ok' AND n <= 8000 THEN 1 ELSE 2 END AS INTEGER) AS attempts, outcome,
          CASE outcome WHEN 'bad_field' THEN '$.facts[' || (bad - 1) || '].name' WHEN 'other_id' THEN id || '0' ELSE '' END AS detail,
          CASE WHEN outcome = 'ok' THEN len(w) ELSE -1 END AS n_words,
          CASE WHEN outcome = 'ok' THEN array_to_string([v || ':' || length(v) FOR v IN w[1:3]], ' ') ELSE '' END AS facts FROM o""",
    "x2_event_memory": f"""WITH {_EVENTS}, d AS (SELECT *, date_trunc('day', ts) AS run, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0') AS at FROM ev),
        ex AS (SELECT r.run, h.fp, arg_max(h.resource, h.at) AS o_resource, arg_max(h.science, h.at) AS o_science, arg_max(h.ts, h.at) AS o_ts, any_value(h.company) AS company, any_value(h.product) AS product, any_value(h.version) AS version
               FROM (SELECT DISTINCT run FROM d) r JOIN d h ON h.ts < r.run AND date_diff('day', CAST(h.ts + INTERVAL 8 HOUR AS DATE), CAST(r.run + INTERVAL 86399 SECOND + INTERVAL 8 HOUR AS DATE)) BETWEEN 0 AND 7 GROUP BY r.run, h.fp),
        nr AS (SELECT c.event_id, x.fp, x.version, x.o_resource, x.o_science, row_number() OVER (PARTITION BY c.event_id ORDER BY x.o_ts DESC, x.fp DESC) AS n
               FROM d c JOIN ex x ON c.run = x.run AND c.company = x.company AND c.product = x.product WHERE (c.run, c.fp) NOT IN (SELECT (run, fp) FROM ex))
        SELECT c.event_id,
          CASE WHEN e.fp IS NOT NULL THEN CASE WHEN (c.resource AND NOT e.o_resource) OR (c.science AND NOT e.o_science) THEN 'material_update' ELSE 'duplicate' END
               WHEN n.fp IS NOT NULL THEN CASE WHEN c.version <> n.version OR (c.resource AND NOT n.o_resource) OR (c.science AND NOT n.o_science) THEN 'material_update' ELSE 'minor_update' END ELSE 'unique' END AS dup_status,
          CASE WHEN e.fp IS NOT NULL THEN CASE WHEN (c.resource AND NOT e.o_resource) OR (c.science AND NOT e.o_science) THEN e.fp END ELSE n.fp END AS update_of
        FROM d c LEFT JOIN ex e ON c.run = e.run AND c.fp = e.fp LEFT JOIN nr n ON c.event_id = n.event_id AND n.n = 1""",
    "k5_event_history": f"""WITH {_EVENTS}, z AS (SELECT *, 0 AS age FROM cu UNION ALL SELECT *, 1 FROM ev WHERE ts < TIMESTAMP '2024-01-24'),
        o AS (SELECT *, row_number() OVER (PARTITION BY lane, fp ORDER BY age, ts DESC, event_id) AS n FROM z)
        SELECT lane, fp AS fingerprint, event_id FROM o WHERE n = 1 AND date_diff('day', CAST(ts + INTERVAL 8 HOUR AS DATE), CAST(TIMESTAMP '2024-01-24 23:59:59' + INTERVAL 8 HOUR AS DATE)) BETWEEN 0 AND 7""",
    "k3_latest_by_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "k7_delivery_ledger": """WITH x AS (SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type AS target, ts, CASE WHEN event_id % 3 = 0 THEN 'published' ELSE 'no_qualifying_items' END AS run_status FROM events WHERE event_id % 3 <> 2)
        SELECT day, target, floor(epoch(ts))::BIGINT AS sent, run_status FROM (SELECT *, row_number() OVER (PARTITION BY day, target ORDER BY ts DESC, run_status DESC) AS n FROM x) WHERE n = 1""",
    "g8_corroboration": "SELECT l_partkey AS fingerprint, count(*) AS n_reports, count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS secondary_hosts FROM lineitem GROUP BY l_partkey",
    "j10_supporting_urls": """WITH x AS (SELECT l_partkey AS fingerprint, l_orderkey || '-' || l_linenumber AS candidate_id, 'https://host' || l_suppkey || '.example.com/' || l_orderkey || '-' || l_linenumber AS url FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY candidate_id, url) AS n FROM (SELECT fingerprint, url, min(candidate_id) AS candidate_id FROM x GROUP BY ALL)),
        l AS (SELECT fingerprint, list(url ORDER BY n) AS urls FROM o WHERE n <= 3 GROUP BY fingerprint)
        SELECT candidate_id, fingerprint, array_to_string(list_slice(list_filter(urls, lambda v: v <> url), 1, 2), ' ') AS supporting FROM x JOIN l USING (fingerprint)""",
    "w5_boards": f"WITH {_SCORED}, {_BOARDS} SELECT run_id, board, rank, item, fingerprint, company, total FROM b",
    "w8_global_selection": f"WITH {_SCORED}, {_GLOBAL} SELECT run_id, rank, item, category, total FROM g",
    "j11_without_global": f"WITH {_SCORED}, {_BOARDS}, {_GLOBAL} SELECT b.run_id, b.board, b.rank, b.item FROM b LEFT JOIN g ON b.run_id = g.run_id AND b.item = g.item WHERE g.item IS NULL OR b.item % 2 = 0",
    "j13_audit": f"WITH {_SCORED}, {_BOARDS} SELECT i.run_id, coalesce(b.board, 'none') AS board, count(*) AS n, max(i.total) AS best FROM i LEFT JOIN b ON i.run_id = b.run_id AND i.item = b.item GROUP BY ALL",
    "j14_external_selection": f"""WITH {_CANDIDATES}, l AS (SELECT doc_id, min(doc_id * 13 % 100) AS importance FROM labels GROUP BY doc_id),
        x AS (SELECT c.run_id, c.candidate_id, l.importance, l.doc_id, row_number() OVER (PARTITION BY c.run_id ORDER BY l.doc_id) AS n FROM l JOIN c ON l.doc_id = c.doc_id)
        SELECT run_id, candidate_id, importance, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, doc_id) AS rank FROM x WHERE n <= 12""",
    "w15_item_numbers": f"""WITH {_SCORED}, {_BOARDS} SELECT run_id, board, item, rank AS number, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id
        ORDER BY CASE board WHEN 'must_read' THEN 0 WHEN 'try_now' THEN 1 ELSE 2 END, rank) AS position FROM b) WHERE position <= 5""",
    "w16_byte_budget": """WITH x AS (SELECT source, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)
        SELECT source, count(*) AS n_blocks, max(used)::BIGINT AS used FROM x WHERE used <= 18000 GROUP BY source""",
    "w17_newest_listing": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS ordered FROM orders ORDER BY ordered DESC, o_orderkey DESC LIMIT 20",
    "g1_pipeline_counts": f"""WITH {_CANDIDATES}, a AS (SELECT run_id, count(*) AS n_candidates, count(*) FILTER (age <= 24) AS n_fresh, min(age) AS latest_age, bool_or(age > 48 AND age <= 168) AS fallback FROM c GROUP BY run_id),
        z AS (SELECT run_id, count(*) AS n_shortlist, count(DISTINCT source) AS n_sources FROM t GROUP BY run_id)
        SELECT run_id, n_candidates, n_fresh, latest_age, fallback, coalesce(n_shortlist, 0) AS n_shortlist, coalesce(n_sources, 0) AS n_sources FROM a LEFT JOIN z USING (run_id)""",
    "r2_technical_gate": f"""WITH {_SCORED}, {_RECORD} SELECT item, verified AND NOT secondary AND len(why) = 0 AS main,
        len(list_filter(why, lambda x: x <> 'unverified_primary_source')) = 0 AND ((verified AND NOT secondary) OR (secondary AND verified AND item % 8 < 4)) AS watch, array_to_string(why, ',') AS reasons FROM y""",
    "g2_rejection_reasons": f"""WITH {_SCORED}, {_RECORD}, n AS (SELECT run_id, reason, count(*) AS n FROM (SELECT run_id, unnest(why) AS reason FROM y) GROUP BY ALL)
        SELECT run_id, reason, n, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, reason) AS rank FROM n""",
    "r3_technical_score": f"""WITH {_SCORED}, {_RECORD}, z AS (SELECT item,
          CASE WHEN item % 10 < 3 THEN 25 WHEN item % 10 < 6 THEN 15 ELSE 5 END AS relevance,
          CASE WHEN item % 3 = 0 AND item % 20 <= 7 THEN 20 WHEN item % 29 <> 0 THEN 14 ELSE 0 END AS actionability,
          least(15, (CASE WHEN item % 23 = 0 THEN 0 ELSE 7 END) + (CASE WHEN item % 2 = 0 THEN 4 ELSE 0 END) + (CASE WHEN dated THEN 4 ELSE 0 END)) AS specificity,
          CASE status WHEN 'unique' THEN 15 WHEN 'material_update' THEN 10 WHEN 'minor_update' THEN 3 ELSE 0 END AS information_gain,
          CASE item % 3 WHEN 0 THEN 8 WHEN 1 THEN 14 ELSE 15 END AS evidence_quality,
          CASE WHEN item % 100 <= 24 THEN 10 WHEN item % 100 <= 72 THEN 7 ELSE 2 END AS time_sensitivity,
          (CASE WHEN status = 'minor_update' THEN -20 ELSE 0 END) + (CASE WHEN item % 43 = 0 THEN -15 ELSE 0 END) + (CASE WHEN item % 21 = 0 THEN -10 ELSE 0 END)
            + (CASE WHEN item % 100 > 72 AND NOT dated THEN -10 ELSE 0 END) AS penalties FROM q)
        SELECT *, greatest(0, relevance + actionability + specificity + information_gain + evidence_quality + time_sensitivity + penalties) AS total FROM z""",
    "r5_global_gate_and_score": f"""WITH {_SCORED}, {_RECORD}, a AS (SELECT *, item % 200 - 5 AS age, item % 4 AS hosts FROM q), z AS (SELECT item, array_to_string(list_filter([
          CASE WHEN item % 11 = 0 OR age < 0 THEN 'not_occurred' END, CASE WHEN item % 13 = 0 THEN 'missing_material_change' END, CASE WHEN item % 17 = 0 THEN 'funding_only' END,
          CASE WHEN item % 19 = 0 THEN 'opinion_without_evidence' END, CASE WHEN item % 4 = 0 AND item % 8 <> 0 THEN 'policy_without_text' END, CASE WHEN item % 23 = 0 THEN 'title_body_conflict' END,
          CASE WHEN item % 9 = 0 AND item % 2 <> 0 THEN 'scientific_claim_unverified' END, CASE WHEN item % 29 = 0 THEN 'invalid_evidence_anchor' END, CASE WHEN age > 168 THEN 'outside_global_window' END,
          CASE WHEN status IN ('duplicate', 'minor_update') THEN 'duplicate_without_material_update' END, CASE WHEN (NOT verified OR secondary) AND hosts < 2 THEN 'insufficient_corroboration' END], lambda x: x IS NOT NULL), ',') AS reasons,
          CASE item % 6 WHEN 0 THEN 30 WHEN 1 THEN 24 WHEN 2 THEN 16 ELSE 8 END AS impact, CASE WHEN item % 6 = 0 THEN 20 WHEN item % 5 = 0 THEN 4 WHEN item % 5 = 1 THEN 8 ELSE 16 END AS global_relevance,
          CASE WHEN age <= 24 THEN 20 WHEN age <= 48 THEN 16 ELSE 8 END AS recency, CASE WHEN verified AND NOT secondary THEN 15 WHEN hosts >= 2 THEN 12 ELSE 0 END AS evidence_quality,
          CASE status WHEN 'unique' THEN 10 WHEN 'material_update' THEN 7 ELSE 0 END AS information_gain, 5 AS clarity FROM a)
        SELECT *, impact + global_relevance + recency + evidence_quality + information_gain + clarity AS total FROM z""",
    "r7_score_backfill": """WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 100 + 1 AS INTEGER) AS v FROM orders)
        SELECT o_orderkey, least(25, greatest(0, v)) AS relevance, least(20, greatest(0, v - 25)) AS actionability, least(15, greatest(0, v - 45)) AS specificity,
          least(15, greatest(0, v - 60)) AS information_gain, least(15, greatest(0, v - 75)) AS evidence_quality, least(10, greatest(0, v - 90)) AS time_sensitivity FROM x""",
    "g7_category_share": f"WITH {_SCORED}, n AS (SELECT category, count(*) AS n FROM i GROUP BY category) SELECT category, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM n",
    "g12_collection_health": """WITH x AS (SELECT CASE page_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'web' ELSE 'github' END AS collector, length(html) > 3000 AS ok FROM pages)
        SELECT coalesce(collector, 'all') AS collector, count(*) AS attempted, count(*) FILTER (ok) AS succeeded FROM x GROUP BY ROLLUP (collector)""",
    "g13_contract_counts": f"""WITH {_SCORED}, {_BOARDS}, n AS (SELECT run_id, max(c) AS most_of_category FROM (SELECT run_id, category, count(*) AS c FROM b GROUP BY ALL) GROUP BY run_id)
        SELECT run_id, count(*) = count(DISTINCT fingerprint) AS unique_events, count(*) = count(DISTINCT item) AS unique_items, count(*) AS n, any_value(most_of_category) AS most_of_category FROM b JOIN n USING (run_id) GROUP BY run_id""",
    "j2_source_integrity": """SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS n_ids FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
        UNION ALL SELECT 'unmatched', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "j7_literal_anchors": r"""WITH x AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')) AS body FROM documents), y AS (SELECT item_id, trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')) AS quote FROM benchmark)
        SELECT doc_id, count(DISTINCT item_id) AS n_anchors FROM x LEFT JOIN y ON len(string_split(quote, ' ')) >= 3 AND contains(body, quote) GROUP BY doc_id""",
    "w13_summary_pick": f"""WITH {_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY total DESC, item) AS n, max(published) OVER (PARTITION BY run_id) - published <= 604800 AS fresh FROM i),
        x AS (SELECT run_id, item, total, fresh, row_number() OVER (PARTITION BY run_id ORDER BY fresh DESC, total DESC, item) AS rank, bool_or(fresh) OVER (PARTITION BY run_id) AS some_fresh FROM o WHERE n = 1)
        SELECT run_id, rank, item, total FROM x WHERE rank <= 3 AND (fresh OR NOT some_fresh)""",
    "u2_set_operations": """WITH x AS (SELECT user_id, event_type, bool_or(event_id % 2 = 0) AS a, bool_or(event_id % 2 = 1) AS b FROM events GROUP BY ALL)
        SELECT user_id, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (a AND b) AS common, count(*) AS "all" FROM x GROUP BY user_id HAVING bool_or(a) AND bool_or(b)""",
    "v1_contract": f"""WITH {_SCORED}, {_BOARDS}, x AS (SELECT run_id, item, list_filter([CASE WHEN item % 7 = 0 THEN 'bad_url' END, CASE WHEN item % 5 = 0 THEN 'bad_date' END,
          CASE WHEN count(*) OVER (PARTITION BY run_id, fingerprint) > 1 THEN 'repeated_event' END], lambda v: v IS NOT NULL) AS bad FROM b)
        SELECT run_id, item, array_to_string(bad, ',') AS violations, len(bad) = 0 AS good FROM x""",
    "g4_freshness": f"""WITH {_CANDIDATES}, a AS (SELECT run_id, count(*) AS n, count(*) FILTER (age <= 24) AS fresh, min(age) AS least FROM t GROUP BY run_id), u AS (SELECT DISTINCT run_id FROM c UNION ALL SELECT 'none')
        SELECT run_id, coalesce(n, 0) AS n_items, coalesce(fresh, 0) AS fresh_count_24h, CASE WHEN n > 0 THEN 'published' ELSE 'no_qualifying_items' END AS run_status,
          coalesce(epoch(TIMESTAMP '2026-07-14 12:00:00')::BIGINT - 3600 * least, 0) AS latest FROM u LEFT JOIN a USING (run_id)""",
    "g10_affected_groups": f"""WITH {_SCORED}, {_GLOBAL}, x AS (SELECT run_id, 2 * rank AS p, category AS name FROM g WHERE rank <= 3 UNION ALL SELECT run_id, 2 * rank + 1, 'g' || (item % 3) FROM g WHERE rank <= 3),
        f AS (SELECT run_id, name, min(p) AS p FROM x GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p) AS n FROM f)
        SELECT run_id, string_agg(name, ',' ORDER BY p) AS groups FROM o WHERE n <= 4 GROUP BY run_id""",
    "t27_overview": f"""WITH {_SCORED}, n AS (SELECT run_id, category, count(*) AS n FROM i GROUP BY ALL)
        SELECT run_id, CAST(sum(n) AS BIGINT)::VARCHAR || (CASE WHEN sum(n) = 1 THEN ' item in ' ELSE ' items in ' END) || string_agg(category, ', ' ORDER BY n DESC, category) AS overview FROM n GROUP BY run_id""",
    "t22_action_horizon": f"""WITH {_SCORED}, x AS (SELECT least(coalesce(CASE WHEN item % 4 = 0 THEN NULL ELSE item % 40 END, 7), 30) AS d FROM i)
        SELECT CASE WHEN d <= 0 THEN 'today' ELSE 'within ' || d || (CASE WHEN d = 1 THEN ' day' ELSE ' days' END) END AS horizon, count(*) AS n FROM x GROUP BY horizon""",
    "v4_upgraded_items": """WITH o AS (SELECT 'r' || (page_id % 9) AS run_id, url, max(page_id * 37 % 100 + 1) AS importance FROM pages GROUP BY ALL),
        x AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, url) AS p FROM o)
        SELECT run_id, url, CASE WHEN p <= 5 THEN 'must_read' WHEN p <= 8 THEN 'try_now' ELSE 'watch' END AS board, p - CASE WHEN p <= 5 THEN 0 WHEN p <= 8 THEN 5 ELSE 8 END AS rank,
          importance, 'old|' || sha256(url) AS fingerprint FROM x WHERE p <= 11""",
    "t17_currencies": r"""WITH x AS (SELECT doc_id, lower(text) AS b FROM documents), w AS (SELECT doc_id, b, regexp_extract_all(b, '[a-z][a-z0-9_-]{2,}') AS ws FROM x)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN b LIKE '%$%' OR b LIKE '%美元%' OR list_has_any(ws, ['usd', 'dollar', 'dollars']) THEN 'dollar' END,
            CASE WHEN b LIKE '%€%' OR b LIKE '%欧元%' OR list_has_any(ws, ['eur', 'euro', 'euros']) THEN 'euro' END,
            CASE WHEN b LIKE '%£%' OR b LIKE '%英镑%' OR list_has_any(ws, ['gbp', 'pound', 'pounds']) THEN 'pound' END,
            CASE WHEN b LIKE '%¥%' OR b LIKE '%日元%' OR b LIKE '%人民币%' OR list_has_any(ws, ['jpy', 'cny', 'rmb', 'yen', 'yuan']) THEN 'yen' END], lambda v: v IS NOT NULL), ',') AS currencies FROM w""",
    "f11_repository_titles": r"""WITH x AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/', '') AS title FROM pages)
        SELECT page_id, title FROM x WHERE NOT regexp_full_match(title, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+')""",
    "f17_localised": """SELECT doc_id, coalesce(nullif(split_part(text, chr(10), 1), ''), CAST(doc_id AS VARCHAR)) AS title, source AS label FROM documents""",
    "k8_confirmed_deliveries": """SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS delivery_id FROM events
        WHERE CAST(ts AS DATE) = DATE '2024-01-24' AND event_id % 4 <> 0 AND event_type IN ('purchase', 'click')""",
    "x6_day_states": """WITH x AS (SELECT CAST(ts AS DATE) AS day, event_type, value, user_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT day, event_type IN ('purchase', 'click') AS blocks, event_type = 'purchase' AND (value > 50 OR user_id % 3 = 0) AS pending FROM x WHERE n = 1""",
    "v8_missing_categories": f"""WITH {_SCORED}, h AS (SELECT DISTINCT run_id, category FROM i WHERE eligible_main AND total >= 60),
        a AS (SELECT DISTINCT run_id, 'c' || CAST(n AS VARCHAR) AS category FROM (SELECT DISTINCT run_id FROM h), range(5) t(n))
        SELECT run_id, coalesce(string_agg(category, ',' ORDER BY category) FILTER (category NOT IN (SELECT category FROM h h2 WHERE h2.run_id = a.run_id)), '') AS missing FROM a GROUP BY run_id""",
    "r6_two_passes": f"""WITH {_SCORED}, {_RECORD}, w AS (SELECT *, list_filter(why, lambda x: x <> 'duplicate_without_material_update') AS first_why FROM y),
        v AS (SELECT *, (verified AND NOT secondary AND len(first_why) = 0) OR (len(list_filter(first_why, lambda x: x <> 'unverified_primary_source')) = 0
              AND ((verified AND NOT secondary) OR (secondary AND verified AND item % 8 < 4))) AS passed FROM w)
        SELECT item, run_id, array_to_string(CASE WHEN passed THEN why ELSE first_why END, ',') AS reasons, CASE WHEN passed THEN status END AS status,
          passed AND len(why) = len(first_why) AS kept FROM v""",
    "f15_source_kinds": r"""WITH x AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(h, '(^|\.)github\.com$') THEN 'repository' WHEN h = 'huggingface.co' AND contains(p, '/blob/') THEN 'model_card'
          WHEN h IN ('arxiv.org', 'openreview.net') THEN 'paper' WHEN regexp_matches(h, '(^|\.)sec\.gov$') THEN 'financial_filing' WHEN regexp_matches(h, '\.gov(\.cn)?$') THEN 'law_or_regulation'
          ELSE 'official_announcement' END AS kind, h <> '' AND NOT starts_with(h, 'www.') AS same FROM x""",
    "t22_actions": r"""WITH d AS (SELECT doc_id, source AS au, lang AS ar, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[\s\p{Z}]+', ' ', 'g')) AS st,
          CASE WHEN doc_id % 5 = 0 THEN '7天内' WHEN doc_id % 45 = 0 THEN '今天' ELSE least(30, doc_id % 45) || '天内' END AS h FROM documents),
        a AS (SELECT doc_id, st, CASE doc_id % 7 WHEN 0 THEN au || '应在' || h || '按当前用量重新计算' || ar || '，并与当前方案对比' WHEN 6 THEN au || '应在' || h || '按当前用量重新计算' || ar || '，并与当前方案对比'
          WHEN 1 THEN au || '应在' || h || '核对' || ar || '的适用范围和生效时间，并更新合规清单' WHEN 2 THEN au || '应在' || h || '使用自身任务集复测' || ar || '，不要仅凭公开基准改变选型'
          WHEN 3 THEN au || '应在' || h || '于隔离环境验证' || ar || '，并核查安装方式、许可证和维护状态' WHEN 4 THEN au || '应在' || h || '先在非生产环境验证' || ar || '的兼容性、性能和成本，再决定是否采用'
          ELSE au || '应在' || h || '针对' || ar || '进行小范围验证，再决定是否扩大使用' END || '。依据：' AS lead FROM d)
        SELECT doc_id, CASE WHEN st = '' THEN NULL WHEN length(lead) + length(st) <= 300 THEN lead || st ELSE lead || rtrim(left(st, 299 - length(lead)), ' ') || '…' END AS action FROM a""",
    "p3_daily": f"""WITH {_SCORED}, {_BOARDS}, {_GLOBAL}, r AS (SELECT run_id, count(*) AS candidate_count, count(*) FILTER (eligible_watch) AS global_candidate_count, count(DISTINCT company) AS source_count FROM i GROUP BY run_id
          UNION ALL SELECT 'none', 0, 0, 0), l AS (SELECT b.run_id, item FROM b WHERE item % 2 = 0 OR (run_id, item) NOT IN (SELECT (run_id, item) FROM g)),
        t AS (SELECT run_id, item, TRUE AS is_event FROM g UNION ALL SELECT run_id, item, FALSE FROM l),
        a AS (SELECT t.run_id, count(*) FILTER (is_event) AS n_events, count(*) FILTER (NOT is_event) AS n_items, max(published) AS latest, count(*) FILTER (996710400 - published BETWEEN 0 AND 86400) AS fresh,
          coalesce(bool_or(996710400 - published > 172800 AND 996710400 - published <= 604800) FILTER (is_event), FALSE) AS late FROM t JOIN i ON t.run_id = i.run_id AND t.item = i.item GROUP BY t.run_id),
        x AS (SELECT run_id, 2 * rank AS p, category AS name FROM g WHERE rank <= 3 UNION ALL SELECT run_id, 2 * rank + 1, 'g' || (item % 3) FROM g WHERE rank <= 3),
        f AS (SELECT run_id, name, min(p) AS p FROM x GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p) AS n FROM f),
        s AS (SELECT run_id, string_agg(name, '、' ORDER BY p) AS groups FROM q WHERE n <= 4 GROUP BY run_id), e AS (SELECT run_id, string_agg('e' || item, '；' ORDER BY rank) AS titles FROM g WHERE rank <= 3 GROUP BY run_id)
        SELECT run_id, CASE WHEN n_events + n_items > 0 THEN 'published' ELSE 'no_qualifying_items' END AS run_status, coalesce(fresh, 0) AS fresh_count_24h, coalesce(latest, 0) AS latest_published_at,
          CASE WHEN titles IS NOT NULL THEN '今天的全球 AI 重点包括：' || titles || '。主要影响' || groups || '，事实与原始来源见下方。' WHEN n_items > 0 THEN '今天没有全球重大事件通过核验；技术与工具栏有 ' || n_items || ' 条可行动信息。'
            ELSE '今天没有全球重大事件或技术信息通过核验，以下为空榜说明。' END AS narrative,
          source_count, coalesce(n_events, 0) AS n_events, coalesce(n_items, 0) AS n_items, greatest(candidate_count, global_candidate_count) AS candidate_count,
          CAST(CASE WHEN coalesce(late, FALSE) THEN 168 ELSE 48 END AS INTEGER) AS lookback_hours, coalesce(late, FALSE) AS fallback_used FROM r LEFT JOIN a USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN e USING (run_id)""",
    "k6_snapshots": """WITH x AS (SELECT *, coalesce(json_extract_string(props, '$.k'), '') AS ver, 'user' || user_id AS u FROM events)
        SELECT concat_ws('|', u, event_type, event_type, ver, '') AS fingerprint, array_to_string(list_sort([event_type, 'user%20' || user_id]), ',') AS entities, 'user%20' || user_id AS primary_entity,
          event_type AS change_signature, lower(ver) AS version_or_metric, event_id % 5 = 0 AS resource_available, 0::BIGINT AS n_regions FROM x""",
    "v2_old_digests": """WITH a AS (SELECT l_orderkey, count(*) AS n, bool_or(l_partkey % 97 = 0 OR l_partkey % 89 = 0 OR l_quantity * 2 + l_partkey % 3 NOT BETWEEN 1 AND 100) OR count(*) > 10 AS bad FROM lineitem GROUP BY l_orderkey),
        v AS (SELECT l_orderkey, list_filter([CASE WHEN l_orderkey % 5 = 0 THEN 'bad_counts' END, CASE WHEN bad THEN 'bad_item' END, CASE WHEN l_orderkey % 17 = 0 THEN 'bad_status' END], lambda x: x IS NOT NULL) AS w FROM a)
        SELECT l_orderkey, 2 AS version, array_to_string(w, ',') AS violations, len(w) = 0 AS good FROM v""",
    "v3_digest_documents": """WITH x AS (SELECT *, l_partkey % 26 + l_partkey % 21 + 3 * (l_partkey % 16) + l_partkey % 11 - (CASE WHEN l_partkey % 4 = 0 THEN 10 ELSE 0 END) AS total, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS latest FROM lineitem),
        a AS (SELECT l_orderkey, bool_or(l_partkey % 101 = 0) AS bad_item, bool_or(l_partkey % 61 = 0 OR total > 100) AS bad_score, count(*) FILTER (l_linenumber <= 3) > 5 OR count(*) FILTER (l_linenumber IN (4, 5)) > 3 OR count(*) FILTER (l_linenumber > 5) > 3 AS bad_boards,
          count(*) <> count(DISTINCT l_suppkey) AS repeated, count(*) FILTER (latest - l_shipdate <= (CASE WHEN l_orderkey % 3 = 0 THEN INTERVAL 12 HOURS ELSE INTERVAL 24 HOURS END)) <> 1 AS bad_fresh FROM x GROUP BY l_orderkey),
        v AS (SELECT l_orderkey, list_filter([CASE WHEN l_orderkey % 29 = 0 THEN 'bad_shape' END, CASE WHEN bad_item THEN 'bad_item' END, CASE WHEN bad_score THEN 'bad_score' END, CASE WHEN bad_boards THEN 'bad_boards' END,
          CASE WHEN repeated THEN 'repeated' END, CASE WHEN bad_fresh THEN 'bad_freshness' END], lambda x: x IS NOT NULL) AS w FROM a)
        SELECT l_orderkey, 4 AS version, array_to_string(w, ',') AS violations, len(w) = 0 AS good FROM v""",
    "t25_item_lines": f"""WITH {_SCORED}, {_BOARDS} SELECT run_id, item, '**' || rank || '. item\\_' || item || '**  `总分 ' || total || '`' || chr(10) || '具体变化：change \\[of\\] ' || company || chr(10)
          || '影响：a、b\\* · area' || chr(10) || '建议行动：act' || chr(10) || '[核查原文](https://example.com/%28' || item || '%29?q=%C3%A9)' || (CASE WHEN board = 'watch' AND item % 2 = 0 THEN '  ⚠ 原始来源暂不可核查' ELSE '' END) || chr(10) AS lines FROM b""",
}
