"""SQL for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
SPOKEN = WORDS.format("list_aggregate(list_transform(list_filter(messages, lambda m: coalesce(m.role, '') <> 'system'), lambda m: coalesce(m.content, '')), 'string_agg', chr(10))")

PAIRS = f"""w AS (SELECT rec_id, split, {SPOKEN} AS w FROM dialogues),
    runs AS (SELECT DISTINCT rec_id, split, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w),
    sizes AS (SELECT rec_id, count(*) AS n FROM runs GROUP BY rec_id),
    common AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS c, any_value(x.split) AS split_a, any_value(y.split) AS split_b FROM runs x JOIN runs y ON x.s = y.s AND x.rec_id < y.rec_id GROUP BY x.rec_id, y.rec_id),
    near AS (SELECT a AS rec_a, b AS rec_b, split_a, split_b FROM common JOIN sizes p ON p.rec_id = a JOIN sizes q ON q.rec_id = b WHERE c / (p.n + q.n - c) >= 0.6)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {PAIRS} SELECT rec_a, rec_b FROM near",
        "p1_groups": f"""WITH RECURSIVE {PAIRS}, sides AS (SELECT rec_a AS a, rec_b AS b FROM near UNION ALL SELECT rec_b, rec_a FROM near), reach AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
            g AS (SELECT a, min(b) AS low FROM reach GROUP BY a), l AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
            SELECT s.rec_id, least(s.rec_id, coalesce(low, s.rec_id)) AS group_id, coalesce(l.n, 0) AS n_links FROM sizes s LEFT JOIN g ON g.a = s.rec_id LEFT JOIN l ON l.a = s.rec_id""",
        "p3_found": """WITH d AS (SELECT replace(replace(lower(trim(scenario)), '-', '_'), ' ', '_') AS scenario, n_turns FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id) AS rn FROM dialogues) WHERE rn = 1),
            c AS (SELECT scenario, n_turns, count(*) AS n FROM d GROUP BY ALL),
            t AS (SELECT plan_id, target_id, greatest(floor(sample_size * target_share + 0.5), min_rows) AS needed, coalesce(sum(n), 0) AS available FROM sample_targets t
                LEFT JOIN c ON (t.scenario IS NULL OR c.scenario = t.scenario) AND c.n_turns >= t.turns_min AND (t.turns_max IS NULL OR c.n_turns <= t.turns_max) GROUP BY ALL)
            SELECT plan_id, target_id FROM t WHERE available < needed""",
        "p3_needs": """WITH d AS (SELECT replace(replace(lower(trim(scenario)), '-', '_'), ' ', '_') AS scenario, n_turns FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id) AS rn FROM dialogues) WHERE rn = 1),
            c AS (SELECT scenario, n_turns, count(*) AS n FROM d GROUP BY ALL),
            t AS (SELECT plan_id, target_id, greatest(floor(sample_size * target_share + 0.5), min_rows)::BIGINT AS needed, coalesce(sum(n), 0)::BIGINT AS available FROM sample_targets t
                LEFT JOIN c ON (t.scenario IS NULL OR c.scenario = t.scenario) AND c.n_turns >= t.turns_min AND (t.turns_max IS NULL OR c.n_turns <= t.turns_max) GROUP BY plan_id, target_id, sample_size, target_share, min_rows)
            SELECT plan_id, target_id, available, needed, available < needed AS cannot_be_met, true AS floor_kept FROM t""",
        "p3_counts": """WITH n AS (SELECT count(DISTINCT coalesce(id, '')) AS n FROM dialogues) SELECT plan_id, least(max(sample_size), any_value(n))::BIGINT AS n_rows, least(max(sample_size), any_value(n))::BIGINT AS n_ids, true AS floors_kept, true AS as_reported FROM sample_targets, n GROUP BY plan_id""",
        "p5_bounds": """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY logged_at) AS rn FROM raw_1) WHERE rn = 1), v AS (SELECT concurrency, run_day, client_key, metric, v FROM o, LATERAL (VALUES ('ttft_ms', ttft_ms), ('itl_mean_ms', itl_mean_ms), ('total_ms', total_ms)) t(metric, v) WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v))
            SELECT 'concurrency_day' AS grouping, concurrency, run_day, NULL::VARCHAR AS client_key, metric, count(*) AS n, true AS within FROM v GROUP BY ALL UNION ALL SELECT 'client', NULL, NULL, client_key, metric, count(*), true FROM v GROUP BY ALL""",
        "p6_found": f"WITH {PAIRS} SELECT rec_a, rec_b FROM near WHERE (split_a = 'train' AND split_b IN ('val', 'test')) OR (split_b = 'train' AND split_a IN ('val', 'test'))",
        "p6_counts": f"""WITH {PAIRS}, o AS (SELECT CASE WHEN split_a = 'train' THEN rec_b ELSE rec_a END AS rec_id FROM near WHERE (split_a = 'train' AND split_b IN ('val', 'test')) OR (split_b = 'train' AND split_a IN ('val', 'test'))), c AS (SELECT rec_id, count(*) AS n FROM o GROUP BY rec_id)
            SELECT split, scenario, source, count(*) AS n_records, sum(n)::BIGINT AS n_pairs FROM c JOIN (SELECT rec_id, split, scenario, source FROM dialogues) USING (rec_id) GROUP BY split, scenario, source""",
        "p9_word_spans": f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), i AS (SELECT {WORDS.format('text')} AS w FROM eval_items), g AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS s FROM i),
            h AS (SELECT doc_id, unnest(range(0, len(w) - 15)) AS p, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS s FROM d), m AS (SELECT doc_id, p FROM h JOIN g USING (s)),
            f AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 16 THEN 0 ELSE 1 END AS fresh FROM m), n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f)
            SELECT doc_id, min(p) AS first_word, max(p) + 16 AS end_word FROM n GROUP BY doc_id, k""",
        "p10_promises": "SELECT doc_id, true AS within_limit, true AS overlaps_kept, true AS covered FROM documents WHERE text <> ''",
        "p9_found": f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {WORDS.format('text')} AS w FROM eval_items),
            g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS s FROM i),
            h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS s FROM d)
            SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (s)""",
    }
