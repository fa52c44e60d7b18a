"""The same results in SQL for DuckDB, written independently of the plans."""

from __future__ import annotations

from colloquy.functions import text as X
from colloquy.plans.catalogue import ASKING, HIGH_VALUE, KEYWORDS, MANIFEST, PHRASES, UNWANTED, ROLE

WS = r"[\t-\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '{WS}+', ' ', 'g')"


SCENARIO = "coalesce(replace(replace(lower(trim(scenario)), '-', '_'), ' ', '_'), 'none')"
FULL = "coalesce(list_aggregate(list_transform(messages, lambda m: coalesce(m.content, '')), 'string_agg', ' '), '')"
CUT = "CASE WHEN list_contains(list_transform(messages, lambda m: coalesce(m.role, '')), 'assistant') THEN list_slice(messages, 1, len(messages) - list_position(list_reverse(list_transform(messages, lambda m: coalesce(m.role, ''))), 'assistant') + 1) ELSE messages[1:0] END"


def canonical(x: str) -> str:
    return f"coalesce(list_aggregate(list_transform({x}, lambda m: concat(coalesce(m.role, ''), ': ', coalesce({collapse('m.content')}, ''))), 'string_agg', chr(10)), '')"


def n_assistant(x: str) -> str:
    return f"len(list_filter({x}, lambda m: m.role = 'assistant'))"


def bucket(x: str) -> str:
    return f"CASE WHEN {x} <= 4 THEN 'short' WHEN {x} <= 8 THEN 'mid' WHEN {x} IS NOT NULL THEN 'long' END"


def errors(messages: str, turns: str, lang: str) -> str:
    """Names of the validation errors of a non-empty dialogue as a list with NULLs."""
    body = f"list_filter({messages}, lambda m: m.role <> 'system')"
    broken = f"len(list_filter({body}, lambda m, i: m.role IS DISTINCT FROM (CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END))) > 0"
    return f"""CASE WHEN coalesce(len({messages}), 0) = 0 THEN ['empty'] ELSE list_filter([
        CASE WHEN len(list_filter({messages}, lambda m, i: m.role = 'system' AND i > 1)) > 0 THEN 'system_not_first' END,
        CASE WHEN {broken} THEN 'role_sequence' END,
        CASE WHEN NOT ({broken}) AND coalesce({messages}[-1].role, '') <> 'assistant' THEN 'not_assistant_last' END,
        CASE WHEN len(list_filter({messages}, lambda m: coalesce(length({strip('m.content')}), 0) = 0)) > 0 THEN 'blank_content' END,
        CASE WHEN {turns} IS DISTINCT FROM {n_assistant(messages)} THEN 'n_turns' END,
        CASE WHEN coalesce({lang}, '') <> 'en' THEN 'lang' END], lambda e: e IS NOT NULL) END"""


def percentile(values: str, p: float) -> str:
    """Linear interpolation in a sorted list, both neighbours weighted by their distance."""
    at = f"((len({values}) - 1) * {p}::DOUBLE)"
    low, high = f"{values}[floor({at})::INT + 1]", f"{values}[ceil({at})::INT + 1]"
    return f"CASE WHEN floor({at}) = ceil({at}) THEN {low}::DOUBLE ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


def keyword(x: str, phrases: list[str]) -> str:
    return f"coalesce(regexp_matches(lower({x}), '(?:^|[^\\p{{L}}\\p{{N}}_\\p{{M}}])(?:{'|'.join(p.replace('-', '[-]') for p in phrases)})(?:$|[^\\p{{L}}\\p{{N}}_\\p{{M}}])'), false)"


def hits(x: str, word: str) -> str:
    return f"((length(lower({x})) - length(replace(lower({x}), '{word}', ''))) // {len(word)})"


TAGS = ", ".join(f"({sum_}, {-i}, '{name}')" for i, (name, sum_) in enumerate((n, " + ".join(hits("t", k) for k in ks)) for n, ks in KEYWORDS.items()))
UNWANTED_SQL, ROLE_SQL = ("|".join(f"(?:{p})" for p in ps) for ps in (UNWANTED, ROLE))
FLAGS = f"""SELECT result_id, {SCENARIO} AS scenario, coalesce(completion, '') AS c FROM results"""
FLAG_COLUMNS = f"""regexp_matches(c, '(?i){UNWANTED_SQL}') AS pattern_hit, len(regexp_extract_all(c, '{WORD}+|[^\\p{{L}}\\p{{N}}_\\s\\x{{A0}}]')) > 60 AS over_length,
    regexp_matches(c, '(?i){ROLE_SQL}') AS role_break, scenario IN ({', '.join(repr(a) for a in ASKING)}) AND NOT contains(c, '?') AS no_question"""
DIALOGUE_SCORES = f"""SELECT 'judge-a' AS judge, gen_config.model_tag AS tag, {SCENARIO} AS scenario, unnest([
    {{'dimension': 'length', 'score': (1 + coalesce(length(completion), 0) % 5)::BIGINT}}, {{'dimension': 'tokens', 'score': (1 + coalesce(n_tokens, 0) % 5)::BIGINT}}], recursive := true) FROM results"""
SHINGLES = f"""docs AS (SELECT doc_id, list_filter(string_split_regex({collapse('text')}, '{WS}+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    runs AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM runs x JOIN runs y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    near AS (SELECT a, b, c / (p.n + q.n - c) AS similarity FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c / (p.n + q.n - c) >= 0.85)"""


def digest(name: str, columns: list[str]) -> str:
    text = " || '|' || ".join(f"coalesce({c}::VARCHAR, '~')" for c in columns)
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, sum(('0x' || substr(md5({text}), 1, 15))::HUGEINT)::VARCHAR AS digest FROM {name}"


def oracle_sql() -> dict[str, str]:
    from colloquy.plans import more_oracles

    return more_oracles.oracle_sql() | {
        "q01_dialogue_funnel": f"""WITH c AS (SELECT rec_id, lang, {CUT} AS kept FROM dialogues), t AS (SELECT *, coalesce({n_assistant('kept')}, 0) AS turns, {canonical('kept')} AS text FROM c),
            r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN coalesce(len(kept), 0) = 0 THEN rec_id::VARCHAR ELSE text END ORDER BY rec_id) AS rn FROM t)
            SELECT CASE WHEN coalesce(len(kept), 0) = 0 THEN 'no_assistant' WHEN rn > 1 THEN 'duplicate' WHEN len({errors('kept', 'turns', 'lang')}) > 0 THEN 'invalid' ELSE 'kept' END AS reason,
            {bucket('turns')} AS bucket, count(*) AS n FROM r GROUP BY ALL""",
        "q02_dialogue_ids": f"SELECT rec_id, 'dlg-' || substr(sha256({canonical('messages')}), 1, 12) AS content_id FROM dialogues",
        "q03_event_runs": """WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""",
        "q04_exact_dedup": """WITH r AS (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL)
            SELECT source, count(*) AS n, count(*) FILTER (rn > 1) AS dropped FROM r GROUP BY source""",
        "q06_email_counts": f"""WITH t AS (SELECT rec_id, {FULL} AS t FROM dialogues)
            SELECT rec_id, len(regexp_extract_all(t, '{X.EMAIL}')) AS emails, regexp_replace(t, '{X.EMAIL}', '[EMAIL]', 'g') AS redacted FROM t""",
        "q08_scenario_tag": f"""WITH t AS (SELECT rec_id, {FULL} AS t FROM dialogues), s AS (SELECT rec_id, greatest({TAGS.replace('(', 'row(', 0)}) AS best FROM t)
            SELECT rec_id, CASE WHEN best[1] > 0 THEN best[3] ELSE 'general' END AS tag FROM s""",
        "q09_keyword_boundary": f"SELECT doc_id, {keyword('text', PHRASES)} AS hit FROM documents",
        "q10_token_stats": f"""WITH t AS (SELECT coalesce(lang, 'none') AS lang, len(regexp_extract_all(text, '{WORD}+|[^\\p{{L}}\\p{{N}}_\\s\\x0B]')) AS t FROM documents)
            SELECT lang, n, total, {percentile('v', 0.5)} AS p50, {percentile('v', 0.95)} AS p95 FROM (SELECT lang, count(t) AS n, sum(t)::BIGINT AS total, list_sort(list(t) FILTER (t IS NOT NULL)) AS v FROM t GROUP BY lang)""",
        "q11_strata": f"SELECT {SCENARIO} AS scenario, {bucket('n_turns')} AS bucket, count(*) AS n FROM dialogues GROUP BY ALL",
        "q12_validation_errors": f"WITH e AS (SELECT unnest({errors('messages', 'n_turns', 'lang')}) AS error FROM dialogues) SELECT error, count(*) AS n FROM e GROUP BY error",
        "q13_eval_samples": """WITH s AS (SELECT rec_id, CASE WHEN len(messages) > 1 AND messages[-1].role = 'assistant' THEN messages END AS m FROM dialogues)
            SELECT rec_id, (len(m) - 1)::INT AS prompt_messages, length(m[-1].content)::INT AS gold_chars, list_filter(m[1:len(m) - 1], lambda x: x.role = 'user')[-1].content AS last_user FROM s""",
        "q14_chat_render": """WITH s AS (SELECT rec_id, CASE WHEN messages[1].role = 'system' THEN messages ELSE list_concat([{'role': 'system', 'content': 'Be brief.'}], coalesce(messages, [])) END AS m FROM dialogues),
            r AS (SELECT rec_id, coalesce(list_aggregate(list_transform(m, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10)), 'string_agg', ''), '') || '<|im_start|>assistant' || chr(10) AS t FROM s)
            SELECT rec_id, md5(t) AS digest, length(t)::INT AS chars FROM r""",
        "q15_rule_flags": f"SELECT result_id, {FLAG_COLUMNS} FROM ({FLAGS})",
        "q16_rule_summary": f"""WITH f AS (SELECT scenario, {FLAG_COLUMNS}, len(regexp_extract_all(c, '{WORD}+|[^\\p{{L}}\\p{{N}}_\\s\\x0B]')) AS t FROM ({FLAGS}))
            SELECT * EXCLUDE (v), {', '.join(f"{percentile('v', p / 100)} AS tokens_p{p}" for p in (50, 90, 95))} FROM (SELECT coalesce(scenario, 'all') AS scenario, count(*) AS n,
            {', '.join(f"count(*) FILTER ({r}) AS n_{r}, count(*) FILTER ({r}) / count(*) AS rate_{r}" for r in ('pattern_hit', 'over_length', 'role_break', 'no_question'))},
            sum(t) / count(*) AS tokens_mean, min(t)::INT AS tokens_min, max(t)::INT AS tokens_max, list_sort(list(t)) AS v FROM f GROUP BY GROUPING SETS ((scenario), ()))""",
        "q17_quota_sample": f"""WITH d AS (SELECT rec_id, {SCENARIO} AS scenario FROM dialogues), s AS (SELECT scenario, count(*) AS size, sum(count(*)) OVER () AS total FROM d GROUP BY scenario),
            b AS (SELECT *, floor(size * 500 / total) AS base, size * 500 / total - floor(size * 500 / total) AS rest FROM s),
            q AS (SELECT scenario, CASE WHEN total <= 500 THEN size ELSE base + CASE WHEN row_number() OVER (ORDER BY rest DESC, scenario) <= 500 - sum(base) OVER () THEN 1 ELSE 0 END END AS quota FROM b),
            r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY sha256('42:' || scenario || ':' || rec_id), rec_id) AS rn FROM d)
            SELECT rec_id, scenario FROM r JOIN q USING (scenario) WHERE rn <= quota""",
        "q18_downsample": f"""WITH d AS (SELECT rec_id, NOT coalesce(lower(source) LIKE 'synthetic%', false) AS is_real, {SCENARIO} IN ({', '.join(repr(h) for h in HIGH_VALUE)}) AS high, {keyword(FULL, PHRASES[:2])} AS word FROM dialogues),
            n AS (SELECT greatest(round_even(count(*) FILTER (NOT is_real) * 2.0, 0) - count(*) FILTER (is_real AND (high OR word)), 0) AS need FROM d),
            r AS (SELECT *, row_number() OVER (PARTITION BY is_real AND NOT (high OR word) ORDER BY sha256('42:pool:' || rec_id), rec_id) AS rn FROM d),
            w AS (SELECT rec_id, CASE WHEN NOT is_real THEN 'synthetic' WHEN high AND word THEN 'both' WHEN high THEN 'label_only' WHEN word THEN 'keyword_only' WHEN rn <= need THEN 'filled' ELSE 'dropped' END AS why FROM r, n)
            SELECT rec_id, why, why <> 'dropped' AS kept FROM w""",
        "q19_stratified_split": f"""WITH d AS (SELECT rec_id, concat_ws('|', {SCENARIO}, {bucket('n_turns')}) AS stratum FROM dialogues),
            r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || stratum || ':' || rec_id), rec_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM d)
            SELECT rec_id, stratum, CASE WHEN rn <= round_even(n * 0.9::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * (0.9::DOUBLE + 0.05::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split FROM r""",
        "q21_distribution": f"""WITH d AS (SELECT split, {SCENARIO} AS stratum FROM dialogues WHERE split IS NOT NULL), o AS (SELECT stratum, count(*) / sum(count(*)) OVER () AS overall FROM d GROUP BY stratum),
            s AS (SELECT split, stratum, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM d GROUP BY split, stratum), g AS (SELECT * FROM (SELECT DISTINCT split FROM d), o)
            SELECT split, stratum, overall, coalesce(share, 0) AS share FROM g LEFT JOIN s USING (split, stratum) WHERE abs(coalesce(share, 0) - overall) > 0.005""",
        "q22_near_duplicate_texts": f"""WITH {SHINGLES}, sides AS (SELECT a, b, similarity FROM near UNION ALL SELECT b, a, similarity FROM near), l AS (SELECT a, count(*) AS n, min(b) FILTER (similarity = 1) AS twin FROM sides GROUP BY a)
            SELECT s.doc_id, least(s.doc_id, coalesce(twin, s.doc_id)) AS text_id, coalesce(l.n, 0) AS n_links FROM sizes s LEFT JOIN l ON l.a = s.doc_id""",
        "q23_near_duplicate_clusters": f"""WITH RECURSIVE {SHINGLES}, sides AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT doc_id, doc_id FROM sizes),
            reach AS (SELECT a, b FROM sides UNION SELECT r.a, x.b FROM reach r JOIN sides x ON r.b = x.a), f AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
            c AS (SELECT doc_id, coalesce(low, doc_id) AS cluster_id FROM documents LEFT JOIN f ON a = doc_id WHERE text IS NOT NULL),
            d AS (SELECT c.*, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(lower(source) LIKE 'synthetic%', false), length(text) DESC, c.doc_id) AS rn FROM c JOIN documents USING (doc_id))
            SELECT doc_id, cluster_id, rn = 1 AS kept FROM d""",
        "q25_leakage": f"""WITH docs AS (SELECT rec_id, split, list_filter(string_split_regex({canonical('messages')}, '{WS}+'), lambda w: w <> '') AS w FROM dialogues WHERE split IS NOT NULL AND messages IS NOT NULL),
            runs AS (SELECT DISTINCT rec_id, split, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs WHERE len(w) > 0),
            sizes AS (SELECT rec_id, count(*) AS n FROM runs GROUP BY rec_id),
            common AS (SELECT x.rec_id AS a, y.rec_id AS b, any_value(x.split) AS p, any_value(y.split) AS q, count(*) AS c FROM runs x JOIN runs y ON x.s = y.s AND x.rec_id < y.rec_id AND x.split <> y.split GROUP BY x.rec_id, y.rec_id)
            SELECT least(p, q) AS split_a, greatest(p, q) AS split_b, count(*) AS n_pairs FROM common JOIN sizes f ON f.rec_id = a JOIN sizes g ON g.rec_id = b WHERE c / (f.n + g.n - c) >= 0.8 GROUP BY ALL""",
        "q27_common_ids": f"""WITH d AS (SELECT {SCENARIO} AS scenario, gen_config.model_tag AS tag FROM results)
            SELECT scenario FROM d GROUP BY scenario HAVING count(DISTINCT tag) = (SELECT count(DISTINCT tag) FROM d)""",
        "q28_cross_table": f"""WITH s AS ({DIALOGUE_SCORES}) SELECT judge, tag, coalesce(scenario, 'all') AS scenario, dimension, sum(score) / count(*) AS mean,
            sqrt((count(*) * sum(score * score) - sum(score) * sum(score))::DOUBLE) / count(*) AS std, count(*) AS n FROM s GROUP BY GROUPING SETS ((judge, tag, scenario, dimension), (judge, tag, dimension))""",
        "q29_pairwise_means": f"""WITH s AS ({DIALOGUE_SCORES}), m AS (SELECT judge, tag, dimension, round(sum(score) / count(*), 3) AS mean, coalesce(list_position(['base', 'sft', 'dpo'], tag), 4) AS ord FROM s GROUP BY judge, tag, dimension)
            SELECT a.judge, a.dimension, a.tag AS tag_a, b.tag AS tag_b, abs(round(b.mean - a.mean, 3)) < 0.1 AS no_diff FROM m a JOIN m b ON a.judge = b.judge AND a.dimension = b.dimension AND (a.ord < b.ord OR (a.ord = b.ord AND a.tag < b.tag))""",
        "q30_cost": """WITH p(model, i, o) AS (VALUES ('base', 0.5::DOUBLE, 1.5::DOUBLE), ('sft', 0.25::DOUBLE, 2.0::DOUBLE)), u AS (SELECT coalesce(gen_config.model_tag, 'none') AS model, count(*) AS requests,
            sum(coalesce(n_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(usage_completion_tokens, 0))::BIGINT AS completion_tokens FROM results GROUP BY 1)
            SELECT model, requests, prompt_tokens, completion_tokens, prompt_tokens / 1e6::DOUBLE * i + completion_tokens / 1e6::DOUBLE * o AS usd, i IS NULL AS unpriced FROM u LEFT JOIN p USING (model)""",
        "q31_json_props": "SELECT event_id, json_type(props) = 'NULL' AS is_null, len(json_keys(props))::INT AS keys FROM events",
        "q32_tier_rollup": f"""WITH f AS (SELECT concurrency, min(start_ts) + 86400 AS t FROM raw_1 GROUP BY concurrency), r AS (SELECT r.* FROM raw_1 r JOIN f ON r.concurrency IS NOT DISTINCT FROM f.concurrency AND start_ts >= t)
            SELECT * EXCLUDE (t, i), {', '.join(f"{percentile(v, p / 100)} AS {n}_p{p}" for v, n in (('t', 'ttft'), ('i', 'itl')) for p in (50, 95))} FROM (SELECT concurrency, count(*) AS n, count(*) FILTER (ok) AS n_ok,
            list_sort(list(ttft_ms) FILTER (ok AND ttft_ms IS NOT NULL AND NOT isnan(ttft_ms))) AS t, list_sort(list(itl_mean_ms) FILTER (ok AND itl_mean_ms IS NOT NULL AND NOT isnan(itl_mean_ms))) AS i,
            coalesce(sum(n_output_tokens) FILTER (ok), 0) / 2505600.0::DOUBLE AS tokens_per_s, count(*) FILTER (ok) / 2505600.0::DOUBLE AS requests_per_s, count(*) FILTER (NOT coalesce(ok, false)) / count(*) AS error_rate FROM r GROUP BY concurrency)""",
        "q33_stream_gaps": """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
            SELECT user_id, count(*) AS n, min(gap) AS gap_min, max(gap) AS gap_max, sum(gap)::BIGINT AS gap_sum FROM g GROUP BY user_id""",
        "q34_length_buckets": """WITH b AS (SELECT doc_id, coalesce(length(text), 0) AS c, ntile(3) OVER (ORDER BY coalesce(length(text), 0), doc_id) AS bucket FROM documents),
            t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY c, doc_id) AS turn FROM b) SELECT doc_id, bucket::INT AS bucket, row_number() OVER (ORDER BY turn, bucket) AS position FROM t""",
        "q36_task_matrix": """WITH g AS (SELECT r_name, n_name, row_number() OVER (ORDER BY sha256('42:task:' || r_name || '|' || n_name)) - 1 AS p, count(*) OVER () AS a FROM region, nation),
            k AS (SELECT unnest(range(0, 300)) AS task_idx) SELECT task_idx, r_name, n_name FROM k JOIN g ON task_idx % a = p""",
        "q37_first_difference": """WITH d AS (SELECT pair_id, coalesce(chosen, '') AS a, coalesce(rejected, '') AS b FROM preference_pairs), s AS (SELECT *, list_zip(regexp_extract_all(a, '(?s).'), regexp_extract_all(b, '(?s).')) AS z FROM d)
            SELECT pair_id, a = b AS same, CASE WHEN a <> b THEN list_position(list_transform(z, lambda p: p[1] IS DISTINCT FROM p[2]), true) - 1 END AS first_char FROM s""",
        "q38_set_operations": """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer), p AS (
            SELECT 'union' AS operation, k FROM (SELECT k FROM o UNION SELECT k FROM c) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM o INTERSECT SELECT k FROM c) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM o)
            UNION ALL SELECT 'semi', k FROM c WHERE k IN (SELECT k FROM o) UNION ALL SELECT 'anti', k FROM c WHERE k NOT IN (SELECT k FROM o)), n(operation) AS (VALUES ('union'), ('intersect'), ('except'), ('semi'), ('anti'))
            SELECT operation, count(k) AS n, coalesce(sum(k), 0)::BIGINT AS key_sum FROM n LEFT JOIN p USING (operation) GROUP BY operation""",
        "q39_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL",
        "q39_event_sessions": """WITH f AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM f), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
        "q40_manifest": " UNION ALL ".join(digest(n, c) for n, c in MANIFEST.items()),
        "q41_sse": """SELECT event_id, event_id % 10 <> 1 AS is_data, event_id % 10 = 0 AS done, CASE WHEN event_id % 10 > 1 THEN event_type END AS content, CASE WHEN event_id % 10 > 1 THEN (event_id % 97)::INT END AS tokens FROM events""",
        "q42_assistant_spans": """WITH s AS (SELECT rec_id, list_filter(messages, lambda m: m.role = 'assistant' AND coalesce(m.content, '') <> '') AS m FROM dialogues)
            SELECT rec_id, coalesce(len(m), 0)::INT AS n_spans, coalesce(list_sum(list_transform(m, lambda x: length(x.content))), 0)::INT AS chars FROM s""",
        "q43_preference_errors": f"""WITH e AS (SELECT unnest(list_filter([CASE WHEN coalesce(len(context), 0) = 0 THEN 'empty_context' END, CASE WHEN len(context) > 0 AND coalesce(context[-1].role, '') <> 'user' THEN 'not_user_last' END,
            CASE WHEN len(list_filter(context, lambda m, i: m.role = 'system' AND i > 1)) > 0 THEN 'system_not_first' END, CASE WHEN len(list_filter(context, lambda m: coalesce(length({strip('m.content')}), 0) = 0)) > 0 THEN 'blank_content' END,
            CASE WHEN coalesce(length({strip('chosen')}), 0) = 0 THEN 'blank_chosen' END, CASE WHEN coalesce(length({strip('rejected')}), 0) = 0 THEN 'blank_rejected' END], lambda x: x IS NOT NULL)) AS error FROM preference_pairs)
            SELECT error, count(*) AS n FROM e GROUP BY error""",
        "q44_preference_ids": f"""SELECT pair_id, 'pref-' || substr(sha256({canonical('context')} || chr(10) || lower({strip("coalesce(chosen, '')")}) || chr(10) || lower({strip("coalesce(rejected, '')")})), 1, 12) AS content_id FROM preference_pairs""",
        "q47_split_sizes": f"""WITH d AS (SELECT coalesce(split, 'none') AS split, {SCENARIO} AS scenario FROM dialogues)
            SELECT coalesce(split, 'all') AS split, coalesce(scenario, 'all') AS scenario, count(*) AS n FROM d GROUP BY CUBE (split, scenario)""",
        "q48_reasoning": f"SELECT result_id, md5({strip("coalesce(completion, '')")}) AS digest FROM results",
        "q49_pricing_join": """SELECT n_name, year(o_orderdate)::INT AS year, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    }
