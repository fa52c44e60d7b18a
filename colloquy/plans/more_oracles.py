"""SQL for the further queries."""

from __future__ import annotations

from colloquy.functions import text as X
from colloquy.plans.catalogue import KEYWORDS
from colloquy.plans.more import TEMPLATE
from colloquy.plans.oracles import DIALOGUE_SCORES, FLAG_COLUMNS, FLAGS, FULL, SCENARIO, SHINGLES, UNWANTED_SQL, WS, bucket, canonical, collapse, errors, n_assistant, percentile, strip

SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"


def plain(x: str) -> str:
    """Roles and contents of a list of messages."""
    return f"coalesce(list_aggregate(list_transform({x}, lambda m: coalesce(m.role, '') || ':' || coalesce(m.content, '')), 'string_agg', chr(10)), '')"


def each(x: str, name: str = "messages", key: str = "rec_id", rows: str = "dialogues") -> str:
    return f"SELECT {key}, unnest({name}) AS m, generate_subscripts({name}, 1) AS i FROM {rows} WHERE len({name}) > 0 {x}"


def merged(rows: str, key: str = "rec_id") -> str:
    """Runs of one role of ``rows`` (key, m, i) as ``key, r, role, content``."""
    return f"""SELECT {key}, r, any_value(role) AS role, string_agg(content, chr(10) ORDER BY i) AS content FROM (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY i) AS r FROM (
        SELECT {key}, i, m.role AS role, m.content AS content, CASE WHEN m.role = lag(m.role) OVER (PARTITION BY {key} ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM {rows})) GROUP BY {key}, r"""


TRANSCRIPT = "list_aggregate(list_transform(<>, lambda m: '[' || CASE m.role WHEN 'system' THEN 'System' WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'Agent' ELSE m.role END || '] ' || " + strip("coalesce(m.content, '')") + "), 'string_agg', chr(10))"
PROMPT = f"replace(replace('{TEMPLATE}', '{{reply}}', {strip('reply')}), '{{context}}', coalesce({TRANSCRIPT.replace("<>", "msgs")}, ''))"
GATE = f"""coalesce(len(list_filter(messages, lambda m: m.role IS NULL OR m.content IS NULL OR NOT m.role IN ('system', 'user', 'assistant'))), 1) > 0"""
PREFERENCE = f"""list_filter([CASE WHEN coalesce(len(context), 0) = 0 THEN 'empty_context' END, CASE WHEN len(context) > 0 AND coalesce(context[-1].role, '') <> 'user' THEN 'not_user_last' END,
    CASE WHEN len(list_filter(context, lambda m, i: m.role = 'system' AND i > 1)) > 0 THEN 'system_not_first' END, CASE WHEN len(list_filter(context, lambda m: coalesce(length({strip('m.content')}), 0) = 0)) > 0 THEN 'blank_content' END,
    CASE WHEN coalesce(length({strip('chosen')}), 0) = 0 THEN 'blank_chosen' END, CASE WHEN coalesce(length({strip('rejected')}), 0) = 0 THEN 'blank_rejected' END], lambda x: x IS NOT NULL)"""
STREAMS = """SELECT request_id, concurrency, ok, n_output_tokens, CASE WHEN ttft_ms >= 0 AND itl_mean_ms >= 0 AND NOT isnan(ttft_ms) AND NOT isnan(itl_mean_ms) THEN ttft_ms / 1000 END AS a, itl_mean_ms / 1000 AS g FROM raw_1"""
JUDGED = f"""WITH p AS (SELECT result_id, coalesce(gen_config.model_tag, 'none') AS tag, length({PROMPT}) AS n FROM (SELECT *, coalesce(completion, '') AS reply, prompt_messages AS msgs FROM results)), j AS (SELECT * FROM p, (VALUES ('judge-a', 7), ('judge-bb', 8)) v(judge, size))"""
TASKS = f"""g AS (SELECT n_name, scenario, row_number() OVER (ORDER BY sha256('42:task:' || n_name || '|' || scenario)) - 1 AS p, count(*) OVER () AS a FROM nation, (VALUES {', '.join(f"('{k}')" for k in KEYWORDS)}) s(scenario)),
    t AS (SELECT task_idx, n_name, scenario FROM (SELECT unnest(range(0, 300)) AS task_idx) JOIN g ON task_idx % a = p)"""


def bounded(x: str, before: str, pattern: str, after: str, placeholder: str) -> str:
    """Replaces a pattern between characters that must not be of a class; twice, as a character may end one match and start the next."""
    once = lambda y: f"regexp_replace({y}, '(^|{before})(?:{pattern})($|{after})', '\\1{placeholder}\\2', 'g')"
    return once(once(x))


def redacted(x: str) -> str:
    """E-mail, then card, then phone numbers as placeholders; what RE2 lacks is said by the characters around."""
    mail = f"regexp_replace({x}, '{X.EMAIL}', '[EMAIL]', 'g')"
    card = bounded(mail, "[^0-9]", r"[0-9](?:[ -]?[0-9]){12,15}", "[^0-9]", "[CARD]")
    return bounded(card, r"[^0-9A-Za-z_-]", r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}", r"[^0-9A-Za-z_-]", "[PHONE]")


def oracle_sql() -> dict[str, str]:
    return {
        "q07_redaction": f"""WITH t AS (SELECT rec_id, {FULL} AS t FROM dialogues), r AS (SELECT rec_id, t, {redacted('t')} AS redacted FROM t)
            SELECT rec_id, ({' + '.join(f"(length(redacted) - length(replace(redacted, '{p}', ''))) // {len(p)} - (length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in ('[EMAIL]', '[CARD]', '[PHONE]'))})::INT AS replacements, redacted FROM r""",
        "q05_drop_report": f"""WITH e AS (SELECT * FROM ({each('')}) WHERE coalesce(length({strip('m.content')}), 0) >= 2), g AS ({merged('e')}), x AS (SELECT rec_id, r, role, {redacted('content')} AS content, max(CASE WHEN role = 'assistant' THEN r END) OVER (PARTITION BY rec_id) AS last FROM g),
            c AS (SELECT rec_id, list({{'role': role, 'content': content}} ORDER BY r) AS msgs, string_agg(coalesce(role, '') || ': ' || {collapse('content')}, chr(10) ORDER BY r) AS text FROM x WHERE r <= last GROUP BY rec_id),
            d AS (SELECT rec_id, coalesce(source, '(none)') AS source, CASE WHEN messages IS NULL THEN 'conversion_failed' WHEN c.rec_id IS NULL THEN 'empty_after_filter' WHEN coalesce(substr(lower(trim(lang)), 1, 2), '') <> 'en' THEN 'not_en' END AS dropped, msgs, text FROM dialogues LEFT JOIN c USING (rec_id)),
            w AS (SELECT *, row_number() OVER (PARTITION BY dropped IS NULL, text ORDER BY rec_id) AS rn FROM d), v AS (SELECT source, CASE WHEN dropped IS NOT NULL THEN dropped WHEN rn > 1 THEN 'duplicate' WHEN len({errors('msgs', n_assistant('msgs'), "'en'")}) > 0 THEN 'validation_failed' ELSE 'kept' END AS reason FROM w)
            SELECT coalesce(source, 'all') AS source, coalesce(reason, 'all') AS reason, count(*) AS n FROM v GROUP BY CUBE (source, reason)""",
        "q20_merged_strata": f"""WITH c AS (SELECT {SCENARIO} AS s, {bucket('n_turns')} AS b, count(*) AS n FROM dialogues WHERE n_turns IS NOT NULL GROUP BY ALL), w AS (SELECT s, coalesce(sum(n) FILTER (b = 'short'), 0) AS x, coalesce(sum(n) FILTER (b = 'mid'), 0) AS y, coalesce(sum(n) FILTER (b = 'long'), 0) AS z FROM c GROUP BY s),
            g AS (SELECT *, CASE WHEN x >= 40 AND y >= 40 AND z >= 40 THEN [[1], [2], [3]] WHEN x >= 40 AND y >= 40 THEN [[1], [2, 3]] WHEN x >= 40 AND y + z >= 40 THEN [[1], [2, 3]] WHEN x >= 40 THEN [[1, 2, 3]]
                WHEN x + y >= 40 AND z >= 40 THEN [[1, 2], [3]] WHEN x + y + z >= 40 THEN [[1, 2, 3]] END AS parts FROM w),
            u AS (SELECT s, unnest(parts) AS part, x, y, z FROM g), l AS (SELECT s || '|' || array_to_string(list_filter(list_transform(part, lambda k: CASE WHEN [x, y, z][k] > 0 THEN ['short', 'mid', 'long'][k] END), lambda b: b IS NOT NULL), '+') AS stratum, list_sum(list_transform(part, lambda k: [x, y, z][k])) AS n FROM u),
            pool AS (SELECT coalesce(sum(x + y + z), 0) AS n FROM g WHERE parts IS NULL), best AS (SELECT stratum FROM l ORDER BY n DESC, stratum LIMIT 1)
            SELECT stratum, sum(n)::BIGINT AS n FROM (SELECT * FROM l UNION ALL SELECT CASE WHEN n >= 40 THEN 'misc|all' ELSE coalesce((SELECT stratum FROM best), 'misc|all') END, n FROM pool WHERE n > 0) GROUP BY stratum""",
        "q35_edit_share": f"""WITH p AS (SELECT pair_id, regexp_replace(coalesce(chosen, ''), '[^\\x00-\\x7F]', '?', 'g') AS a, regexp_replace(coalesce(rejected, ''), '[^\\x00-\\x7F]', '?', 'g') AS b FROM preference_pairs), d AS (SELECT pair_id, {collapse('a')} AS a, {collapse('b')} AS b FROM p)
            SELECT pair_id, CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END AS share FROM d""",
        "q45_format_conversion": f"""WITH e AS ({each('')}), bad AS (SELECT rec_id, count(*) FILTER (m.content IS NULL OR m.role IS NULL OR NOT m.role IN ('user', 'assistant', 'system')) > 0 OR count(*) FILTER (m.role <> 'system') = 0 AS bad FROM e GROUP BY rec_id),
            s AS (SELECT rec_id, 0 AS r, 'system' AS role, string_agg(m.content, chr(10) ORDER BY i) AS content FROM e WHERE m.role = 'system' GROUP BY rec_id), b AS (SELECT * FROM e WHERE m.role <> 'system'),
            a AS (SELECT * FROM s UNION ALL {merged('b')}), t AS (SELECT rec_id, count(*) AS n, string_agg(role || ': ' || {collapse('content')}, chr(10) ORDER BY r) AS text FROM a GROUP BY rec_id)
            SELECT rec_id, NOT coalesce(bad, true) AS converted, CASE WHEN NOT bad THEN n END::INT AS n_messages, CASE WHEN NOT bad THEN md5(text) END AS digest FROM (SELECT rec_id FROM dialogues WHERE messages IS NOT NULL) LEFT JOIN bad USING (rec_id) LEFT JOIN t USING (rec_id)""",
        "q46_context": f"""WITH c AS (SELECT rec_id, CASE WHEN messages[-1].role = 'assistant' THEN messages[1:len(messages) - 1] ELSE messages END AS c FROM dialogues), k AS (SELECT rec_id, CASE WHEN c[-1].role = 'user' THEN c END AS c FROM c)
            SELECT rec_id, len(c)::INT AS n_messages, list_sum(list_transform(c, lambda m: coalesce(length(m.content), 0)))::INT AS chars, md5({TRANSCRIPT.replace("<>", "c")}) AS digest FROM k""",
        "q50_jsonl_round_trip": "SELECT doc_id, md5(text) AS digest, lang, (SELECT count(*) FROM documents) AS written FROM documents",
        "q51_json_array": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "q52_load_dialogues": f"""WITH e AS (SELECT {errors('messages', 'n_turns', 'lang')} AS e FROM dialogues) SELECT error, count(*) AS n FROM (SELECT unnest(e) AS error FROM e) GROUP BY error UNION ALL SELECT 'valid', count(*) FROM e WHERE len(e) = 0""",
        "q53_load_preferences": f"""WITH e AS (SELECT {PREFERENCE} AS e FROM preference_pairs) SELECT error, count(*) AS n FROM (SELECT unnest(e) AS error FROM e) GROUP BY error UNION ALL SELECT 'valid', count(*) FROM e WHERE len(e) = 0""",
        "q54_load_probes": f"SELECT pair_id::VARCHAR AS id, scenario AS category, md5({plain('context')}) AS digest FROM preference_pairs WHERE context[-1].role = 'user'",
        "q55_load_seeds": f"SELECT {SCENARIO} AS scenario, count(*) AS n, sum(item_id)::BIGINT AS ids FROM eval_items GROUP BY 1",
        "q56_load_results": "SELECT result_id, coalesce(gen_config.model_tag, 'none') AS model_tag, md5(completion) AS digest FROM results",
        "q57_request_logs": """SELECT concurrency, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(ttft_ms) AS n_ttft, min(start_ts) AS first, max(total_ms) FILTER (NOT isnan(total_ms)) AS slowest, sum(n_output_tokens)::BIGINT AS tokens FROM raw_1 GROUP BY concurrency""",
        "q58_csv_report": "SELECT event_type, count(*) AS n, min(value) AS low FROM events GROUP BY event_type",
        "q59_merged_messages": f"""WITH e AS ({each('')}), r AS ({merged('e')}) SELECT rec_id, count(*)::INT AS n_messages, md5(string_agg(coalesce(role, '') || ':' || coalesce(content, ''), chr(10) ORDER BY r)) AS digest FROM r GROUP BY rec_id""",
        "q60_token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '[{WORDS}]+|[^{WORDS}{SPACE}]'))::INT AS tokens FROM documents",
        "q61_instruction_format": f"""WITH r AS (SELECT pair_id, {strip("list_filter(context, lambda m: m.role = 'user')[-1].content")} AS q, CASE WHEN pair_id % 3 = 0 THEN {strip('scenario')} END AS more, {strip('chosen')} AS a FROM preference_pairs),
            s AS (SELECT pair_id, CASE WHEN coalesce(length(more), 0) > 0 THEN concat_ws(chr(10) || chr(10), q, more) ELSE q END AS q, a, coalesce(length(q), 0) > 0 AND coalesce(length(a), 0) > 0 AS fine FROM r)
            SELECT pair_id, fine AS converted, CASE WHEN fine THEN md5('user:' || q || chr(10) || 'assistant:' || a) END AS digest FROM s""",
        "q62_prefixed_format": f"""WITH e AS ({each('')}), c AS (SELECT rec_id, i, CASE m.role WHEN 'user' THEN 'Customer: ' WHEN 'assistant' THEN 'Salesman: ' ELSE 'Note: ' END || m.content AS cell FROM e WHERE i <= 6), k AS (SELECT *, lead(cell) OVER (PARTITION BY rec_id ORDER BY i) AS nxt FROM c WHERE coalesce(length({strip('cell')}), 0) > 0),
            p AS (SELECT rec_id, i, {strip('substr(cell, 10)')} AS q, {strip('substr(nxt, 10)')} AS a FROM k WHERE starts_with(cell, 'Customer:') AND starts_with(nxt, 'Salesman:'))
            SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS pair_idx, length(q) > 0 AND length(a) > 0 AS converted, CASE WHEN length(q) > 0 AND length(a) > 0 THEN md5('user:' || q || chr(10) || 'assistant:' || a) END AS digest FROM p""",
        "q63_preference_training": f"""SELECT pair_id, md5({plain("CASE WHEN context[1].role = 'system' THEN context ELSE list_concat([{'role': 'system', 'content': 'Be brief.'}], context) END")}) AS prompt, md5('assistant:' || coalesce(chosen, '')) AS chosen, md5('assistant:' || coalesce(rejected, '')) AS rejected
            FROM preference_pairs WHERE context[-1].role = 'user'""",
        "q64_probes": f"""WITH b AS (SELECT rec_id, messages, len(messages) - list_position(list_reverse(list_transform(messages, lambda m: coalesce(m.role, ''))), 'assistant') AS k FROM dialogues), p AS (SELECT rec_id, CASE WHEN k > 0 THEN messages[1:k] END AS p, CASE WHEN k > 0 THEN messages[k + 1].content END AS g FROM b)
            SELECT rec_id, len(p)::INT AS n_prompt, CASE WHEN p IS NOT NULL THEN md5({plain('p')}) END AS digest, md5(g) AS gold FROM p""",
        "q65_judge_prompts": f"SELECT result_id, md5({PROMPT}) AS digest FROM (SELECT *, coalesce(completion, '') AS reply, prompt_messages AS msgs FROM results)",
        "q66_reasoning_parts": f"""SELECT result_id, md5({strip("coalesce(completion, '')")}) AS content, CASE WHEN result_id % 6 = 0 THEN 'given' WHEN result_id % 3 = 0 THEN 'why' WHEN result_id % 3 = 1 THEN '' END AS reasoning,
            md5(CASE result_id % 3 WHEN 0 THEN '<think> why </think>' || chr(10) || coalesce(completion, '') WHEN 1 THEN regexp_replace(coalesce(completion, ''), '^{WS}+', '') ELSE coalesce(completion, '') END) AS kept FROM results""",
        "q67_dialogue_gate": f"""SELECT CASE WHEN rec_id % 7 = 0 THEN 'not_json' WHEN rec_id % 7 = 1 OR messages IS NULL OR {GATE} THEN 'schema' WHEN len({errors('messages', n_assistant('messages'), "'en'")}) > 0 THEN 'semantic' WHEN {n_assistant('messages')} < 2 THEN 'too_few_turns'
            WHEN regexp_matches(list_aggregate(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content), 'string_agg', chr(10)), '(?i){UNWANTED_SQL}') THEN 'forbidden_text' ELSE 'passed' END AS outcome, count(*) AS n FROM dialogues GROUP BY 1""",
        "q68_preference_gate": f"""SELECT CASE WHEN pair_id % 5 = 0 THEN 'not_json' WHEN context IS NULL OR len(list_filter(context, lambda m: m.role IS NULL OR m.content IS NULL)) > 0 OR len({PREFERENCE}) > 0 THEN 'schema' WHEN regexp_matches(chosen, '(?i){UNWANTED_SQL}') THEN 'forbidden_text' ELSE 'passed' END AS outcome, count(*) AS n FROM preference_pairs GROUP BY 1""",
        "q69_rule_failures": f"""WITH f AS (SELECT result_id, n_tokens, {FLAG_COLUMNS} FROM ({FLAGS}) JOIN (SELECT result_id, n_tokens FROM results) USING (result_id)), l AS (SELECT result_id, n_tokens, list_filter([CASE WHEN pattern_hit THEN 'pattern_hit' END, CASE WHEN over_length THEN 'over_length' END, CASE WHEN role_break THEN 'role_break' END, CASE WHEN no_question THEN 'no_question' END], lambda x: x IS NOT NULL) AS l FROM f)
            SELECT result_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS rule, n_tokens::VARCHAR AS detail FROM l WHERE len(l) > 0""",
        "q70_stream_summaries": f"""SELECT request_id, a * 1000 AS ttft_ms, CASE WHEN a IS NOT NULL THEN (a + g + g) * 1000 END AS total_ms, coalesce(n_output_tokens, CASE WHEN a IS NULL THEN 0 ELSE 3 END)::INT AS n_output_tokens, ok, CASE WHEN a IS NULL THEN 0 ELSE 2 END::INT AS n_gaps FROM ({STREAMS})""",
        "q71_stream_rollup": f"""WITH l AS (SELECT concurrency, count(*) AS n, count(a) AS n_with_output, sum(coalesce(n_output_tokens, CASE WHEN a IS NULL THEN 0 ELSE 3 END))::BIGINT AS tokens, list_sort(list(a) FILTER (a IS NOT NULL)) AS t, list_sort(list(a + g + g) FILTER (a IS NOT NULL)) AS w FROM ({STREAMS}) GROUP BY concurrency)
            SELECT concurrency, n, n_with_output, tokens, {', '.join(f"{percentile(v, p / 100)} AS {c}_p{p}" for v, c in (('t', 'ttft'), ('w', 'total')) for p in (50, 95))} FROM l""",
        "q72_speedup": "SELECT concurrency, count(*) * min(total_ms) / max(total_ms) AS speedup, sum(n_output_tokens) / max(total_ms) AS per_ms FROM raw_1 WHERE total_ms > 0 AND NOT isnan(total_ms) GROUP BY concurrency",
        "q73_compared_generations": """WITH d AS (SELECT pair_id, coalesce(chosen, '') AS a, coalesce(rejected, '') AS b, string_split(chosen, ' ') AS u, string_split(rejected, ' ') AS v FROM preference_pairs), s AS (SELECT *, list_zip(regexp_extract_all(a, '(?s).'), regexp_extract_all(b, '(?s).')) AS z FROM d),
            w AS (SELECT pair_id, list_transform(string_split(a, ' ')[1:2], lambda x: length(x)) = list_transform(string_split(b, ' ')[1:2], lambda x: length(x)) AS match, CASE WHEN a <> b THEN list_position(list_transform(z, lambda p: p[1] IS DISTINCT FROM p[2]), true) - 1 END::INT AS first_char, coalesce(u, ['']) AS u, coalesce(v, ['']) AS v FROM s)
            SELECT pair_id, match, first_char, CASE WHEN u <> v THEN list_position(list_transform(list_zip(u, v), lambda p: p[1] IS DISTINCT FROM p[2]), true) - 1 END::INT AS first_token FROM w""",
        "q74_consistency": """WITH d AS (SELECT pair_id, coalesce(chosen, '') = coalesce(rejected, '') AS match FROM preference_pairs)
            SELECT count(*) AS n_total, count(*) FILTER (NOT match) AS n_mismatch, bool_and(match) AS consistent, count(*) FILTER (NOT match) AS n_changed, sum(pair_id) FILTER (NOT match)::BIGINT AS mismatched_ids FROM d""",
        "q75_zipped_rows": """WITH a AS (SELECT result_id AS prompt_id, row_number() OVER (ORDER BY result_id) AS position FROM results), b AS (SELECT result_id AS reply_id, coalesce(length(completion), 0)::INT AS chars, row_number() OVER (ORDER BY coalesce(length(completion), 0), result_id) AS position FROM results)
            SELECT prompt_id, position, reply_id, chars FROM a JOIN b USING (position)""",
        "q76_parameter_grid": "SELECT (4 * 2 ** r_regionkey)::INT AS rank, (n_nationkey * 2)::INT AS rate, (8 * 2 ** r_regionkey)::INT AS alpha FROM region, nation",
        "q77_picked_examples": f"""WITH i AS (SELECT {SCENARIO} AS scenario, item_id FROM eval_items), g AS (SELECT scenario, row_number() OVER (ORDER BY sha256('42:task:' || scenario)) - 1 AS p, count(*) OVER () AS a FROM (SELECT DISTINCT scenario FROM i)),
            t AS (SELECT task_idx, scenario FROM (SELECT unnest(range(0, 200)) AS task_idx) JOIN g ON task_idx % a = p),
            r AS (SELECT task_idx, scenario, item_id, row_number() OVER (PARTITION BY task_idx ORDER BY sha256('42:' || task_idx || ':' || item_id), item_id) AS place, 1 + ('0x' || substr(sha256('42:count:' || task_idx), 1, 12))::BIGINT % 3 AS most FROM t JOIN i USING (scenario))
            SELECT task_idx, scenario, item_id, place FROM r WHERE place <= most""",
        "q78_every_kth": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, greatest(count(*) OVER () // 37, 1) AS k FROM documents) SELECT doc_id FROM r WHERE p % k = 0 AND p // k < 37",
        "q79_log_series": """SELECT metric, step, value FROM (SELECT 'loss' AS metric, c_custkey AS step, c_acctbal AS value FROM customer UNION ALL SELECT 'eval_loss', c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0) WHERE step % 11 <> 0""",
        "q80_ranked_runs": "SELECT c_nationkey, min(c_acctbal) FILTER (c_nationkey % 4 <> 0) AS best_loss FROM customer GROUP BY c_nationkey",
        "q81_sizes": """WITH s AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 128 ELSE p_size * 64 // 8 END AS d, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 8 END AS k FROM part)
            SELECT p_partkey, d::BIGINT AS head_dim, (2 * (p_size + 1) * k * d * 2)::BIGINT AS bytes_per_token, CASE WHEN p_size <> 0 THEN p_partkey / p_size END AS ratio, (p_partkey - p_size - 2)::BIGINT AS budget FROM s""",
        "q82_judge_average": f"""WITH m AS (SELECT judge, gen_config.model_tag AS tag, sum(1 + (coalesce(n_tokens, 0) + 2) % 5) / count(*) AS mean FROM results, (VALUES ('j1'), ('j2')) v(judge) GROUP BY ALL) SELECT tag, 'size' AS dimension, avg(mean) AS mean, count(*) AS judges FROM m GROUP BY tag""",
        "q83_judge_samples": f"""WITH d AS (SELECT pair_id, {SCENARIO} AS scenario FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL), s AS (SELECT scenario, count(*) AS size, sum(count(*)) OVER () AS total FROM d GROUP BY scenario),
            b AS (SELECT *, floor(size * 60 / total) AS base, size * 60 / total - floor(size * 60 / total) AS rest FROM s),
            q AS (SELECT scenario, CASE WHEN total <= 60 THEN size ELSE base + CASE WHEN row_number() OVER (ORDER BY rest DESC, scenario) <= 60 - sum(base) OVER () THEN 1 ELSE 0 END END AS quota FROM b),
            r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY sha256('42:' || scenario || ':' || pair_id), pair_id) AS rn FROM d)
            SELECT pair_id, tag, scenario FROM r JOIN q USING (scenario), (VALUES ('chosen'), ('rejected')) v(tag) WHERE rn <= quota""",
        "q84_lsh_links": f"""WITH {SHINGLES}, sides AS (SELECT a, b, similarity FROM near UNION ALL SELECT b, a, similarity FROM near), l AS (SELECT a, min(b) FILTER (similarity = 1) AS twin FROM sides GROUP BY a),
            i AS (SELECT s.doc_id, least(s.doc_id, coalesce(twin, s.doc_id)) AS text_id FROM sizes s LEFT JOIN l ON l.a = s.doc_id), k AS (SELECT p.text_id, count(DISTINCT q.text_id) AS n FROM sides JOIN i p ON p.doc_id = a JOIN i q ON q.doc_id = b WHERE p.text_id <> q.text_id GROUP BY p.text_id)
            SELECT doc_id, text_id, coalesce(n, 0) AS n_links FROM i LEFT JOIN k USING (text_id)""",
        "q85_generate": """WITH s AS (SELECT result_id, CASE WHEN prompt_messages[1].role = 'system' THEN prompt_messages ELSE list_concat([{'role': 'system', 'content': 'Be brief.'}], coalesce(prompt_messages, [])) END AS m FROM results),
            r AS (SELECT result_id, list_aggregate(list_transform(m, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10)), 'string_agg', '') || '<|im_start|>assistant' || chr(10) AS t FROM s)
            SELECT result_id, true AS ok, (length(t) - length(replace(t, chr(10), '')))::VARCHAR || ' lines' AS completion, length(t) AS prompt_tokens, 2::BIGINT AS completion_tokens FROM r""",
        "q86_judge_scores": f"""{JUDGED} SELECT result_id::VARCHAR AS id, tag, judge, CASE WHEN n % 7 <> 0 THEN 1 + n % 5 END::INT AS clear, CASE WHEN n % 7 <> 0 THEN 1 + (n + size) % 5 END::INT AS kind, CASE WHEN n % 7 = 0 THEN 'not_json' END AS error FROM j""",
        "q87_judge_usage": f"""{JUDGED} SELECT judge, sum(CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END)::BIGINT AS requests, sum(CASE WHEN n % 7 = 0 THEN 2 * n ELSE n END)::BIGINT AS prompt_tokens, sum(CASE WHEN n % 7 = 0 THEN 6 ELSE 3 END)::BIGINT AS completion_tokens FROM j GROUP BY judge""",
        "q88_synthesis_errors": f"""WITH {TASKS} SELECT CASE WHEN task_idx % 5 = 0 THEN 'not_json' WHEN task_idx % 3 = 0 THEN 'semantic' ELSE 'accepted' END AS kind, count(*) AS n FROM t GROUP BY 1""",
        "q89_synthesis_cost": f"""WITH {TASKS}, u AS (SELECT *, CASE WHEN task_idx % 5 = 0 OR task_idx % 3 = 0 THEN 2 ELSE 1 END AS r FROM t)
            SELECT (task_idx % 2)::VARCHAR AS parity, count(*) AS tasks, count(*) FILTER (r = 1) AS accepted, sum(r)::BIGINT AS requests, sum(r * task_idx)::BIGINT AS prompt_tokens, sum(7 * r)::BIGINT AS completion_tokens FROM u GROUP BY 1""",
        "q90_trace_summary": f"""WITH e AS ({each('')}) SELECT rec_id::VARCHAR AS conversation_id, count(*) AS turns, count(*) FILTER (regexp_matches(coalesce(m.content, ''), '(?i){UNWANTED_SQL}') OR regexp_matches(coalesce(m.content, ''), '(?i)as an ai|language model|virtual assistant') OR len(regexp_extract_all(coalesce(m.content, ''), '[{WORDS}]+|[^{WORDS}{SPACE}]')) > 60) AS failed_turns,
            sum(length(m.content))::DOUBLE AS latency_ms, sum(i - 1)::BIGINT AS prompt_tokens, count(*) AS completion_tokens FROM e GROUP BY rec_id""",
        "q91_trace_sink": f"""WITH e AS ({each('')}) SELECT rec_id::VARCHAR AS conversation_id, i - 1 AS turn_index, md5(coalesce(m.content, '')) AS digest FROM e""",
        "q92_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL",
        "q93_evaluation_turns": f"""SELECT result_id::VARCHAR AS conversation_id, md5({strip('c')}) AS digest, u::BIGINT AS completion_tokens, (pattern_hit::INT + over_length::INT + role_break::INT + no_question::INT) AS n_failures
            FROM (SELECT result_id, c, {FLAG_COLUMNS} FROM ({FLAGS})) JOIN (SELECT result_id, usage_completion_tokens AS u FROM results) USING (result_id)""",
        "q94_usage": "SELECT result_id, n_tokens::BIGINT AS prompt_tokens, usage_completion_tokens::BIGINT AS completion_tokens, NULL::BIGINT AS total_tokens, 'http://host/' || coalesce(source, '') || '/models' AS url FROM results",
    }
