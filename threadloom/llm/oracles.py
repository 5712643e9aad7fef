"""DuckDB SQL of the llm queries that SQL can express over whole tables."""

from __future__ import annotations

from threadloom.llm.answers import PLACEHOLDERS
from threadloom.plans import sql as S

_SPLIT = f"CASE lower({S.strip('meta.split')}) WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'dev' THEN 'val' WHEN 'test' THEN 'test' END"
_RECORDS = f"""records AS (SELECT record_id, weakness_id, regexp_replace(weakness_id, '_Reviewer_.*$', '') AS paper, split
    FROM {S.latest("sft_train", "record_id", "exported_at", {"weakness_id": "meta.weakness_id", "split": _SPLIT})})"""


def _set(c: str) -> str:
    return f"list_distinct({S.words(c)})"


_NEAR = "10 * length(list_intersect(a.w, b.w)) >= 7 * (length(a.w) + length(b.w) - length(list_intersect(a.w, b.w)))"
_SIZE = "length(a.w) >= 0.7 * length(b.w) AND length(b.w) >= 0.7 * length(a.w)"

P1 = f"""
    WITH {_RECORDS},
    w AS (SELECT record_id, split = 'train' AS train, {_set('t')} AS w FROM records JOIN {S.latest("classified_weakness_pairs", "weakness_id", "classified_at", {"t": "original_weakness"})} USING (weakness_id) WHERE split IS NOT NULL AND t IS NOT NULL),
    s AS (SELECT paper, bool_or(split = 'train') AS train, bool_or(split <> 'train') AS eval FROM records WHERE split IS NOT NULL GROUP BY 1),
    p AS (SELECT paper, train, eval, {_set('t')} AS w FROM s JOIN {S.latest("paper_context", "submission_id", "fetched_at", {"t": "title"})} ON paper = submission_id WHERE t IS NOT NULL)
    SELECT DISTINCT 'weakness' AS field_name, least(a.record_id, b.record_id) AS key_a, greatest(a.record_id, b.record_id) AS key_b FROM w a JOIN w b ON a.train AND NOT b.train AND {_SIZE}
        WHERE length(a.w) >= 8 AND length(b.w) >= 8 AND {_NEAR}
    UNION ALL SELECT DISTINCT 'title', least(a.paper, b.paper), greatest(a.paper, b.paper) FROM p a JOIN p b ON a.train AND b.eval AND a.paper <> b.paper AND {_SIZE} WHERE length(a.w) > 0 AND length(b.w) > 0 AND {_NEAR}"""

P2 = f"""
    WITH t AS (SELECT 'weakness' AS field_name, weakness_id AS id, {_set('t')} AS w FROM {S.latest("classified_weakness_pairs", "weakness_id", "classified_at", {"t": "original_weakness"})} WHERE t IS NOT NULL
        UNION ALL SELECT 'claim', weakness_id, {_set('t')} FROM {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"t": "enhanced_review.claim"})} WHERE t IS NOT NULL)
    SELECT a.field_name, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.field_name = b.field_name AND a.id < b.id AND {_SIZE} WHERE length(a.w) >= 8 AND length(b.w) >= 8 AND {_NEAR}"""

_P2_TEXTS = P2[P2.index("WITH") : P2.index("    SELECT a.field_name")].rstrip()
P2_LINKS = f"""
    {_P2_TEXTS}, l AS (SELECT * FROM t WHERE length(w) >= 8),
    p AS (SELECT a.field_name, a.id, count(*) AS n FROM l a JOIN l b ON a.field_name = b.field_name AND a.id <> b.id AND {_SIZE} WHERE {_NEAR} GROUP BY 1, 2)
    SELECT field_name, id, min(id) OVER (PARTITION BY field_name, list_sort(w)) AS class_id, coalesce(n, 0) AS n_links FROM l LEFT JOIN p USING (field_name, id)"""

_SPEAKER = f"""CASE WHEN NOT {S.blank('role')} AND lower({S.strip('role')}) <> 'unknown' THEN lower({S.strip('role')}) ELSE
    nullif(regexp_extract(lower(regexp_extract(coalesce(actor_id, ''), '([^/]*)/*\\s*$', 1)), '^(reviewer|author|area_chair|program_chair)', 1), '') END"""
P3 = f"""
    WITH RECURSIVE v AS (SELECT event_id, submission_id, {S.strip('reply')} AS reply, {S.blank('reply')} OR {S.strip('reply')} = submission_id AS opens, t, message, speaker FROM {S.latest("thread_events", "event_id", "fetched_at",
        {"submission_id": "submission_id", "reply": "reply_to_event_id", "t": "epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ))", "message": f"NOT {S.blank('text')}", "speaker": _SPEAKER})} WHERE submission_id IS NOT NULL),
    r AS (SELECT event_id AS opener_id, event_id, submission_id, t, 0 AS links, message, speaker FROM v WHERE opens
        UNION ALL SELECT r.opener_id, v.event_id, v.submission_id, greatest(v.t, r.t), r.links + 1, v.message, v.speaker FROM r JOIN v ON NOT v.opens AND v.reply = r.event_id AND v.submission_id = r.submission_id),
    k AS (SELECT opener_id FROM r GROUP BY 1 HAVING bool_or(event_id = opener_id AND message) AND NOT bool_or(message AND speaker IS NULL) AND min(CASE WHEN message THEN speaker END) <> max(CASE WHEN message THEN speaker END))
    SELECT opener_id, CAST(row_number() OVER (PARTITION BY opener_id ORDER BY t NULLS FIRST, links, event_id) AS INTEGER) AS msg_no, event_id FROM r WHERE message AND opener_id IN (SELECT opener_id FROM k)"""

P5 = f"""
    WITH v AS {S.latest("enhanced_data_with_snippets_dual", "weakness_id", "aligned_at", {"a": "aligned_snippets_task1", "b": "aligned_snippets_task2"})},
    s AS (SELECT weakness_id, 'aligned_snippets_task1' AS list_name, unnest(a).text AS t, generate_subscripts(a, 1) AS n FROM v UNION ALL SELECT weakness_id, 'aligned_snippets_task2', unnest(b).text, generate_subscripts(b, 1) FROM v)
    SELECT weakness_id, list_name, CAST(n AS INTEGER) AS snippet_no,
        CASE WHEN list_max(list_transform(string_split_regex(t, '[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}.!?;,。]'), lambda x: length(x))) > max_chars THEN 'unbroken' ELSE 'breakable' END AS cut_kind
    FROM s JOIN chunk_limits USING (list_name) WHERE length(t) > max_chars"""

P7 = f"""
    WITH RECURSIVE {_RECORDS},
    papers AS (SELECT DISTINCT paper FROM records),
    authors AS (SELECT DISTINCT submission_id AS paper, unnest(a).author_id AS author FROM {S.latest("paper_context", "submission_id", "fetched_at", {"a": "participants.authors"})}),
    edges AS (SELECT DISTINCT a.paper AS a, b.paper AS b FROM authors a JOIN authors b USING (author) WHERE a.paper <> b.paper AND NOT {S.blank('author')} AND a.paper IN (FROM papers) AND b.paper IN (FROM papers)),
    reach AS (SELECT paper AS a, paper AS b FROM papers UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
    roots AS (SELECT a AS paper, min(b) AS root FROM reach GROUP BY 1),
    g AS (SELECT root, min(record_id) AS group_id FROM records JOIN roots USING (paper) GROUP BY 1 HAVING count(DISTINCT split) > 1)
    SELECT record_id, group_id FROM records JOIN roots USING (paper) JOIN g USING (root)"""

_P7_ROOTS = P7[: P7.index("    g AS (SELECT")].rstrip().rstrip(",")
P7_FOREST = f"{_P7_ROOTS}, g AS (SELECT root, min(record_id) AS group_id FROM records JOIN roots USING (paper) GROUP BY 1) SELECT group_id, count(*) AS n_papers, count(*) - 1 AS n_edges FROM roots JOIN g USING (root) GROUP BY 1"
P7_CHECK = f"{_P7_ROOTS} SELECT count(*) AS n_records, count(DISTINCT root) AS n_groups, 0::BIGINT AS n_divided, true AS shares_met FROM records JOIN roots USING (paper)"

_P5_TEXTS = P5[: P5.index("    SELECT weakness_id, list_name, CAST(n AS INTEGER)")].rstrip()
P5_CHECK = f"{_P5_TEXTS} SELECT list_name, count(*) AS n_texts, CAST(sum(length(t)) AS BIGINT) AS n_chars, 0::BIGINT AS n_over, 0::BIGINT AS n_wrong FROM s JOIN chunk_limits USING (list_name) WHERE length(t) > max_chars GROUP BY 1"

_EMPTY = f"lower(regexp_replace({S.collapse('coalesce(a, {q}{q})').replace('{q}', chr(39))}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) IN ({', '.join(map(S.quote, sorted(PLACEHOLDERS)))})"
P6_EMPTY = f"""
    WITH m AS (SELECT record_id, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM {S.latest("sft_train", "record_id", "exported_at", {"m": "messages"})}),
    r AS (SELECT record_id, i, lower({S.strip('m.role')}) AS role, m.content AS content FROM m),
    u AS (SELECT record_id, i, row_number() OVER (PARTITION BY record_id ORDER BY i) AS n FROM r WHERE role = 'user'),
    t AS (SELECT 'sft_train' AS table_name, u.record_id AS record_key, u.n AS pair_no, x.content AS a FROM u LEFT JOIN r x ON x.record_id = u.record_id AND x.i = u.i + 1 AND x.role = 'assistant' WHERE n <= 2
        UNION ALL SELECT 'enhanced_reviews', weakness_id, 1, c FROM {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"c": "enhanced_review.claim"})})
    SELECT table_name, record_key, CAST(pair_no AS INTEGER) AS pair_no FROM t WHERE {_EMPTY}"""

P8_CHECK = "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_divided, 0::BIGINT AS n_wrong FROM container_sizes"
P9_CHECK = f"""
    WITH s AS (SELECT regexp_replace(regexp_replace(lower({S.strip('source')}), '[\\s_-]+', '_', 'g'), '([^s])s$', '\\1') AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1)
    SELECT source, coalesce(n, 0) AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_foreign FROM mix_targets LEFT JOIN s USING (source)"""

_SIDES = "bool_or(split = 'train') AS train, bool_or(split <> 'train') AS eval FROM records WHERE split IS NOT NULL GROUP BY 2"
_NEIGHBOURS = "list_transform(range(1, length({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_P1_MET = f"""{_RECORDS},
    u AS (SELECT 'weakness' AS field_name, weakness_id AS id, {_SIDES} UNION ALL SELECT 'title', paper, {_SIDES}),
    t AS (SELECT 'weakness' AS field_name, weakness_id AS id, t FROM {S.latest("classified_weakness_pairs", "weakness_id", "classified_at", {"t": "original_weakness"})} UNION ALL SELECT 'title', submission_id, t FROM {S.latest("paper_context", "submission_id", "fetched_at", {"t": "title"})}),
    x AS (SELECT u.*, list_sort({_set('t')}) AS w FROM u JOIN t USING (field_name, id) WHERE t IS NOT NULL),
    n AS (SELECT a.field_name, a.id AS id_t, b.id AS id_e, length(list_intersect(a.w, b.w)) AS common_words, {_NEIGHBOURS.format("a.w")} AS a, {_NEIGHBOURS.format("b.w")} AS b
        FROM x a JOIN x b ON a.field_name = b.field_name AND a.train AND b.eval AND {_SIZE} WHERE least(length(a.w), length(b.w)) >= CASE WHEN a.field_name = 'weakness' THEN 8 ELSE 1 END AND {_NEAR}),
    m AS (SELECT *, list_transform(a, lambda x: list_contains(b, x)) AS m FROM n),
    s AS (SELECT field_name, id_t, id_e, common_words, length(list_filter(range(1, length(m) + 1), lambda i: m[i] AND (i = 1 OR NOT m[i - 1]))) AS spans, length(list_filter(m, lambda x: x)) AS pairs FROM m)"""
P1_SPANS = f"WITH {_P1_MET} SELECT field_name, id_t, id_e, common_words, spans, pairs + spans AS matched_words FROM s"
P1_REPORT = f"""
    WITH {_P1_MET},
    h AS (SELECT id_e AS weakness_id, sum(spans) AS spans, sum(common_words) AS common_words FROM s WHERE field_name = 'weakness' GROUP BY 1),
    p AS (SELECT DISTINCT id_e AS paper FROM s WHERE field_name = 'title' AND id_t <> id_e),
    v AS (SELECT submission_id AS paper, max(venue) AS venue FROM paper_context GROUP BY 1)
    SELECT split, venue, count(*) AS n_records, count(spans) AS n_overlapping, count(p.paper) AS n_same_title, CAST(coalesce(sum(spans), 0) AS BIGINT) AS spans, CAST(coalesce(sum(common_words), 0) AS BIGINT) AS common_words
    FROM records LEFT JOIN h USING (weakness_id) LEFT JOIN p USING (paper) LEFT JOIN v USING (paper) WHERE split <> 'train' GROUP BY 1, 2"""

SQL = {"p1_found": P1, "p1_report": P1_REPORT, "p1_spans": P1_SPANS, "p2_found": P2, "p2_links": P2_LINKS, "p3_found": P3, "p5_found": P5, "p5_check": P5_CHECK, "p6_empty": P6_EMPTY, "p7_found": P7, "p7_forest": P7_FOREST, "p7_check": P7_CHECK, "p8_check": P8_CHECK, "p9_check": P9_CHECK}
