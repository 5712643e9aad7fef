"""Snippets for reviews: chunks of a paper's documents scored, ranked and merged for both tasks, with their SQL.

The documents of a paper stand for its pages: chunk n of a document counts as page n + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import lexical as L
from threadloom.functions import text as X
from threadloom.operators import chunks as C
from threadloom.operators import retrieval as R
from threadloom.plans import sql as S
from threadloom.runtime import cut, latest, spread, table


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "enhanced_reviews")
    r, c = F.col("enhanced_review"), F.col("weakness_category")
    join = lambda a, f=None: F.array_join(F.filter(F.transform(a, lambda x: x[f] if f else x), lambda x: ~X.blank(x)), "\n")
    s = r["actionable_suggestions"]
    sections = F.transform(F.filter(F.coalesce(F.col("paper_context.sections_index"), F.array().cast(rows.schema["paper_context"].dataType["sections_index"].dataType)), lambda x: x.isNotNull()), lambda x: F.struct(F.coalesce(x["name"], F.lit("")).alias("name"), x["page"].cast("int").alias("page")))
    fields = {
        "claim": r["claim"], "evidence": r["evidence"], "weakness": F.col("original_weakness"), "followups": join(F.col("follow_ups"), "text"), "rebuttals": join(F.col("rebuttals")), "meta": F.concat_ws(" ", c["l1_name"], c["l2_name"]),
        "what": join(s, "what"), "where": join(s, "where"), "how": join(s, "how"), "outcome": join(s, "expected_outcome"),
    }
    flat = rows.select("weakness_id", "enhanced_at", F.col("submission_id").alias("group"), F.col("paper_context.pdf_url").alias("pdf_url"), *[F.coalesce(v, F.lit("")).alias(k) for k, v in fields.items()], sections.alias("sections"))
    return latest(flat, ["weakness_id"], "enhanced_at", ["weakness_id", "group", "pdf_url", *fields, "sections"])


def packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "submission_id", "text")
    return docs.select("doc_id", "submission_id", F.posexplode(C.pack(F.col("text"))).alias("chunk_no", "text"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).select(F.col("submission_id").alias("group"), F.col("doc_id").alias("doc"), "chunk_no", (F.col("chunk_no") + 1).alias("page"), "text")


def _prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.prepare_records(spread(cut(records(spark, d), "records"))), R.prepare_chunks(chunks(spark, d))


def case_flags(spark: SparkSession, d: str) -> DataFrame:
    """The cases each record belongs to by all it says; ablation also by its suggestions."""
    flags = R.prepare_records(records(spark, d))
    return flags.select("weakness_id", *[F.col(f"case_{n}").alias(n) for n in L.CASES])


def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 1,400 characters of every document."""
    return packed(spark, d).select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def snippet_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and anchor matches of every record with the chunks of its paper, in all modes."""
    r, c = _prepared(spark, d)
    pairs = R.score_pairs(r, c, list(R.WEIGHTS))
    return pairs.select("weakness_id", F.col("doc").alias("doc_id"), "chunk_no", *[F.col(f"{x}_{m}") for m in R.WEIGHTS for x in ("score", "anchor")])


def snippet_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Chunks around the best three of each record for the first task, within one place in the same document."""
    pairs = R.score_pairs(*_prepared(spark, d), ["task1"])
    return R.neighbourhood(pairs, "weakness_id", "doc", "chunk_no", "score_task1", "anchor_task1", 3, 1).select("weakness_id", F.col("doc").alias("doc_id"), "chunk_no")


def align_task1(spark: SparkSession, d: str) -> DataFrame:
    """The first task's three snippets of each record."""
    return R.align_task1(*_prepared(spark, d)).select("weakness_id", "rank", "id", "score")


def align_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The second task's snippets: evidence and support channels, merged."""
    return R.align(*_prepared(spark, d))


def alignment_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of each record in the first task."""
    r, c = _prepared(spark, d)
    r, c = cut(r, "records"), cut(c, "chunks")
    return R.status(r, c, R.align_task1(r, c))


def snippet_block(spark: SparkSession, d: str) -> DataFrame:
    """The text block that shows a model the first task's snippets, by its digest."""
    best = R.align_task1(*_prepared(spark, d))
    shown = chunks(spark, d).select(F.concat_ws(":", "doc", "chunk_no").alias("id"), "page", "text")
    return R.prompt_block(best, shown, "weakness_id", "id").select("weakness_id", F.md5("block").alias("digest"))


QUERIES = {f.__name__: f for f in [case_flags, pack_chunks, snippet_scores, snippet_neighbourhood, align_task1, align_snippets, alignment_status, snippet_block]}

# --- SQL ---------------------------------------------------------------------------------------------------------------
_JOIN = lambda a: f"coalesce(array_to_string(list_filter({a}, lambda x: NOT {S.blank('x')}), chr(10)), '')"
_OF = lambda f: _JOIN(f'list_transform(r.actionable_suggestions, lambda y: y."{f}")')
_RECORDS = f"""
    v AS {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"grp": "submission_id", "pdf_url": "paper_context.pdf_url", "r": "enhanced_review", "w": "original_weakness", "f": "follow_ups", "b": "rebuttals", "c": "weakness_category", "s": "paper_context.sections_index"})},
    r0 AS (SELECT weakness_id, grp, pdf_url, coalesce(r.claim, '') AS claim, coalesce(r.evidence, '') AS evidence, coalesce(w, '') AS weakness, {_JOIN("list_transform(f, lambda y: y.text)")} AS followups, {_JOIN("b")} AS rebuttals,
        concat_ws(' ', c.l1_name, c.l2_name) AS meta, {_OF("what")} AS what, {_OF("where")} AS "where", {_OF("how")} AS how, {_OF("expected_outcome")} AS outcome, list_filter(s, lambda x: x IS NOT NULL) AS sections FROM v),
    r1 AS (SELECT *, {S.norm("concat_ws(' ', meta, weakness, claim, evidence, followups, rebuttals)")} AS blob, {S.norm("""concat_ws(' ', "where", how, what)""")} AS blob_how FROM r0),
    r2 AS (SELECT *, {S.norm("""concat_ws(' ', blob, what, "where", how)""")} AS blob_all FROM r1)"""


def _cases() -> str:
    return ", ".join(f"{S.has_any('blob_all' if n == 'ablation' else 'blob', m)} AS {n}" for n, m in L.CASES.items())


def _phrases(c: str) -> str:
    return f"list_slice(list_filter(list_transform(string_split_regex({S.norm(c)}, '[.;:\\n]'), lambda p: {S.strip('p')}), lambda p: length(string_split_regex(p, '\\s+')) BETWEEN 2 AND 18 AND length(p) <= 120), 1, 18)"


def _hints(blob: str) -> str:
    return f"list_filter([{', '.join(map(S.quote, R.HINT_WORDS))}], lambda h: regexp_matches({blob}, '\\b' || h || '\\b'))"


def _pages(text: str, blob: str) -> str:
    named = f"list_transform(regexp_extract_all({text}, '(?i)\\bp(?:age)?\\.?\\s*(\\d{{1,6}})\\b', 1), lambda p: CAST(p AS INTEGER))"
    hit = f"list_filter(sections, lambda s: s.page IS NOT NULL AND s.page <> 0 AND length(list_filter({S.tokens('s.name')}, lambda w: contains({blob}, w))) > 0)"
    return f"list_concat({named}, coalesce(list_transform({hit}, lambda s: CAST(s.page AS INTEGER)), []))"


def _anchors(fields: list[str]) -> str:
    text = S.norm("concat_ws(chr(10), " + ", ".join(f'"{f}"' for f in fields) + ")")
    found = ", ".join(f"regexp_extract_all({text}, {S.quote(p)})" for p in L.ANCHORS)
    return f"list_distinct(list_transform(flatten([{found}]), lambda a: {S.strip('a')}))"


def _sections(mode: str) -> str:
    if mode == "task2_support":
        wanted = f"[{', '.join(map(S.quote, R.SUPPORT_SECTIONS))}]"
    else:
        wanted = "flatten([" + ", ".join(f"CASE WHEN {n} THEN [{', '.join(map(S.quote, names))}] ELSE [] END" for n, names in R.PREFERRED_SECTIONS.items()) + "])"
    name, apart = S.norm("s.name"), "abs(page - CAST(s.page AS INTEGER))"
    bad = f"CASE {apart} WHEN 0 THEN -0.18 WHEN 1 THEN -0.08 ELSE 0 END"
    good = f"CASE WHEN length(list_filter({wanted}, lambda p: contains({name}, p))) > 0 THEN CASE {apart} WHEN 0 THEN 0.18 WHEN 1 THEN 0.10 ELSE 0 END ELSE 0 END"
    each = f"CASE WHEN s.page IS NULL OR {name} = '' THEN 0 WHEN {S.has_any(name, R.DISCOURAGED_SECTIONS)} AND {bad} < 0 THEN {bad} ELSE {good} END"
    return f"coalesce(list_sum(list_transform(sections, lambda s: CAST({each} AS DOUBLE))), 0)"


def _terms(mode: str) -> str:
    """The biases and penalties, said once more."""
    has, kinds = (lambda n: S.has_any("t", R.TERMS[n])), (lambda *k: "kind IN (" + ", ".join(map(S.quote, k)) + ")")
    out = [(has("irrelevant"), -0.35)]
    if mode != "task2_support":
        out += [(f"method_clarity AND {kinds('method')}", 0.08), (f"method_clarity AND {has('method')}", 0.12), (f"empirical AND {kinds('table_result', 'protocol', 'implementation')}", 0.06), (f"empirical AND {has('statistics')}", 0.10), (f"empirical AND {has('models')}", 0.08)]
    if mode != "task1":
        out += [(f"ablation AND {has('ablation')}", 0.14), (f"ablation AND {kinds('analysis', 'implementation', 'table_result')}", 0.06)]
    if mode == "task2_evidence":
        formal = "(novelty OR theory)"
        out += [(f"{formal} AND {kinds('method')}", 0.12), (f"{formal} AND {has('formal')}", 0.14), (f"{formal} AND {has('prior')}", 0.12), (f"{formal} AND {has('proofs')}", 0.08), (f"mechanism AND {has('style')}", 0.08), (f"mechanism AND {kinds('method', 'analysis')}", 0.05)]
        out += [(f"(novelty OR theory OR mechanism OR ablation) AND page <= 2 AND {kinds('generic', 'analysis')} AND {has('generic')} AND NOT {has('structural')}", -0.18), (f"novelty AND page <= 2 AND {kinds('generic')} AND NOT {has('novel_prior')}", -0.10)]
        out += [(f"method_clarity AND {kinds('table_result', 'protocol')} AND NOT {has('clarity_keep')}", -0.12), (f"empirical AND {kinds('method')} AND NOT {has('empirical_keep')}", -0.10), (f"{formal} AND {kinds('protocol', 'table_result')} AND NOT {has('theory_keep')}", -0.12)]
    if mode == "task2_support":
        out += [(f"contains(t, 'limitations') AND NOT {has('limits_keep')}", -0.10)] + [(f"{S.has_any('blob_how', words)} AND {kinds(*types)}", points) for words, types, points in R.SUPPORT_TYPES]
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in out)


def _score(mode: str) -> str:
    support = mode == "task2_support"
    parts = [f"{w} * CASE WHEN length(t_{f}) > 0 THEN length(list_intersect(t_{f}, ct)) / length(t_{f}) ELSE 0 END" for f, w in R.WEIGHTS[mode].items()]
    parts += [f"least(0.30, 0.05 * length(list_filter(p_{f}, lambda x: contains(t, x))))" for f in R.PHRASE_FIELDS[mode]]
    all_ = "_all" if support else ""
    distance = f"list_min(list_transform(pages{all_}, lambda p: abs(p - page)))"
    parts += [f"least(0.20, 0.03 * length(list_filter(hints{all_}, lambda h: contains(t, h))))", f"CASE {distance} WHEN 0 THEN 0.18 WHEN 1 THEN 0.10 WHEN 2 THEN 0.05 ELSE 0 END"]
    parts += [f"least(0.45, {0.12 if support else 0.20} * length(list_filter(anchors_{mode}, lambda a: contains(t, a))))", _sections(mode), _terms(mode)]
    return f"round(CAST({' + '.join(parts)} AS DOUBLE), 6) AS score_{mode}, length(list_filter({'anchors_match' if support else f'anchors_{mode}'}, lambda a: contains(t, a))) > 0 AS anchor_{mode}"


def _prepared_sql() -> str:
    text = "concat_ws(' ', claim, evidence, weakness, followups)"
    columns = [f't_{f} := {S.tokens(chr(34) + f + chr(34))}' for f in R.FIELDS] + [f'p_{f} := {_phrases(chr(34) + f + chr(34))}' for f in R.FIELDS]
    columns += [f"hints := {_hints('blob')}", f"hints_all := {_hints('blob_all')}", f"pages := {_pages(text, 'blob')}"]
    columns += ["pages_all := " + _pages("""concat_ws(' ', claim, evidence, weakness, followups, "where")""", "blob_all")]
    columns += [f"anchors_{m} := {_anchors(f)}" for m, f in R.ANCHOR_FIELDS.items()] + [f"anchors_match := {_anchors(R.MATCH_FIELDS['task2_support'])}"]
    return f"r3 AS (SELECT *, {_cases()}, unnest(struct_pack({', '.join(columns)})) FROM r2)"


_PACKED = f"""
    b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {S.strip('p')}), lambda p: p <> '')) AS p, generate_subscripts(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {S.strip('p')}), lambda p: p <> ''), 1) AS i FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, i, CASE WHEN length(p) > 1400 THEN list_transform(list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: s <> ''), lambda s: struct_pack(s := s, gap := 1)) ELSE [struct_pack(s := p, gap := 2)] END AS parts FROM b),
    o AS (SELECT doc_id, i, unnest(parts) AS x, generate_subscripts(parts, 1) AS j FROM e),
    n AS (SELECT doc_id, x.s AS s, x.gap AS gap, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM o),"""
# a part opens a chunk, or is added to the open one; the size counts the separators
_PACKED += """
    z AS (SELECT doc_id, k, s AS chunk, CAST(length(s) + gap AS BIGINT) AS size, 0::BIGINT AS no FROM n WHERE k = 1
        UNION ALL SELECT n.doc_id, n.k, CASE WHEN z.size + length(n.s) + n.gap > 1400 AND z.size > 0 THEN n.s ELSE z.chunk || ' ' || n.s END, CASE WHEN z.size + length(n.s) + n.gap > 1400 AND z.size > 0 THEN length(n.s) ELSE z.size + length(n.s) + n.gap END,
            z.no + CASE WHEN z.size + length(n.s) + n.gap > 1400 AND z.size > 0 THEN 1 ELSE 0 END FROM z JOIN n ON n.doc_id = z.doc_id AND n.k = z.k + 1),
    y AS (SELECT doc_id, no, arg_max(chunk, k) AS text FROM z GROUP BY 1, 2),
    ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS chunk_no, text FROM y WHERE length(text) >= 80)"""
_KIND = "CASE " + " ".join(f"WHEN {S.has_any('t', m)} THEN '{k}'" for k, m in L.CHUNK_TYPES.items()) + " ELSE 'generic' END"
_PAIRS = f"""
    {_PACKED},
    c0 AS (SELECT submission_id AS grp, doc_id, chunk_no, chunk_no + 1 AS page, {S.norm("ch.text")} AS t FROM ch JOIN documents USING (doc_id)),
    c1 AS (SELECT *, {S.tokens("t")} AS ct, {_KIND} AS kind FROM c0), {_RECORDS}, {_prepared_sql()},
    s AS (SELECT weakness_id, doc_id, chunk_no, page, t, {", ".join(_score(m) for m in R.WEIGHTS)} FROM r3 JOIN c1 USING (grp))"""


def _near(mode: str, seeds: int, width: int, name: str) -> str:
    return f"""{name}_k AS (SELECT *, score_{mode} AS score, row_number() OVER (PARTITION BY weakness_id ORDER BY score_{mode} DESC, doc_id, chunk_no) AS r, max(score_{mode}) OVER (PARTITION BY weakness_id) AS top FROM s),
    {name}_n AS (SELECT *, max(CASE WHEN r <= {seeds} AND (anchor_{mode} OR score >= top - 0.10) THEN 1 ELSE 0 END) OVER (PARTITION BY weakness_id, doc_id ORDER BY chunk_no RANGE BETWEEN {width} PRECEDING AND {width} FOLLOWING) AS near FROM {name}_k),
    {name} AS (SELECT * FROM {name}_n WHERE r <= {seeds} OR near = 1)"""


def _best(mode: str, name: str) -> str:
    return f"""{_near(mode, R.SEEDS[mode], R.WIDTH[mode], name + "_p")},
    {name}_o AS (SELECT *, substring(t, 1, 350) AS prefix, row_number() OVER (PARTITION BY weakness_id, substring(t, 1, 350) ORDER BY score DESC, doc_id, chunk_no) AS d FROM {name}_p),
    {name} AS (SELECT * FROM (SELECT weakness_id, doc_id || ':' || chunk_no AS id, page, score, prefix, row_number() OVER (PARTITION BY weakness_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM {name}_o WHERE d = 1) WHERE rank <= {R.KEPT[mode]})"""


SQL = {
    "case_flags": f"WITH {_RECORDS} SELECT weakness_id, {_cases()} FROM r2",
    "pack_chunks": f"WITH RECURSIVE {_PACKED} SELECT doc_id, chunk_no, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM ch",
    "snippet_scores": f"WITH RECURSIVE {_PAIRS} SELECT weakness_id, doc_id, chunk_no, {', '.join(f'score_{m}, anchor_{m}' for m in R.WEIGHTS)} FROM s",
    "snippet_neighbourhood": f"WITH RECURSIVE {_PAIRS}, {_near('task1', 3, 1, 'q')} SELECT weakness_id, doc_id, chunk_no FROM q",
    "align_task1": f"WITH RECURSIVE {_PAIRS}, {_best('task1', 'q')} SELECT weakness_id, CAST(rank AS INTEGER) AS rank, id, score FROM q",
    "align_snippets": f"""WITH RECURSIVE {_PAIRS}, {_best('task2_evidence', 'q')}, {_best('task2_support', 'u')},
        am AS (SELECT *, 'evidence' AS channel, CASE WHEN rank <= 3 THEN 0 ELSE 2 END AS tier FROM q UNION ALL SELECT *, 'support', CASE WHEN rank <= 2 THEN 1 ELSE 2 END FROM u),
        ao AS (SELECT *, CASE WHEN tier < 2 THEN rank ELSE 0 END AS k, row_number() OVER (PARTITION BY weakness_id, prefix ORDER BY tier, CASE WHEN tier < 2 THEN rank ELSE 0 END, score DESC, channel, id) AS d FROM am),
        ap AS (SELECT *, row_number() OVER (PARTITION BY weakness_id ORDER BY tier, k, score DESC, channel, id) AS place FROM ao WHERE d = 1)
        SELECT weakness_id, CAST(place AS INTEGER) AS place, id, channel, score FROM ap WHERE place <= 5""",
    "alignment_status": f"""WITH RECURSIVE {_PACKED}, {_RECORDS}, g AS (SELECT DISTINCT submission_id AS grp FROM ch JOIN documents USING (doc_id))
        SELECT weakness_id, CASE WHEN coalesce(pdf_url, '') = '' THEN 'no_pdf_url' WHEN grp IS NULL OR grp NOT IN (SELECT grp FROM g WHERE grp IS NOT NULL) THEN 'no_text_extracted' ELSE 'ok' END AS status FROM r0""",
    "snippet_block": f"""WITH RECURSIVE {_PAIRS}, {_best('task1', 'q')}, x AS (SELECT doc_id || ':' || chunk_no AS id, text FROM ch)
        SELECT weakness_id, md5(string_agg('(p.' || page || ', score=' || printf('%.4f', CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE)) || ') ' || substring(x.text, 1, 1200), chr(10) ORDER BY rank)) AS digest FROM q JOIN x USING (id) GROUP BY 1""",
}
