"""Classifier, validator and score queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import rules as U
from threadloom.functions import scoring as C
from threadloom.functions import text as X
from threadloom.functions import validate as V
from threadloom.functions import claims as K
from threadloom.operators import answers as A
from threadloom.plans import sql as S
from threadloom.runtime import latest, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "classified_weakness_pairs").select("weakness_id", "classified_at", "original_weakness", "follow_ups", "rebuttals", F.col("weakness_category.l2_id").alias("l2_id"))
    return latest(rows, ["weakness_id"], "classified_at", ["weakness_id", "original_weakness", "follow_ups", "rebuttals", "l2_id"])


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "enhanced_reviews").select("weakness_id", "submission_id", "enhanced_at", "original_weakness", "enhanced_review", "weakness_category", F.col("paper_context.sections_index").alias("sections"))
    return latest(rows, ["weakness_id"], "enhanced_at", ["weakness_id", "submission_id", "original_weakness", "enhanced_review", "weakness_category", "sections"])


def classify_followup(spark: SparkSession, d: str) -> DataFrame:
    """Label, tier and score of every follow-up, and whether it should be verified."""
    f = _pairs(spark, d).select("weakness_id", "original_weakness", F.posexplode("follow_ups").alias("place", "f")).select("weakness_id", "place", "original_weakness", F.col("f.text").alias("text")).where("text is not null and original_weakness is not null")
    f = f.withColumns({"first": F.lower("original_weakness"), "t": F.lower("text")})
    labelled = f.withColumn("l", U.follow_up(F.col("first"), F.col("t")))
    return labelled.select("weakness_id", "place", "l.label", "l.tier", F.round("l.score", 6).alias("score"), U.needs_check(F.col("l"), F.col("text")).alias("verify"))


def _kw(c: str, stop: list[str]) -> str:
    words = "[" + ", ".join(map(S.quote, stop)) + "]"
    return rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '\b[a-z]{{3,}}\b'), lambda x: NOT list_contains({words}, x)))"


_P = S.latest("classified_weakness_pairs", "weakness_id", "classified_at", {"original_weakness": "original_weakness", "follow_ups": "follow_ups", "rebuttals": "rebuttals", "l2_id": "weakness_category.l2_id"})
_FOLLOW = f"""
    WITH f AS (SELECT weakness_id, original_weakness AS w, unnest(follow_ups).text AS t, generate_subscripts(follow_ups, 1) - 1 AS place FROM {_P}),
    k AS (SELECT *, {U.first_sql(U.FOLLOW_UP, 'lower(t)', '')} AS by_text, {_kw('w', U.LABEL_STOPWORDS)} AS ik, {_kw('t', U.LABEL_STOPWORDS)} AS fk FROM f WHERE t IS NOT NULL AND w IS NOT NULL),
    r AS (SELECT *, CASE WHEN length(ik) > 0 AND length(fk) > 0 THEN length(list_intersect(ik, fk)) / length(ik) ELSE 0 END AS ratio, length(regexp_extract_all(lower(t), '{U.PRONOUN}')) AS pronouns FROM k),
    l AS (SELECT *, CASE WHEN by_text <> '' THEN split_part(by_text, '/', 1) ELSE 'same_issue' END AS label,
        CASE WHEN by_text <> '' THEN split_part(by_text, '/', 2) WHEN ratio <= 0.35 AND pronouns >= 3 THEN 'low' ELSE 'medium' END AS tier,
        CASE WHEN by_text <> '' THEN CAST(split_part(by_text, '/', 3) AS DOUBLE) WHEN ratio > 0.35 THEN least(0.5 + ratio * 0.3, 0.82) WHEN pronouns >= 3 THEN 0.55
            WHEN regexp_matches(lower(t), '{U.GRATITUDE}') AND NOT {U.sql(U.NEGATIVE, 'lower(t)')} THEN 0.68 ELSE 0.60 END AS s FROM r)
    SELECT weakness_id, CAST(place AS INTEGER) AS place, label, tier, round(CAST(s AS DOUBLE), 6) AS score,
        (tier IN ('low', 'medium') AND length(t) > 150) OR s < 0.65 OR (label = 'debate' AND tier <> 'high') OR (label = 'new_issue' AND s < 0.80) AS verify FROM l"""


def quote_only(spark: SparkSession, d: str) -> DataFrame:
    """Rebuttals that only repeat their weakness."""
    r = _pairs(spark, d).select("weakness_id", "original_weakness", F.posexplode("rebuttals").alias("place", "rebuttal")).where("rebuttal is not null and original_weakness is not null")
    return r.select("weakness_id", "place", U.quote_only(F.col("original_weakness"), F.col("rebuttal")).alias("quote_only"))


_QUOTE = f"""
    WITH r AS (SELECT weakness_id, original_weakness AS w, unnest(rebuttals) AS t, generate_subscripts(rebuttals, 1) - 1 AS place FROM {_P}),
    k AS (SELECT weakness_id, place, {_kw('w', U.QUOTE_STOPWORDS)} AS a, {_kw('t', U.QUOTE_STOPWORDS)} AS b FROM r WHERE t IS NOT NULL AND w IS NOT NULL)
    SELECT weakness_id, CAST(place AS INTEGER) AS place, length(a) > 0 AND length(b) > 0 AND length(list_intersect(a, b)) > 0.55 * length(a) AND length(list_intersect(a, b)) > 0.45 * length(b) AS quote_only FROM k"""


def reply_type(spark: SparkSession, d: str) -> DataFrame:
    """Types and roles of the replies under the three sets of venue rules, counted."""
    e = table(spark, d, "thread_events")
    kinds = {name: U.reply_type(F.col("invitation"), F.col("actor_id"), name).alias(f"type_{name}") for name in U.REPLY_TYPES}
    return e.select(*kinds.values(), U.role_of(kinds["first"], F.col("actor_id")).alias("role")).groupBy(*[f"type_{n}" for n in kinds], "role").agg(F.count("*").alias("n"))


def _reply_type_sql() -> str:
    inv, sig = "lower(coalesce(invitation, ''))", "lower(coalesce(actor_id, ''))"
    one = lambda n: f"CASE WHEN {U.first_sql(U.REPLY_TYPES[n], inv, '')} <> '' THEN {U.first_sql(U.REPLY_TYPES[n], inv, '')} WHEN regexp_matches({sig}, '/authors$') THEN 'rebuttal' ELSE 'comment' END"
    cols = ", ".join(f"{one(n)} AS type_{n}" for n in U.REPLY_TYPES)
    return f"""WITH t AS (SELECT *, {cols} FROM thread_events), r AS (SELECT *, CASE WHEN actor_id IS NULL THEN 'unknown' WHEN type_first = 'rebuttal' THEN 'author' WHEN type_first = 'decision' THEN 'program_chair' WHEN type_first = 'meta_review' THEN 'area_chair'
        WHEN contains({sig}, 'area_chair') THEN 'area_chair' WHEN contains({sig}, 'reviewer') THEN 'reviewer' WHEN regexp_matches({sig}, '/authors$') THEN 'author' ELSE 'unknown' END AS r FROM t)
        SELECT {", ".join(f"type_{n}" for n in U.REPLY_TYPES)}, r AS role, count(*) AS n FROM r GROUP BY ALL"""


def l13_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """Categories after the tie-break among those of theory."""
    p = _pairs(spark, d).where("original_weakness is not null").withColumn("t", F.lower("original_weakness"))
    return p.select("weakness_id", U.tie_break(F.col("t"), F.col("l2_id")).alias("l2_id"))


def _tie_sql() -> str:
    h = {k: " + ".join(f"CAST(contains(lower(original_weakness), {S.quote(p)}) AS INTEGER)" for p in v) for k, v in U.TIE_PHRASES.items()}
    h1, h2, h3 = h.values()
    return f"""WITH h AS (SELECT weakness_id, l2_id, {h1} AS a, {h2} AS b, {h3} AS c FROM {_P} WHERE original_weakness IS NOT NULL)
        SELECT weakness_id, CASE WHEN l2_id NOT IN ('L2.3.1', 'L2.3.2', 'L2.3.3') OR l2_id IS NULL THEN l2_id WHEN c > 0 AND c >= a AND c >= b THEN 'L2.3.3' WHEN a > 0 AND a > b THEN 'L2.3.1' WHEN b > 0 AND b > a THEN 'L2.3.2' ELSE l2_id END AS l2_id FROM h"""


def noisy_title(spark: SparkSession, d: str) -> DataFrame:
    """Section names and paper titles that look like extraction noise, counted."""
    p = table(spark, d, "paper_context")
    names = p.select(F.explode("sections_index.name").alias("title")).union(p.select("title")).where("title is not null")
    return names.groupBy("title").agg(F.count("*").alias("n")).select("title", "n", U.noisy_title(F.col("title")).alias("noisy"))


_NOISY = rf"""
    WITH t AS (SELECT unnest(sections_index).name AS title FROM paper_context UNION ALL SELECT title FROM paper_context), g AS (SELECT title, count(*) AS n FROM t WHERE title IS NOT NULL GROUP BY 1),
    w AS (SELECT *, trim(title) AS s, list_filter(string_split_regex(trim(title), '\s+'), lambda x: x <> '') AS w FROM g)
    SELECT title, n, CASE WHEN s = '' THEN true ELSE length(w) > 8 OR list_contains([{", ".join(map(S.quote, U.TRAILING))}], lower(trim(w[-1], '.,;:"''')))
        OR (regexp_matches(s, '\.\s+[A-Za-z]') AND NOT regexp_matches(s, '^[A-Z]?\d+(?:\.\d+)*\.\s')) OR regexp_matches(s, '[("''.]$')
        OR regexp_matches(regexp_extract(s, '\p{{L}}', 0), '^\p{{Ll}}') OR (regexp_matches(s, ':\s+[A-Z]') AND length(w) > 5) END AS noisy FROM w"""


def leak_flags(spark: SparkSession, d: str) -> DataFrame:
    """Texts that speak of the rebuttal, by each list of signs."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", *[U.leaks(F.col("text"), k).alias(k) for k in U.LEAKS])


def specificity(spark: SparkSession, d: str) -> DataFrame:
    c = _reviews(spark, d).where("enhanced_review.claim is not null").select("weakness_id", F.lower(F.btrim("enhanced_review.claim")).alias("t"))
    return c.select("weakness_id", U.specificity(F.col("t")).cast("int").alias("score"))


_R = S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"claim": "enhanced_review.claim"})
_SPECIFIC = rf"""
    WITH c AS (SELECT weakness_id, lower(trim(claim)) AS t FROM {_R} WHERE claim IS NOT NULL)
    SELECT weakness_id, CAST(CASE WHEN regexp_matches(t, '\d') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\b(section|sec\.|table|figure|fig\.|appendix|app\.)\b') THEN 2 ELSE 0 END
        + {" + ".join(f"CAST(regexp_matches(t, '{chr(92)}b{w}{chr(92)}b') AS INTEGER)" for w in U.SPECIFIC)}
        + CASE WHEN regexp_matches(t, '\b(because|therefore|which|leading to|causing|so that)\b') THEN 1 ELSE 0 END + least(length(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) // 10, 3) AS INTEGER) AS score FROM c"""


def review_validation(spark: SparkSession, d: str) -> DataFrame:
    """How often each failure of a review occurs, suggestion numbers left out."""
    issues = _reviews(spark, d).select(F.explode(V.review_issues(F.col("enhanced_review"), F.col("sections"))).alias("i"))
    return issues.select(F.regexp_replace("i", r"\[\d+\]", "").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def record_validation(spark: SparkSession, d: str) -> DataFrame:
    """The first reason against each record."""
    reason = V.record_failure(F.col("enhanced_review"), F.col("original_weakness"), F.col("weakness_category"), 0.5)
    return _reviews(spark, d).select("weakness_id", F.coalesce(reason, F.lit("valid")).alias("reason"))


def repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Penalty of both tasks for repeated lines, and the gate."""
    docs = table(spark, d, "documents").where("text is not null")
    t = F.col("text")
    return docs.select("doc_id", F.round(C.repetition_penalty(t, 2), 6).alias("p1"), F.round(C.repetition_penalty(t, 1), 6).alias("p2"), C.repetition_gate(t).alias("gate"))


_REPEAT = f"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x FROM l) GROUP BY 1, 2),
    s AS (SELECT doc_id, sum(n) AS lines, sum(CASE WHEN n > 2 THEN n ELSE 0 END) AS r1, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS r2, max(n) AS most FROM u GROUP BY 1)
    SELECT doc_id, round(CASE WHEN coalesce(lines, 0) < 4 THEN 1.0 ELSE greatest(0.0, 1 - 2 * r1 / lines) END, 6) AS p1, round(CASE WHEN coalesce(lines, 0) < 4 THEN 1.0 ELSE greatest(0.0, 1 - 2 * r2 / lines) END, 6) AS p2,
        NOT (coalesce(lines, 0) > 5 AND coalesce(most, 0) > 3) AS gate FROM l LEFT JOIN s USING (doc_id)"""


def claim_answers(spark: SparkSession, d: str) -> DataFrame:
    """The claims of each paper as one numbered answer."""
    c = _reviews(spark, d).where(~X.blank(F.col("enhanced_review.claim")) & F.col("submission_id").isNotNull()).select("submission_id", "weakness_id", F.regexp_replace(X.strip(F.col("enhanced_review.claim")), r"\s*\n\s*", " ").alias("claim"))
    all_ = c.groupBy("submission_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("weakness_id", "claim"))), lambda x: x["claim"]).alias("claims"))
    lines = F.transform("claims", lambda x, i: F.concat(F.lit("Claim "), (i + 1).cast("string"), F.lit(": "), x))
    return all_.select("submission_id", "claims", F.array_join(lines, "\n").alias("answer"))


#: Requirements of a rubric, by weight; the replayed judge gives each a score from the hash of id and requirement, or none.
WEIGHTS = [30, 25, 20, 15, 10]


def replayed(ids: DataFrame, kind: str, numbers: F.Column) -> DataFrame:
    """(id, no, score) of a judge whose answers lie in a table: 1 to 5, null where it failed."""
    each = ids.select("id", F.explode(numbers).alias("no"))
    digit = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(kind), "id", F.col("no").cast("string"))), 1, 4), 16, 10).cast("int"), F.lit(16))
    return each.select("id", "no", F.when(digit > 0, F.pmod(digit, F.lit(5)) + 1).alias("score"))


def _soft(ids: DataFrame) -> DataFrame:
    weight = F.element_at(F.lit(WEIGHTS), F.col("no"))
    return replayed(ids, "soft", F.sequence(F.lit(1), F.lit(len(WEIGHTS)))).select("id", weight.alias("weight"), "score")


def reward_claims(spark: SparkSession, d: str) -> DataFrame:
    """Each paper's answer of claims, with thinking before it, rewarded from replayed scores of a rubric and of the coverage of its first three weaknesses."""
    a = claim_answers(spark, d).select(F.col("submission_id").alias("id"), F.concat(F.lit("<think>Claim 1: not this\n</think>\n"), "answer").alias("solution"), F.col("answer").alias("truth"), F.least(F.size("claims"), F.lit(3)).alias("n_truth"))
    got = A.reward_claims(a, _soft(a), replayed(a, "cover", F.sequence(F.lit(1), F.col("n_truth"))).select("id", "score"))
    return got.select(F.col("id").alias("submission_id"), "gate", "n", "alpha", *[F.round(c, 6).alias(c) for c in ("soft", "cover", "prior", "penalty", "form", "reward")])


def claim_prior(spark: SparkSession, d: str) -> DataFrame:
    """Number of claims of each paper's answer and its prior."""
    n = C.claim_count(F.col("answer"))
    return claim_answers(spark, d).select("submission_id", n.alias("n"), F.round(C.count_prior(n), 6).alias("prior"))


def analysis_text(review: str = "enhanced_review") -> F.Column:
    """A review as text under headings, suggestions numbered."""
    r = F.col(review)
    field = lambda x, name, key: F.concat(F.lit(f"- **{name}**: "), F.coalesce(x[key], F.lit("")))
    one = lambda x, i: F.concat_ws("\n", F.concat(F.lit("### Suggestion "), (i + 1).cast("string")), field(x, "What", "what"), field(x, "Where", "where"), field(x, "How", "how"), field(x, "Expected Outcome", "expected_outcome"), field(x, "Priority", "priority"))
    s = F.array_join(F.transform(F.filter(F.coalesce(r["actionable_suggestions"], F.array()), lambda x: x.isNotNull()), one), "\n")
    return F.concat_ws("\n", F.concat(F.lit("## Claim\n"), r["claim"]), F.concat(F.lit("## Evidence\n"), r["evidence"]), s, F.concat(F.lit("## Severity\n"), r["severity"]))


def reward_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Each review as an analysis, with thinking before it, rewarded from replayed scores of a rubric."""
    a = _reviews(spark, d).where("enhanced_review is not null").select(F.col("weakness_id").alias("id"), F.concat(F.lit("<think>...</think>"), analysis_text()).alias("solution"))
    got = A.reward_analyses(a, _soft(a))
    return got.select(F.col("id").alias("weakness_id"), "gate", *[F.round(c, 6).alias(c) for c in ("soft", "form", "reward")])


def refined_claims(spark: SparkSession, d: str) -> DataFrame:
    """Each paper's claims cut to sentences, alike ones represented by one, merged and numbered."""
    a = A.with_refined(claim_answers(spark, d), F.col("claims"), "refined")
    return a.select("submission_id", F.array_join("refined", "\n").alias("answer"))


def claims_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether each paper's whole answer of claims is complete, or what is wrong with it first."""
    return A.with_claims_state(claim_answers(spark, d), F.col("answer"), "state").select("submission_id", "state")


def claims_answer(spark: SparkSession, d: str) -> DataFrame:
    """The claims cut out of each paper's answer with talk around it."""
    a = claim_answers(spark, d).select("submission_id", F.concat(F.lit("Here they are:\n"), "answer", F.lit("\nThat is all.\nuser\nmore")).alias("text"))
    return A.with_claims_answer(a, F.col("text"), "answer").select("submission_id", "answer")


def analysis_answer(spark: SparkSession, d: str) -> DataFrame:
    """Each review cut out of an answer that goes on after it."""
    a = _reviews(spark, d).where("enhanced_review is not null").select("weakness_id", F.concat(analysis_text(), F.lit("\n[TASK 2] and so on")).alias("t"))
    return a.select("weakness_id", F.md5(K.analysis_answer(F.col("t"))).alias("digest"))


def sanitize_refs(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with places that can't be trusted in general words."""
    r = _reviews(spark, d).where("enhanced_review.evidence is not null")
    has = F.coalesce(F.size("sections") > 0, F.lit(False))
    return r.select("weakness_id", K.general_places(F.col("enhanced_review.evidence"), has).alias("evidence"))


def mapped_rebuttals(spark: SparkSession, d: str) -> DataFrame:
    """Each weakness with its rebuttals as the text of a mapping, where the second rebuttal points to the first, cleaned in order."""
    p = _pairs(spark, d).where("size(rebuttals) > 0 and original_weakness is not null")
    said = F.filter("rebuttals", lambda x: x.isNotNull())
    lines = F.transform(said, lambda x, i: F.concat(F.lit("W"), (i + 1).cast("string"), F.lit(" -> "), F.regexp_replace(x, r"\s+", " "), F.lit(" (Confidence: 0.9)")))
    text = F.concat(F.array_join(lines, "\n"), F.lit("\nW"), (F.size(said) + 1).cast("string"), F.lit(" -> Same segment as W1 (Confidence: 0.5)"))
    points = F.array_join(F.transform(F.sequence(F.lit(1), F.size(said) + 1), lambda i: F.concat(F.lit("Point "), i.cast("string"), F.lit(": "), F.when(i == 1, F.regexp_replace("original_weakness", r"\s+", " ")).otherwise("another point"))), "\n")
    m = p.select("weakness_id", text.alias("text"), K.points(points).alias("w")).select("weakness_id", F.explode(K.mapped(F.col("text"), F.col("w"))).alias("m"))
    return m.select("weakness_id", "m.key", F.md5("m.rebuttal").alias("digest"), "m.confidence")


def routed_followups(spark: SparkSession, d: str) -> DataFrame:
    """Follow-ups of each weakness routed by a text that knows two weaknesses, one that doesn't exist, or none."""
    p = _pairs(spark, d).select("weakness_id", F.greatest(F.size("follow_ups"), F.lit(0)).alias("n"))
    text = F.when(F.col("n") % 3 == 0, F.lit("no routes")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.concat(F.lit("F"), i.cast("string"), F.lit(" -> "), F.when(i % 2 == 1, "W1, w2").otherwise("W9"), F.lit(" (Confidence: 0.8)"))), "\n"))
    r = p.select("weakness_id", F.explode(K.routed(text, F.col("n"), F.lit(["W1", "W2"]))).alias("r"))
    return r.select("weakness_id", "r.follow_up", "r.weakness")


def analysis_states(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the reviews as analyses, counted."""
    a = _reviews(spark, d).where("enhanced_review is not null").select(analysis_text().alias("t"))
    return a.groupBy(V.analysis_state(F.col("t")).alias("state")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in [
    classify_followup, quote_only, reply_type, l13_tiebreak, noisy_title, leak_flags, specificity, review_validation, record_validation, repetition_penalty, claim_prior, reward_claims, reward_analysis, analysis_states,
    refined_claims, claims_state, claims_answer, analysis_answer, sanitize_refs, mapped_rebuttals, routed_followups,
]}
_CLAIMS = f"""
    c AS (SELECT submission_id, weakness_id, regexp_replace({S.strip('claim')}, '\\s*\\n\\s*', ' ', 'g') AS claim FROM {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"submission_id": "submission_id", "claim": "enhanced_review.claim"})} WHERE NOT {S.blank('claim')} AND submission_id IS NOT NULL),
    b AS (SELECT submission_id, claim, row_number() OVER (PARTITION BY submission_id ORDER BY weakness_id) AS i FROM c),
    a AS (SELECT submission_id, count(*) AS n, string_agg('Claim ' || i || ': ' || claim, chr(10) ORDER BY i) AS answer FROM b GROUP BY 1)"""
_SCORE = lambda kind: f"CAST('0x' || substring(md5('{kind}:' || submission_id || ':' || no), 1, 4) AS INTEGER) % 16"
_MEAN = "least(1.0, greatest(0.0, (sum(s * w) / sum(w) FILTER (s IS NOT NULL) - 1) / 4))"
_AZ = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+'))"
_REWARD_CLAIMS = f"""
    WITH {_CLAIMS},
    w AS (SELECT submission_id, i, {_AZ.format("claim")} AS w, length(regexp_extract_all(claim || ' ', '[.!?]\\s')) > 1 AS long FROM b),
    p AS (SELECT x.submission_id, length(list_intersect(x.w, y.w)) / (length(x.w) + length(y.w) - length(list_intersect(x.w, y.w))) AS j FROM w x JOIN w y ON x.submission_id = y.submission_id AND x.i < y.i WHERE length(x.w) > 0 AND length(y.w) > 0),
    q AS (SELECT submission_id, count(*) FILTER (j >= 0.7) AS p7, count(*) FILTER (j >= 0.65) AS p65 FROM p GROUP BY 1),
    m AS (SELECT submission_id, count(*) FILTER (long) AS many FROM w GROUP BY 1),
    s AS (SELECT submission_id, {_MEAN} AS soft, count(s) > 0 AS some, count(s) = 5 AS ok FROM (SELECT submission_id, no, w, CASE WHEN {_SCORE('soft')} > 0 THEN {_SCORE('soft')} % 5 + 1 END AS s FROM a, (SELECT unnest([1, 2, 3, 4, 5]) AS no, unnest({WEIGHTS}) AS w)) GROUP BY 1),
    g AS (SELECT submission_id, {_MEAN} AS cover, count(s) > 0 AS some, count(s) = count(*) AS ok FROM (SELECT submission_id, no, 1 AS w, CASE WHEN {_SCORE('cover')} > 0 THEN {_SCORE('cover')} % 5 + 1 END AS s FROM a, (SELECT unnest([1, 2, 3]) AS no) WHERE no <= n) GROUP BY 1),
    f AS (SELECT submission_id, n, NOT {U.sql(("any", *U.LEAKS["reward"]), "answer")} AND NOT (n >= 3 AND coalesce(p7, 0) / (n * (n - 1) / 2) > 0.5) AS gate, CASE WHEN s.some THEN soft ELSE 0 END AS soft, CASE WHEN g.some THEN cover ELSE 0 END AS cover,
        CASE WHEN NOT s.ok AND NOT g.ok THEN NULL WHEN NOT s.ok THEN 0.0 WHEN NOT g.ok THEN 1.0 ELSE 0.8 END AS alpha, CASE WHEN n <= 1 THEN 1.0 WHEN n = 2 THEN 0.9 ELSE greatest(0.6, 0.9 - 0.15 * (n - 2)) END AS prior,
        CASE WHEN many > 0 THEN greatest(0.75, 1 - 0.12 * many) ELSE 1.0 END * CASE WHEN coalesce(p65, 0) > 0 THEN greatest(0.70, 1 - 0.15 * p65) ELSE 1.0 END AS form
        FROM a LEFT JOIN q USING (submission_id) JOIN m USING (submission_id) JOIN s USING (submission_id) JOIN g USING (submission_id))
    SELECT submission_id, gate, CAST(n AS INTEGER) AS n, CAST(alpha AS DOUBLE) AS alpha, round(CAST(soft AS DOUBLE), 6) AS soft, round(CAST(cover AS DOUBLE), 6) AS cover, round(CAST(prior AS DOUBLE), 6) AS prior, 1.0::DOUBLE AS penalty, round(CAST(form AS DOUBLE), 6) AS form,
        round(CAST(CASE WHEN NOT gate OR alpha IS NULL THEN 0 ELSE (alpha * soft + (1 - alpha) * cover) * prior * form END AS DOUBLE), 6) AS reward FROM f"""
_CONCEPTS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda x: length(x) >= 4 AND NOT list_contains([" + ", ".join(map(S.quote, K.CLAIM_STOPWORDS)) + "], x)))"
_STATE = f"""
    WITH {_CLAIMS},
    w AS (SELECT submission_id, i, {S.norm("claim")} AS t, {_CONCEPTS.format("claim")} AS w FROM b),
    p AS (SELECT y.submission_id, y.i, min(CASE WHEN x.t = y.t THEN 0 WHEN length(x.w) > 0 AND length(y.w) > 0 AND length(list_intersect(x.w, y.w)) / least(length(x.w), length(y.w)) >= 0.60 THEN 1 END) AS k FROM w x JOIN w y ON x.submission_id = y.submission_id AND x.i < y.i GROUP BY 1, 2),
    f AS (SELECT submission_id, arg_min(CASE WHEN k = 0 THEN 'Duplicate' ELSE 'Near-duplicate' END || ' claim detected at Claim ' || i, i) AS state FROM p WHERE k IS NOT NULL GROUP BY 1)
    SELECT submission_id, coalesce(state, 'Complete') AS state FROM a LEFT JOIN f USING (submission_id)"""
_ROUTED = f"""
    WITH p AS (SELECT weakness_id, coalesce(length(follow_ups), 0) AS n FROM {_P}), f AS (SELECT weakness_id, n, unnest(range(0, n)) AS follow_up FROM p)
    SELECT weakness_id, CAST(follow_up AS INTEGER) AS follow_up, unnest(CASE WHEN n % 3 = 0 OR follow_up % 2 = 0 THEN ['W1', 'W2'] ELSE ['UNRELATED'] END) AS weakness FROM f"""
_MAPPED = f"""
    WITH p AS (SELECT weakness_id, original_weakness AS w, list_filter(rebuttals, lambda x: x IS NOT NULL) AS said FROM {_P} WHERE length(rebuttals) > 0 AND original_weakness IS NOT NULL),
    r AS (SELECT weakness_id, w, i, {S.strip("regexp_replace(t, '\\s+', ' ', 'g')")} AS t FROM (SELECT weakness_id, w, unnest(said) AS t, generate_subscripts(said, 1) AS i FROM p)),
    k AS (SELECT weakness_id, i, t, CASE WHEN i = 1 THEN {_kw("regexp_replace(w, '\\s+', ' ', 'g')", U.QUOTE_STOPWORDS)} ELSE {_kw("'another point'", U.QUOTE_STOPWORDS)} END AS a, {_kw("t", U.QUOTE_STOPWORDS)} AS b FROM r),
    q AS (SELECT weakness_id, i, CASE WHEN lower(t) = 'no response' OR (length(a) > 0 AND length(b) > 0 AND length(list_intersect(a, b)) > 0.55 * length(a) AND length(list_intersect(a, b)) > 0.45 * length(b)) THEN 'No Response' ELSE t END AS t FROM k),
    u AS (SELECT weakness_id, i, CASE WHEN t <> 'No Response' AND row_number() OVER (PARTITION BY weakness_id, t ORDER BY i) > 1 THEN 'No Response' ELSE t END AS t FROM q),
    z AS (SELECT weakness_id, length(said) + 1 AS i, coalesce((SELECT t FROM u WHERE u.weakness_id = p.weakness_id AND u.i = 1), 'No Response') AS t FROM p)
    SELECT weakness_id, 'W' || i AS key, md5(t) AS digest, 0.9::DOUBLE AS confidence FROM u UNION ALL SELECT weakness_id, 'W' || i, md5(t), 0.5 FROM z"""
_VALID = f"""v AS (SELECT weakness_id, original_weakness AS w, r, c, coalesce(r.actionable_suggestions, []) AS s, sections FROM {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"original_weakness": "original_weakness", "r": "enhanced_review", "c": "weakness_category", "sections": "paper_context.sections_index"})})"""
_SAID = "list_transform(s, lambda x: concat_ws(chr(10), x.what, x.\"where\", x.how, x.expected_outcome, x.priority))"
_LEN = lambda c: f"length({S.strip(f'coalesce({c}, {chr(39) * 2})')})"
_FIELDS = ["what", "where", "how", "expected_outcome", "priority"]
_LACKS = "CASE " + " ".join(f"""WHEN {S.blank(f'x."{f}"')} THEN '{f}'""" for f in _FIELDS) + " END"
_RECORD = f"""
    WITH {_VALID}, m AS (SELECT *, list_filter(list_transform(s, lambda x, i: struct_pack(i := i - 1, f := {_LACKS})), lambda y: y.f IS NOT NULL) AS m, lower(concat_ws(chr(10), r.claim, r.evidence, array_to_string({_SAID}, chr(10)))) AS told FROM v)
    SELECT weakness_id, CASE WHEN r IS NULL THEN 'missing enhanced_review' WHEN {S.blank('r.claim')} THEN 'empty claim' WHEN length(s) = 0 THEN 'no suggestions' WHEN length(m) > 0 THEN 'suggestion[' || m[1].i || '] missing ' || m[1].f WHEN {S.blank('w')} THEN 'empty original_weakness'
        WHEN coalesce(c.l2_id, 'UNKNOWN') = 'UNKNOWN' THEN 'unclassified' WHEN coalesce(c.confidence, 0) < 0.5 THEN 'low confidence' WHEN {U.sql(("any", *U.LEAKS["chat"]), "told")} THEN 'rebuttal leakage' ELSE 'valid' END AS reason FROM m"""
_ISSUES = [
    ("enhanced_review", "r IS NULL"), ("claim", f"r IS NOT NULL AND {_LEN('r.claim')} < {V.SHORTEST['claim']}"), ("evidence", f"r.evidence IS NOT NULL AND {_LEN('r.evidence')} < {V.SHORTEST['evidence']}"), ("actionable_suggestions", "r IS NOT NULL AND length(s) = 0"),
    ("evidence_hallucination", f"coalesce(length(sections), 0) = 0 AND regexp_matches(coalesce(r.evidence, ''), {S.quote(V.SECTION_REF)})"), ("rebuttal_leakage", f"r IS NOT NULL AND {U.sql(('any', *U.LEAKS['generation']), 'told')}"),
    ("severity", f"r IS NOT NULL AND NOT list_contains({V.SEVERITIES}, coalesce(r.severity, ''))"), ("citations", "r IS NOT NULL AND r.citations IS NULL"),
]
_EACH = [("missing", "x IS NULL"), *[(f, f"x IS NOT NULL AND {_LEN(f'x.{chr(34)}{f}{chr(34)}')} < {n}") for f, n in V.SHORTEST.items() if f in _FIELDS], ("priority", f"x IS NOT NULL AND NOT list_contains({V.PRIORITIES}, coalesce(x.priority, ''))"), ("where_banned_phrase", f"x IS NOT NULL AND {U.sql(('any', *V.VAGUE_PLACES), 'coalesce(x.' + chr(34) + 'where' + chr(34) + ', ' + chr(39) * 2 + ')')}")]
_REVIEW_ISSUES = f"""
    WITH {_VALID}, t AS (SELECT *, concat_ws(chr(10), r.claim, r.evidence, array_to_string({_SAID}, chr(10)), array_to_string(r.citations, chr(10))) AS told FROM v), x AS (SELECT unnest(s) AS x FROM v),
    i AS ({" UNION ALL ".join([f"SELECT '{n}' AS issue FROM t WHERE {c}" for n, c in _ISSUES] + [f"SELECT 'suggestion.{n}' FROM x WHERE {c}" for n, c in _EACH])}) SELECT issue, count(*) AS n FROM i GROUP BY 1"""

SQL = {
    "record_validation": _RECORD, "review_validation": _REVIEW_ISSUES,
    "reward_claims": _REWARD_CLAIMS, "claims_state": _STATE, "routed_followups": _ROUTED, "mapped_rebuttals": _MAPPED,
    "classify_followup": _FOLLOW, "quote_only": _QUOTE, "reply_type": _reply_type_sql(), "l13_tiebreak": _tie_sql(), "noisy_title": _NOISY, "specificity": _SPECIFIC, "repetition_penalty": _REPEAT,
    "leak_flags": "SELECT doc_id, " + ", ".join(f"{U.sql(('any', *p), 'text')} AS {k}" for k, p in U.LEAKS.items()) + " FROM documents WHERE text IS NOT NULL",
    "claim_prior": f"""WITH n AS (SELECT submission_id, count(*) AS n FROM {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"submission_id": "submission_id", "claim": "enhanced_review.claim"})} WHERE NOT {S.blank('claim')} AND submission_id IS NOT NULL GROUP BY 1)
        SELECT submission_id, CAST(n AS INTEGER) AS n, round(CASE WHEN n <= 1 THEN 1.0 WHEN n = 2 THEN 0.9 ELSE greatest(0.6, 0.9 - 0.15 * (n - 2)) END, 6)::DOUBLE AS prior FROM n""",
}
