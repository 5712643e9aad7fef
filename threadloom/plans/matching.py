"""Pairs inside a group: best matches, near doubles, valid groups, digests of id sets; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import lexical as L
from threadloom.functions import rules as U
from threadloom.functions import text as X
from threadloom.functions import validate as V
from threadloom.operators import relational as R
from threadloom.plans import sql as S
from threadloom.runtime import latest, table


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "enhanced_reviews").select("weakness_id", "submission_id", "enhanced_at", "original_weakness", "enhanced_review", F.col("weakness_category.l2_id").alias("l2_id"), F.col("paper_context.abstract").alias("abstract"))
    return latest(rows, ["weakness_id"], "enhanced_at", ["weakness_id", "submission_id", "original_weakness", "enhanced_review", "l2_id", "abstract"])


def best_match(spark: SparkSession, d: str) -> DataFrame:
    """For each claim the weakness of its paper it is most similar to by words, else the paper's first."""
    r = _reviews(spark, d)
    claims = r.where("enhanced_review.claim is not null").select("submission_id", F.col("weakness_id").alias("claim_of"), X.word_set(F.col("enhanced_review.claim")).alias("a"))
    weak = r.where("original_weakness is not null").select("submission_id", "weakness_id", X.word_set(F.col("original_weakness")).alias("b"))
    return R.best_match(claims, weak, "submission_id", "claim_of", "weakness_id", X.jaccard(F.col("a"), F.col("b"))).select("claim_of", "weakness_id", F.round("similarity", 6).alias("similarity"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Claims of one paper that share at least 0.65 of their words, or 0.6 of the smaller set's content tokens; each pair once."""
    c = _reviews(spark, d).where("enhanced_review.claim is not null and submission_id is not null").select("submission_id", "weakness_id", X.word_set(F.col("enhanced_review.claim")).alias("w"), L.tokens(F.col("enhanced_review.claim")).alias("t"))
    other = c.select("submission_id", F.col("weakness_id").alias("other"), F.col("w").alias("w2"), F.col("t").alias("t2"))
    both = c.join(other, "submission_id").where("weakness_id < other and size(w) > 0 and size(w2) > 0")
    least = F.least(F.size("t"), F.size("t2"))
    contained = F.when(least > 0, F.size(F.array_intersect("t", "t2")) / least).otherwise(0.0)
    scored = both.select("weakness_id", "other", F.round(X.jaccard(F.col("w"), F.col("w2")), 6).alias("jaccard"), F.round(contained, 6).alias("containment"))
    return scored.where("jaccard >= 0.65 or containment >= 0.6")


def valid_groups(spark: SparkSession, d: str) -> DataFrame:
    """Papers and categories with their valid items counted; groups without one, without an abstract or a category are left out."""
    r = _reviews(spark, d).where(~X.blank(F.col("abstract")) & ~X.blank(F.col("l2_id")) & ~X.blank(F.col("submission_id")))
    ok = r.where(V.item_valid(F.col("enhanced_review")))
    return ok.groupBy("submission_id", "l2_id").agg(F.count("*").alias("n_items"), F.min("weakness_id").alias("first_item"))


def id_set_digest(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the sorted JSON list of the documents' ids of each source, in blocks of ids that concatenate in order."""
    ids = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("block")).distinct()
    blocks = ids.groupBy("source", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ", ").alias("part"))
    return blocks.select("source", "block", F.sha2(F.concat(F.lit("["), "part", F.lit("]")), 256).alias("digest"))


def id_set_digest_whole(spark: SparkSession, d: str) -> DataFrame:
    """One SHA-256 for the id set of each source: of the JSON list of its blocks' digests, in the order of the blocks."""
    parts = id_set_digest(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("parts"))
    return parts.select("source", F.size("parts").alias("blocks"), F.sha2(F.to_json(F.col("parts.digest")), 256).alias("digest"))


QUERIES = {f.__name__: f for f in [best_match, near_dup_pairs, valid_groups, id_set_digest, id_set_digest_whole]}
_REV = S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"submission_id": "submission_id", "w": "original_weakness", "c": "enhanced_review.claim", "r": "enhanced_review", "l2_id": "weakness_category.l2_id", "abstract": "paper_context.abstract"})
_WS = lambda c: f"list_distinct({S.words(c)})"
_FIELDS = ["what", '"where"', "how", "expected_outcome", "priority"]
SQL = {
    "best_match": f"""WITH r AS {_REV}, a AS (SELECT submission_id, weakness_id AS claim_of, {_WS('c')} AS a FROM r WHERE c IS NOT NULL), b AS (SELECT submission_id, weakness_id, {_WS('w')} AS b FROM r WHERE w IS NOT NULL),
        s AS (SELECT claim_of, weakness_id, CASE WHEN length(a) + length(b) > 0 THEN length(list_intersect(a, b)) / (length(a) + length(b) - length(list_intersect(a, b))) ELSE 0 END AS similarity FROM a JOIN b USING (submission_id))
        SELECT claim_of, arg_max(weakness_id, struct_pack(s := similarity, i := -r)) AS weakness_id, round(max(similarity), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY claim_of ORDER BY weakness_id) AS r FROM s) GROUP BY 1""",
    "near_dup_pairs": f"""WITH c AS (SELECT submission_id, weakness_id, {_WS('c')} AS w, {S.tokens('c')} AS t FROM {_REV} WHERE c IS NOT NULL),
        p AS (SELECT a.weakness_id, b.weakness_id AS other, round(length(list_intersect(a.w, b.w)) / (length(a.w) + length(b.w) - length(list_intersect(a.w, b.w))), 6) AS jaccard,
            round(CASE WHEN least(length(a.t), length(b.t)) > 0 THEN length(list_intersect(a.t, b.t)) / least(length(a.t), length(b.t)) ELSE 0 END, 6)::DOUBLE AS containment FROM c a JOIN c b ON a.submission_id = b.submission_id AND a.weakness_id < b.weakness_id WHERE length(a.w) > 0 AND length(b.w) > 0)
        SELECT * FROM p WHERE jaccard >= 0.65 OR containment >= 0.6""",
    "valid_groups": f"""WITH v AS (SELECT submission_id, weakness_id, l2_id, r, concat_ws(chr(10), r.claim, r.evidence, r.severity, array_to_string(r.citations, chr(10)), array_to_string(list_transform(r.actionable_suggestions, lambda x: concat_ws(chr(10), x.what, x."where", x.how, x.expected_outcome, x.priority)), chr(10))) AS told
            FROM {_REV} WHERE NOT {S.blank('abstract')} AND NOT {S.blank('l2_id')} AND NOT {S.blank('submission_id')})
        SELECT submission_id, l2_id, count(*) AS n_items, min(weakness_id) AS first_item FROM v WHERE NOT {S.blank('r.claim')} AND length(r.actionable_suggestions) > 0 AND NOT {U.sql(("any", *U.LEAKS["chat"]), 'told')}
            AND length(list_filter(r.actionable_suggestions, lambda x: {" OR ".join(S.blank(f'x.{f}') for f in _FIELDS)})) = 0 GROUP BY 1, 2""",
    "id_set_digest": "SELECT source, CAST(floor(doc_id / 1000) AS BIGINT) AS block, sha256('[' || string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) || ']') AS digest FROM (SELECT DISTINCT source, doc_id FROM documents) GROUP BY 1, 2",
}
