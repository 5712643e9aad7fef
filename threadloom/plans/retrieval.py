"""Retrieval queries over the papers' documents and the claims about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import lexical as L
from threadloom.operators import retrieval as R
from threadloom.plans import sql as S
from threadloom.runtime import latest, table


def claims(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "enhanced_reviews").select("weakness_id", "submission_id", "enhanced_at", F.col("enhanced_review.claim").alias("claim"))
    return latest(rows, ["weakness_id"], "enhanced_at", ["weakness_id", "submission_id", "claim"])


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "submission_id", "text")


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three documents of its paper that best cover each claim."""
    q = claims(spark, d).select("weakness_id", "submission_id", L.tokens(F.col("claim")).alias("q_tokens"))
    c = texts(spark, d).withColumn("t", L.norm(F.col("text"))).select("doc_id", "submission_id", L.tokens(F.col("t")).alias("c_tokens"), F.md5(L.prefix_key(F.col("t"))).alias("prefix"))
    return R.lexical_topk(q, c, "submission_id", "weakness_id", "doc_id")


_CLAIMS = S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"submission_id": "submission_id", "claim": "enhanced_review.claim"})
_TOPK = f"""
    WITH q AS (SELECT weakness_id, submission_id, {S.tokens("claim")} AS t FROM {_CLAIMS}),
    c AS (SELECT doc_id, submission_id, {S.tokens("text")} AS t, substring({S.norm("text")}, 1, 350) AS prefix FROM documents),
    s AS (SELECT weakness_id, doc_id, prefix, round(length(list_intersect(q.t, c.t)) / length(q.t), 6) AS score FROM q JOIN c USING (submission_id) WHERE length(q.t) > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY weakness_id, prefix ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0),
    k AS (SELECT weakness_id, doc_id, score, row_number() OVER (PARTITION BY weakness_id ORDER BY score DESC, doc_id) AS rank FROM o WHERE r = 1)
    SELECT weakness_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 3"""


def tokens_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return texts(spark, d).withColumn("t", L.tokens(F.col("text"))).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ")).alias("digest"))


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.md5(L.norm(F.col("text"))).alias("digest"))


def chunk_type(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).withColumn("t", L.norm(F.col("text"))).select("doc_id", L.chunk_type(F.col("t")).alias("kind"))


def _chunk_type_sql() -> str:
    t = S.norm("text")
    whens = " ".join(f"WHEN {S.has_any('t', m)} THEN '{k}'" for k, m in L.CHUNK_TYPES.items())
    return f"SELECT doc_id, CASE {whens} ELSE 'generic' END AS kind FROM (SELECT doc_id, {t} AS t FROM documents)"


def phrase_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Points for the phrases of a weakness that documents of its paper repeat."""
    rows = table(spark, d, "classified_weakness_pairs").select("weakness_id", "submission_id", "classified_at", "original_weakness")
    q = latest(rows, ["weakness_id"], "classified_at", ["weakness_id", "submission_id", "original_weakness"])
    c = texts(spark, d).select("doc_id", "submission_id", L.norm(F.col("text")).alias("t"))
    both = q.select("weakness_id", "submission_id", L.phrases(F.col("original_weakness")).alias("p")).join(c, "submission_id")
    return both.select("weakness_id", "doc_id", F.round(L.phrase_overlap(F.col("p"), F.col("t")), 6).alias("score")).where("score > 0")


_PHRASES = f"list_slice(list_filter(list_transform(string_split_regex({S.norm('w')}, '[.;:\\n]'), lambda p: {S.strip('p')}), lambda p: length(string_split_regex(p, '\\s+')) BETWEEN 2 AND 18 AND length(p) <= 120), 1, 18)"
_PHRASE_SQL = f"""
    WITH q AS (SELECT weakness_id, submission_id, {_PHRASES} AS p FROM {S.latest("classified_weakness_pairs", "weakness_id", "classified_at", {"submission_id": "submission_id", "w": "original_weakness"})}),
    c AS (SELECT doc_id, submission_id, {S.norm("text")} AS t FROM documents)
    SELECT weakness_id, doc_id, round(least(0.30, 0.05 * length(list_filter(p, lambda x: contains(t, x)))), 6)::DOUBLE AS score
    FROM q JOIN c USING (submission_id) WHERE length(list_filter(p, lambda x: contains(t, x))) > 0"""


def dedup_prefix350(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each 350-character prefix."""
    keyed = texts(spark, d).select(L.prefix_key(L.norm(F.col("text"))).alias("k"), "doc_id")
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


QUERIES = {
    "lexical_topk": lexical_topk, "tokens_distinct": tokens_distinct, "norm_text": norm_text, "chunk_type": chunk_type, "phrase_overlap": phrase_overlap, "dedup_prefix350": dedup_prefix350,
}
SQL = {
    "lexical_topk": _TOPK,
    "tokens_distinct": f"SELECT doc_id, CAST(length(t) AS INTEGER) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)",
    "norm_text": f"SELECT doc_id, md5({S.norm('text')}) AS digest FROM documents",
    "chunk_type": _chunk_type_sql(),
    "phrase_overlap": _PHRASE_SQL,
    "dedup_prefix350": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY substring({S.norm('text')}, 1, 350)",
}
