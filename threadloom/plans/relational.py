"""Joins, aggregates, samples and splits of the pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import relational as R
from threadloom.plans import sql as S
from threadloom.runtime import cut, latest, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "classified_weakness_pairs").select("weakness_id", "submission_id", "classified_at", "original_weakness", F.col("weakness_category.l1_id").alias("l1_id"), F.col("weakness_category.l2_id").alias("l2_id"), F.col("weakness_category.confidence").alias("confidence"))
    return latest(rows, ["weakness_id"], "classified_at", ["weakness_id", "submission_id", "original_weakness", "l1_id", "l2_id", "confidence"])


_PAIRS = S.latest("classified_weakness_pairs", "weakness_id", "classified_at", {"submission_id": "submission_id", "original_weakness": "original_weakness", "l1_id": "weakness_category.l1_id", "l2_id": "weakness_category.l2_id", "confidence": "weakness_category.confidence"})


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Weaknesses that have no enhanced review yet."""
    return R.resume(_pairs(spark, d).select("weakness_id"), table(spark, d, "enhanced_reviews"), "weakness_id")


def eligible_semi(spark: SparkSession, d: str) -> DataFrame:
    """Weaknesses with an enhanced review and a chat record."""
    chats = table(spark, d, "sft_train").select(F.col("meta.weakness_id").alias("weakness_id"))
    return R.eligible(_pairs(spark, d).select("weakness_id", "l2_id"), table(spark, d, "enhanced_reviews"), chats, key="weakness_id")


def tax_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names of the categories from the taxonomy that the rows themselves hold, a dimension of a few dozen rows."""
    c = table(spark, d, "classified_weakness_pairs").select("weakness_category.*")
    names = c.where("l2_id is not null and l2_id != 'UNKNOWN'").groupBy("l2_id").agg(F.min("l2_name").alias("l2_name"), F.min("l1_name").alias("l1_name"))
    return _pairs(spark, d).select("weakness_id", "l2_id").join(names, "l2_id")


def overlay_existing_wins(spark: SparkSession, d: str) -> DataFrame:
    """Titles from the reviews' own context over those of the papers."""
    own = latest(table(spark, d, "enhanced_reviews").select("submission_id", "enhanced_at", F.col("paper_context.title").alias("title")), ["submission_id"], "enhanced_at", ["submission_id", "title"])
    papers = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "title"), ["submission_id"], "fetched_at", ["submission_id", "title"])
    return R.overlay(own, papers, "submission_id", ["title"])


def reclassify_merge(spark: SparkSession, d: str) -> DataFrame:
    """Categories of the pairs, replaced where the enhanced review has another one."""
    new = latest(table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", F.col("weakness_category.l2_id").alias("new_l2")), ["weakness_id"], "enhanced_at", ["weakness_id", "new_l2"])
    return _pairs(spark, d).join(new, "weakness_id", "left").select("weakness_id", F.coalesce("new_l2", "l2_id").alias("l2_id"))


def final_records(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, enhanced reviews and chat records joined, snippets added where there are any."""
    review = latest(table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", F.col("enhanced_review.severity").alias("severity")), ["weakness_id"], "enhanced_at", ["weakness_id", "severity"])
    chat = latest(table(spark, d, "sft_train").select("record_id", "exported_at", F.col("meta.weakness_id").alias("weakness_id")), ["record_id"], "exported_at", ["record_id", "weakness_id"])
    snippets = latest(table(spark, d, "enhanced_data_with_snippets_dual").select("weakness_id", "aligned_at", F.size("aligned_snippets_task1").alias("n_snippets")), ["weakness_id"], "aligned_at", ["weakness_id", "n_snippets"])
    return chat.join(_pairs(spark, d).select("weakness_id", "l2_id"), "weakness_id").join(review, "weakness_id").join(snippets, "weakness_id", "left")


def group_cap_collect(spark: SparkSession, d: str) -> DataFrame:
    """The three most confident weaknesses of each paper and category, from a confidence of 0.5 on; an unknown one counts as 1."""
    rows = _pairs(spark, d).where("l2_id is not null and l2_id != 'UNKNOWN' and coalesce(confidence, 1.0) >= 0.5")
    got = R.group_cap_collect(rows, ["submission_id", "l2_id"], [F.desc_nulls_last("confidence"), F.asc("weakness_id")], F.col("weakness_id"), 3, F.md5("original_weakness"))
    return got.select("submission_id", "l2_id", F.array_join("items", ",").alias("items"), "context")


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Weaknesses per first and second level, per first level and in all."""
    return _pairs(spark, d).rollup("l1_id", "l2_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.grouping_id().cast("int").alias("level"))


def percent_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per year: share of papers with sections, mean number of keywords."""
    papers = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "year", "keywords", "sections_index"), ["submission_id"], "fetched_at", ["submission_id", "year", "keywords", "sections_index"])
    some = F.size("sections_index") > 0
    return papers.groupBy("year").agg(F.count("*").alias("n"), F.count_if(some).alias("has_sections"), F.round(F.count_if(some) / F.count("*"), 6).alias("share"), F.round(F.avg(F.when(F.col("keywords").isNotNull(), F.size("keywords"))), 6).alias("mean_keywords"))


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A score cache written from the views, then merged with all other events: each key's latest score."""
    rows = table(spark, d, "events").select(F.sha2(F.concat_ws("|", "user_id", "event_type"), 256).alias("cache_key"), F.col("value").alias("score"), F.col("ts").alias("created_at"), "event_id", "event_type")
    parts = [rows.where(c).drop("event_type") for c in ("event_type = 'view'", "event_type != 'view' or event_type is null")]
    cache = cut(R.upsert(None, parts[0], ["cache_key"], "created_at"), "cache")
    return R.upsert(cache, parts[1], ["cache_key"], "created_at").select("cache_key", "score", "created_at")


def id_digest(spark: SparkSession, d: str) -> DataFrame:
    return R.id_digest(_pairs(spark, d), ["submission_id"], "weakness_id")


def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 20 weaknesses of each category by confidence, then shuffle key."""
    rows = _pairs(spark, d).where("l2_id is not null").select("weakness_id", "l2_id", "confidence")
    return R.stratified_cap(rows, "l2_id", [F.desc_nulls_last("confidence"), R.random_key("weakness_id"), F.asc("weakness_id")], 20).select("weakness_id", "l2_id")


def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 120 weaknesses over the categories."""
    rows = _pairs(spark, d).where("l2_id is not null").select("weakness_id", "l2_id")
    return R.stratified_quota(rows, "l2_id", "weakness_id", 120)


def split_train_val(spark: SparkSession, d: str) -> DataFrame:
    return R.split_val_first(_pairs(spark, d).select("weakness_id"), "weakness_id", 0.05).select("weakness_id", "split")


def split_train_first(spark: SparkSession, d: str) -> DataFrame:
    return R.split_train_first(_pairs(spark, d).select("weakness_id"), "weakness_id", 0.9, 7).select("weakness_id", "split")


def chunk_shards(spark: SparkSession, d: str) -> DataFrame:
    return R.shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "shard")


def weighted_soft_score(spark: SparkSession, d: str) -> DataFrame:
    """Events as scores of 1 to 5 (views have none), weighted by the event's value, per user: (mean - 1) / 4."""
    e = table(spark, d, "events").withColumn("s", F.when(F.col("event_type") != "view", F.pmod("event_id", F.lit(5)) + 1))
    mean = R.weighted_mean(e, ["user_id"], F.col("s"), F.col("value"))
    return mean.select("user_id", F.round(F.coalesce((F.col("score") - 1) / 4, F.lit(0.5)), 6).alias("soft"), "n_known")


def weight_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Order prices as weights of their customer, scaled to 100; equal where they sum to 0."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    w = F.when(F.col("total") > 0, F.col("o_totalprice") * 100 / F.col("total")).otherwise(F.lit(100.0) / F.col("n"))
    return o.join(total, "o_custkey").select("o_orderkey", F.round(w, 6).alias("weight"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Characters over four, per document source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.expr("n_chars div 4")).alias("tokens"))


def chat_records(spark: SparkSession, d: str) -> DataFrame:
    """Claims as chat messages in JSON, one record per valid review."""
    r = latest(table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", "original_weakness", F.col("enhanced_review.claim").alias("claim")), ["weakness_id"], "enhanced_at", ["weakness_id", "original_weakness", "claim"])
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = F.array(message("user", F.col("original_weakness")), message("assistant", F.col("claim")))
    return r.where(~X.blank(F.col("claim")) & ~X.blank(F.col("original_weakness"))).select("weakness_id", F.md5(F.to_json(chat)).alias("digest"))


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Common words, Jaccard and containment of weakness and claim."""
    r = latest(table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", "original_weakness", F.col("enhanced_review.claim").alias("claim")), ["weakness_id"], "enhanced_at", ["weakness_id", "original_weakness", "claim"])
    r = r.where("original_weakness is not null and claim is not null").select("weakness_id", X.word_set(F.col("original_weakness")).alias("a"), X.word_set(F.col("claim")).alias("b"))
    common, least = F.size(F.array_intersect("a", "b")), F.least(F.size("a"), F.size("b"))
    return r.where("size(a) > 0 and size(b) > 0").select("weakness_id", common.alias("common"), F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(common / least, 6).alias("containment"))


def concat_shards(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all tables in one bag, counted by kind."""
    a = table(spark, d, "thread_events").select(F.lit("event").alias("kind"), "text")
    b = table(spark, d, "documents").select(F.lit("document").alias("kind"), "text")
    c = table(spark, d, "classified_weakness_pairs").select(F.lit("weakness").alias("kind"), F.col("original_weakness").alias("text"))
    return a.unionByName(b).unionByName(c).groupBy("kind").agg(F.count("*").alias("n"), F.count("text").alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


QUERIES = {f.__name__: f for f in [
    resume_anti, eligible_semi, tax_lookup, overlay_existing_wins, reclassify_merge, final_records, group_cap_collect, label_distribution, percent_stats, last_wins, cache_upsert, id_digest,
    stratified_cap, stratified_quota, split_train_val, split_train_first, chunk_shards, weighted_soft_score, weight_normalise, token_estimates, chat_records, token_sets, concat_shards,
]}
_REVIEW = lambda **c: S.latest("enhanced_reviews", "weakness_id", "enhanced_at", c)
_WS = lambda c: f"list_distinct({S.words(c)})"
SQL = {
    "resume_anti": f"SELECT weakness_id FROM {_PAIRS} WHERE weakness_id NOT IN (SELECT weakness_id FROM enhanced_reviews WHERE weakness_id IS NOT NULL)",
    "eligible_semi": f"SELECT weakness_id, l2_id FROM {_PAIRS} WHERE weakness_id IN (SELECT weakness_id FROM enhanced_reviews) AND weakness_id IN (SELECT meta.weakness_id FROM sft_train)",
    "tax_lookup": f"""WITH n AS (SELECT weakness_category.l2_id AS l2_id, min(weakness_category.l2_name) AS l2_name, min(weakness_category.l1_name) AS l1_name FROM classified_weakness_pairs WHERE weakness_category.l2_id <> 'UNKNOWN' GROUP BY 1)
        SELECT weakness_id, l2_id, l2_name, l1_name FROM {_PAIRS} JOIN n USING (l2_id)""",
    "overlay_existing_wins": f"""SELECT submission_id, coalesce(a.title, b.title) AS title FROM {S.latest("enhanced_reviews", "submission_id", "enhanced_at", {"title": "paper_context.title"})} a
        FULL JOIN {S.latest("paper_context", "submission_id", "fetched_at", {"title": "title"})} b USING (submission_id)""",
    "reclassify_merge": f"SELECT weakness_id, coalesce(n, l2_id) AS l2_id FROM {_PAIRS} LEFT JOIN {_REVIEW(n='weakness_category.l2_id')} USING (weakness_id)",
    "final_records": f"""SELECT weakness_id, record_id, l2_id, severity, n_snippets FROM {S.latest("sft_train", "record_id", "exported_at", {"weakness_id": "meta.weakness_id"})} JOIN {_PAIRS} USING (weakness_id)
        JOIN {_REVIEW(severity='enhanced_review.severity')} USING (weakness_id) LEFT JOIN {S.latest("enhanced_data_with_snippets_dual", "weakness_id", "aligned_at", {"n_snippets": "CASE WHEN aligned_snippets_task1 IS NOT NULL THEN CAST(length(aligned_snippets_task1) AS INTEGER) END"})} USING (weakness_id)""",
    "group_cap_collect": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY submission_id, l2_id ORDER BY confidence DESC NULLS LAST, weakness_id) AS r FROM {_PAIRS} WHERE l2_id <> 'UNKNOWN' AND coalesce(confidence, 1.0) >= 0.5)
        SELECT submission_id, l2_id, string_agg(weakness_id, ',' ORDER BY r) AS items, arg_min(md5(original_weakness), r) AS context FROM r WHERE r <= 3 GROUP BY 1, 2""",
    "label_distribution": f"SELECT l1_id, l2_id, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, CAST(grouping(l1_id, l2_id) AS INTEGER) AS level FROM {_PAIRS} GROUP BY ROLLUP (l1_id, l2_id)",
    "percent_stats": f"""SELECT year, count(*) AS n, count(*) FILTER (length(s) > 0) AS has_sections, round(count(*) FILTER (length(s) > 0) / count(*), 6) AS share, round(avg(length(k)), 6) AS mean_keywords
        FROM {S.latest("paper_context", "submission_id", "fetched_at", {"year": "year", "k": "keywords", "s": "sections_index"})} GROUP BY 1""",
    "last_wins": "SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2",
    "cache_upsert": """SELECT cache_key, v.s AS score, v.t AS created_at FROM (SELECT sha256(user_id || '|' || event_type) AS cache_key, arg_max(struct_pack(s := value, t := ts), struct_pack(a := ts, s := value, b := event_id)) AS v FROM events GROUP BY 1)""",
    "id_digest": f"SELECT submission_id, count(DISTINCT weakness_id) AS n_ids, CAST(bit_xor(CAST('0x' || substring(md5(weakness_id), 1, 15) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT DISTINCT submission_id, weakness_id FROM {_PAIRS}) GROUP BY 1",
    "stratified_cap": f"""SELECT weakness_id, l2_id FROM (SELECT *, row_number() OVER (PARTITION BY l2_id ORDER BY confidence DESC NULLS LAST, md5(weakness_id || ':42'), weakness_id) AS r FROM {_PAIRS} WHERE l2_id IS NOT NULL) WHERE r <= 20""",
    "stratified_quota": f"""WITH p AS (SELECT weakness_id, l2_id, md5(weakness_id || ':42') AS k FROM {_PAIRS} WHERE l2_id IS NOT NULL), n AS (SELECT greatest(1, 120 // count(DISTINCT l2_id)) AS q FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY l2_id ORDER BY k, weakness_id) AS r FROM p) SELECT weakness_id, l2_id FROM r, n ORDER BY CASE WHEN r > q THEN 1 ELSE 0 END, k, weakness_id LIMIT 120""",
    "split_train_val": f"""SELECT weakness_id, CASE WHEN row_number() OVER (ORDER BY md5(weakness_id || ':42'), weakness_id) <= greatest(1, CAST(floor(count(*) OVER () * 0.05) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM {_PAIRS}""",
    "split_train_first": f"""SELECT weakness_id, CASE WHEN row_number() OVER (ORDER BY md5(weakness_id || ':7'), weakness_id) <= CAST(floor(count(*) OVER () * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM {_PAIRS}""",
    "chunk_shards": "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents",
    "weighted_soft_score": """SELECT user_id, round(coalesce((CASE WHEN sum(value) FILTER (s IS NOT NULL) > 0 THEN sum(s * value) / sum(value) FILTER (s IS NOT NULL) END - 1) / 4, 0.5), 6) AS soft, count(s) AS n_known
        FROM (SELECT *, CASE WHEN event_type <> 'view' THEN event_id % 5 + 1 END AS s FROM events) GROUP BY 1""",
    "weight_normalise": """SELECT o_orderkey, round(CASE WHEN sum(o_totalprice) OVER w > 0 THEN o_totalprice * 100 / sum(o_totalprice) OVER w ELSE 100.0 / count(*) OVER w END, 6) AS weight FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
    "token_estimates": "SELECT source, count(*) AS n, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "chat_records": f"""SELECT weakness_id, md5(CAST(to_json([struct_pack("role" := 'user', content := w), struct_pack("role" := 'assistant', content := c)]) AS VARCHAR)) AS digest
        FROM {_REVIEW(w='original_weakness', c='enhanced_review.claim')} WHERE NOT {S.blank('w')} AND NOT {S.blank('c')}""",
    "token_sets": f"""WITH r AS (SELECT weakness_id, {_WS('w')} AS a, {_WS('c')} AS b FROM {_REVIEW(w='original_weakness', c='enhanced_review.claim')} WHERE w IS NOT NULL AND c IS NOT NULL),
        i AS (SELECT *, length(list_intersect(a, b)) AS m FROM r WHERE length(a) > 0 AND length(b) > 0)
        SELECT weakness_id, CAST(m AS INTEGER) AS common, round(m / (length(a) + length(b) - m), 6) AS jaccard, round(m / least(length(a), length(b)), 6) AS containment FROM i""",
    "concat_shards": """SELECT kind, count(*) AS n, count(text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT 'event' AS kind, text FROM thread_events UNION ALL SELECT 'document', text FROM documents
        UNION ALL SELECT 'weakness', original_weakness FROM classified_weakness_pairs) GROUP BY 1""",
}
