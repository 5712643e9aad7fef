"""The valid rows of the domain's tables, as the llm queries use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.runtime import latest, table, wide


def near_items(spark: SparkSession, d: str) -> DataFrame:
    """(scope, id, ts, text) of problem 2, all versions."""
    pairs = table(spark, d, "classified_weakness_pairs")
    reviews = table(spark, d, "enhanced_reviews")
    a = pairs.select(F.lit("weakness").alias("scope"), F.col("weakness_id").alias("id"), F.col("classified_at").alias("ts"), F.col("original_weakness").alias("text"))
    b = reviews.select(F.lit("claim").alias("scope"), F.col("weakness_id").alias("id"), F.col("enhanced_at").alias("ts"), F.col("enhanced_review.claim").alias("text"))
    return a.union(b)


def split_name(c: Column) -> Column:
    """train, val or test; null for null, blank and unknown names."""
    s = F.lower(X.strip(c))
    return F.when(s == "train", "train").when(s.isin("val", "valid", "validation", "dev"), "val").when(s == "test", "test")


def records(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, weakness_id, paper, split) of the valid records; the paper is that of the weakness_id."""
    rows = table(spark, d, "sft_train").select("record_id", "exported_at", F.col("meta.weakness_id").alias("weakness_id"), F.col("meta.split").alias("split"))
    valid = latest(rows, ["record_id"], "exported_at", ["record_id", "weakness_id", "split"])
    return valid.select("record_id", "weakness_id", paper_of("weakness_id").alias("paper"), split_name(F.col("split")).alias("split"))


def paper_of(c: str) -> Column:
    """The submission_id a weakness_id starts with: what stands before _Reviewer_, else the whole."""
    return F.regexp_replace(F.col(c), r"_Reviewer_.*$", "")


def overlap_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(scope, id, text, train, eval) of problem 1: weaknesses by weakness_id and titles by paper; and the records."""
    used = records(spark, d).where("split is not null")
    sides = [F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("eval")]
    pairs = latest(table(spark, d, "classified_weakness_pairs"), ["weakness_id"], "classified_at", ["weakness_id", "original_weakness"])
    papers = latest(table(spark, d, "paper_context"), ["submission_id"], "fetched_at", ["submission_id", "title"])
    a = used.groupBy("weakness_id").agg(*sides).join(pairs, "weakness_id")
    b = used.groupBy(F.col("paper").alias("submission_id")).agg(*sides).join(papers, "submission_id")
    items = a.select(F.lit("weakness").alias("scope"), F.col("weakness_id").alias("id"), F.col("original_weakness").alias("text"), "train", "eval")
    return items.union(b.select(F.lit("title"), "submission_id", "title", "train", "eval")), used


LISTS = ["aligned_snippets_task1", "aligned_snippets_task2"]


def oversize_snippets(spark: SparkSession, d: str) -> DataFrame:
    """(weakness_id, list_name, snippet_no, text) of the valid rows, both lists, only the texts above the limit of their list.

    Texts that fit are left out before the rows meet by key, and the long ones are spread over the cluster.
    """
    limits = {r[0]: r[1] for r in table(spark, d, "chunk_limits").where("list_name is not null and max_chars > 0").groupBy("list_name").agg(F.min("max_chars")).collect() if r[0] in LISTS}  # at most two
    one = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array()), lambda x, i: F.struct(F.lit(c).alias("list_name"), (i + 1).alias("snippet_no"), x["text"].alias("text"))), lambda x: F.length(x["text"]) > limits[c])
    big = F.concat(*[one(c) for c in limits]) if limits else F.array().cast("array<struct<list_name:string,snippet_no:int,text:string>>")
    rows = table(spark, d, "enhanced_data_with_snippets_dual").select("weakness_id", "aligned_at", big.alias("big"))
    valid = latest(rows, ["weakness_id"], "aligned_at", ["weakness_id", "big"])
    spread = valid.select("weakness_id", F.explode("big").alias("s")).select("weakness_id", "s.*")
    return spread.repartition(wide(spark), "weakness_id", "list_name", "snippet_no")


def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, record_key, pair_no, question, answer) of problem 6, from the valid rows: every turn of every record."""
    chats = latest(table(spark, d, "sft_train").select("record_id", "exported_at", "messages"), ["record_id"], "exported_at", ["record_id", "messages"])
    role = lambda m: F.lower(X.strip(m["role"]))
    numbered = F.transform("messages", lambda m, i: F.struct(i.alias("i"), role(m).alias("role"), m["content"].alias("content")))
    asked = F.filter(numbered, lambda m: m["role"] == "user")
    after = lambda m: F.get("messages", m["i"] + 1)
    answer = lambda m: F.when(role(after(m)) == "assistant", after(m)["content"])
    turns = F.transform(asked, lambda m, n: F.struct((n + 1).alias("pair_no"), m["content"].alias("question"), answer(m).alias("answer")))
    a = chats.select(F.lit("sft_train").alias("table_name"), F.col("record_id").alias("record_key"), F.explode(turns).alias("t")).select("table_name", "record_key", "t.*")
    reviews = table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", "original_weakness", F.col("enhanced_review.claim").alias("claim"))
    b = latest(reviews, ["weakness_id"], "enhanced_at", ["weakness_id", "original_weakness", "claim"])
    return a.union(b.select(F.lit("enhanced_reviews"), "weakness_id", F.lit(1), F.col("original_weakness"), F.col("claim")))


def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    """(node, key): paper and author_id, from the valid rows of paper_context."""
    papers = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "participants.authors"), ["submission_id"], "fetched_at", ["submission_id", "authors"])
    one = papers.select(F.col("submission_id").alias("node"), F.explode("authors").alias("a")).select("node", X.strip(F.col("a.author_id")).alias("key"))
    return one.where(~X.blank(F.col("key")))
