"""Relational steps of the pipeline: resume, overlay, grouping with a cap, samples, splits and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.numbering import number_in_order


def random_key(id_: str, seed: int = 42) -> Column:
    """A reproducible shuffle key that SQL can compute as well."""
    return F.md5(F.concat(F.col(id_).cast("string"), F.lit(f":{seed}")))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet. Null keys are never done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def eligible(rows: DataFrame, *needed: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in all of the others."""
    for other in needed:
        rows = rows.join(other.select(key).distinct(), key, "left_semi")
    return rows


def overlay(existing: DataFrame, new: DataFrame, key: str, columns: list[str], existing_wins: bool = True) -> DataFrame:
    """Full outer merge by key; of two non-null values the winner's is taken, column by column."""
    a, b = (existing, new) if existing_wins else (new, existing)
    b = b.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return a.select(key, *columns).join(b, key, "full_outer").select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns])


def group_cap_collect(rows: DataFrame, keys: list[str], order: list[Column], item: Column, cap: int, context: Column) -> DataFrame:
    """The best `cap` items of each group in order, with the first row's context."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= cap)
    got = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__r", item.alias("item")))).alias("__i"), F.min_by(context, "__r").alias("context"))
    return got.select(*keys, F.transform("__i", lambda x: x["item"]).alias("items"), "context")


def stratified_cap(rows: DataFrame, stratum: str, order: list[Column], cap: int) -> DataFrame:
    """At most `cap` rows of each stratum, the first by order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("__r") <= cap).drop("__r")


def stratified_quota(rows: DataFrame, stratum: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    """max(1, n // k) of each of the k strata, topped up from the rest to n, all by the shuffle key."""
    rows = rows.withColumn("__key", random_key(id_, seed))
    k = rows.select(stratum).distinct().count()
    each = max(1, n // k) if k else 1
    first = F.row_number().over(Window.partitionBy(stratum).orderBy("__key", id_))
    # more than n rows of a stratum can never be taken
    ranked = rows.withColumn("__r", first).where(F.col("__r") <= max(n, each))
    return ranked.orderBy((F.col("__r") > each).cast("int"), "__key", id_).limit(n).drop("__key", "__r")


def numbered_by_key(rows: DataFrame, id_: str, seed: int = 42) -> tuple[DataFrame, int]:
    """Rows with their place (from 1) in the shuffled order, and how many there are; no global sort in one task."""
    keyed = rows.withColumn("__key", random_key(id_, seed)).withColumn("__all", F.lit(0))
    out = number_in_order(keyed, ["__all"], ["__key", id_], "place").drop("__key", "__all")
    return out, rows.count()


def split_val_first(rows: DataFrame, id_: str, ratio: float, seed: int = 42) -> DataFrame:
    """val for the first max(1, int(n * ratio)) of the shuffled rows, train for the rest."""
    out, n = numbered_by_key(rows, id_, seed)
    return out.withColumn("split", F.when(F.col("place") <= max(1, int(n * ratio)), "val").otherwise("train"))


def split_train_first(rows: DataFrame, id_: str, ratio: float, seed: int = 42) -> DataFrame:
    """train for the first int(n * ratio) of the shuffled rows, val for the rest; ratio 1 leaves no val."""
    out, n = numbered_by_key(rows, id_, seed)
    return out.withColumn("split", F.when(F.col("place") <= int(n * ratio), "train").otherwise("val"))


def shards(rows: DataFrame, id_: str, n: int) -> DataFrame:
    """Contiguous shards of the rows in order of id, the first (rows mod n) one larger."""
    out = number_in_order(rows.withColumn("__all", F.lit(0)), ["__all"], [id_], "place").drop("__all")
    base, rest = divmod(rows.count(), n)
    k = F.col("place") - 1
    big = (base + 1) * rest
    return out.withColumn("shard", F.when(k < big, F.floor(k / (base + 1))).otherwise(rest + F.floor((k - big) / max(base, 1))).cast("int"))


def upsert(cache: DataFrame | None, new: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The cache with new rows merged in: of every key the row with the latest ts, of equals the new one. Without a cache the new rows alone."""
    rows = new.withColumn("__new", F.lit(1))
    if cache is not None:
        rows = cache.select(new.columns).withColumn("__new", F.lit(0)).unionByName(rows)
    rest = [c for c in new.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, "__new", *[c for c in rest if c != ts])).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def weighted_mean(rows: DataFrame, keys: list[str], score: Column, weight: Column) -> DataFrame:
    """Mean of the known scores, weights renormalised over them; null where none is known or the weights are 0."""
    known = F.when(score.isNotNull(), weight)
    total = F.sum(known)
    return rows.groupBy(*keys).agg(F.when(total > 0, F.sum(score * known) / total).alias("score"), F.count(score).alias("n_known"))


def id_digest(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """A digest of each group's set of ids, whatever their order: sum and xor of hashes, and the number."""
    distinct = rows.select(*keys, id_).where(F.col(id_).isNotNull()).distinct()
    low = F.conv(F.substring(F.md5(F.col(id_).cast("string")), 1, 15), 16, 10).cast("long")
    return distinct.groupBy(*keys).agg(F.count("*").alias("n_ids"), F.bit_xor(low).alias("digest"))


def best_match(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, similarity: Column) -> DataFrame:
    """For each left row the most similar right row of its group, the smallest id among equals; without any likeness the group's first. (left_id, right_id, similarity)"""
    pairs = left.join(right, group).withColumn("__s", F.coalesce(similarity, F.lit(0.0)))
    best = pairs.groupBy(left_id).agg(F.max("__s").alias("similarity"), F.min_by(right_id, F.struct(-F.col("__s"), F.col(right_id))).alias(right_id))
    return best.select(left_id, right_id, "similarity")
