"""Model calls behind a replaceable provider and a cache table keyed by the hash of the request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A provider maps batches of (cache_key, kind, prompt) to batches of (cache_key, text, error).
Provider = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ANSWER = "cache_key string, text string, error string"


def cache_key(kind: Column, prompt: Column, model: str) -> Column:
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), F.lit(model).alias("model"), prompt.alias("prompt"))), 256)


def stub(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers every prompt with a digit of its key, for tests."""
    for batch in it:
        keys = batch.column("cache_key").to_pylist()
        yield pa.RecordBatch.from_pydict({"cache_key": keys, "text": [str(int(k[:4], 16) % 5 + 1) for k in keys], "error": pa.nulls(len(keys), pa.string())})


def complete(requests: DataFrame, cache: DataFrame | None, model: str, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """requests (id, kind, prompt): (answers by id, new cache rows). Equal requests and cached ones aren't asked again; failed ones keep their error."""
    keyed = requests.withColumn("cache_key", cache_key(F.col("kind"), F.col("prompt"), model))
    asked = keyed.select("cache_key", "kind", "prompt").dropDuplicates(["cache_key"])
    if cache is not None:
        asked = asked.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    new = asked.mapInArrow(provider, ANSWER)
    known = new if cache is None else cache.select("cache_key", "text", "error").unionByName(new)
    return keyed.join(known, "cache_key", "left").select("id", "kind", "text", "error"), new


def retry(answers: DataFrame, score: str, threshold: float, again: DataFrame) -> DataFrame:
    """Rows below the threshold take the answer of the second pass if it is at least as sure."""
    second = again.select("id", F.col("text").alias("__text"), F.col(score).alias("__score"))
    better = (F.col(score) < threshold) & (F.col("__score") >= F.col(score))
    return answers.join(second, "id", "left").withColumns({"text": F.when(better, F.col("__text")).otherwise(F.col("text")), score: F.when(better, F.col("__score")).otherwise(F.col(score))}).drop("__text", "__score")
