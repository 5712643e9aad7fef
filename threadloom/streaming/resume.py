"""Append-and-skip-done as a stream: new files are processed once, keys already written are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.runtime import scratch_dir


def process_new(spark: SparkSession, source: DataFrame, target: str, key: str, step: Callable[[DataFrame], DataFrame], name: str) -> StreamingQuery:
    """Runs `step` over the rows of a streaming source whose key isn't in the target yet and appends the results.

    Each micro-batch drops repeated keys, takes out those done and appends; a batch run again after a failure finds its
    keys done. Progress lies in the shared folder. Ends when all that is there has been read.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select(key).distinct(), key, "left_anti")
        except Exception as e:  # the target doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        step(fresh).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", f"{scratch_dir(spark)}/stream-{name}").trigger(availableNow=True).start()


def windowed_counts(source: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key; later ones than the watermark allows are dropped."""
    return source.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
