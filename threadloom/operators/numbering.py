"""Row numbers inside groups of any size, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.runtime import cut


#: Rows of one group that one task may sort.
GROUP = 200_000


def by_size(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of groups of at most so many rows, and those of larger groups; None where there are none. df is read several times."""
    if df.count() <= most:
        return df, None
    large = cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]), "large")
    if large.isEmpty():
        return df, None
    return df.join(large, _same(keys), "left_anti"), df.join(large, _same(keys), "left_semi")


def number_in_order(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no", most: int | None = None) -> DataFrame:
    """Adds `name`: 1, 2, ... within each group of equal keys, by rising `order` (nulls first).

    Groups of up to `most` rows are numbered by a window; only larger ones are spread over tasks (see number_large). Rows
    equal in keys and order get numbers in no defined order.
    """
    df = cut(df.drop(name), "to-number")
    small, large = by_size(df, keys, GROUP if most is None else most)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    parts = [small.withColumn(name, place)] if small is not None else []
    if large is not None:
        parts.append(number_large(large, keys, order, name))
    return reduce(DataFrame.union, parts)


def number_large(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The same for groups of any size, without bringing one into one task.

    Rows are range-partitioned and sorted by keys and order, so a large group lies in several neighbouring partitions.
    Each task counts within its partition; the driver learns two keys and a count per partition and works out by how
    much the first group of each partition is shifted.
    """
    spark = df.sparkSession
    df = df.drop("__pid", "__no", "__p", "__shift")
    by = [*keys, *order]
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__pid", F.spark_partition_id())
    schema = T.StructType([*parts.schema.fields, T.StructField("__no", T.LongType())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, 0
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            new[0] = True
            for k in keys:
                c = batch.column(k)
                differ = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
                nulls = c.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= differ | (nulls[1:] != nulls[:-1])
            start = np.flatnonzero(new)
            no = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n])) + 1
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            if first == last:
                no[: start[1] if len(start) > 1 else n] += so_far
            last, so_far = tuple(batch.column(k)[n - 1].as_py() for k in keys), int(no[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(no, pa.int64())], names=[*batch.schema.names, "__no"])

    counted = cut(parts.mapInArrow(count, schema), "counted")
    key = F.struct(*keys)
    ends = counted.groupBy("__pid").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("k"), "__no")).alias("last")).orderBy("__pid").collect()
    rows, before = [], None
    for e in ends:
        shift = before[1] if before and before[0] == e["first"] else 0
        if shift:
            rows.append((e["__pid"], *e["first"], shift))
        whole = e["last"]["k"]
        before = (whole, e["last"]["__no"] + (shift if whole == e["first"] else 0))
    if not rows:
        return counted.select(*df.columns, F.col("__no").alias(name))
    fields = [T.StructField("__pid", T.IntegerType()), *[T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("__shift", T.LongType())]
    shifts = F.broadcast(spark.createDataFrame(rows, T.StructType(fields)))  # at most one row per partition
    counted = counted.withColumnRenamed("__pid", "__p")
    joined = counted.join(shifts, (F.col("__p") == F.col("__pid")) & _same(keys), "left")
    return joined.select(*df.columns, (F.col("__no") + F.coalesce("__shift", F.lit(0))).alias(name))


def _same(keys: list[str]):
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return cond
