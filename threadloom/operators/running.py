"""Running sums over groups of any size: blocks first, then the blocks' own sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group that one window sees.
BLOCK = 4096


def running_sum(df: DataFrame, key: str, index: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds the sum of each value over the rows of the group up to and with this one; index counts the group's rows without gaps."""
    df = df.withColumns(values).withColumn("__b", F.floor(F.col(index) / block))
    sums = df.groupBy(key, "__b").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "__b", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(key, "__b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({v: F.sum(v).over(inside) for v in values})
    return local.join(offsets, [key, "__b"]).withColumns({v: F.col(v) + F.col(f"__{v}") for v in values}).drop("__b", *[f"__{v}" for v in values])


def previous(df: DataFrame, key: str, index: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns of the row before (name to source), null for the first; a join on the index, so no window over the group."""
    before = df.select(key, (F.col(index) + 1).alias(index), *[F.col(src).alias(name) for name, src in columns.items()])
    return df.join(before, [key, index], "left")
