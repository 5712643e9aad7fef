"""Pages into chunks: blank lines first, sentences where a part is too long, packed greedily."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as X


def parts(text: Column, limit: int) -> Column:
    """array<struct<s, gap>>: what is packed, and how many characters its separator counts for."""
    entry = lambda gap: lambda s: F.struct(s.alias("s"), F.lit(gap).alias("gap"))
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: X.strip(p)), lambda p: p != "")
    sentences = lambda p: F.transform(F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: X.strip(s)), lambda s: s != ""), entry(1))
    return F.flatten(F.transform(blocks, lambda p: F.when(F.length(p) > limit, sentences(p)).otherwise(F.array(entry(2)(p)))))


def pack(text: Column, limit: int = 1400, least: int = 80) -> Column:
    """The chunks of a text, in order; those under `least` characters are dropped. Null and empty texts have none."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def add(acc: Column, x: Column) -> Column:
        n = F.length(x["s"])
        flush = (acc["size"] + n + x["gap"] > limit) & (acc["size"] > 0)
        joined = F.when(acc["size"] > 0, F.concat(acc["open"], F.lit(" "), x["s"])).otherwise(x["s"])
        return F.struct(
            F.when(flush, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(flush, x["s"]).otherwise(joined).alias("open"),
            F.when(flush, n).otherwise(acc["size"] + n + x["gap"]).alias("size"),
        )

    chunks = F.aggregate(parts(F.coalesce(text, F.lit("")), limit), start, add, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.filter(F.transform(chunks, lambda c: X.strip(c)), lambda c: F.length(c) >= least)
