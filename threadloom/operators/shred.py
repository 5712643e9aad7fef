"""Problem 4: deeply nested records as flat tables, by columnar shredding.

Every leaf path of a nested column becomes a sequence of (r, d, v): v is the value, r the repetition level (0: a new record,
k: another entry of the k-th list on the path) and d the definition level (how much of the path is present). Each optional
field, list and struct counts one level, and so does the slot of a list entry. The sequences alone say where lists begin,
which are null, which are empty and which entries are null, so that a table per repeated ancestor is rebuilt from them:
an entry of the ancestor exists where d reaches its slot, and its place is the number of entries since r fell below it.

Null lists and empty lists give no rows, null entries give a row of nulls that keeps its place. Maps and variants are leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]  # list entries are named "*"
    kind: T.DataType
    slot: int  # definition level from which on an entry of the innermost list exists
    column: Column

    @property
    def depth(self) -> int:
        return self.path.count("*")

    @property
    def ancestor(self) -> tuple[str, ...]:
        """Path of the innermost list; () for leaves outside lists."""
        at = [i for i, p in enumerate(self.path) if p == "*"]
        return self.path[: at[-1]] if at else ()


def leaves(column: Column, kind: T.DataType, path: tuple[str, ...]) -> list[Leaf]:
    """The leaf paths below a column, each with its sequence of levels as array<struct<r, d, v>>."""

    def entry(r: Column, d: int, v: Column) -> Column:
        return F.array(F.struct(r.alias("r"), F.lit(d).alias("d"), v.alias("v")))

    def build(at: T.DataType, rest: tuple[str, ...], d: int, rep: int, leaf: T.DataType, c: Column, r: Column) -> Column:
        none = lambda level: entry(r, level, F.lit(None).cast(leaf))
        if not rest:
            return F.when(c.isNull(), none(d)).otherwise(entry(r, d + 1, c))
        if isinstance(at, T.ArrayType):
            inner = F.flatten(F.transform(c, lambda x, i: build(at.elementType, rest[1:], d + 2, rep + 1, leaf, x, F.when(i == 0, r).otherwise(F.lit(rep + 1)))))
            return F.when(c.isNull(), none(d)).when(F.size(c) == 0, none(d + 1)).otherwise(inner)
        return F.when(c.isNull(), none(d)).otherwise(build(at[rest[0]].dataType, rest[1:], d + 1, rep, leaf, c[rest[0]], r))

    def paths(at: T.DataType, so_far: tuple[str, ...], d: int, slot: int) -> list[tuple[tuple[str, ...], T.DataType, int]]:
        if isinstance(at, T.ArrayType):
            return paths(at.elementType, (*so_far, "*"), d + 2, d + 2)
        if isinstance(at, T.StructType):
            return [x for f in at.fields for x in paths(f.dataType, (*so_far, f.name), d + 1, slot)]
        return [(so_far, at, slot)]

    return [Leaf((*path, *rest), leaf, slot, build(kind, rest, 0, 0, leaf, column, F.lit(0))) for rest, leaf, slot in paths(kind, (), 0, 0)]


def shred(df: DataFrame, columns: list[str]) -> list[Leaf]:
    return [leaf for c in columns for leaf in leaves(F.col(c), df.schema[c].dataType, (c,))]


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _places(depth: pa.Array, levels: pa.Array) -> pa.Array:
    """For each entry its places in the lists on its path, from the repetition levels; one pass over all rows, each begins with level 0."""
    n = depth[0].as_py() if len(depth) else 1
    r = levels.flatten().to_numpy(zero_copy_only=False)
    places = np.empty((len(r), n), np.int32)
    for k in range(1, n + 1):
        count = np.cumsum(r <= k)  # an entry of list k begins; below k its parent does
        places[:, k - 1] = count - np.maximum.accumulate(np.where(r < k, count, 0)) + 1
    entries = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * n, pa.int32()), pa.array(places.ravel()))
    ends = np.cumsum(levels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), entries)


def tables(df: DataFrame, keys: list[str], columns: list[str]) -> dict[str, DataFrame]:
    """One table per list path below the columns, and "" for what lies outside lists.

    Rows hold the keys, item_no (for lists in lists item_no_1, item_no_2, ...; from 1) and the leaf values under their
    dotted names below the list; a list of plain values has them as `value`. Name clashes get the full dotted path.
    """
    found = shred(df, columns)
    out: dict[str, DataFrame] = {}
    for ancestor in dict.fromkeys(leaf.ancestor for leaf in found):
        own = [leaf for leaf in found if leaf.ancestor == ancestor]
        depth = own[0].depth
        short = [".".join(p for p in leaf.path[len(ancestor) + bool(depth) :] if p != "*") or "value" for leaf in own]
        reserved = {*keys, "item_no", *(f"item_no_{i}" for i in range(1, depth + 1))}
        names = [".".join(leaf.path) if n in reserved or short.count(n) > 1 else n for leaf, n in zip(own, short, strict=True)]
        if not depth:
            out[""] = df.select(*keys, *[leaf.column[0]["v"].alias(n) for leaf, n in zip(own, names, strict=True)])
            continue
        levels = df.select(*keys, *[leaf.column.alias(f"__{i}") for i, leaf in enumerate(own)])
        values = F.arrays_zip(*[F.col(f"__{i}") for i in range(len(own))])
        with_places = levels.withColumn("__p", _places(F.lit(depth), F.transform("__0", lambda x: x["r"])))
        flat = with_places.select(*keys, F.explode(F.arrays_zip(values.alias("x"), F.col("__p").alias("p"))).alias("__y")).select(*keys, F.col("__y.x").alias("__x"), F.col("__y.p").alias("__places"))
        places = [F.col("__places")[i].alias(f"item_no_{i + 1}" if depth > 1 else "item_no") for i in range(depth)]
        out[".".join(p for p in ancestor if p != "*")] = flat.where(F.col("__x")["__0"]["d"] >= own[0].slot).select(
            *keys, *places, *[F.col("__x")[f"__{i}"]["v"].alias(n) for i, n in enumerate(names)]
        )
    return out
