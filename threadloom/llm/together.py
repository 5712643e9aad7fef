"""Problem 7: splits that keep related records together: a spanning forest by contraction, its trees dealt to the splits.

Entities (papers) are nodes; those that share a key (an author) are joined by a star around the smallest of them, so a key
of any size gives as many edges as it has entities. Each round every component picks its least edge (edges have a total
order, so the picks form trees), the trees are contracted by pointer doubling, and what then lies inside a component is
dropped; components at least halve in number. The picked edges are written down: they are a spanning forest, kept for good
where a path is given.

Dealing: groups are put into bands by the size of their group (powers of two). From the largest band down, each band gives
so many groups to val and test that their totals follow the wanted shares, and within a band those are spread evenly by
the hash of the group. A band gives a split another group only where at least half of it is still wanted, so a group much
larger than the share of val or test goes to train.

Edges: null entities and keys link nothing; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.numbering import number_in_order
from threadloom.runtime import cut


def star_edges(pairs: DataFrame) -> DataFrame:
    """pairs (node, key) to edges (a, b) between nodes of one key."""
    pairs = pairs.where("node is not null and key is not null").select("node", "key").distinct()
    hub = pairs.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(hub, "key").where("node != a").select("a", F.col("node").alias("b")).distinct()


def spanning_forest(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node) and edges (a, b). Returns labels (node, root) of all nodes and the forest (a, b); both are tables.

    With a path the forest is written there and stays: later runs can add edges to it instead of to all old ones.
    """
    labels = cut(nodes.where("node is not null").distinct().select("node", F.col("node").alias("root")), "labels")
    weight = F.struct(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    edges = cut(edges.where("a != b").select("a", "b", weight.alias("w")), "edges")
    forest = [edges.select(F.col("w.x").alias("a"), F.col("w.y").alias("b")).limit(0)]
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a", "w"))
        picks = cut(both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.w").alias("w")), "picks")
        forest.append(picks.select(F.col("w.x").alias("a"), F.col("w.y").alias("b")).distinct())
        back = picks.select(F.col("a").alias("b"), F.col("b").alias("back"))
        # of two that picked each other the smaller is the root
        up = picks.join(back, "b", "left").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up"))
        up = cut(up, "up")
        while True:
            above = up.select(F.col("a").alias("up"), F.col("up").alias("above"))
            jumped = cut(up.join(above, "up").select("a", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved")), "up")
            up = jumped.select("a", "up")
            if jumped.where("moved").isEmpty():
                break
        name = lambda df, c: df.join(up.select(F.col("a").alias(c), F.col("up").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        labels = cut(name(labels, "root"), "labels")
        left = name(name(edges, "a"), "b").where("a != b")
        edges = cut(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")), "edges")
    trees = reduce(DataFrame.union, forest)
    if path:
        trees.write.mode("overwrite").parquet(path)
        trees = labels.sparkSession.read.parquet(path)
    return labels.select("node", "root"), trees


def quotas(bands: list[tuple[int, int, int]], shares: dict[str, float]) -> list[tuple[int, int, int, int]]:
    """bands (band, groups, records) from the largest down; returns (band, groups, groups for val, groups for test)."""
    out, seen, have = [], 0, {"val": 0.0, "test": 0.0}
    for band, groups, records in bands:
        seen += records
        mean, take, left = records / groups, {}, groups
        for split in ("val", "test"):
            want = (shares[split] * seen - have[split]) / mean
            take[split] = max(0, min(int(want + 0.5), left))
            left -= take[split]
            have[split] += take[split] * mean
        out.append((band, groups, take["val"], take["test"]))
    return out


def deal(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """groups (group_id, size) with a split for each."""
    banded = cut(groups.select("group_id", "size").withColumn("band", F.floor(F.log2("size")).cast("int")), "banded")
    found = [tuple(r) for r in banded.groupBy("band").agg(F.count("*"), F.sum("size")).orderBy(F.desc("band")).collect()]  # at most 64 rows
    plan = quotas(found, shares)
    spark = groups.sparkSession
    small = F.broadcast(spark.createDataFrame(plan, "band int, groups long, n_val long, n_test long"))
    ranked = number_in_order(banded.withColumn("__h", F.xxhash64("group_id")), ["band"], ["__h", "group_id"], "k").join(small, "band")
    step = lambda n, k: F.floor(k * F.col(n) / F.col("groups")) > F.floor((k - 1) * F.col(n) / F.col("groups"))
    apart = F.when(step("n_val", F.col("k")), "val")
    # test is dealt among what val leaves, so that both get their full number
    taken = F.floor(F.col("k") * F.col("n_val") / F.col("groups"))
    rest = F.col("k") - taken
    left = F.greatest(F.col("groups") - F.col("n_val"), F.lit(1))
    test = (F.floor(rest * F.col("n_test") / left) > F.floor((rest - 1) * F.col("n_test") / left)) & apart.isNull()
    return ranked.select("group_id", "size", F.coalesce(apart, F.when(test, "test"), F.lit("train")).alias("split"))
