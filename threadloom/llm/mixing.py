"""Problem 9: sources mixed to target shares by Poisson replication.

Every document has a number u in (0, 1) from a seeded hash of its id. At rate r it is used as often as the Poisson
distribution of mean r, inverted at u, says, and never more than its source allows. The rate is the target repetition rate
of its source and at most max_repeat, so every source, the scarcest too, is drawn at random. As u stays, uses only grow with
r, so a source's tokens are a rising function of r; it is tabulated for all rates of a fixed grid in one pass over all
documents (bounded by sources times grid), and each source takes the rate that comes closest to its share. The mixture may
be as large as the scarcest source at its highest rate allows. As whole documents are used, shares can be missed by part of a
long one: of SIZES sizes from half of that on the one that comes closest to all shares is taken, the largest of equals.

Edges: documents of no tokens, of null ids or of sources without a target are not used; sources without documents are left
out and the other shares stand as they are among themselves; a null max_repeat is 1; repeated rows are repeated items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X

#: Rates of the grid, evenly from 0 to the max_repeat of a source.
GRID = 16_384
#: Sizes of the mixture that are tried where no total is given.
SIZES = 1024


def source_name(c: Column) -> Column:
    """Plain name: trimmed, lower case, one underscore between words, without a plural s."""
    s = F.regexp_replace(F.lower(X.strip(c)), r"[\s_-]+", "_")
    return F.regexp_replace(s, r"([^s])s$", "$1")


def uniform(key: str, seed: int) -> Column:
    """In (0, 1), from the upper 52 bits of a seeded hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 12).cast("double") + 0.5) / float(1 << 52)


def cdf_table(most: int) -> np.ndarray:
    """[k, g]: chance of at most k uses at rate g of the grid of a source that may be used so often."""
    rate = np.linspace(0, most, GRID + 1)
    term = np.exp(-rate)
    rows = [term]
    for k in range(1, most):
        term = term * rate / k
        rows.append(rows[-1] + term)
    return np.stack(rows)


def first_rates(u: np.ndarray, most: int, table: np.ndarray) -> np.ndarray:
    """[k, document]: the first grid rate at which it is used more than k times; GRID + 1 is none."""
    # used more than k times at rate r iff u > P(at most k); that chance falls with r
    return np.stack([np.searchsorted(-table[k], -u, side="right") for k in range(most)]) if most else np.zeros((0, len(u)), np.int64)


def rates(at_rate: dict[str, np.ndarray], shares: dict[str, float], total: float | None = None) -> dict[str, int]:
    """The place on the grid for each source; at_rate: its tokens at every rate of the grid."""
    if not shares:
        return {}
    most = min(at_rate[s][-1] / share for s, share in shares.items())
    tried = np.array([min(total, most)]) if total else np.linspace(0.5, 1, SIZES) * most
    places = []
    for s, share in shares.items():
        above = np.minimum(np.searchsorted(at_rate[s], tried * share), GRID)
        below = np.maximum(above - 1, 0)
        places.append(np.where(at_rate[s][above] - tried * share < tried * share - at_rate[s][below], above, below))
    used = np.stack([at_rate[s][g] for s, g in zip(shares, places, strict=True)])
    off = np.abs(used / np.maximum(used.sum(0), 1) - np.array(list(shares.values()))[:, None]).max(0)
    best = np.flatnonzero(off <= off.min() + 1e-4)[-1]
    return {s: int(g[best]) for s, g in zip(shares, places, strict=True)}


def mix(sizes: DataFrame, targets: DataFrame, key: str, seed: int = 17, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """sizes (key, source, tokens), targets (source, target_share, max_repeat): (mixture, report).

    mixture: (position_key, key, copy_no, source, tokens), shuffled globally: partitions by range of a hash, sorted in it.
    report: per target source its target, what was there and what is used, and the actual share.
    """
    spark = sizes.sparkSession
    wanted = [(source, float(share), int(most or 1)) for source, share, most in targets.select("source", "target_share", "max_repeat").where("source is not null and target_share > 0").dropDuplicates(["source"]).collect()]
    known = sizes.where((F.col("tokens") > 0) & F.col(key).isNotNull()).withColumn("source", source_name(F.col("source"))).where(F.col("source").isin([s for s, *_ in wanted]))
    known = known.select(key, "source", "tokens", uniform(key, seed).alias("u"))
    limits = {s: most for s, _, most in wanted}
    table = spark.sparkContext.broadcast((limits, {m: cdf_table(m) for m in set(limits.values())}))

    def tabulate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            source, tokens, u = np.array(batch.column("source").to_pylist(), dtype=object), batch.column("tokens").to_numpy(), batch.column("u").to_numpy()
            for s, most in table.value[0].items():
                at = source == s
                if at.any():
                    g = first_rates(u[at], most, table.value[1][most]).ravel()
                    n = np.bincount(g, weights=np.tile(tokens[at], most), minlength=GRID + 2)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"source": [s] * len(some), "g": pa.array(some, pa.int32()), "n": pa.array(n[some].astype(np.int64))})

    steps = known.mapInArrow(tabulate, "source string, g int, n long").groupBy("source", "g").agg(F.sum("n").alias("n")).toArrow()
    at_rate = {s: np.zeros(GRID + 2) for s in limits}
    for s, g, n in zip(*(steps.column(c).to_pylist() for c in ("source", "g", "n")), strict=True):
        at_rate[s][g] = n
    at_rate = {s: np.cumsum(x[:-1]) for s, x in at_rate.items() if x[:-1].any()}
    shares = {s: share for s, share, _ in wanted if s in at_rate}
    chosen = spark.sparkContext.broadcast(rates(at_rate, {s: x / sum(shares.values()) for s, x in shares.items()}, total))
    id_kind = known.schema[key].dataType.simpleString()

    def replicate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            source, u = np.array(batch.column("source").to_pylist(), dtype=object), batch.column("u").to_numpy()
            uses = np.zeros(len(u), np.int32)
            for s, g in chosen.value.items():
                at = np.flatnonzero(source == s)
                if len(at):
                    uses[at] = (first_rates(u[at], m := table.value[0][s], table.value[1][m]) <= g).sum(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, "source", "tokens")], pa.array(uses)], names=[key, "source", "tokens", "uses"])

    used = known.mapInArrow(replicate, f"`{key}` {id_kind}, source string, tokens long, uses int")
    copies = used.where("uses > 0").select(key, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"))
    mixture = copies.select(F.xxhash64(F.lit(seed + 1), key, "copy_no").alias("position_key"), key, "copy_no", "source", "tokens").repartitionByRange("position_key", key, "copy_no").sortWithinPartitions("position_key", key, "copy_no")
    asked = F.broadcast(spark.createDataFrame([(s, share, most) for s, share, most in wanted], "source string, target_share double, max_repeat int"))
    sums = used.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").alias("copies"), F.max("uses").alias("most_uses"))
    report = asked.join(sums, "source", "left").fillna(0, ["available_tokens", "used_tokens", "copies", "most_uses"])
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    report = report.select("source", "target_share", "max_repeat", "available_tokens", "used_tokens", "copies", "most_uses", (F.col("used_tokens") / F.greatest(all_used, F.lit(1))).alias("actual_share"))
    return mixture, report
