"""Problem 8: containers of fixed capacity filled from optimal length buckets.

An item above the capacity is divided into full pieces and a rest; nothing else is. A histogram of all item lengths (one
count per length up to the capacity) goes to the driver, where dynamic programming chooses the bucket boundaries that
minimise padding. The same counts then give the batches: from the longest bucket down, items first go where they leave
the least room in containers already begun, and what is left opens batches of its own bucket, as many items as the token
budget takes. The plan speaks of buckets and of ranks in a bucket only and is as small as the histogram; the items are
ranked inside their buckets in parallel and each looks up its container.

Edges: items of no tokens take no room and are in no container; null ids are kept like others; equal items are told apart
by nothing and may swap places; without items or containers the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.numbering import number_in_order
from threadloom.runtime import cut

#: Buckets at most.
BUCKETS = 128


def boundaries(counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most `buckets` buckets with the least padding; counts[i] items have length i."""
    top = len(counts) - 1
    if top <= 0:
        return np.zeros(0, np.int64)
    ends = np.r_[0, np.flatnonzero(counts[1:]) + 1]  # lengths that occur
    cum = np.cumsum(counts)[ends] - counts[0]
    n = len(ends) - 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n <= buckets:
        return ends[1:]
    # all of (i, j] padded to ends[j]: the best i never falls as j grows, so the middle j halves the range of i for both sides
    best = np.r_[0, np.full(n, np.iinfo(np.int64).max // 2)]
    choice = []
    for _ in range(buckets):
        from_, total = np.zeros(n + 1, np.int64), best.copy()
        lo, hi, first, last = np.array([1]), np.array([n]), np.array([0]), np.array([n - 1])
        while len(lo):  # one level of the halving at a time
            mid = (lo + hi) // 2
            many = np.minimum(last, mid - 1) - first + 1
            at = np.cumsum(many) - many
            i = np.arange(many.sum()) - np.repeat(at - first, many)
            j = np.repeat(mid, many)
            cost = best[i] + ends[j] * (cum[j] - cum[i])
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, many))
            from_[mid], total[mid] = i[hit[np.searchsorted(hit, at)]], least
            lo, hi, first, last = np.r_[lo, mid + 1], np.r_[mid - 1, hi], np.r_[first, from_[mid]], np.r_[from_[mid], last]
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        choice.append(from_)
        best = np.r_[0, total[1:]]
    out, at = [], n
    for from_ in reversed(choice):
        if at == 0:
            break
        out.append(ends[at])
        at = from_[at]
    return np.array(out[::-1], dtype=np.int64)


def plan(numbers: np.ndarray, bounds: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(bucket, first rank, first container, items a container): where the items of each bucket go, ranks from 0."""
    out: list[tuple[int, int, int, int]] = []
    open_: list[list[int]] = []  # [room, first container, containers]
    new = 0
    for b in range(len(bounds) - 1, -1, -1):
        size, left, rank = int(bounds[b]), int(numbers[b]), 0
        begun = sorted(x for x in open_ if x[0] >= size)
        rest = [x for x in open_ if x[0] < size]
        for room, first, many in begun:
            each = room // size
            if not left:
                rest.append([room, first, many])
                continue
            used = min(many, -(-left // each))
            out.append((b, rank, first, each))
            put = min(left, used * each)
            full = put // each
            if full:
                rest.append([room - each * size, first, full])
            if full < used:
                rest.append([room - (put - full * each) * size, first + full, 1])
            if used < many:
                rest.append([room, first + used, many - used])
            left, rank = left - put, rank + put
        if left:
            each = capacity // size
            used = -(-left // each)
            out.append((b, rank, new, each))
            full = left // each
            if full:
                rest.append([capacity - each * size, new, full])
            if full < used:
                rest.append([capacity - (left - full * each) * size, new + full, 1])
            new += used
        # containers without room for any item need not be kept
        open_ = [x for x in rest if b == 0 or x[0] >= int(bounds[0])]
    return out


def items(sizes: DataFrame, capacities: dict[str, int], key: str) -> DataFrame:
    """sizes (key, tokens) to (kind, key, piece_no, tokens), pieces of oversized ones from 1."""
    caps = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("capacity")) for k, c in capacities.items()])
    each = sizes.where("tokens > 0").select(key, "tokens", F.explode(caps).alias("c")).select(key, "tokens", "c.kind", "c.capacity")
    pieces = F.ceil(F.col("tokens") / F.col("capacity"))
    out = each.select("kind", key, "tokens", "capacity", F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("piece_no"))
    return out.select("kind", key, F.col("piece_no").cast("int").alias("piece_no"), F.least("capacity", F.col("tokens") - (F.col("piece_no") - 1) * F.col("capacity")).alias("tokens"))


def fill(sizes: DataFrame, capacities: dict[str, int], key: str, buckets: int = BUCKETS) -> DataFrame:
    """(kind, container_no, key, piece_no, tokens): every item in one container of each kind."""
    spark = sizes.sparkSession
    capacities = {k: int(c) for k, c in capacities.items() if c and c > 0}
    if not capacities:
        return items(sizes, {"none": 1}, key).limit(0).select("kind", F.lit(0).cast("long").alias("container_no"), key, "piece_no", "tokens")
    all_ = cut(items(sizes, capacities, key), "items")
    found = all_.groupBy("kind", "tokens").count().toArrow()  # at most the sum of the capacities
    kinds, lengths, counts = (found.column(c).to_pylist() for c in ("kind", "tokens", "count"))
    bounds, plans = {}, {}
    for kind, capacity in capacities.items():
        hist = np.zeros(capacity + 1, np.int64)
        for k, n, c in zip(kinds, lengths, counts, strict=True):
            if k == kind:
                hist[n] = c
        hist = np.trim_zeros(hist, "b")
        bounds[kind] = boundaries(hist, buckets)
        of = np.searchsorted(bounds[kind], np.arange(len(hist)))
        numbers = np.bincount(of, weights=hist, minlength=len(bounds[kind])).astype(np.int64) if len(hist) else np.zeros(0, np.int64)
        plans[kind] = np.array(plan(numbers, bounds[kind], capacity), dtype=np.int64).reshape(-1, 4)
        plans[kind] = plans[kind][np.lexsort((plans[kind][:, 1], plans[kind][:, 0]))]
    shared = spark.sparkContext.broadcast((bounds, plans))
    id_kind = all_.schema[key].dataType.simpleString()

    def bucket(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kind, tokens = np.array(batch.column("kind").to_pylist(), dtype=object), batch.column("tokens").to_numpy()
            out = np.zeros(len(tokens), np.int32)
            for k, b in shared.value[0].items():
                at = kind == k
                out[at] = np.searchsorted(b, tokens[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "bucket"])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kind, b, rank = np.array(batch.column("kind").to_pylist(), dtype=object), batch.column("bucket").to_numpy().astype(np.int64), batch.column("rank").to_numpy() - 1
            out = np.zeros(len(rank), np.int64)
            for k, p in shared.value[1].items():
                at = np.flatnonzero(kind == k)
                if len(at):
                    big = int(max(p[:, 1].max(), rank[at].max())) + 1
                    row = np.searchsorted(p[:, 0] * big + p[:, 1], b[at] * big + rank[at], side="right") - 1
                    out[at] = p[row, 2] + (rank[at] - p[row, 1]) // p[row, 3]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(out), batch.column(key), batch.column("piece_no"), batch.column("tokens")], names=["kind", "container_no", key, "piece_no", "tokens"])

    bucketed = all_.mapInArrow(bucket, f"kind string, `{key}` {id_kind}, piece_no int, tokens long, bucket int").withColumn("__h", F.xxhash64(key, "piece_no"))
    ranked = number_in_order(bucketed, ["kind", "bucket"], ["__h", key, "piece_no"], "rank")
    return ranked.mapInArrow(place, f"kind string, container_no long, `{key}` {id_kind}, piece_no int, tokens long")
