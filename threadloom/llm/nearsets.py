"""Distinct-word sets as sequences of word pairs, shared by the near-copy operators.

Put every set of words in alphabetical order. Let U be the size of the union of two sets that are near (share at least
0.7 U words) and put the union in that order. At most 0.3 U words are not shared, so they cut the shared ones into at
most 0.3 U + 1 runs, and at least 0.7 U - (0.3 U + 1) = 0.4 U - 1 pairs of neighbours are neighbours in *both* sets. Two
near texts thus have at least T = ceil(0.4 n - 1) such pairs in common, n the size of the larger set, whatever was
inserted, deleted or put in another order; and a pair of words is rarer than its words.

Pairs have a global order of their own: rising product of the two words' counts in a histogram over all texts, then
hash. By the usual argument on prefixes, c of T common pairs lie among the first n - 1 - (T - c) pairs of each set, so
only those are looked up; the T - c last ones, the long lists, are probed.

Beside the pairs goes a parity sketch of the set: 120 bits, each the parity of the number of words that hash to it, and
eight bits of n. The sketches of two sets differ in no more bits than the sets differ in words, so too many differing
bits rule a pair out without its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import text as X

#: Buckets of the global word histogram: the driver gets at most this many counts whatever the size of the corpus.
BUCKETS = 1 << 16
THRESHOLD = 0.7
SKETCH_BITS = 120


@F.arrow_udf(T.StructType([T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())]))
def _sketch(hashes: pa.Array) -> pa.Array:
    """Parities of the bits of the sketch, the size of the set in the top byte of s2."""
    values, lengths = flat(hashes)
    row = np.repeat(np.arange(len(lengths)), lengths)
    number = np.bincount(row * SKETCH_BITS + values % SKETCH_BITS, minlength=len(lengths) * SKETCH_BITS).reshape(-1, SKETCH_BITS)
    bits = np.zeros((len(lengths), 128), np.uint8)
    bits[:, :SKETCH_BITS] = number & 1
    s = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    s2 = s[:, 1] | np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
    return pa.StructArray.from_arrays([pa.array(s[:, 0].view(np.int64)), pa.array(s2.view(np.int64))], names=["s1", "s2"])


def word_hashes(words: Column, scopes: list[Column]) -> Column:
    """64 bits of each word; equal words of different scopes differ."""
    return F.transform(words, lambda w: F.xxhash64(*scopes, w))


def with_sets(df: DataFrame, text: str, scope: list[str]) -> DataFrame:
    """Adds __n (distinct words), __h (their hashes, in the words' order), __s1 and __s2 (the sketch, n in the top byte of __s2) and __cid; (__s1, __s2, __cid) is the class of the set."""
    df = df.withColumn("__set", X.word_set(F.coalesce(F.col(text), F.lit(""))))
    scopes = [F.col(c).cast("string") for c in scope]
    df = df.withColumns({"__n": F.size("__set"), "__h": word_hashes(F.col("__set"), scopes), "__cid": F.xxhash64(*scopes, F.concat_ws(" ", "__set"))}).drop("__set")
    return df.withColumn("__s", _sketch("__h")).withColumns({"__s1": F.col("__s.s1"), "__s2": F.col("__s.s2")}).drop("__s")


def histogram(df: DataFrame) -> np.ndarray:
    """Counts of the words of all rows, by hash bucket; a table of fixed size."""
    rows = df.select(F.explode("__h").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("b")).count().toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows.column("b").to_numpy()] = rows.column("count").to_numpy()
    return out


def least_common(n: np.ndarray) -> np.ndarray:
    """T: the least number of neighbouring pairs that near sets have in common, the larger of n words."""
    return np.maximum(1, np.ceil(0.4 * n - 1 - 1e-9)).astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit token for a pair of neighbours; the lowest bit is 0."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C159E3779B9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x & ~np.uint64(1)).view(np.int64)


def word_pairs(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of neighbours, row by row: token, row, place, key of the global order, and in how many texts the pair can be at most."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    here = np.flatnonzero(row[1:] == row[:-1])
    place = here - starts(lengths)[row[here]]
    count = np.maximum(counts[values % BUCKETS], 1)
    token = mix(values[here], values[here + 1])
    weight = (np.log2(count[here] * count[here + 1].astype(np.float64)) * 256).astype(np.uint64)
    key = weight << np.uint64(48) | token.view(np.uint64) >> np.uint64(16)
    return token, row[here], place, key, np.minimum(count[here], count[here + 1])


def ranks(key: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the pairs of each row in the global order, from 0."""
    pairs = np.maximum(lengths - 1, 0)
    place, most = np.arange(len(row)) - np.repeat(starts(pairs), pairs), int(pairs.max(initial=0))
    if most * len(pairs) <= 4 * len(row):  # rows of about one length are sorted as a matrix; what fills it up comes last
        table = np.full((len(pairs), most), np.iinfo(np.uint64).max)
        table[row, place] = key
        at = np.empty(table.shape, np.int64)
        np.put_along_axis(at, np.argsort(table, axis=1, kind="stable"), np.arange(most)[None], axis=1)
        return at[row, place]
    out = np.empty(len(row), np.int64)
    out[np.lexsort((key, row))] = place
    return out


def short_lists(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of each row that must be looked up for one common pair (c = 1): row and place of the pair in the row."""
    _, row, place, key, _ = word_pairs(values, lengths, counts)
    short = ranks(key, row, lengths) < (lengths - least_common(lengths))[row]
    return row[short], place[short]


def probe(values: np.ndarray, lengths: np.ndarray, asked: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the asked values are in the list of their row; by binary search, lists rise as unsigned numbers."""
    start = starts(lengths)
    lo, hi = start[row], start[row] + lengths[row]
    values, asked = values.view(np.uint64), asked.view(np.uint64)
    end = hi.copy()
    for _ in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        mid = (lo + hi) >> 1
        less = (mid < end) & (values[np.minimum(mid, len(values) - 1)] < asked)
        open_ = lo < hi
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return (lo < end) & (values[np.minimum(lo, len(values) - 1)] == asked) if len(values) else np.zeros(len(asked), bool)


def may_be_near(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray, threshold: float) -> np.ndarray:
    """False where sketches or sizes rule a pair out."""
    na, nb = (a2.view(np.uint64) >> np.uint64(56)).astype(np.int64), (b2.view(np.uint64) >> np.uint64(56)).astype(np.int64)
    apart = np.bitwise_count((a1 ^ b1).view(np.uint64)).astype(np.int64) + np.bitwise_count((a2 ^ b2).view(np.uint64) << np.uint64(8))
    small = (apart * (1 + threshold) <= (1 - threshold) * (na + nb) + 1e-9) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
    return small | (na == 255) | (nb == 255)


def batches(out: dict[str, np.ndarray], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(out.values())))
    for i in range(0, n, size):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + size]) for k, v in out.items()})


def near(common: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether so many common words make two sets near; whole numbers, no rounding."""
    return common * 1000 >= round(threshold * 1000) * (na + nb - common)


def checked(threshold: float) -> float:
    if threshold < THRESHOLD:
        raise ValueError(f"the bound on common pairs holds from {THRESHOLD} on")
    return threshold


def shards(size: int, per: int) -> int:
    return max(1, math.ceil(size / per))
