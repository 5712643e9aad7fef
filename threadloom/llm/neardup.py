"""Problem 2: near-duplicate records with small edits, by a T-occurrence search in the manner of DivideSkip.

The inverted lists are those of the neighbouring word pairs (see nearsets). A text of n distinct words is in n - 1 of them
and shares at least T with a near one. Of its lists the longest T - c are set aside. The short ones are merged: Spark
shuffles (pair, sketch) by pair and merges sorted runs, one pass over them counts for every two texts in how many short
lists both stand, and sketches keep those apart at once that can't be near. Who has at least c occurrences is a candidate;
whether it also stands in the long lists is asked of its own sorted pairs by binary search (a long list itself is never
built, so none lies in one place), and only candidates that reach T occurrences in all are compared word by word.

c is 1. A text whose short lists hold frequent pairs (both words in more than a FREQUENT part of all word places) takes
c = 2 and is listed under every two of its frequent pairs instead of each: two near texts without a rare pair in common
have two frequent ones in common. Frequent lists are never formed, so no key holds a fixed share of the rows.

Behaviour at the edges: null and empty texts and those under min_words belong to no pair; of repeated rows of a key the
one with the latest ts counts; texts with the same set of words form one class, which is searched once; a run of more
than BLOCK texts is ordered by size and searched block against block in separate tasks, only where sizes allow a link;
empty tables give an empty result; columns of the input other than those named are ignored. TILE, BLOCK, WIDE, HELD and
STEP choose the route, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.llm import nearsets as N
from threadloom.runtime import cut

#: Texts of one run that are paired inside one task.
BLOCK = 8192
#: Texts in a block of a longer run.
WIDE = 32_768
#: Pairs that are looked at in one step.
STEP = 1 << 18
#: Rows that a task takes up at once.
HELD = 500_000
#: Runs of more texts are compared as matrices.
TILE = 48
#: Rows of a matrix at most, and about how many cells it has.
ROWS, CELLS = 128, 1 << 15
#: A pair is frequent if both its words have more than this part of all word places (and more than BLOCK).
FREQUENT = 1 / 400
#: Up to so many words two near texts may have one pair in common only (T = 1).
ONE_PAIR = 5
POSTING = "token long, s1 long, s2 long"


def looked_up(pairs: tuple[np.ndarray, ...], lengths: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of some rows: which are in short lists, which are frequent, and for each row the key of its last short list."""
    _, row, _, key, most = pairs
    rank, t = N.ranks(key, row, lengths), N.least_common(lengths)
    frequent = most > limit
    number = lengths - t
    two = np.zeros(len(lengths), bool)
    two[row[frequent & (rank < number[row])]] = True
    number = np.minimum(number + two, np.maximum(lengths - 1, 0))
    last = np.zeros(len(lengths), np.uint64)
    at = rank == number[row] - 1
    last[row[at]] = key[at]
    return rank < number[row], frequent, last


def frequent_limit(counts: np.ndarray) -> float:
    return max(float(BLOCK), counts.sum() * FREQUENT)


def postings(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, sketch) of the short lists of each row; copies of a set count once in a map task. Tokens of two frequent pairs are odd."""
    shared = df.sparkSession.sparkContext.broadcast((counts, frequent_limit(counts)))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            new = []
            for i, c in enumerate(batch.column("__cid").to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            values, lengths = N.flat(batch.column("__h"))
            pairs = N.word_pairs(values, lengths, shared.value[0])
            token, row = pairs[0], pairs[1]
            short, frequent, _ = looked_up(pairs, lengths, shared.value[1])
            own = short & (~frequent | (lengths[row] <= ONE_PAIR))
            often = np.flatnonzero(short & frequent)
            often = often[np.lexsort((token[often], row[often]))]
            sizes = np.bincount(row[often], minlength=len(lengths))
            i, j = next(couples(N.starts(sizes), sizes, len(often) ** 2 + 1), (often[:0], often[:0]))
            two = N.mix(token[often][i], token[often][j]) | 1
            token, row = np.r_[token[own], two], np.r_[row[own], row[often][i]]
            if len(token):
                yield from N.batches({"token": token, "s1": batch.column("__s1").to_numpy()[row], "s2": batch.column("__s2").to_numpy()[row]})

    return df.select("__cid", "__h", "__s1", "__s2").mapInArrow(emit, POSTING)


def couples(starts: np.ndarray, sizes: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j of each run, in steps: member i of a run meets the members after it."""
    after = np.repeat(starts + sizes, sizes) - 1
    member = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(N.starts(sizes), sizes)
    later = after - member
    at, total = 0, np.cumsum(later)
    while at < len(member):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        n = later[at:to]
        i = np.repeat(member[at:to], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(N.starts(n), n)
        at = to


def tile(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray, same: bool, threshold: float) -> Iterator[list[np.ndarray]]:
    """Pairs of x and y that may be near, in steps; same: x is y, each pair once.

    Both sides are put in order of size, so that a row meets only those of a size that allows a link. Whole sketches are
    compared for tiles, in whole bits with each side's share rounded up; only what passes there is looked at in full.
    """
    share = (1 - threshold) / (1 + threshold)
    size = lambda s2: (s2.view(np.uint64) >> np.uint64(56)).astype(np.int64)
    by_size = lambda s1, s2: (lambda at: (s1[at], s2[at]))(np.argsort(size(s2), kind="stable"))
    room = lambda n: np.where(n == 255, 120, np.ceil(n * share + 1e-9)).astype(np.uint8)
    x1, x2 = by_size(x1, x2)
    y1, y2 = (x1, x2) if same else by_size(y1, y2)
    nx, ny = size(x2), size(y2)
    rx, ry = room(nx), room(ny)
    (u1, u2), (v1, v2) = ((s1.view(np.uint64), s2.view(np.uint64) << np.uint64(8)) for s1, s2 in ((x1, x2), (y1, y2)))
    # 255 stands for any size from there on: those meet all
    low = np.where(nx == 255, 0, np.searchsorted(ny, threshold * nx - 1e-9))
    high = np.where(nx == 255, len(ny), np.searchsorted(ny, nx / threshold + 2e-9, side="right"))
    long_ = int(np.searchsorted(ny, 255))
    s = 0
    while s < len(x1):
        e = min(len(x1), s + max(1, min(ROWS, CELLS // max(1, int(high[s] - low[s])))))
        from_, to = max(int(low[s:e].min()), s if same else 0), int(high[e - 1])
        at = np.r_[from_:to, max(to, long_) : len(ny)]
        apart = np.bitwise_count(u1[s:e, None] ^ v1[None, at])
        apart += np.bitwise_count(u2[s:e, None] ^ v2[None, at])
        i, j = np.divmod(np.flatnonzero(apart <= rx[s:e, None] + ry[None, at]), max(1, len(at)))
        i, j = i + s, at[j]
        if same:
            once = j > i
            i, j = i[once], j[once]
        near = N.may_be_near(x1[i], x2[i], y1[j], y2[j], threshold)
        i, j = i[near], j[near]
        yield ordered(x1[i], x2[i], y1[j], y2[j])
        s = e


def ordered(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> list[np.ndarray]:
    swap = (x1 > y1) | ((x1 == y1) & (x2 > y2))
    return [np.where(swap, y1, x1), np.where(swap, y2, x2), np.where(swap, x1, y1), np.where(swap, x2, y2)]


def occurrences(token: np.ndarray) -> np.ndarray:
    """A list of a pair counts as one occurrence, one of two frequent pairs as none: those are probed."""
    return (token & 1) ^ 1


def merge_runs(threshold: float):
    """Over sorted rows: pairs of each run with their occurrences; of a long run its members, with the number of their block."""

    def distinct(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Rows in one piece, of equal neighbours one."""
        t, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        new = np.r_[True, (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(t) else np.zeros(0, bool)
        return [t[new], a[new], b[new]]

    def members(t: np.ndarray, a: np.ndarray, b: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        """Rows of one long run, in blocks numbered from `first`."""
        yield from N.batches({"a1": a, "a2": b, "b1": a, "b2": b, "n": t, "token": t, "block": first + np.arange(len(t)) // WIDE})

    def emit(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs that are no part of a long one begun before."""
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(t)])
        some = (sizes > 1) & (sizes <= TILE)
        found = []
        for i, j in couples(starts[some], sizes[some], STEP):
            near = N.may_be_near(a[i], b[i], a[j], b[j], threshold)
            i, j = i[near], j[near]
            found.append([*ordered(a[i], b[i], a[j], b[j]), occurrences(t[i])])
        for s, k in zip(starts[(sizes > TILE) & (sizes <= BLOCK)], sizes[(sizes > TILE) & (sizes <= BLOCK)], strict=True):
            found += [[*x, np.repeat(occurrences(t[s : s + 1]), len(x[0]))] for x in tile(a[s : s + k], b[s : s + k], a[s : s + k], b[s : s + k], True, threshold)]
        if found:
            x, at = np.unique(np.stack([np.concatenate(p) for p in list(zip(*found, strict=True))[:4]], 1), axis=0, return_inverse=True)
            n = np.bincount(at.ravel(), weights=np.concatenate([f[4] for f in found]), minlength=len(x)).astype(np.int64)
            k = np.zeros(len(x), np.int64)
            yield from N.batches({"a1": x[:, 0], "a2": x[:, 1], "b1": x[:, 2], "b2": x[:, 3], "n": n, "token": k, "block": k - 1})
        for s, k in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK], strict=True):
            yield from members(t[s : s + k], a[s : s + k], b[s : s + k], 0)

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        long_token, blocks = None, 0  # the long run whose first blocks are out already

        def whole(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = int(np.searchsorted(t, long_token, side="right")) if long_token is not None and len(t) and t[0] == long_token else 0
            yield from members(t[:own], a[:own], b[:own], blocks)
            yield from emit(t[own:], a[own:], b[own:])

        for batch in it:
            held.append([batch.column(c).to_numpy() for c in ("token", "s1", "s2")])
            size += len(batch)
            if size < HELD:
                continue
            t, a, b = distinct(held)
            last = int(np.searchsorted(t, t[-1]))  # the last run may go on
            yield from whole(t[:last], a[:last], b[:last])
            t, a, b = t[last:], a[last:], b[last:]
            if t[0] != long_token:
                long_token, blocks = None, 0
            if len(t) > max(BLOCK, WIDE):  # of a long run only less than a block is kept
                out = len(t) // WIDE * WIDE
                yield from members(t[:out], a[:out], b[:out], blocks)
                long_token, blocks = int(t[0]), blocks + out // WIDE
                t, a, b = t[out:], a[out:], b[out:]
            held, size = [[t, a, b]], len(t)
        if held:
            yield from whole(*distinct(held))

    return over


def candidates(sets: DataFrame, counts: np.ndarray, threshold: float = N.THRESHOLD) -> DataFrame:
    """Pairs of sketches that meet in a short list (a1, a2, b1, b2), with the number n of lists of one pair in which they do."""
    lists = postings(sets, counts).repartition("token").sortWithinPartitions("token", "s2", "s1")
    kinds = "a1 long, a2 long, b1 long, b2 long, n long"
    met = cut(lists.mapInArrow(merge_runs(threshold), f"{kinds}, token long, block long"), "met")

    def two_blocks(key: tuple, at: pa.Table) -> pa.Table:
        a, b, block = (at.column(c).to_numpy() for c in ("a1", "a2", "block"))
        p, q = block == key[1].as_py(), block == key[2].as_py()
        found = list(tile(a[p], b[p], a[q], b[q], key[1] == key[2], threshold))
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("a1", "a2", "b1", "b2", "n"), [*out, np.repeat(occurrences(np.array([key[0].as_py()])), len(out[0]))], strict=True)))

    in_runs = met.where("block >= 0").select("token", "a1", "a2", "block")
    size = F.shiftrightunsigned("a2", 56)
    blocks = in_runs.groupBy("token", "block").agg(F.min(size).alias("low"), F.max(size).alias("high"))
    other = blocks.select("token", F.col("block").alias("q"), F.col("low").alias("low_q"), F.col("high").alias("high_q"))
    fit = (F.col("high") >= threshold * F.col("low_q")) & (F.col("high_q") >= threshold * F.col("low")) | (F.greatest("high", "high_q") == 255)
    two = blocks.withColumnRenamed("block", "p").join(other, "token").where((F.col("p") <= F.col("q")) & fit)
    two = two.select("token", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    more = in_runs.join(two, ["token", "block"]).groupBy("token", "p", "q").applyInArrow(two_blocks, kinds)
    return met.where("block < 0").select("a1", "a2", "b1", "b2", "n").union(more).groupBy("a1", "a2", "b1", "b2").agg(F.sum("n").alias("n"))


def reaching(counts: Broadcast):
    """Over rows with the hashes ha, hb of the words of a and b, n of whose lists are met among the short ones: rows that reach T occurrences, without the hashes."""
    limit = frequent_limit(counts.value)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            (va, la), (vb, lb) = N.flat(batch.column("ha")), N.flat(batch.column("hb"))
            a, b = N.word_pairs(va, la, counts.value), N.word_pairs(vb, lb, counts.value)
            (_, frequent, last_a), (_, _, last_b) = looked_up(a, la, limit), looked_up(b, lb, limit)
            aside = np.flatnonzero((a[3] > np.minimum(last_a, last_b)[a[1]]) | frequent)
            lists = b[0][np.lexsort((b[0].view(np.uint64), b[1]))]
            found = N.probe(lists, np.maximum(lb - 1, 0), a[0][aside], a[1][aside])
            total = batch.column("n").to_numpy() + np.bincount(a[1][aside], weights=found, minlength=len(la))
            yield batch.drop_columns(["ha", "hb", "n"]).filter(pa.array(total >= N.least_common(np.maximum(la, lb))))

    return run


def check(pairs: DataFrame, classes: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """The near ones among all classes (scope, __s1, __s2, __cid, text) with the sketches (a1, a2) and (b1, b2), their __cid as a, b.

    First the long lists are probed; then whole texts are compared, in whole numbers. pairs needn't hold a sketch twice:
    classes of equal sketch and different __cid are compared as well.
    """
    side = lambda s: classes.select(F.col("__s1").alias(f"{s}1"), F.col("__s2").alias(f"{s}2"), F.col("__cid").alias(s), F.col("scope").alias(f"scope_{s}"), F.col("text").alias(f"t{s}"))
    twins = classes.groupBy("__s1", "__s2").agg(F.count("*").alias("n")).where("n > 1")  # reads no texts
    twins = twins.select(F.col("__s1").alias("a1"), F.col("__s2").alias("a2"), F.col("__s1").alias("b1"), F.col("__s2").alias("b2"), F.lit(1 << 20).cast("long").alias("n"))
    pairs = pairs.where("not (a1 = b1 and a2 = b2)").union(twins)
    both = pairs.join(side("a"), ["a1", "a2"]).repartition("b1", "b2").join(side("b"), ["b1", "b2"]).where("scope_a = scope_b and (not (a1 = b1 and a2 = b2) or a < b)")
    both = both.select("a1", "a2", "a", "b1", "b2", "b", "n", "scope_a", X.word_set(F.col("ta")).alias("wa"), X.word_set(F.col("tb")).alias("wb"))
    hashes = lambda s: N.word_hashes(F.col(f"w{s}"), [F.col("scope_a")]).alias(f"h{s}")
    both = both.select("a1", "a2", "a", "b1", "b2", "b", "n", "wa", "wb", hashes("a"), hashes("b"))
    # a step of its own: as a filter, the words of each text would be found anew for every use of them
    both = both.mapInArrow(reaching(pairs.sparkSession.sparkContext.broadcast(counts)), "a1 long, a2 long, a long, b1 long, b2 long, b long, wa array<string>, wb array<string>")
    top, low = round(threshold * 1000), 1000
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(common * (low + top) >= top * (F.size("wa") + F.size("wb"))).select("a1", "a2", "a", "b1", "b2", "b")


def near_classes(items: DataFrame, min_words: int = 8, threshold: float = N.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """items: (scope, id, ts, text). Returns members (scope, id, s1, s2, c) and the pairs of near classes (a1, a2, a, b1, b2, b).

    Every valid row is a member of the class of its set of words; links between different sets are all in the pairs.
    """
    N.checked(threshold)
    sets = N.with_sets(items.select(F.col("scope").cast("string").alias("scope"), "id", "ts", "text"), "text", ["scope"])
    sets = cut(sets, "sets")
    valid = sets.where("id is not null").groupBy("scope", "id").agg(F.max(F.struct("ts", "__n", "__s1", "__s2", "__cid")).alias("v"))
    members = cut(valid.where(F.col("v.__n") >= min_words).select("scope", "id", F.col("v.__s1").alias("s1"), F.col("v.__s2").alias("s2"), F.col("v.__cid").alias("c")), "members")
    sets = sets.where(F.col("__n") >= min_words)
    counts = N.histogram(sets)
    # one text of each class, partitioned by sketch as the joins need it
    classes = sets.repartition("__s1", "__s2").groupBy("__s1", "__s2", "__cid").agg(F.min("scope").alias("scope"), F.min("text").alias("text"))
    return members, cut(check(candidates(sets, counts, threshold), classes, counts, threshold), "near")


def near_pairs(items: DataFrame, min_words: int = 8, threshold: float = N.THRESHOLD) -> DataFrame:
    """(scope, id_a, id_b), id_a < id_b: all pairs of valid rows of one scope whose texts are near."""
    members, links = near_classes(items, min_words, threshold)
    side = lambda s: members.select("scope", F.col("id").alias(f"id_{s}"), F.col("s1").alias(f"{s}1"), F.col("s2").alias(f"{s}2"), F.col("c").alias(s))
    across = links.join(side("a"), ["a1", "a2", "a"]).join(side("b"), ["b1", "b2", "b", "scope"])
    same = side("a").join(side("b").withColumnsRenamed({"b1": "a1", "b2": "a2", "b": "a"}), ["a1", "a2", "a", "scope"]).where("id_a < id_b")
    one = across.select("scope", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return one.union(same.select("scope", "id_a", "id_b"))


def near_links(items: DataFrame, min_words: int = 8, threshold: float = N.THRESHOLD) -> DataFrame:
    """(scope, id, class_id, n_links): one row per valid text, its class (smallest id of those with the same words) and how many others are near.

    Counts come from class sizes and links between classes; pairs of copies are never formed.
    """
    members, links = near_classes(items, min_words, threshold)
    key = ["s1", "s2", "c"]
    sizes = members.groupBy(*key).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    both = links.select(F.col("a1").alias("s1"), F.col("a2").alias("s2"), F.col("a").alias("c"), F.col("b1").alias("o1"), F.col("b2").alias("o2"), F.col("b").alias("o"))
    both = both.union(links.select("b1", "b2", "b", "a1", "a2", "a"))
    other = sizes.select(F.col("s1").alias("o1"), F.col("s2").alias("o2"), F.col("c").alias("o"), F.col("n").alias("m"))
    across = both.join(other, ["o1", "o2", "o"]).groupBy(*key).agg(F.sum("m").alias("m"))
    counted = sizes.join(across, key, "left").select(*key, "class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return members.join(counted, key).select("scope", "id", "class_id", "n_links")
