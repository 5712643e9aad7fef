"""Problem 1: same or near-same records across splits, found through a full-text index of the evaluation side.

The evaluation texts, as their words in alphabetical order (see nearsets), are cut into shards of a bounded number of words
and each shard gets a compressed index (see fmindex). The indexes lie in the shared folder; training texts stream through
them: every task of the training side opens one shard after another and runs the word pairs that must be looked up (see
nearsets) through backward search, all at once. Where they occur is located, and sketches keep apart what can't be near.
For each (training, evaluation) pair left the evaluation text is read off the index and the matches are extended as long
as neighbouring words agree: maximal matches, merged to a number of spans, of words in them and of words in common. The
last decides, in whole numbers. Texts of a single word look up the word itself. A text on both sides meets itself.

Edges: null and blank texts, and those under min_words, match nothing; equal sets of words are one class, indexed and
searched once; a missing side gives an empty result; other columns are ignored. SHARD, HELD and STEP bound what a task
holds, by words and not by texts; they choose the route, not the rows. Words count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import nearsets as N
from threadloom.llm.fmindex import Index
from threadloom.runtime import cut

#: Words of evaluation texts in one shard, on average; about 4 bytes each in the index.
SHARD = 2_000_000
#: Matches that are located, and words that are compared, in one step.
STEP = 1 << 20
#: Words of training texts that a task takes through all shards at once.
HELD = 4_000_000
NEAR = "t1 long, t2 long, t long, e1 long, e2 long, e long, common long, spans long, matched long"


def build_shards(evaluation: DataFrame) -> list[str]:
    """Writes the index of each shard to the shared folder as rows (shard, index, e1, e2, e). Returns the files."""
    words = evaluation.agg(F.sum(F.size("__h"))).first()[0] or 0
    n = N.shards(words, SHARD)

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        batch = rows.combine_chunks().to_batches()[0]
        values, lengths = N.flat(batch.column("__h"))
        lists = {name: [batch.column(c).to_pylist()] for name, c in (("e1", "__s1"), ("e2", "__s2"), ("e", "__cid"))}
        return pa.table({"shard": [key[0].as_py()], "index": pa.array([Index.build(values, lengths).dump()], pa.binary()), **lists})

    keyed = evaluation.select(F.pmod("__cid", F.lit(n)).alias("shard"), "__h", "__s1", "__s2", "__cid")
    made = keyed.groupBy("shard").applyInArrow(one, "shard long, index binary, e1 array<long>, e2 array<long>, e array<long>")
    return sorted(cut(made, "index").inputFiles())


def located(index: Index, values: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, indexed text) for every occurrence of a pair that must be looked up, in steps."""
    symbol = index.symbols(values)
    row, place = N.short_lists(values, lengths, counts)
    left = N.starts(lengths)[row] + place
    known = (symbol[left] > 0) & (symbol[left + 1] > 0)
    row, left = row[known], left[known]
    low, high = index.back(symbol[left + 1], np.zeros(len(left), np.int64), np.full(len(left), index.rows))
    low, high = index.back(symbol[left], low, high)
    alone = np.flatnonzero(lengths == 1)
    at = N.starts(lengths)[alone]
    alone, at = alone[symbol[at] > 0], at[symbol[at] > 0]
    row, low, high = np.r_[row, alone], np.r_[low, index.start[symbol[at]]], np.r_[high, index.start[symbol[at] + 1]]
    total = np.cumsum(high - low)
    i = 0
    while i < len(row):
        to = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, side="right")))
        n = (high - low)[i:to]
        yield np.repeat(row[i:to], n), index.locate(np.repeat(low[i:to], n) + np.arange(n.sum()) - np.repeat(N.starts(n), n))[0]
        i = to


def matches(index: Index, values: np.ndarray, lengths: np.ndarray, q: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of a query row and an indexed text: size of the text, common words, maximal matches of two words and more, and the words in them."""
    symbol = index.symbols(values)
    theirs, n = index.read(doc)
    of = np.repeat(np.arange(len(doc)), n)
    mine_n = lengths[q]
    mine = symbol[np.repeat(N.starts(lengths)[q] - N.starts(mine_n), mine_n) + np.arange(mine_n.sum())]
    row = np.repeat(np.arange(len(q)), mine_n)
    by_row = lambda x, r: x[np.lexsort((x, r))]
    common = np.bincount(row, weights=N.probe(by_row(theirs, of), n, mine, row), minlength=len(q)).astype(np.int64)
    width = len(index.alphabet) + 2
    pair = np.flatnonzero(of[1:] == of[:-1])
    lists = by_row(theirs[pair] * width + theirs[pair + 1], of[pair])
    at = np.flatnonzero((row[1:] == row[:-1]) & (mine[1:] > 0) & (mine[:-1] > 0))
    at = at[N.probe(lists, np.maximum(n - 1, 0), mine[at] * width + mine[at + 1], row[at])]
    first = np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])] if len(at) else np.zeros(0, bool)
    spans = np.bincount(row[at], weights=first, minlength=len(q)).astype(np.int64)
    return n, common, spans, np.bincount(row[at], minlength=len(q)) + spans


def search(index: Index, keys: list[np.ndarray], batch: pa.RecordBatch, counts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The near ones among the texts of a batch and those of a shard, as NEAR."""
    values, lengths = N.flat(batch.column("__h"))
    s1, s2, c = (batch.column(x).to_numpy() for x in ("__s1", "__s2", "__cid"))
    met = [np.zeros(0, np.int64)]
    for q, doc in located(index, values, lengths, counts):
        may = N.may_be_near(s1[q], s2[q], keys[0][doc], keys[1][doc], threshold)
        met.append(np.unique(q[may] * len(keys[0]) + doc[may]))
    q, doc = np.divmod(np.unique(np.concatenate(met)), max(1, len(keys[0])))
    size = np.cumsum(lengths[q] + index.lengths[doc]) if len(q) else q
    i = 0
    while i < len(q):
        to = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + STEP, side="right")))
        n, common, spans, matched = matches(index, values, lengths, q[i:to], doc[i:to])
        ok = np.flatnonzero(N.near(common, lengths[q[i:to]], n, threshold))
        a, b = q[i:to][ok], doc[i:to][ok]
        yield from N.batches({"t1": s1[a], "t2": s2[a], "t": c[a], "e1": keys[0][b], "e2": keys[1][b], "e": keys[2][b], "common": common[ok], "spans": spans[ok], "matched": matched[ok]})
        i = to


def through_shards(training: DataFrame, evaluation: DataFrame, counts: np.ndarray, threshold: float = N.THRESHOLD) -> DataFrame:
    """All near pairs of a training and an evaluation class, as NEAR."""
    files = build_shards(evaluation)
    shared = training.sparkSession.sparkContext.broadcast(counts)

    def some(queries: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in files:
            fs, path = pafs.FileSystem.from_uri(file)
            for part in pq.ParquetFile(path, filesystem=fs).iter_batches(batch_size=1):
                index = Index.load(part.column("index")[0].as_py())
                keys = [part.column(c)[0].values.to_numpy() for c in ("e1", "e2", "e")]
                for batch in queries:
                    yield from search(index, keys, batch, shared.value, threshold)

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for batch in it:
            held.append(batch)
            words += len(batch.column("__h").flatten())
            if words >= HELD:
                yield from some(held)
                held, words = [], 0
        if held:
            yield from some(held)

    return training.select("__h", "__s1", "__s2", "__cid").mapInArrow(stream, NEAR)


def across(items: DataFrame, min_words: dict[str, int], threshold: float = N.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """items: (scope, id, text, train, eval), one row per id, saying on which sides it stands.

    Returns members (scope, id, train, eval, c1, c2, c), c1 to c being the class, and the near pairs of classes (t1, t2, t,
    e1, e2, e, common, spans, matched); a class on both sides meets itself.
    """
    N.checked(threshold)
    sets = N.with_sets(items.select("scope", "id", "text", "train", "eval"), "text", ["scope"])
    least = F.lit(1)
    for scope, n in min_words.items():
        least = F.when(F.col("scope") == scope, n).otherwise(least)
    sets = cut(sets.where(F.col("__n") >= least).drop("text"), "sets")
    members = sets.select("scope", "id", "train", "eval", F.col("__s1").alias("c1"), F.col("__s2").alias("c2"), F.col("__cid").alias("c"))
    one = sets.groupBy("__s1", "__s2", "__cid").agg(F.max("train").alias("train"), F.max("eval").alias("eval"), F.first("__h").alias("__h"))
    one = cut(one, "classes")
    return members, cut(through_shards(one.where("train"), one.where("eval"), N.histogram(sets), threshold), "near")


def overlapping(items: DataFrame, min_words: dict[str, int], threshold: float = N.THRESHOLD) -> DataFrame:
    """(scope, id_t, id_e, common, spans, matched): ids of the training side and ids of the evaluation side, near or equal; an id may meet itself."""
    members, near = across(items, min_words, threshold)
    side = lambda s, flag: members.where(flag).select("scope", F.col("id").alias(f"id_{s}"), F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("c").alias(s))
    return near.join(side("t", "train"), ["t1", "t2", "t"]).join(side("e", "eval"), ["e1", "e2", "e", "scope"]).select("scope", "id_t", "id_e", "common", "spans", "matched")
