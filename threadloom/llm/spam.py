"""Problem 10: keyword-stuffed pages and link lists, by the perplexity of word-class sequences under a model of prose.

Texts become sequences of classes (see wordclass). Four-gram models with Witten-Bell back-off are trained on the prose
sentences of all documents: those that end with a full stop, have a fifth of function words and don't go round in circles.
Documents are in two folds by their hash, and each is scored by the model of the other fold, so no page vouches for itself.
Keywords repeat at any distance or not at all: words that stand where function words are missing are a class of their own,
which prose doesn't have, so the verdict depends neither on how many keywords a page has nor on their order.

A page's score is its mean surprisal in bits a token, with PRIOR tokens of the usual score added, so that few tokens prove
little, and with no token above CAP bits, so that a few odd marks can't decide. The scores of all different pages are
held-out scores; their logarithms have a median and a spread (half the distance of the 16th and 84th percentile), and what
lies more than FAR spreads above or below is abnormal: above are keywords, tags and links, below the same phrase frame over
and over.

Edges: null and blank texts are never flagged; long texts are scored whole; a model's counts are a table of fixed size
(classes to the fourth power) whatever the corpus, and so is the histogram of scores; without any prose nothing is
flagged; a fold without prose is scored by its own model; repeated rows get the same verdict each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.wordclass import ID, K, encode
from threadloom.runtime import cut

ORDER = 4
CAP = 10.0
PRIOR = 5
#: Spreads from the median of held-out scores, and the least spread (of natural logarithms).
FAR, LEAST_SPREAD = 4.5, 0.18
#: Steps of the histogram of scores: natural logarithms in 1,024ths, between bits of e^-8 and e^8.
STEPS, RANGE = 1024, 8


def encoded(documents: DataFrame) -> DataFrame:
    """(doc_id, fold, seq): one byte a token."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seq, lengths = encode(batch.column("text"))
            offsets = pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            of = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(seq.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), of], names=["doc_id", "fold", "seq"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    at = documents.where("text is not null and doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"), F.col("text").cast("string").alias("text"))
    return at.mapInArrow(run, f"doc_id {kind}, fold int, seq binary")


def classes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All classes of a column of sequences, and their numbers."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.int8).astype(np.int64), np.array([len(x) for x in parts], np.int64)


def grams(seq: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Number of the four-gram that ends at each place; before the begin of its unit all classes are the start."""
    place, k = np.arange(len(seq)), np.zeros(len(seq), np.int64)
    for i in range(ORDER - 1, -1, -1):
        k = k * K + np.where(place - i >= begin, seq[np.maximum(place - i, 0)], ID["start"])
    return k


def prose(seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of prose sentences, and the begin of the sentence for each place of all."""
    if not len(seq):
        return seq, seq
    ends = (seq == ID["stop"]) | (seq == ID["line"])
    first = np.r_[True, ends[:-1]]
    first[np.cumsum(lengths)[lengths.cumsum() < len(seq)]] = True
    begin = np.flatnonzero(first)
    size = np.diff(np.r_[begin, len(seq)])
    share = lambda x: np.add.reduceat(x.astype(np.int64), begin) / size
    good = (size >= 7) & (seq[begin + size - 1] == ID["stop"]) & (share(seq >= ID["det"]) >= 0.2) & (share(seq == ID["near"]) < 0.15)
    good &= share((seq == ID["loop"]) | (seq == ID["bare"])) == 0
    return np.flatnonzero(np.repeat(good, size)), np.repeat(begin, size)


def surprisal(counts: np.ndarray) -> np.ndarray:
    """Bits of each four-gram's last class, from the counts of all four-grams."""
    by_order = [counts]
    for _ in range(ORDER - 1):
        by_order.append(by_order[-1].reshape(K, -1).sum(0))
    p = (by_order[-1] + 1) / (by_order[-1].sum() + K)
    for n in range(ORDER - 2, -1, -1):
        c = by_order[n].reshape(-1, K)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, K), (len(c) // (p.size // K), 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower).reshape(-1)
    return (-np.log2(p)).astype(np.float32)


def train(sequences: DataFrame) -> np.ndarray:
    """[fold, four-gram]: how often it occurs in the prose of each fold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * K**ORDER, np.int64)
        for batch in it:
            seq, lengths = classes_of(batch.column("seq"))
            at, begin = prose(seq, lengths)
            fold = np.repeat(batch.column("fold").to_numpy(), lengths)
            total += np.bincount(fold[at] * K**ORDER + grams(seq, begin)[at], minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    rows = sequences.select("fold", "seq").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * K**ORDER, np.int64)
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(2, -1)


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens, total, page): number of tokens of each document with a text, the sum of their surprisals, each at most CAP, and a hash of the sequence."""
    sequences = cut(encoded(documents), "classes")
    counts = train(sequences)
    page = F.xxhash64("seq").alias("page")
    if not counts.any():
        return sequences.select("doc_id", F.length("seq").alias("tokens"), F.lit(None).cast("double").alias("total"), page)
    models = np.stack([np.minimum(surprisal(c if c.any() else counts.sum(0)), CAP) for c in counts])
    bits = documents.sparkSession.sparkContext.broadcast(models)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seq, lengths = classes_of(batch.column("seq"))
            begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
            fold = np.repeat(batch.column("fold").to_numpy(), lengths)
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=bits.value[1 - fold, grams(seq, begin)], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths.astype(np.int32)), pa.array(sums, mask=lengths == 0), batch.column("page")], names=["doc_id", "tokens", "total", "page"])

    kind = sequences.schema["doc_id"].dataType.simpleString()
    return sequences.select("doc_id", "fold", "seq", page).mapInArrow(run, f"doc_id {kind}, tokens int, total double, page long")


def usual(scored: DataFrame) -> tuple[float, float] | None:
    """Median and spread of the logarithms of the mean surprisal over all different pages; None without any."""
    log = F.ln(F.greatest(F.col("total") / F.col("tokens"), F.lit(1e-6)))
    step = F.floor(F.least(F.greatest(log, F.lit(-RANGE)), F.lit(RANGE)) * STEPS).cast("int")
    each = scored.where("total is not null").groupBy("page").agg(F.min(step).alias("step"))
    rows = each.groupBy("step").count().orderBy("step").toArrow()  # at most 2 * RANGE * STEPS + 1
    if not rows.num_rows:
        return None
    value, n = (rows.column("step").to_numpy() + 0.5) / STEPS, np.cumsum(rows.column("count").to_numpy())
    low, middle, high = (float(value[np.searchsorted(n, q * n[-1])]) for q in (0.16, 0.5, 0.84))
    return middle, max((high - low) / 2, LEAST_SPREAD)


def judged(documents: DataFrame, far: float = FAR) -> DataFrame:
    """(doc_id, tokens, bits, spreads, spam): mean surprisal with the prior, how many spreads it lies from the median, and the verdict."""
    scored = cut(scores(documents), "scores")
    found = usual(scored)
    if found is None:
        return scored.select("doc_id", "tokens", *[F.lit(None).cast("double").alias(c) for c in ("bits", "spreads")], F.lit(False).alias("spam"))
    middle, spread = found
    bits = (F.col("total") + PRIOR * float(np.exp(middle))) / (F.col("tokens") + PRIOR)
    spreads = (F.ln("bits") - middle) / spread
    return scored.withColumn("bits", bits).withColumn("spreads", spreads).select("doc_id", "tokens", "bits", "spreads", F.coalesce(F.abs("spreads") > far, F.lit(False)).alias("spam"))


def flagged(documents: DataFrame, far: float = FAR) -> DataFrame:
    """doc_id of the pages with abnormal perplexity."""
    return judged(documents, far).where("spam").select("doc_id")
