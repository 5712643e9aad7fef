"""Problems 1 and 2 against comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import nearsets as N
from threadloom.llm import neardup, overlap
from threadloom.llm.fmindex import Index, Packed, suffix_order

WORD = re.compile(r"[^\W_]+")


def words(text):
    return set(WORD.findall((text or "").lower()))


def near(a, b, least):
    a, b = words(a), words(b)
    return len(a) >= least and len(b) >= least and 10 * len(a & b) >= 7 * len(a | b)


def corpus(n, seed, low=3, high=40):
    """Texts from templates with families of edited copies, so that many pairs lie near the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    templates = [rng.sample(vocabulary[:80], 12) for _ in range(6)]
    out = []
    while len(out) < n:
        base = rng.choice(templates)[: rng.randrange(4, 13)] + rng.sample(vocabulary, rng.randrange(low, high))
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                kind, at = rng.randrange(4), rng.randrange(len(t))
                if kind == 0:
                    t[at] = rng.choice(vocabulary)
                elif kind == 1:
                    t.insert(at, rng.choice(vocabulary))
                elif kind == 2 and len(t) > 3:
                    del t[at]
                else:
                    t.append(t.pop(at))
            out.append(" ".join(t).upper() if rng.random() < 0.1 else ", ".join(t))
    return out[:n]


ITEMS = "scope string, id string, ts int, text string, token string, __set string"


@pytest.mark.parametrize("seed, block, wide, held", [(1, 8192, 32_768, 500_000), (2, 8192, 64, 100), (3, 16, 16, 500_000), (4, 4, 8, 30), (5, 4, 2, 40)])
def test_all_near_pairs_are_found(spark, monkeypatch, seed, block, wide, held):
    """Also with frequent pairs, with runs longer than a block, and longer than what a task takes up at once."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "WIDE", wide)
    monkeypatch.setattr(neardup, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(held, 10_000)))
    texts = corpus(350, seed)
    texts += [texts[0]] * 40 + [None, "", "one two three", "x " * 20_000]
    rows = [(("a", "b")[i % 2], f"{i:04d}", 1, t, "clash", "clash") for i, t in enumerate(texts)]
    rows += [("a", "0000", 0, "an older version of the first text that must not count at all", None, None), ("a", None, 1, texts[0], None, None), rows[2]]
    got = sorted(map(tuple, neardup.near_pairs(spark.createDataFrame(rows, ITEMS)).collect()))
    valid = [r for r in rows[: len(texts)]]
    want = sorted((s, a[1], b[1]) for i, a in enumerate(valid) for b in valid[i + 1 :] if (s := a[0]) == b[0] and near(a[3], b[3], 8))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 300 and got == want


def test_no_rows_and_low_thresholds(spark):
    empty = spark.createDataFrame([], ITEMS)
    assert neardup.near_pairs(empty).count() == 0
    with pytest.raises(ValueError):
        neardup.near_pairs(empty, threshold=0.5)


def test_sketches_never_rule_out_near_sets():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(-(2**62), 2**62, rng.integers(8, 400))
        b = np.unique(np.r_[a[: rng.integers(1, len(a) + 1)], rng.integers(-(2**62), 2**62, rng.integers(0, 20))])
        a = np.unique(a)

        def sketch(x):
            bits = np.bincount(x % N.SKETCH_BITS, minlength=N.SKETCH_BITS) & 1
            value = sum(int(v) << i for i, v in enumerate(bits[:64])), sum(int(v) << i for i, v in enumerate(bits[64:])) | min(len(x), 255) << 56
            return [np.array([v], dtype=np.uint64).view(np.int64) for v in value]

        common = len(np.intersect1d(a, b))
        if 10 * common >= 7 * (len(a) + len(b) - common):
            assert N.may_be_near(*sketch(a), *sketch(b), 0.7)[0]


def test_suffix_order_and_locate():
    rng = random.Random(4)
    for n in (0, 1, 2, 50):
        text = np.array([rng.randrange(3) for _ in range(n)], dtype=np.int64)
        assert list(suffix_order(text)) == sorted(range(n), key=lambda i: list(text[i:]))
    docs = [[rng.randrange(6) for _ in range(rng.randrange(0, 12))] for _ in range(30)]
    flat = np.array([x for d in docs for x in d], dtype=np.int64)
    index = Index.load(Index.build(flat, np.array([len(d) for d in docs]), every=3).dump())
    for a in range(7):
        for b in range(7):
            symbol = index.symbols(np.array([a, b]))
            want = sorted((i, p) for i, d in enumerate(docs) for p in range(len(d) - 1) if d[p : p + 2] == [a, b])
            if (symbol < 0).any():
                assert not want
                continue
            low, high = index.back(symbol[1:], np.array([0]), np.array([index.rows]))
            low, high = index.back(symbol[:1], low, high)
            doc, place = index.locate(np.arange(low[0], high[0]))
            assert sorted(zip(doc.tolist(), place.tolist(), strict=True)) == want


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top in (0, 1, 2, 255, 256, 2**33, 2**50):
        x = rng.integers(0, top + 1, 70_000)
        packed = Packed.of(x)
        at = rng.permutation(len(x))
        assert (packed[at] == x[at]).all() and len(packed.data) <= len(x) * max(1, top.bit_length()) / 8 + 9
    assert len(Packed.of(np.zeros(0, np.int64))[np.zeros(0, np.int64)]) == 0


def test_an_index_is_smaller_than_its_text_and_reads_it_off():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(3000)]
    docs = [rng.choice(3000, rng.integers(0, 60), p=(w := 1 / np.arange(1, 3001)) / w.sum()) for _ in range(3000)]
    values, lengths = np.concatenate(docs) * 7919, np.array([len(d) for d in docs])
    data = Index.build(values, lengths).dump()
    assert len(data) < len(" ".join(" ".join(words[i] for i in d) for d in docs))
    index = Index.load(data)
    got, n = index.read(np.arange(len(docs)))
    assert (n == lengths).all() and (index.alphabet[got - 1] == values).all()


@pytest.mark.parametrize("a, b", [("a b c d e f", "a b c x d e f"), ("a c e", "b d f"), ("a b", "a b"), ("a b c d", "b c d"), ("a x b", "a b"), ("q", "q")])
def test_maximal_matches(a, b):
    ids = lambda t: np.array([ord(x) for x in sorted(t.split())])
    x, y = ids(a), ids(b)
    index = Index.build(y, np.array([len(y)]))
    n, common, spans, matched = overlap.matches(index, x, np.array([len(x)]), np.array([0]), np.array([0]))
    pairs = {(i, j) for i, j in zip(y, y[1:], strict=False)}
    hit = [(i, j) in pairs for i, j in zip(x, x[1:], strict=False)]
    runs = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
    assert (n[0], common[0], spans[0], matched[0]) == (len(y), len(set(x) & set(y)), runs, sum(hit) + runs)


@pytest.mark.parametrize("shard, held, step", [(2_000_000, 4_000_000, 1 << 20), (300, 500, 40)])
def test_overlaps_across_splits(spark, monkeypatch, shard, held, step):
    for name, value in (("SHARD", shard), ("HELD", held), ("STEP", step)):
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(8)
    texts = corpus(260, 7, 1, 30) + [None, " ", "lone", "lone", "a b", "b a!"]
    rows = [("title" if i % 3 == 0 else "weakness", f"{i:04d}", t, rng.random() < 0.6, rng.random() < 0.5, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "scope string, id string, text string, train boolean, eval boolean, spans string")
    got = sorted(map(tuple, overlap.overlapping(df, {"weakness": 8, "title": 1}).select("scope", "id_t", "id_e").collect()))
    least = {"weakness": 8, "title": 1}
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] and b[4] and near(a[2], b[2], least[a[0]]))
    assert len(want) > 100 and got == want


def test_one_side_only(spark):
    rows = [("title", "1", "a b c", True, False), ("title", "2", "a b c", True, False)]
    df = spark.createDataFrame(rows, "scope string, id string, text string, train boolean, eval boolean")
    with pytest.raises(ValueError):
        overlap.overlapping(df, {}, threshold=0.5)
    assert overlap.overlapping(df, {}).count() == 0
    assert overlap.overlapping(df.limit(0), {}).count() == 0
    assert overlap.overlapping(df.withColumn("eval", F.lit(True)).withColumn("train", F.lit(False)), {}).count() == 0


def test_sketches_are_those_of_the_hashes(spark):
    texts = ["one two three", "", None, "a", " ".join(f"w{i}" for i in range(254)), " ".join(f"w{i}" for i in range(300))]
    rows = N.with_sets(spark.createDataFrame([("s", t) for t in texts], "scope string, text string"), "text", ["scope"]).select("__n", "__h", "__s1", "__s2").collect()
    assert sorted(r["__n"] for r in rows) == sorted(len(words(t)) for t in texts)
    for n, hashes, s1, s2 in rows:
        value = min(n, 255) << 120
        for h in hashes:
            value ^= 1 << h % N.SKETCH_BITS
        assert (s1 % 2**64, s2 % 2**64) == (value % 2**64, value >> 64)


@pytest.mark.parametrize("same", [True, False])
def test_tiles_leave_out_sizes_that_rule_a_link_out(monkeypatch, same):
    rng = np.random.default_rng(3)

    def sketches(n):
        size = np.r_[rng.integers(8, 256, n - 3), 255, 255, 8].astype(np.uint64)
        s1 = rng.integers(0, 8, n).astype(np.int64)
        return s1, (size << np.uint64(56) | rng.integers(0, 8, n).astype(np.uint64)).view(np.int64)

    x = sketches(900)
    y = x if same else sketches(700)
    cells, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda a: cells.append(a.size if a.ndim == 2 else 0) or count(a))
    got = np.concatenate([np.stack(f, 1) for f in neardup.tile(*x, *y, same, 0.7)])
    looked_at = sum(cells) / 2  # two halves of a sketch
    monkeypatch.undo()
    i, j = np.triu_indices(900, 1) if same else (a.ravel() for a in np.meshgrid(np.arange(900), np.arange(700), indexing="ij"))
    near_ = N.may_be_near(x[0][i], x[1][i], y[0][j], y[1][j], 0.7)
    want = np.stack(neardup.ordered(x[0][i], x[1][i], y[0][j], y[1][j]), 1)[near_]
    assert len(got) == len(want) > 0 and (got[np.lexsort(got.T)] == want[np.lexsort(want.T)]).all()
    assert 0 < looked_at < 0.85 * len(i)


def test_tiles_of_no_rows():
    none = np.zeros(0, np.int64)
    one = np.array([5]), np.array([9 << 56])
    for x, y in (((none, none), one), (one, (none, none))):
        assert sum(len(f[0]) for f in neardup.tile(*x, *y, False, 0.7)) == 0


def test_words_of_a_candidate_are_found_once(spark):
    sets = N.with_sets(spark.createDataFrame([("s", f"a b c d e f g h i j {i}") for i in range(3)], "scope string, text string"), "text", ["scope"])
    classes = spark.createDataFrame(sets.select("__s1", "__s2", "__cid", "scope", "text").collect(), "__s1 long, __s2 long, __cid long, scope string, text string")
    a, b, c = sorted((r["__s1"], r["__s2"]) for r in classes.collect())
    pairs = spark.createDataFrame([(*a, *b, 5), (*a, *c, 5)], "a1 long, a2 long, b1 long, b2 long, n long")
    found = neardup.check(pairs, classes, np.ones(N.BUCKETS, np.int64), 0.7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2 and plan.count("split(") == 2


def test_ranks_of_rows_of_any_length():
    rng = np.random.default_rng(4)
    for lengths in ([], [0], [1], [5, 1, 0, 3], [3000, 2, 1], rng.integers(0, 50, 200)):
        lengths = np.array(lengths, np.int64)
        row = np.repeat(np.arange(len(lengths)), np.maximum(lengths - 1, 0))
        key = rng.integers(0, 20, len(row)).astype(np.uint64)
        want = [p for r in range(len(lengths)) for p in np.argsort(np.argsort(key[row == r], kind="stable"), kind="stable")]
        assert N.ranks(key, row, lengths).tolist() == want
