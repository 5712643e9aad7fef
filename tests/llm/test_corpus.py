"""Problems 8, 9 and 10."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import mixing, packing, spam, tokens
from threadloom.llm.wordclass import ID, encode


def padding(counts, bounds):
    return sum(int(c) * (int(bounds[np.searchsorted(bounds, i)]) - i) for i, c in enumerate(counts) if c and i)


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = rng.integers(0, 4, rng.integers(2, 11))
        counts[0], counts[-1] = 0, 1
        n, k = len(counts) - 1, 3
        from itertools import combinations

        best = min(padding(counts, np.array([*c, n])) for c in combinations(range(1, n), min(k - 1, n - 1)))
        got = packing.boundaries(counts, k)
        assert len(got) <= k and padding(counts, got) == best
    assert len(packing.boundaries(np.zeros(5, np.int64))) == 0 and len(packing.boundaries(np.zeros(1, np.int64))) == 0


def test_boundaries_tell_all_lengths_apart():
    counts = np.zeros(4100, np.int64)
    counts[[1, 2, 4099]] = 1000, 1000, 1
    assert packing.boundaries(counts, 2).tolist() == [2, 4099]


def test_plan_never_overfills():
    rng = np.random.default_rng(2)
    for _ in range(50):
        bounds = np.unique(rng.integers(1, 100, rng.integers(1, 12)))
        numbers = rng.integers(0, 60, len(bounds))
        rows = packing.plan(numbers, bounds, 100)
        used, placed = Counter(), Counter()
        for i, (b, first, container, each) in enumerate(rows):
            later = [r[1] for r in rows if r[0] == b and r[1] > first]
            end = min(later) if later else int(numbers[b])
            for rank in range(first, end):
                used[container + (rank - first) // each] += int(bounds[b])
                placed[b] += 1
        assert all(v <= 100 for v in used.values())
        assert [placed[b] for b in range(len(bounds))] == numbers.tolist()


def test_containers_hold_everything_once(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 7, 50, 64, 65, 200, rng.randrange(1, 64)]), "clash") for i in range(400)] + [(None, 5, "x"), (1, 9, "twice")]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long, kind string")
    got = packing.fill(df, {"a": 64, "b": 1000, "off": None}, "doc_id").collect()
    for kind, capacity in (("a", 64), ("b", 1000)):
        rows = [r for r in got if r["kind"] == kind]
        per, doc, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
        for r in rows:
            per[r["container_no"]] += r["tokens"]
            doc[r["doc_id"]] += r["tokens"]
            pieces[r["doc_id"]].append(r["tokens"])
        want = defaultdict(int)
        for i, n, _ in sizes:
            if n:
                want[i] += n
        assert dict(doc) == dict(want) and max(per.values()) <= capacity
        assert sum(want.values()) / (len(per) * capacity) > 0.95
        assert sorted(per) == list(range(len(per)))
        assert all(len(p) == 1 for i, p in pieces.items() if want[i] <= capacity and i != 1)
    assert packing.fill(df.limit(0), {"a": 64}, "doc_id").count() == 0 and packing.fill(df, {}, "doc_id").count() == 0


VOCABULARY = pytest.mark.skipif(not __import__("os").path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@VOCABULARY
def test_tokens_of_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "  ", "42 ", "\n\n", "don't ", "Привет ", "<|endoftext|> ", "x" * 30, "\t"]) for _ in range(3000))
    whole = len(tokens.encoder(tokens.VOCABULARY).encode_ordinary(text))
    for piece in (10, 100, 1000):
        monkeypatch.setattr(tokens, "PIECE", piece)
        assert tokens.count(text, tokens.VOCABULARY) == whole
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df, "text", ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0}


def test_poisson_inversion():
    table = mixing.cdf_table(3)
    u = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
    g = mixing.first_rates(u, 3, table)
    for at in (0, 500, 2000, 9000, mixing.GRID):
        rate = np.linspace(0, 3, mixing.GRID + 1)[at]
        cdf = [np.exp(-rate) * sum(rate**j / np.prod(range(1, j + 1)) for j in range(k + 1)) for k in range(3)]
        assert ((g <= at).sum(0) == [sum(x > c for c in cdf) for x in u]).all()


def test_scarce_sources_are_drawn_too_and_long_texts_matter(spark):
    """The scarcest source is used at its highest finite rate, not wholly; any max_repeat works; a size is taken that fits a source of few long texts."""
    rng = random.Random(9)
    sizes = [(i, "scarce", 10) for i in range(500)] + [(1000 + i, "plenty", 10) for i in range(9000)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("scarce", 0.5, 20), ("plenty", 0.5, 1)], "source string, target_share double, max_repeat int")
    mixture, report = mixing.mix(df, targets, "doc_id")
    got = {r["source"]: r for r in report.collect()}
    uses = Counter(r["doc_id"] for r in mixture.collect() if r["source"] == "scarce")
    assert got["scarce"]["actual_share"] == pytest.approx(0.5, abs=0.001) and len(set(uses.values())) > 5 and max(uses.values()) <= 20
    at_rate = {"a": np.cumsum(np.r_[0, np.full(mixing.GRID, 1)]).astype(float), "b": np.repeat([0.0, 700.0, 1400.0], [1, mixing.GRID // 2, mixing.GRID // 2])}
    place = mixing.rates(at_rate, {"a": 0.9, "b": 0.1})
    used = {s: at_rate[s][g] for s, g in place.items()}
    assert used["b"] / sum(used.values()) == pytest.approx(0.1, abs=0.001)
    assert mixing.rates({}, {}) == {}


def test_mixture_meets_targets(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice(["review", "Reviews ", "web page", "WEB-PAGE", None, "odd"]), rng.randrange(0, 40), 0.5) for i in range(6000)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long, u double")
    targets = spark.createDataFrame([("review", 0.7, 3), ("web_page", 0.2, 1), ("absent", 0.1, None)], "source string, target_share double, max_repeat int")
    mixture, report = mixing.mix(df, targets, "doc_id")
    shares = {r["source"]: r for r in report.collect()}
    assert shares["review"]["actual_share"] == pytest.approx(7 / 9, abs=0.01) and shares["web_page"]["actual_share"] == pytest.approx(2 / 9, abs=0.01)
    assert shares["absent"]["used_tokens"] == 0 and shares["review"]["most_uses"] <= 3 and shares["web_page"]["most_uses"] <= 1
    rows = mixture.collect()
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3 and sum(r["tokens"] for r in rows) == sum(r["used_tokens"] for r in shares.values())
    assert all((r["source"] == "review") == (sizes[r["doc_id"]][1] in ("review", "Reviews ")) for r in rows)
    assert sorted(map(tuple, mixing.mix(df.repartition(7), targets, "doc_id")[0].collect())) == sorted(map(tuple, rows))
    small = mixing.mix(df, targets, "doc_id", total=5000.0)[1].agg(F.sum("used_tokens")).first()[0]
    assert small == pytest.approx(5000, rel=0.03)
    assert mixing.mix(df.limit(0), targets, "doc_id")[0].count() == 0


def classes(*texts):
    seq, lengths = encode(pa.array(texts, pa.string()))
    names = {v: k for k, v in ID.items()}
    return [[names[x] for x in part] for part in np.split(seq, np.cumsum(lengths)[:-1])]


def test_classes():
    got = classes("The model of Foobar-12 costs 4.5 EUR.\nSee https://a.b/c #Tag model", "", None, " ", "model Xy xy. Xy z", "a_b")
    assert got[0] == ["det", "new", "prep", "name", "new", "number", "name", "stop", "line", "new", "link", "tag", "near"]
    assert got[1:4] == [[], [], []]
    assert got[4] == ["new", "name", "near", "stop", "loop", "letter"] and len(got[5]) >= 1


def test_texts_are_encoded_alike_alone_and_together():
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "Model", "model", "of", "gain", "7", "\n", "A.", "http://x.y/z", "#tag", "x", "loan", "best", "(", "?"]) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    assert classes(*texts) == [classes(t)[0] for t in texts]


NOUNS = [f"{x}{y}" for x in ("gra", "bol", "tre", "mul", "cor", "fen", "wip") for y in ("dient", "tune", "mark", "lation", "form", "der", "ping", "sal")]
PHRASES = ["the {} of the {}", "in {} {}", "which is {}", "and we {} it", "for Mr {}", "because {} has not {}", "on 12 {}", "({})", "with the {}", "{}, {}", "not only {} but {}", "of the {}", "of the {}", "of the {}"]


def sentence(rng):
    parts = [rng.choice(PHRASES) for _ in range(rng.randrange(3, 7))]
    return "The {} ".format(rng.choice(NOUNS)) + " ".join(x.format(*rng.sample(NOUNS, 2)) for x in parts) + "."


def page(rng):
    """Prose, now and then with a keyword line, a table, a link or few words only."""
    text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 7)))
    kind = rng.randrange(12)
    if kind == 0:
        return text + "\n\nKeywords: " + ", ".join(rng.sample(NOUNS, 5))
    if kind == 1 and len(text) > 400:
        return text + "\n\nMethod | recall | accuracy\n" + "\n".join(f"{n.capitalize()} | {i}.5 | {i}.25" for i, n in enumerate(rng.sample(NOUNS, rng.randrange(2, 5))))
    return text + "\nSee https://a.example/b" if kind == 2 else " ".join(text.split()[:4]) + "." if kind == 3 else text


SPAM = ["cheap loan best cheap loan top cheap loan " * 8, "\n".join(f"http://a{i}.example/x{i}" for i in range(20)), " ".join(f"#Tag{i}" for i in range(20)), "Need cheap loan? Get cheap loan, then cheap loan. Our cheap loan offers cheap loan for your cheap loan. " * 5, "\n".join(f"Brand item{i} - {i}.99 EUR - SKU B{i}" for i in range(15))]


def test_spam_stands_out(spark):
    rng = random.Random(7)
    prose = [page(rng) for _ in range(600)]
    extra = [None, "", " ", "N/A", "spam", prose[0] + "\n\nKeywords: " + ", ".join(NOUNS[:4]), prose[1] + "\n\nSee https://a.example/b", prose[2] * 300]
    rows = [(i, t, "x") for i, t in enumerate(prose + extra + SPAM)] + [(len(prose) + len(extra), SPAM[0], "x"), (None, SPAM[0], "x")]
    rows += [(9000 + i, prose[5], "x") for i in range(300)]  # a text that a third of all rows repeat narrows nothing
    got = spam.flagged(spark.createDataFrame(rows, "doc_id long, text string, seq string"))
    first = len(prose) + len(extra)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted([first, *range(first, first + len(SPAM))])
    assert spam.flagged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spam.flagged(spark.createDataFrame([(1, SPAM[0])], "doc_id long, text string")).count() == 0


def test_both_tails_and_held_out_scores(spark):
    """One frame said over and over is abnormally predictable, keywords are abnormally surprising; a fold of spam alone can't teach its own model."""
    rng = random.Random(12)
    prose = [page(rng) for _ in range(600)]
    words = [a + b for a in NOUNS for b in ("", "al", "ic", "ous", "ing", "ed", "or", "um")]
    frame = "The " + " of the ".join(words) + "."
    rows = list(enumerate([*prose, frame, " ".join(words)]))
    got = {r["doc_id"]: r for r in spam.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, r in got.items() if r["spam"]] == [601]
    assert min(got, key=lambda i: got[i]["spreads"]) == 600 and got[600]["spreads"] < -3
    low = spam.flagged(spark.createDataFrame(rows, "doc_id long, text string"), far=3.0).where("doc_id = 600")
    assert low.count() == 1


def test_keywords_at_any_cycle(spark):
    rng = random.Random(8)
    prose = [page(rng) for _ in range(600)]
    table = prose[0] + "\n\nMethod | recall | accuracy\n" + "\n".join(f"{n.capitalize()} | {i}.5 | {i}.25" for i, n in enumerate(NOUNS[:4]))
    words = [a + b for a in NOUNS for b in ("", "al", "ic", "ous", "ing", "ed", "or", "um")]
    pages = []
    for cycle in (5, 24, 30, 60, 400):
        seq = [words[i % cycle] for i in range(400)]
        mixed = rng.sample(seq, len(seq))
        pages += [" ".join(seq), ", ".join(seq), " ".join(mixed), "\n".join(" ".join(seq[i : i + 3]) for i in range(0, 400, 3)), " ".join(f"for {w}" if i % 8 == 7 else w for i, w in enumerate(seq))]
        pages += [" | ".join(w.capitalize() for w in seq), ". ".join(" ".join(seq[i : i + 8]).capitalize() for i in range(0, 400, 8)) + "."]
    rows = list(enumerate([*prose, table, *pages]))
    got = sorted(r["doc_id"] for r in spam.flagged(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(range(len(prose) + 1, len(rows)))
