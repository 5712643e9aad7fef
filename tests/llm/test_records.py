"""Problems 3, 5, 6 and 7."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import answers, conversations, endings, pieces, queries, tables, together
from threadloom.llm.endings import EndModel

EVENT = "submission_id string, event_id string, timestamp string, role string, actor_id string, text string, reply_to_event_id string, fetched_at int, t string, h string"


def event(id_, reply, minute=None, role="reviewer", text="hello", sub="s", actor=None, at=1):
    return (sub, id_, None if minute is None else f"2024-01-01T00:{minute:02d}:00Z", role, actor, text, reply, at, "clash", "clash")


def rebuilt(spark, rows):
    return sorted(tuple(r)[:3] for r in conversations.discussions(spark.createDataFrame(rows, EVENT)).collect())


def test_order_speakers_and_gaps(spark):
    rows = [
        event("a", None, 5), event("b", "a", 3, "author"), event("c", "b", 4, " Reviewer "), event("d", "a", None, "unknown", actor="V/Authors"), event("e", "a", 9, "author", text=" ​"), event("f", "e", 1, "author"),
        event("g", "missing", 1), event("h", "h", 1), event("i", "j", 1), event("j", "i", 1),  # a gap, two circles
        event("k", "s", 1), event("l", "k", 2), event("m", "", 1), event("n", "m", 2, "author"), event("n", "m", 2, "", actor="V/Someone", at=2),  # one speaker; an unknown one in the latest version
        event("o", "", 1, text=None), event("p", "o", 2, "author"), event("q", "a", 2, "author", sub="other"), event(None, "a", 1), event("r", "a", 1, sub=None), event("b", "a", 3, "author"),
        event("u", None, None), event("v", "u", 1, "author"), event("w", "u", None, "author"),
    ]
    assert rebuilt(spark, rows) == [("a", 1, "a"), ("a", 2, "b"), ("a", 3, "d"), ("a", 4, "c"), ("a", 5, "f"), ("u", 1, "u"), ("u", 2, "w"), ("u", 3, "v")]


def test_long_chains_and_no_events(spark):
    rows = [event("e000", None, 1)] + [event(f"e{i:03d}", f"e{i - 1:03d}", None, ("author", "reviewer")[i % 2]) for i in range(1, 140)]
    assert rebuilt(spark, rows) == [("e000", i + 1, f"e{i:03d}") for i in range(140)]
    assert rebuilt(spark, []) == []


def split(spark, rows, limit=60, overlap=12):
    kind = "weakness_id string, list_name string, snippet_no int, text string, max_chars int, __over int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], kind)
    limits = spark.createDataFrame([("l", limit, overlap), ("l", limit, overlap), ("none", None, 1)], "list_name string, max_chars int, overlap_chars int")
    return pieces.split_oversize(df, limits, ["weakness_id", "snippet_no"], "list_name").collect()


def test_pieces_fit_overlap_and_lose_nothing(spark):
    rng = random.Random(6)
    texts = ["", None, "x" * 60, "x" * 61, "😀" * 130, "word " * 40, "One sentence here. " * 9, "para one is here\n\npara two is a little longer than that\n\n" * 4, "a,b;c" * 50, "。" * 99, " " * 200, "\n" * 150]
    texts += ["".join(rng.choice("ab ,.\n。😀\t") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    got = {r["snippet_no"]: r for r in split(spark, [("w", "l", i, t) for i, t in enumerate(texts)] + [("w", "other", 0, "y" * 500), ("w", "none", 1, "y" * 500)])}
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 60}
    for i, r in got.items():
        t, at = texts[i], 0
        assert r["cut_kind"] == ("unbroken" if re.search(r"[^\s.!?;,。]{61,}", t) else "breakable")
        for n, p in enumerate(r["pieces"], 1):
            assert p["piece_no"] == n and 0 < len(p["text"]) <= 60 and p["text"] == t[p["start"] : p["start"] + len(p["text"])]
            assert at - p["start"] == (min(12, at) if n > 1 else 0)
            at = p["start"] + len(p["text"])
        assert at == len(t)


def test_cuts_prefer_strong_boundaries(spark):
    for gap in (1, 15, 25):  # however long the white space behind the full stop is
        (row,) = split(spark, [("w", "l", 0, "x" * 30 + "." + " " * gap + "yy " * 40)], 60, 0)
        assert row["pieces"][0]["text"] == "x" * 30 + "." + " " * gap
    (row,) = split(spark, [("w", "l", 0, "Word is a word." + '"' * 20 + " Next words are here and here and here and there as well.")], 60, 0)
    assert row["pieces"][0]["text"].rstrip().endswith('"')
    text = "Alpha beta gamma delta epsilon.\n\nZeta eta theta iota. Kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
    (row,) = split(spark, [("w", "l", 0, text)], 60, 0)
    assert [p["text"].strip() for p in row["pieces"]][0] == "Alpha beta gamma delta epsilon."
    assert split(spark, []) == []


SENTENCE = ["The bound in the section holds for all runs.", "A reader finds the code in the appendix.", "It affects the main claim of the work.", "Without it, the gain stays unexplained."]
LONG = "The new method for the task lacks a comparison with the strong baseline of the field, which limits the claim."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return EndModel([" ".join(rng.sample(SENTENCE, 3)) for _ in range(300)])


@pytest.mark.parametrize("question, answer, found", [
    (LONG, None, ["empty"]), (LONG, "​ \n", ["empty"]), (LONG, "N/A", ["empty"]), (LONG, "[No response]", ["empty"]), (LONG, "...", ["empty"]),
    (LONG, LONG, ["copied"]), (f"Paper: x\n\nReviewer comment:\n{LONG}\n\nState it.", "Answer: " + LONG.upper(), ["copied"]),
    (LONG, "I cannot help with writing about this paper.", ["refusal"]), (LONG, "Es tut mir leid, aber das geht nicht.", ["refusal"]), (LONG, "Lo siento, pero no puedo evaluar esto.", ["refusal", "language"]), (LONG, "As an automated assistant I am not able to judge it.", ["refusal"]),
    (LONG, "I cannot agree that this is minor: the bound in the section holds for few runs.", []), (LONG, "The authors cannot exclude that the claim of the work is wrong.", []),
    (LONG, "Die Schranke ist nicht klar, und der Abschnitt über das Verfahren sollte die Kosten von allen Läufen nennen.", ["language"]), (LONG, "Мы видим, что сеть без доказательства хуже на этих данных.", ["language"]),
    ("Die Frage ist, ob der Beweis für das Modell auf allen Daten gilt.", "Der Beweis ist nicht vollständig, weil die Annahme auf den Daten fehlt.", []),
    (LONG, "It affects the main", ["truncated"]), (LONG, "Without it, the gain stays unexplained. A reader finds the co-", ["truncated"]), (LONG, "The bound in the section holds (see the", ["truncated"]), (LONG, "Without it,", ["truncated"]), (LONG, "There are gaps: (1) the code, (2)", ["truncated"]),
    (LONG, "Without it, the gain stays unexplained", []), (LONG, "Without it, the gain stays unexplained [28]", []), (LONG, "Without it, the gain stays unexplained (Table 4)", []), (None, "It affects the main claim of the work.", []), ("", "It affects the main claim of the work.", []),
    (LONG, "The bound in the section holds for all runs. " * 5000, []),
])
def test_defects(model, question, answer, found):
    assert answers.defects(question, answer, model) == found


def test_fields_must_close():
    m = EndModel(["Evidence: a b.\n\nHow: do it.\n\nSeverity: major"] * 20)
    assert m.truncated("Evidence: a b.\n\nHow: do it.") and not m.truncated("Evidence: a b.\n\nSeverity: minor") and m.truncated("Evidence: x.\n\nSeverity:")


def test_judging_a_table(spark):
    rows = [("t", "a", 1, LONG, None, "x"), ("t", "b", 1, None, None, "x"), ("t", "c", 1, LONG, LONG, "x"), ("t", "c", 1, LONG, LONG, "x"), ("t", "d", 1, LONG, SENTENCE[0], "x"), ("t", None, None, LONG, "", "x")]
    kind = "table_name string, record_key string, pair_no int, question string, answer string, defects string"
    got = answers.judge(spark.createDataFrame(rows, kind), ["table_name", "record_key", "pair_no"]).collect()
    assert sorted((r["record_key"] or "-", r["defect"]) for r in got) == [("-", "empty"), ("a", "empty"), ("b", "empty"), ("c", "copied"), ("c", "copied")]
    assert answers.judge(spark.createDataFrame([], kind), ["table_name", "record_key", "pair_no"]).count() == 0


def test_endings_are_counted_over_all_answers(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.sample(SENTENCE, 3)) + f" Run {i} of the plan is done." for i in range(6000)] + ["It affects the main claim of the " + w for w in ("work", "main", "wor")]
    # a third of all rows is one text; the one answer with a rare word counts whatever its hash, as every other
    rare = ["The reader of the section finds a zymurgy."] + [f"The reader of the {w} finds the zymurgy." for w in ("code", "work", "field")]
    rows = [("t", str(i), 1, LONG, t) for i, t in enumerate([*texts, *rare, *[texts[0]] * 3000, "The reader of the section finds a zymurgy", "The reader finds the zymur"])]
    df = spark.createDataFrame(rows, "table_name string, record_key string, pair_no int, question string, answer string")
    whole = EndModel({t for *_, t in rows if len(t) >= 40})
    for keys in (300_000, 50):
        monkeypatch.setattr(answers, "KEYS", keys, raising=False)
        got = answers.fit(df)
        assert got.seen.items() <= whole.seen.items() and got.ended.items() <= whole.ended.items() and got.seen[("zymurgy",)] == 4
        assert (got.closing, got.inner, got.tails) == (whole.closing, whole.inner, whole.tails)
        assert len(got.seen) < 100  # what unfinished answers ask for
        assert all(got.truncated(t) == whole.truncated(t) for *_, t in rows)
        assert not got.truncated(rows[-2][-1]) and got.truncated(rows[-1][-1])


ODD = ["", "a", "A. B", "It is 12.5 of v2. (It) is? Yes! No", "x" * 60 + ".", "İSTANBUL ſo K-1_b ’tis a naïve\x1fΣΑΣ word.", "Über die Form. 7. 8 is it.", *SENTENCE, " ".join(SENTENCE), "... . .", "Model A-b3 of Wang. It", "a\nScore: b.\nHow 2: c."]


def test_runs_spell_the_contexts_token_by_token():
    texts = ODD * 3
    seen, also, runs, ends = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        endings.tally(text, seen, also, runs, ends)
    assert sum(runs.values()) > 2 * len(runs)  # equal runs are worked on once
    endings.spell(runs, ends, seen, also)
    want, ended = Counter(), Counter()
    for text in texts:
        t = endings.classes(text) if endings.STOP.search(text.strip()) else []
        for i in range(len(t) - 1):
            if t[i][0].isalnum():
                keys = [endings.SEP.join(c) for c in [*endings.contexts(t, i), endings.shape(t, i)]]
                want.update(keys)
                if t[i + 1] in ".!?" and t[i : i + 3 : 2] != ["0", "0"]:
                    ended.update(keys)
    contexts = lambda n: {k[1:]: v for k, v in n.items() if k[0] == "c"}
    assert contexts(seen) == want and contexts(also) == ended and not runs and not ends
    assert seen["tN"] == sum(endings.classes(x)[:-1].count("N") for x in texts if endings.STOP.search(x.strip()))


def test_classes_are_kept_up_to_a_bound(monkeypatch):
    want = [endings.classes(x) for x in ODD]
    monkeypatch.setattr(endings, "KEPT", 3)
    endings.KINDS.clear()
    assert [endings.classes(x) for x in ODD] == want and len(endings.KINDS) <= 3
    assert endings.classes("The GPU of v2 is 12. Then x") == ["the", "N", "of", "N", "is", "0", ".", "then", "x"]


@pytest.mark.parametrize("text", [*ODD, "I CANNOT HELP.", "as an AI, I am", "Es tut mir leid, ABER nein", "Я не могу помочь", "i can’t assiſt", "Lo siento, no", "we decline", "I must decline", "Ich möchte mich nicht äußern", "N/A", "_na_", "- none -", "[To be added]", "to  be", "None of it", "​ tba​", "No answer. At all"])
def test_short_ways_agree_with_the_long_ones(text):
    assert answers.words(text) == answers.WORD.findall(text.lower())
    assert answers.refuses(text) == bool(re.search("|".join(answers.REFUSALS), text, re.IGNORECASE))
    core = re.sub(r"^[\W_]+|[\W_]+$", "", answers.BLANK.sub(" ", text).strip()).lower()
    assert answers.is_empty(text) == (core in answers.PLACEHOLDERS)


def test_every_turn_is_judged(spark, tmp_path):
    kind = "record_id string, exported_at timestamp, messages array<struct<role:string,content:string>>"
    turns = lambda *answers_: [m for a in answers_ for m in (("user", LONG), ("assistant", a))]
    rows = [("r", None, turns(SENTENCE[0], "N/A", SENTENCE[1], "", LONG)), ("s", None, [*turns(SENTENCE[2]), ("user", LONG)]), ("n", None, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "sft_train.parquet"))
    kind = "weakness_id string, enhanced_at timestamp, original_weakness string, enhanced_review struct<claim:string>"
    spark.createDataFrame([("w", None, LONG, (None,))], kind).write.parquet(str(tmp_path / "enhanced_reviews.parquet"))
    pairs = tables.answer_pairs(spark, str(tmp_path))
    assert sorted((r["record_key"], r["pair_no"]) for r in pairs.collect()) == [("r", n) for n in (1, 2, 3, 4, 5)] + [("s", 1), ("s", 2), ("w", 1)]
    got = {f: sorted((r["record_key"], r["pair_no"], r["defect"]) for r in getattr(queries, f)(spark, str(tmp_path)).collect()) for f in ("p6_defects", "p6_found")}
    first = [("r", 2, "empty"), ("s", 2, "empty"), ("w", 1, "empty")]
    assert got["p6_found"] == first  # two turns by definition
    assert got["p6_defects"] == sorted([*first, ("r", 4, "empty"), ("r", 5, "copied")])


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for n, k in pairs:
        if n is None or k is None or n not in root:
            continue
        if k in first:
            root[find(n)] = find(first[k])
        else:
            first[k] = n
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n, keys, seed", [(0, 1, 0), (1, 1, 1), (60, 50, 2), (80, 400, 3), (50, 2, 4)])
def test_forest_spans_the_components(spark, n, keys, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    pairs = [(rng.choice(nodes), f"k{rng.randrange(keys)}", 1) for _ in range(n)] + [(None, "k0", 1), ("n0" if n else None, None, 1)]
    pairs += pairs[:3]
    df = spark.createDataFrame(pairs, "node string, key string, a int")
    labels, forest = together.spanning_forest(spark.createDataFrame([(x,) for x in nodes], "node string"), together.star_edges(df))
    got = {r["node"]: r["root"] for r in labels.collect()}
    want = components(nodes, [p[:2] for p in pairs])
    pair_up = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    assert pair_up(got) == pair_up(want)
    assert forest.count() == n - len(set(want.values()))


def test_chain_is_contracted(spark):
    nodes = spark.range(70).select(F.format_string("n%03d", "id").alias("node"))
    edges = spark.range(69).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b"))
    labels, forest = together.spanning_forest(nodes, edges)
    assert labels.select("root").distinct().count() == 1 and forest.count() == 69


def test_dealing_keeps_shares(spark):
    rng = random.Random(5)
    groups = [(f"g{i}", 1 + int(rng.paretovariate(1.2))) for i in range(900)] + [("giant", 1500)]
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    got = together.deal(spark.createDataFrame(groups, "group_id string, size long"), shares).collect()
    assert len(got) == len(groups) and {r["split"] for r in got if r["group_id"] == "giant"} == {"train"}
    total = sum(s for _, s in groups)
    for split_, share in shares.items():
        assert abs(sum(r["size"] for r in got if r["split"] == split_) / total - share) < 0.02
    assert together.deal(spark.createDataFrame([], "group_id string, size long"), shares).count() == 0


def test_bands_of_few_groups_reach_every_split():
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    rows = together.quotas([(3, 1, 10), (2, 1, 9), (1, 2, 18), (0, 2, 18)], shares)
    assert sum(r[2] for r in rows) > 0 and sum(r[3] for r in rows) > 0
    assert all(v + t <= n for _, n, v, t in rows)
    assert together.quotas([(5, 1, 40)], shares) == [(5, 1, 0, 0)]


def test_a_forest_can_be_kept(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    labels, forest = together.spanning_forest(nodes, edges, str(tmp_path / "forest"))
    assert spark.read.parquet(str(tmp_path / "forest")).count() == forest.count() == 3
    assert labels.select("root").distinct().count() == 3
