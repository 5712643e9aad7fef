"""Core operators on small tables with every kind of edge, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import lexical as L
from threadloom.functions import scoring as C
from threadloom.functions import text as X
from threadloom.functions import times
from threadloom.operators import chunks, relational, retrieval, shred
from threadloom.operators.numbering import number_in_order
from threadloom.operators.running import previous, running_sum
from threadloom.operators.threads import turns
from threadloom.runtime import latest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_words_and_blanks(spark):
    assert one(spark, X.words, "Été-42, naïve_x!  中文 ok") == ["été", "42", "naïve", "x", "中文", "ok"]
    for v, want in [(None, True), ("", True), (" ​﻿ \n", True), (" x ", False)]:
        assert one(spark, X.blank, v) is want
    assert one(spark, X.strip, "  a b​\n") == "a b"


def test_latest_takes_the_newest_row_and_no_null_key(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")]
    got = latest(spark.createDataFrame(rows, "k string, ts int, v string"), ["k"], "ts", ["k", "v"]).collect()
    assert sorted(map(tuple, got)) == [("a", "y"), ("b", "z")]
    assert latest(spark.createDataFrame([], "k string, ts int, v string"), ["k"], "ts", ["k", "v"]).count() == 0


@pytest.mark.parametrize("most", [None, 100, 0])
@pytest.mark.parametrize("groups", [[("hot", 900), ("b", 3), (None, 5)], [], [("a", 1)]])
def test_numbers_run_through_groups_that_span_partitions(spark, groups, most):
    rng = random.Random(1)
    rows = [(k, rng.randrange(300), i) for k, n in groups for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(7)
    got = {r["id"] if r["k"] == "hot" else (r["k"], r["id"]): r["no"] for r in number_in_order(df, ["k"], ["o", "id"], "no", most).collect()}
    want = {}
    for k, _ in groups:
        for i, (_, id_) in enumerate(sorted((o, id_) for kk, o, id_ in rows if kk == k), 1):
            want[id_ if k == "hot" else (k, id_)] = i
    assert got == want


def test_running_sums_and_previous_rows(spark):
    rows = [("a", i, i % 3) for i in range(50)] + [("b", 0, 5)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    got = {(r["k"], r["i"]): (r["s"], r["p"]) for r in previous(running_sum(df, "k", "i", {"s": F.col("v")}, block=7), "k", "i", {"p": "v"}).collect()}
    total = 0
    for i in range(50):
        total += i % 3
        assert got["a", i] == (total, (i - 1) % 3 if i else None)
    assert got["b", 0] == (5, None)


NESTED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("x", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("parts", T.ArrayType(T.StructType([T.StructField("item_no", T.IntegerType()), T.StructField("sub", T.ArrayType(T.StringType()))]))),
    ])),
    T.StructField("item_no", T.StringType()),
])


def test_shredding_keeps_places_of_nested_lists(spark):
    rows = [
        ("a", ("n", ["t1", None, ""], [(1, ["p", "q"]), None, (2, []), (3, None), (4, ["r"])]), "clash"),
        ("b", None, None), ("c", (None, [], None), None), ("d", ("m", None, []), None),
    ]
    t = shred.tables(spark.createDataFrame(rows, NESTED), ["id"], ["x"])
    assert sorted(map(tuple, t["x.tags"].collect())) == [("a", 1, "t1"), ("a", 2, None), ("a", 3, "")]
    parts = {(r["id"], r["item_no"]): r["x.parts.*.item_no"] for r in t["x.parts"].collect()}
    assert parts == {("a", 1): 1, ("a", 2): None, ("a", 3): 2, ("a", 4): 3, ("a", 5): 4}
    assert sorted(map(tuple, t["x.parts.sub"].collect())) == [("a", 1, 1, "p"), ("a", 1, 2, "q"), ("a", 5, 1, "r")]
    assert {r["id"]: r["x.name" if "x.name" in t[""].columns else "name"] for r in t[""].collect()} == {"a": "n", "b": None, "c": None, "d": "m"}
    assert shred.tables(spark.createDataFrame([], NESTED), ["id"], ["x"])["x.parts.sub"].count() == 0


def packed(text, limit, least):
    import re

    out, buf, size = [], [], 0
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not part:
            continue
        units = [(s.strip(), 1) for s in re.split(r"(?<=[.!?])\s+", part)] if len(part) > limit else [(part, 2)]
        for s, gap in units:
            if not s:
                continue
            if size + len(s) + gap > limit and buf:
                out.append(" ".join(buf))
                buf, size = [s], len(s)
            else:
                buf.append(s)
                size += len(s) + gap
    return [c for c in [*out, " ".join(buf)] if len(c) >= least]


def test_chunks_are_packed_like_one_after_another(spark):
    rng = random.Random(3)
    texts = [None, "", "short", "x" * 500]
    for _ in range(40):
        sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 15))) + rng.choice([".", "!", ""])
        texts.append(rng.choice(["\n\n", "\n \n", " "]).join(" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 7))))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, c in df.select("t", chunks.pack(F.col("t"), 120, 20)).collect():
        assert c == packed(t or "", 120, 20)


def test_topk_through_index_equals_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    q = [(i, rng.sample(words, 4)) for i in range(6)] + [(99, [])]
    c = [(i, rng.sample(words, 9)) for i in range(20)] + [(77, [])]
    got = retrieval.open_topk(spark.createDataFrame(q, "q long, q_tokens array<string>"), spark.createDataFrame(c, "c long, c_tokens array<string>"), "q", "c", 3).collect()
    want = []
    for i, a in q:
        best = sorted(((-round(len(set(a) & set(b)) / len(a), 6), j) for j, b in c if a and set(a) & set(b)))[:3]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_neighbourhood_and_merge(spark):
    scored = [("w", "d", n, 0.0, False) for n in range(10)] + [("w", "other", 5, 0.0, True)]
    best = {5: (0.9, False), 9: (0.85, False), 2: (0.1, True), 0: (0.1, False)}
    scored = [(w, d, n, *(best.get(n, (s, a)) if d == "d" else (s, False))) for w, d, n, s, a in scored]
    df = spark.createDataFrame(scored, "weakness_id string, doc string, n int, score double, anchor boolean")
    got = sorted((r["doc"], r["n"]) for r in retrieval.neighbourhood(df, "weakness_id", "doc", "n", "score", "anchor", 4, 1).collect())
    assert got == [("d", n) for n in (0, 1, 2, 3, 4, 5, 6, 8, 9)]
    kind = "q string, rank int, id string, score double, prefix string"
    a = spark.createDataFrame([("q", i + 1, f"a{i}", 0.9 - i / 10, f"pa{i}") for i in range(5)], kind)
    b = spark.createDataFrame([("q", 1, "b0", 0.5, "pa0"), ("q", 2, "b1", 0.4, "pb1"), ("q", 3, "b2", 0.95, "pb2")], kind)
    merged = [r["id"] for r in retrieval.merge_ranked(a, b, "q", "id").orderBy("place").collect()]
    assert merged == ["a0", "a1", "a2", "b1", "b2"]


@pytest.mark.parametrize("most", [None, 6, 0])
def test_turns_and_phases_follow_the_rule(spark, most):
    rng = random.Random(9)
    rows = []
    for s in range(12):
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice(["review", "rebuttal", "comment", "meta_review", "decision", "rating_update", "rating_update"])
            rows.append((f"s{s}", f"e{s}-{i:02d}", None if i == 0 else f"2024-01-01T00:{i:02d}:00Z", rng.choice(["reviewer", "author", "area_chair"]), "x", kind, None, None, 1))
    df = spark.createDataFrame(rows, "submission_id string, event_id string, timestamp string, role string, actor_id string, event_type string, rating double, confidence double, fetched_at int")
    got = {r["event_id"]: (r["turn"], r["phase"]) for r in turns(df, most).collect()}
    phases = {"review": "initial_review", "rebuttal": "rebuttal", "comment": "discussion", "meta_review": "meta_review", "decision": "decision", "rating_update": "post_rebuttal"}
    for s in {r[0] for r in rows}:
        turn, before, rebutted = 0, None, False
        for r in (r for r in rows if r[0] == s):
            kind, role = r[5], r[3]
            bump = {"review": before != "reviewer", "rebuttal": before != "author", "comment": role != before, "meta_review": True, "decision": True, "rating_update": False}[kind]
            turn += bump or (turn == 0 and kind != "rating_update")
            phase = "post_rebuttal" if kind == "comment" and role == "reviewer" and rebutted else phases[kind]
            assert got[r[1]] == (turn, phase)
            rebutted |= kind == "rebuttal"
            before = role


@pytest.mark.parametrize("text, micros", [("2024-01-02T03:04:05Z", 1704164645000000), ("2024-01-02T03:04:05.5+01:00", 1704161045500000), ("2024-01-02 03:04:05", 1704164645000000), ("2024-01-02T03:04:05+0100", 1704161045000000), ("pending", None), ("", None), (None, None), ("2024", None)])
def test_times(spark, text, micros):
    assert one(spark, times.usable_time, text) == micros


def test_splits_and_shards(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    got = relational.split_val_first(df, "k", 0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"val": 2, "train": 21}
    assert relational.split_train_first(df, "k", 1.0).where("split = 'val'").count() == 0
    sizes = sorted((r["shard"], r["count"]) for r in relational.shards(df, "k", 4).groupBy("shard").count().collect())
    assert sizes == [(0, 6), (1, 6), (2, 6), (3, 5)]
    rows = spark.createDataFrame([("x", i) for i in range(30)] + [("y", 100)], "s string, id int")
    picked = relational.stratified_quota(rows, "s", "id", 10).collect()
    assert len(picked) == 10 and any(r["s"] == "y" for r in picked)


def test_overlay_resume_weights(spark):
    a = spark.createDataFrame([("1", "a"), ("2", None)], "k string, v string")
    b = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "k string, v string")
    assert sorted(map(tuple, relational.overlay(a, b, "k", ["v"]).collect())) == [("1", "a"), ("2", "y"), ("3", "z")]
    assert sorted(map(tuple, relational.overlay(a, b, "k", ["v"], False).collect())) == [("1", "x"), ("2", "y"), ("3", "z")]
    assert [r["k"] for r in relational.resume(b, a, "k").collect()] == ["3"]
    scores = spark.createDataFrame([("g", 5, 2.0), ("g", None, 3.0), ("g", 1, 2.0), ("h", None, 1.0), ("z", 3, 0.0)], "g string, s int, w double")
    assert {r["g"]: r["score"] for r in relational.weighted_mean(scores, ["g"], F.col("s"), F.col("w")).collect()} == {"g": 3.0, "h": None, "z": None}


CLAIMS = "Claim 1: The method lacks a baseline on large data.\nClaim 2: The proof of the bound is missing.\nClaim 3: The proof of the bound is missing."


def test_reward_parts(spark):
    text = lambda c, v: one(spark, c, v)
    gate = lambda c: C.gate_of_claims(c, C.claim_bodies(X.strip(c)))
    assert text(C.claim_count, CLAIMS) == 3
    assert text(gate, CLAIMS) is True
    assert text(gate, "\n".join(f"Claim {i}: the same words again" for i in range(1, 5))) is False
    assert text(gate, "None") is True
    assert text(gate, "Claim 1: as the rebuttal says") is False
    assert text(gate, "no claims here") is False
    assert text(C.base_score, " none ") == 0.10 and text(C.base_score, "x") == 0.0 and text(C.base_score, CLAIMS) is None
    assert text(lambda c: C.repetition_penalty(c, 2), "a\na\na\nb") == pytest.approx(0.0)
    assert text(lambda c: C.repetition_penalty(c, 2), "a\na\nb\nc") == 1.0
    assert text(lambda c: C.repetition_penalty(c, 1), "a\na\nb\nc") == 0.0
    assert text(lambda c: C.repetition_penalty(c, 1), "a\na") == 1.0
    assert text(C.cut_claims, "Sure. " + CLAIMS) == CLAIMS
    assert text(C.without_thinking, "<think>a\nb</think> x ") == "x"
    assert text(C.parsed_score, "score: 4 of 5") == 4 and text(C.parsed_score, "none 17") is None
    assert text(lambda c: C.form_of_claims(C.claim_bodies(c)), CLAIMS) == pytest.approx(0.85)
    whole = "## Claim\nc\n## Evidence\ne\n### Suggestion 1\n- **What**: a\n- **Where**: b\n- **How**: c\n- **Expected Outcome**: d\n- **Priority**: high\n## Severity\nmajor"
    assert text(C.cut_analysis, "intro\n" + whole + "\nassistant\n## Claim again") == whole
    assert text(C.hard_gate_analysis, whole) is True and text(C.hard_gate_analysis, "## Claim\nc\n### Suggestion 1\n- **What**: a") is False
    assert text(C.format_analysis, whole) == 1.0 and text(C.format_analysis, "x") == pytest.approx(0.9 * 0.9 * 0.85)


def test_lexical_markers(spark):
    assert one(spark, lambda c: L.chunk_type(L.norm(c)), "See Table 3.") == "table_result" and one(spark, lambda c: L.chunk_type(L.norm(c)), None) == "generic"
    assert one(spark, lambda c: L.anchors(L.norm(c)), "Eq. (3) and Table 4, then table 4") == ["eq. (3)", "table 4"]
    assert one(spark, L.tokens, "The Method, (uses) a 2-stage λ/x a") == ["method", "uses", "2-stage", "λ/x"]


def test_id_set_has_one_digest(spark, tmp_path):
    import hashlib
    import json

    from threadloom.plans import catalogue

    sha = lambda ids: hashlib.sha256(json.dumps(ids, separators=(", ", ": ")).encode()).hexdigest()
    spark.createDataFrame([("a", i) for i in (*range(2500), 7)] + [("b", 3)], "source string, doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: (r["blocks"], r["digest"]) for r in catalogue.queries()["id_set_digest_whole"](spark, str(tmp_path)).collect()}
    want = lambda ids: [sha([i for i in ids if i // 1000 == b]) for b in sorted({i // 1000 for i in ids})]
    assert got == {s: (len(x), hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()) for s, x in (("a", want(range(2500))), ("b", want([3])))}
