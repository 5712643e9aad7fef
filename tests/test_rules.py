"""Classifiers, validators and folds, a case for every branch."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import rules as U
from threadloom.functions import validate as V
from threadloom.functions import claims as K
from threadloom.operators import answers as A
from threadloom.operators import provider

FOLLOW_UPS = [
    ("No baseline.", "I would raise my rating after this.", "score_update"),
    ("No baseline.", "The new numbers help, so I have updated my score already.", "acknowledgment"),
    ("Proof unclear.", "The authors have clarified all steps, thanks.", "acknowledgment"),
    ("Proof unclear.", "The answer does not resolve the gap in step two.", "debate"),
    ("Proof unclear.", "Thanks for the reply; however, some points are not answered.", "debate"),
    ("Proof unclear.", "I still believe the lemma is off.", "debate"),
    ("Proof unclear.", "Please also add a figure.", "same_issue"),
    ("Proof unclear.", "Moving to a different matter: the code is absent.", "new_issue"),
    ("Proof unclear.", "A new issue is the licence, though this point was raised above.", "same_issue"),
    ("The proof of the main bound is unclear to readers", "The main bound and its proof confuse readers", "same_issue"),
    ("abc", "It is this and that.", "same_issue"),
    ("abc", "I appreciate the effort.", "same_issue"),
]


@pytest.mark.parametrize("first, text, label", FOLLOW_UPS)
def test_follow_up_labels(spark, first, text, label):
    df = spark.createDataFrame([(first, text)], "a string, b string")
    assert df.select(U.follow_up(F.lower("a"), F.lower("b"))["label"]).first()[0] == label


def test_follow_up_scores(spark):
    df = spark.createDataFrame([("x", "I appreciate the effort."), ("x", "It is this and that."), ("x", "Fine."), ("the proof of the bound", "bound proof")], "a string, b string")
    got = [r[0] for r in df.select(U.follow_up(F.lower("a"), F.lower("b"))["score"]).collect()]
    assert got == pytest.approx([0.68, 0.55, 0.60, 0.80])


def test_quotes(spark):
    rows = [("The paper omits a comparison with strong baselines", "> The paper omits a comparison with strong baselines"), ("The paper omits a comparison with strong baselines", "We ran three further baselines and report them in the appendix with their spread."), ("", "x"), ("a b", "the")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(U.quote_only(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, False, False]


@pytest.mark.parametrize("invitation, signature, kinds, role", [
    ("V/-/Decision", "V/Program_Chairs", ("decision",) * 3, "program_chair"),
    ("V/P1/-/Official_Review", "V/P1/Reviewer_x", ("review",) * 3, "reviewer"),
    ("V/P1/-/Meta_Review", "V/P1/Area_Chair_a", ("meta_review",) * 3, "area_chair"),
    ("V/P1/-/Rebuttal", "V/P1/Authors", ("rebuttal", "rebuttal", "rebuttal"), "author"),
    ("V/P1/Authors/-/Official_Comment", None, ("rebuttal",) * 3, "unknown"),
    ("V/P1/-/Official_Comment", "V/P1/Area_Chair_a", ("comment",) * 3, "area_chair"),
    (None, None, ("comment",) * 3, "unknown"),
])
def test_reply_types(spark, invitation, signature, kinds, role):
    df = spark.createDataFrame([(invitation, signature)], "i string, s string")
    row = df.select(*[U.reply_type(F.col("i"), F.col("s"), n) for n in U.REPLY_TYPES], U.role_of(U.reply_type(F.col("i"), F.col("s"), "first"), F.col("s"))).first()
    assert tuple(row) == (*kinds, role)


@pytest.mark.parametrize("title, noisy", [
    ("Related Work", False), ("4. Convergence Analysis", False), ("A.3 Sensitivity", False), ("of the", True), ("we show that this works", True), ("", True), ("   ", True),
    ("One Two Three Four Five Six Seven Eight Nine", True), ("Results. We find", True), ("Method (", True), ("Ends here.", True), ("Methods and Techniques for Proving Inequalities: In Short", True),
])
def test_noisy_titles(spark, title, noisy):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(U.noisy_title(F.col("t"))).first()[0] is noisy


def test_tie_break_and_specificity(spark):
    rows = [("There is no proof here", "L2.3.2"), ("a strong assumption", "L2.3.1"), ("gap between theory and no proof", "L2.3.1"), ("no proof", "L1.1.1"), ("nothing", "L2.3.3")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, l string").select(U.tie_break(F.lower("t"), F.col("l"))).collect()]
    assert got == ["L2.3.1", "L2.3.2", "L2.3.3", "L1.1.1", "L2.3.3"]
    texts = ["Table 3 lacks a baseline because of the metric", "vague", "1", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.specificity(F.lower(F.btrim("t")))).collect()]
    assert got == [2 + 2 + 3 + 1, 0, 2, 0]


REVIEW = "claim string, evidence string, actionable_suggestions array<struct<what:string,where:string,how:string,expected_outcome:string,priority:string>>, citations array<string>, severity string"
GOOD = {"claim": "The study lacks a strong baseline.", "evidence": "The reviewer names three published systems.", "citations": [], "severity": "major", "actionable_suggestions": [{"what": "Add the three systems.", "where": "Main results", "how": "Train each with the same budget.", "expected_outcome": "A fair picture of gains.", "priority": "high"}]}


def changed(**k):
    return json.loads(json.dumps(GOOD)) | k


def suggestion(**k):
    return changed(actionable_suggestions=[GOOD["actionable_suggestions"][0] | k])


@pytest.mark.parametrize("review, sections, issues", [
    (GOOD, True, []), (None, True, ["enhanced_review"]), (changed(claim="short"), True, ["claim"]), (changed(evidence="tiny"), True, ["evidence"]), (changed(evidence=None), True, []),
    (changed(actionable_suggestions=None), True, ["actionable_suggestions"]), (changed(actionable_suggestions=[]), True, ["actionable_suggestions"]), (changed(severity="bad"), True, ["severity"]), (changed(citations=None), True, ["citations"]),
    (changed(evidence="As Table 3 shows, the gain is small."), False, ["evidence_hallucination"]), (changed(evidence="As Table 3 shows, the gain is small."), True, []), (changed(evidence="The authors clarified this point later on."), True, ["rebuttal_leakage"]),
    (suggestion(what="x"), True, ["suggestion[0].what"]), (suggestion(where=None), True, ["suggestion[0].where"]), (suggestion(how="x"), True, ["suggestion[0].how"]), (suggestion(expected_outcome=""), True, ["suggestion[0].expected_outcome"]),
    (suggestion(priority="low"), True, ["suggestion[0].priority"]), (suggestion(where="somewhere in the text"), True, ["suggestion[0].where_banned_phrase"]), (changed(actionable_suggestions=[None]), True, ["suggestion[0].missing"]),
])
def test_review_issues(spark, review, sections, issues):
    df = spark.createDataFrame([(json.dumps(review), ["s1"] if sections else [])], "j string, s array<string>").select(F.from_json("j", REVIEW).alias("r"), "s")
    df = df.select(F.when(F.lit(review is not None), F.col("r")).alias("r"), "s")
    assert df.select(V.review_issues(F.col("r"), F.col("s"))).first()[0] == issues


@pytest.mark.parametrize("review, weakness, category, reason", [
    (GOOD, "w", ("L2.1.1", 0.9), None), (None, "w", ("L2.1.1", 0.9), "missing enhanced_review"), (changed(claim=" "), "w", ("L2.1.1", 0.9), "empty claim"), (changed(actionable_suggestions=[]), "w", ("L2.1.1", 0.9), "no suggestions"),
    (suggestion(how=" "), "w", ("L2.1.1", 0.9), "suggestion[0] missing how"), (GOOD, "", ("L2.1.1", 0.9), "empty original_weakness"), (GOOD, "w", ("UNKNOWN", 0.9), "unclassified"), (GOOD, "w", (None, 0.9), "unclassified"),
    (GOOD, "w", ("L2.1.1", 0.2), "low confidence"), (GOOD, "w", ("L2.1.1", None), "low confidence"), (changed(evidence="As the authors say in their response."), "w", ("L2.1.1", 0.9), "rebuttal leakage"),
])
def test_record_failures(spark, review, weakness, category, reason):
    df = spark.createDataFrame([(json.dumps(review), weakness, category)], "j string, w string, c struct<l2_id:string,confidence:double>")
    df = df.select(F.when(F.lit(review is not None), F.from_json("j", REVIEW)).alias("r"), "w", "c")
    assert df.select(V.record_failure(F.col("r"), F.col("w"), F.col("c"), 0.5)).first()[0] == reason


def test_rubrics_and_candidates(spark):
    soft, hard = ("r", 1.0, "semantic", "x"), ("r", "x")
    kind = "s array<struct<requirement:string,weight:double,type:string,rationale:string>>, h array<struct<requirement:string,rationale:string>>"
    rows = [([soft] * 5, [hard] * 2), ([soft] * 4, [hard] * 2), ([soft] * 5, [hard]), ([("r", 1.0, "odd", "x")] * 5, [hard] * 2), ([("r", None, "format", "x")] * 5, [hard] * 2), (None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(V.rubric_valid(F.col("s"), F.col("h"))).collect()] == [True, False, False, False, False, False]
    rows = [([("t", 0.1)] * 3,), ([("t", 0.1)] * 2,), ([(" ", 0.1)] * 3,), ([("t", None)] * 3,), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "c array<struct<text:string,temperature:double>>").select(V.candidates_valid(F.col("c"))).collect()] == [True, False, False, False, False]


def test_mapping_is_cleaned_in_order(spark):
    weak = [(f"W{i}", t) for i, t in enumerate(["the baseline comparison is missing entirely", "proofs are wrong", "typos", "figures", "tables"], 1)]
    text = (
        'W1 -> "The baseline comparison is missing entirely" (Confidence: 0.9)\nW2 -> We fixed the derivation. (Confidence: 0.8)\nW3 -> Same segment as W2 (Confidence: 0.7)\n'
        "W4 -> We fixed the derivation. (Confidence: 0.6)\nW5 -> No Response (Confidence: 0.5)\nW9 -> odd (Confidence: 0.1)\nW2 -> again (Confidence: 0.2)"
    )
    df = spark.createDataFrame([(text, weak), ("W1 -> Same text as W2 (Confidence: 1)", weak), (None, weak), (text, [])], "t string, w array<struct<key:string,text:string>>")
    got = [[(m["key"], m["rebuttal"]) for m in r[0]] if r[0] is not None else [] for r in df.select(K.mapped(F.col("t"), F.col("w"))).collect()]
    assert dict(got[0]) == {"W1": "No Response", "W2": "We fixed the derivation.", "W3": "We fixed the derivation.", "W4": "No Response", "W5": "No Response"}
    assert got[1:] == [[("W1", "No Response")], [], []]
    row = spark.createDataFrame([("Point 1: a\nb Point 2: c",)], "t string").select(K.points(F.col("t"))).first()[0]
    assert [tuple(r) for r in row] == [("W1", "a\nb"), ("W2", "c")]


@pytest.mark.parametrize("text, n, weak, want", [
    ("F1 -> W1, unrelated (Confidence: 0.9) F2 -> W7 (Confidence: 0.5) F9 -> W1 (Confidence: 1)", 2, ["W1", "W2"], [(0, "W1"), (0, "UNRELATED"), (1, "UNRELATED")]),
    ("", 2, ["W1"], [(0, "W1"), (1, "W1")]), ("F1 -> W2 (Confidence: 1)", 2, ["W1"], [(0, "W1"), (1, "W1")]), ("failed", 2, ["W1", "W2"], [(0, "W1"), (0, "W2"), (1, "W1"), (1, "W2")]), (None, 1, ["W1", "W2"], [(0, "W1"), (0, "W2")]), ("x", 0, ["W1", "W2"], []),
])
def test_routes(spark, text, n, weak, want):
    row = spark.createDataFrame([(text, n, weak)], "t string, n int, w array<string>").select(K.routed(F.col("t"), F.col("n"), F.col("w"))).first()[0]
    assert [tuple(r) for r in row] == want


def refined(spark, *lists):
    df = spark.createDataFrame([(x,) for x in lists], "c array<string>")
    return [r["out"] for r in A.with_refined(df, F.col("c"), "out").select("out").collect()]


def test_claims_are_refined(spark):
    claims = ["- Claim 3: The baseline on ImageNet is missing. More words.", "The ImageNet baseline is missing from Table 2.", "Notation is unclear.", "Runtime is not reported on any dataset.", "", None]
    got, none, null, one = refined(spark, claims, [], None, ["a b"])
    assert len(got) == 2 and got[0].startswith("Claim 1: The ImageNet baseline")
    assert none == [] and null == [] and one == ["Claim 1: a b"]


def plain_refined(claims):
    """The rules said once more, one claim after another."""
    words = lambda c: {w for w in re.sub(r"[^a-z0-9\s]+", " ", c.lower()).split() if len(w) >= 4 and w not in K.CLAIM_STOPWORDS}
    points = lambda c: 2 * bool(re.search(r"\d", c)) + 2 * bool(re.search(r"\b(section|table|figure|appendix)\b", c)) + sum(bool(re.search(rf"\b{w}\b", c)) for w in U.SPECIFIC) + min(len(c.split()) // 10, 3)
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0
    heads = []
    for c in sorted(claims, key=lambda c: -points(c)):
        if all(share(words(c), words(h)) < 0.5 for h in heads):
            heads.append(c)
    left = list(range(len(heads)))
    while len(left) > 2:
        pairs = [(-share(words(heads[i]), words(heads[j])), i, j) for i in left for j in left if i < j and words(heads[i]) and words(heads[j])]
        if not pairs:
            break
        left.remove(min(pairs)[2])
    return [f"Claim {i}: {heads[k]}" for i, k in enumerate(left[:2], 1)]


def test_refined_claims_as_said_plainly(spark):
    rng = random.Random(3)
    vocabulary = ["table", "baseline", "gain", "data", "proof", "metric", "noise", "speed", "model", "clear", "weak", "seed", "runtime", "loss", "42", "x1"]
    lists = [[" ".join(rng.choices(vocabulary, k=rng.randrange(1, 14))) for _ in range(rng.randrange(0, 9))] for _ in range(40)]
    assert refined(spark, *lists) == [plain_refined(x) for x in lists]


@pytest.mark.parametrize("text, state", [
    (None, "Empty output"), ("none", "Complete (no weaknesses)"), ("Claim 1: ok\nuser\n", "Contains stray role marker"), ("[TASK 1] Claim 1: a", "Contains stray task header"), ("words", "Missing numbered claims"),
    ("Claim 1: a\nmore", "Contains non-claim trailing content"), ("Claim 2: a", "Claim numbering not sequential at Claim 2"), ("Claim 1:", "Malformed claim line"), ("Claim 1: Same  text\nClaim 2: same text", "Duplicate claim detected at Claim 2"),
    ("Claim 1: missing strong baseline\nClaim 2: strong baseline missing today", "Near-duplicate claim detected at Claim 2"), ("Claim 1: missing baselines\nClaim 2: unclear notation", "Complete"),
])
def test_completeness(spark, text, state):
    df = spark.createDataFrame([(text,)], "t string")
    assert A.with_claims_state(df, F.col("t"), "state").first()["state"] == state


@pytest.mark.parametrize("text, sections, want", [
    ("See Section 3.1 and Table 2, App. B2, Fig. 4a", False, "See the relevant section and the results table, the appendix, the figure"), ("See Section 3.1", True, "See Section 3.1"), ("Table 1", False, "the results table"), (None, True, None), ("", False, ""),
    ("in the Section 'we show that' (p. 9)", True, "in the relevant section (p. 9)"), ("in Section 'Related Work' (p. 9)", True, "in Section 'Related Work' (p. 9)"), ("as in sec. \"of the\", and Section 'Related Work'", True, "as in the relevant section, and Section 'Related Work'"),
])
def test_places_in_general_words(spark, text, sections, want):
    df = spark.createDataFrame([(text, sections)], "t string, s boolean")
    assert df.select(K.general_places(F.col("t"), F.col("s"))).first()[0] == want


def test_provider_asks_once_and_uses_the_cache(spark):
    requests = spark.createDataFrame([("1", "k", "p"), ("2", "k", "p"), ("3", "k", "q")], "id string, kind string, prompt string")
    answers, new = provider.complete(requests, None, "m", provider.stub)
    got = {r["id"]: r["text"] for r in answers.collect()}
    assert got["1"] == got["2"] and new.count() == 2
    again, asked = provider.complete(requests, new, "m", provider.stub)
    assert asked.count() == 0 and {r["id"]: r["text"] for r in again.collect()} == got
    first = spark.createDataFrame([("1", "a", 0.5), ("2", "b", 0.9), ("3", "c", 0.3)], "id string, text string, s double")
    second = spark.createDataFrame([("1", "x", 0.6), ("2", "y", 1.0), ("3", "z", 0.2)], "id string, text string, s double")
    assert {r["id"]: r["text"] for r in provider.retry(first, "s", 0.6, second).collect()} == {"1": "x", "2": "b", "3": "c"}


WHOLE = "## Claim\nc\n## Evidence\ne\n### Suggestion 1\n- **What**: a\n- **Where**: b\n- **How**: c\n- **Expected Outcome**: d\n- **Priority**: high\n## Severity\nmajor"


@pytest.mark.parametrize("text, state", [
    (WHOLE, "Complete"), (None, "Missing section: ## Claim"), (WHOLE.replace("## Evidence", "x"), "Missing section: ## Evidence"), (WHOLE.replace("- **How**: c\n", ""), "Suggestion 1 missing field: How"), (WHOLE + "\nuser\n", "Contains stray role marker"),
    (WHOLE + " [TASK 2]", "Contains stray task header"), (WHOLE.replace("major", "odd"), "Severity section missing a valid value"),
])
def test_states_of_analyses(spark, text, state):
    assert spark.createDataFrame([(text,)], "t string").select(V.analysis_state(F.col("t"))).first()[0] == state


def test_answers_are_cut_out(spark):
    rows = [("x\n" + WHOLE + "\nmore",), ("words\nassistant\nmore",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(K.analysis_answer(F.col("t"))).collect()]
    assert got[0].endswith("major") and got[1:] == ["words", None]
    rows = [("Sure:\nClaim 1: The proof is missing.\nClaim 2: No runtime on any dataset.\ntail\nClaim 3: x",), ("none",), ("plain",), (None,), ("Claim 1: a\nuser\nClaim 2: b",)]
    got = [r["a"] for r in A.with_claims_answer(spark.createDataFrame(rows, "t string"), F.col("t"), "a").collect()]
    assert got == ["Claim 1: No runtime on any dataset.\nClaim 2: The proof is missing.", "None", "plain", None, "Claim 1: a"]


def test_rewards_of_claims(spark):
    """A row for every branch: thinking, gate, base score, failed judges, missing truth, weights of 0, penalties."""
    two = "Claim 1: The baseline is missing.\nClaim 2: No runtime is given."
    rows = {
        "all": (two, two), "think": ("<think>\nx</think>" + two, two), "leak": (two + " In their response they agree.", two), "gate": ("no claims here", two), "none": ("none", two), "soft fails": (two, two), "cover fails": (two, two),
        "both fail": (two, two), "no truth": (two, "None"), "zero weights": (two, two), "long": ("Claim 1: One. Two. Three.", two), "null": (None, None),
    }
    soft = {k: [(2.0, 5), (1.0, 2)] for k in rows} | {"soft fails": [(2.0, 5), (1.0, None)], "both fail": [(1.0, None)], "zero weights": [(0.0, 5)]}
    cover = {k: [3, 5] for k in rows} | {"cover fails": [3, None], "both fail": [None]}
    got = A.reward_claims(
        spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, solution string, truth string"),
        spark.createDataFrame([(k, w, s) for k, v in soft.items() for w, s in v], "id string, weight double, score int"),
        spark.createDataFrame([(k, s) for k, v in cover.items() for s in v], "id string, score int"),
    ).collect()
    got = {r["id"]: r["reward"] for r in got}
    full = (0.8 * 0.75 + 0.2 * 0.75) * 0.9
    want = {"all": full, "think": full, "leak": 0, "gate": 0, "none": 0.1, "soft fails": 0.75 * 0.9, "cover fails": 0.75 * 0.9, "both fail": 0, "no truth": 0.75 * 0.9, "zero weights": (0.8 * 0.5 + 0.2 * 0.75) * 0.9, "long": 0.75 * 0.88, "null": 0}
    assert got == pytest.approx(want)


def test_rewards_of_analyses(spark):
    rows = [("a", WHOLE), ("b", WHOLE.replace("## Evidence\ne", "")), ("c", WHOLE), ("d", "<think>" + WHOLE + "</think>"), ("e", WHOLE.replace("## Claim\nc\n", ""))]
    soft = spark.createDataFrame([("a", 1.0, 5), ("a", 1.0, None), ("b", 1.0, 5), ("c", 1.0, None), ("d", 1.0, 5), ("e", 1.0, 3)], "id string, weight double, score int")
    got = {r["id"]: r["reward"] for r in A.reward_analyses(spark.createDataFrame(rows, "id string, solution string"), soft).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0, "c": 0, "d": 0, "e": 0.45})


@pytest.mark.parametrize("review, ok", [(GOOD, True), (None, False), (changed(claim=""), False), (changed(actionable_suggestions=[]), False), (suggestion(what=None), False), (changed(evidence="As the authors say"), False)])
def test_valid_items(spark, review, ok):
    df = spark.createDataFrame([(json.dumps(review),)], "j string").select(F.when(F.lit(review is not None), F.from_json("j", REVIEW)).alias("r"))
    assert df.select(V.item_valid(F.col("r"))).first()[0] is ok
