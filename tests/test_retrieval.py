"""Scores of the retrieval modes by hand, and what the merged list promises."""

import pytest

from threadloom.operators import retrieval as R

RECORD = "weakness_id string, group string, " + ", ".join(f"`{f}` string" for f in R.FIELDS) + ", sections array<struct<name:string,page:int>>"
CHUNK = "group string, doc long, chunk_no int, page int, text string"


def record(id_, sections=(), **fields):
    return (id_, "g", *[fields.get(f, "") for f in R.FIELDS], list(sections))


def scores(spark, records, chunks, mode):
    r = R.prepare_records(spark.createDataFrame(records, RECORD))
    c = R.prepare_chunks(spark.createDataFrame(chunks, CHUNK))
    return {(x["weakness_id"], x["doc"]): {"score": x[f"score_{mode}"], "anchor_match": x[f"anchor_{mode}"]} for x in R.score_pairs(r, c, [mode]).collect()}


CHUNKS = [("g", 1, 0, 1, "Alpha beta delta and nothing else."), ("g", 2, 0, 4, "Lemma 3 and its proof follow from the equation above."), ("other", 3, 0, 1, "alpha beta gamma"), ("g", 4, 0, 9, "")]


def test_scores_by_hand(spark):
    rows = [record("plain", claim="alpha beta gamma"), record("formal", claim="the proof of lemma 3 is unclear"), record("empty")]
    got = scores(spark, rows, CHUNKS, "task2_evidence")
    assert ("plain", 3) not in got and got["empty", 1]["score"] == 0
    assert got["plain", 1]["score"] == pytest.approx(0.38 * 2 / 3, abs=1e-6)
    # overlap, theory bias by type and by words, clarity by type and by words, anchor, two hint words
    assert got["formal", 2]["score"] == pytest.approx(0.38 * 2 / 3 + 0.12 + 0.14 + 0.08 + 0.12 + 0.20 + 0.06, abs=1e-6)
    assert got["formal", 2]["anchor_match"] and not got["plain", 1]["anchor_match"]
    first = scores(spark, rows, CHUNKS, "task1")
    assert first["plain", 1]["score"] == pytest.approx(0.48 * 2 / 3, abs=1e-6)
    support = scores(spark, [record("s", what="alpha beta", how="gamma")], CHUNKS, "task2_support")
    assert support["s", 1]["score"] == pytest.approx(0.20 + 0.05, abs=1e-6)  # the phrase counts as well
    # a method chunk gains where the suggestion speaks of methods; evidence makes an anchor match but no anchor score
    support = scores(spark, [record("m", how="another theorem"), record("n", how="another thing"), record("a", evidence="lemma 3")], CHUNKS, "task2_support")
    assert support["m", 2]["score"] - support["n", 2]["score"] == pytest.approx(0.07, abs=1e-6)
    assert support["a", 2]["anchor_match"] and support["a", 2]["score"] == pytest.approx(0.14 + 0.03, abs=1e-6)  # overlap and a hint word
    first = scores(spark, [record("f", followups="see lemma 3")], CHUNKS, "task1")
    assert first["f", 2]["anchor_match"] and first["f", 2]["score"] > 0.20


def test_places_count(spark):
    rows = [record("p", [("Alpha Study", 3), ("References", 9), ("", 1)], claim="alpha on page 4"), record("e", [("Experiments", 4)], claim="the baseline results", where="p. 4")]
    got = scores(spark, rows, CHUNKS, "task2_evidence")
    assert got["p", 2]["score"] == pytest.approx(0.18, abs=1e-6)  # the named page
    assert got["p", 4]["score"] == pytest.approx(-0.18, abs=1e-6)  # a discouraged section
    assert got["p", 1]["score"] == pytest.approx(0.38 / 2 + 0.05, abs=1e-6)  # two pages from the section named like the claim
    assert got["e", 2]["score"] == pytest.approx(0.18 - 0.10, abs=1e-6)  # the preferred section, less what a method chunk loses in an empirical case; the support text isn't read here


def test_aligned_lists(spark):
    chunks = [("g", d, n, n + 1, f"alpha beta chunk {d} {n} " + "words " * (d + n)) for d in range(3) for n in range(5)] + [("g", 9, 0, 1, "alpha beta chunk 0 0 " + "words " * 0)]
    rows = [record("a", claim="alpha beta chunk", what="alpha chunk"), record("b", claim="nothing here")]
    got = R.align(R.prepare_records(spark.createDataFrame(rows, RECORD)), R.prepare_chunks(spark.createDataFrame(chunks, CHUNK))).collect()
    places = sorted(r["place"] for r in got if r["weakness_id"] == "a")
    assert places == [1, 2, 3, 4] and len({r["id"] for r in got if r["weakness_id"] == "a"}) == 4  # both channels name the same four
    assert {"0:0", "9:0"} - {r["id"] for r in got if r["weakness_id"] == "a"}  # of equal prefixes one
    block = R.prompt_block(spark.createDataFrame([("q", 1, "x", 0.5), ("q", 2, "y", 0.25)], "q string, rank int, c string, score double"), spark.createDataFrame([("x", 7, "text x"), ("y", 8, "text y")], "c string, page int, text string"), "q", "c")
    assert block.first()["block"] == "(p.7, score=0.5000) text x\n(p.8, score=0.2500) text y"
    assert R.align(R.prepare_records(spark.createDataFrame([], RECORD)), R.prepare_chunks(spark.createDataFrame([], CHUNK))).count() == 0


def test_task1_and_status(spark):
    chunks = [("g", 0, n, n + 1, f"alpha chunk {n}") for n in range(9)] + [("other", 1, 0, 1, "beta")]
    rows = [record("a", claim="alpha chunk 4"), record("b", claim="zzz")]
    r, c = R.prepare_records(spark.createDataFrame(rows, RECORD)), R.prepare_chunks(spark.createDataFrame(chunks, CHUNK))
    found = R.align_task1(r, c)
    assert [x["id"] for x in found.where("weakness_id = 'a'").orderBy("rank").collect()] == ["0:4", "0:0", "0:1"]
    asked = spark.createDataFrame([("a", "g", "u"), ("b", "g", None), ("c", "g", " x"), ("d", "none", "u"), ("e", None, "u")], "weakness_id string, group string, pdf_url string")
    got = {x["weakness_id"]: x["status"] for x in R.status(asked, c, found.where("weakness_id = 'a'")).collect()}
    assert got == {"a": "ok", "b": "no_pdf_url", "c": "no_snippet_found", "d": "no_text_extracted", "e": "no_text_extracted"}
