"""Files, forum notes, raw reviews and the resumable stream."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources import enhanced, forum, lines
from threadloom.streaming import resume

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.ArrayType(T.LongType()))])


def test_lines_round_trip_and_damaged_lines(spark, tmp_path):
    rows = [("a", "x y​", [1, 2]), ("b", None, None), ("c", "", [])]
    path = str(tmp_path / "l")
    lines.write_lines(spark.createDataFrame(rows, SCHEMA), path)
    back = {r["id"]: (r["text"], r["n"]) for r in lines.read_strict(spark, path, SCHEMA).collect()}
    assert back == {"a": ("x y ", [1, 2]), "b": (None, None), "c": ("", [])}
    (tmp_path / "bad.json").write_text('{"id": "a"}\n{"id": \n\n{"id": "b", "n": [3]}\n')
    good, bad = lines.read_tolerant(spark, str(tmp_path / "bad.json"), SCHEMA)
    assert sorted(r["id"] for r in good.collect()) == ["a", "b"] and [r["raw"] for r in bad.collect()] == ['{"id": ']
    with pytest.raises(Exception):
        lines.read_strict(spark, str(tmp_path / "bad.json"), SCHEMA).collect()


def test_documents_splits_and_newest_file(spark, tmp_path):
    lines.write_document(spark, {"b": [1, "é"]}, str(tmp_path / "d.json"))
    assert lines.read_document(spark, str(tmp_path / "d.json")) == {"b": [1, "é"]}
    lines.write_splits(spark.createDataFrame([("1", "train"), ("2", "val")], "id string, split string"), "split", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'val'").count() == 1
    assert lines.latest_file(spark, str(tmp_path / "s")).endswith(".parquet")


@pytest.mark.parametrize("raw, sound", [('{"a": 1}', True), (' {"a": 1}\n', True), ('{"a": 1} x', False), ('{"a": 1}{"b": 2}', False), ('{"a": 1}}', False), ('{"a": 1}, {"b": 2}', False), ('{"a": 1}] }', False), ('"a": 1}', False), ("", False), (None, False), ("[1]", False), ("null", False)])
def test_whole_json(spark, raw, sound):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(F.coalesce(enhanced.kind(enhanced.whole_json(F.col("r"))) == "OBJECT", F.lit(False))).first()[0] is sound


def test_raw_reviews_in_every_shape(spark):
    review = {"claim": "c", "citations": "one", "actionable_suggestions": {"what": "w", "id": 3}, "extra": {"x": [1]}}
    rows = [
        (1, json.dumps({"weakness_id": "a", "enhanced_review": json.dumps(review), "paper_context": None})),
        (2, json.dumps({"paper_context": {"keywords": json.dumps(["k1", None, " "]), "sections_index": [{"section_id": None, "name": "N", "page": 3}, None]}, "weakness_id": "b", "weakness_category": [{"l1_id": "x"}]})),
        (3, '{"weakness_id": "b", "enhanced'), (4, json.dumps({"weakness_id": "a", "enhanced_review": {"citations": [], "actionable_suggestions": json.dumps([{"what": "v"}, None])}})), (5, json.dumps({"no": "id"})), (6, None),
    ]
    got = {r["weakness_id"]: r for r in enhanced.from_raw(spark.createDataFrame(rows, "line_no long, raw string")).collect()}
    assert set(got) == {"a", "b"}
    assert [s["what"] if s else None for s in got["a"]["enhanced_review"]["actionable_suggestions"]] == ["v", None]
    assert got["b"]["enhanced_review"] is None and got["b"]["weakness_category"]["l1_id"] == "x"
    assert got["b"]["paper_context"]["keywords"] == ["k1", None, " "] and got["b"]["paper_context"]["sections_index"][0]["page"] == "3"
    first = {r["weakness_id"]: r for r in enhanced.from_raw(spark.createDataFrame(rows[:1], "line_no long, raw string")).collect()}["a"]["enhanced_review"]
    assert first["citations"] == ["one"] and first["actionable_suggestions"][0]["what"] == "w"
    assert enhanced.from_raw(spark.createDataFrame([], "line_no long, raw string")).count() == 0


def test_forum_notes(spark):
    v2 = spark.createDataFrame([("1", "f", "f", ["a/-/Review"], ["s"], 5), ("f", "f", None, None, None, 1)], "id string, forum string, replyto string, invitations array<string>, signatures array<string>, tcdate long")
    v1 = spark.createDataFrame([("2", "f", "1", "b/-/Comment", ["t"], 6), ("3", "f", "1", None, None, None)], "id string, forum string, replyto string, invitation string, signatures array<string>, tcdate long")
    got = {r["id"]: r["invitations"] for r in forum.canonical_notes(v2, v1).collect()}
    assert got == {"1": ["a/-/Review"], "2": ["b/-/Comment"], "3": None}
    one = spark.createDataFrame([("x", 1)], "k string, v int")
    two = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert sorted(map(tuple, forum.first_source([one, two], "k").collect())) == [("x", 1), ("y", 3)]
    filled = spark.createDataFrame([(["r"],), ([],)], "replies array<string>")
    assert forum.best_source({"a": filled.limit(0), "b": filled, "c": filled.union(filled).where("size(replies) = 0")}, "replies") == "b"
    with pytest.raises(ValueError):
        forum.require_rows(filled.limit(0), "events")


def test_fields_of_notes(spark):
    content = {"Overall_Score": "8: Accept", "review": " good ", "confidence": "4", "x": "12", "Notes": "long words"}
    df = spark.createDataFrame([(content,)], "c map<string,string>")
    rating = forum.by_keys(F.col("c"), forum.RATING_KEYS, True)
    row = df.select(forum.number(rating), forum.label(rating), forum.by_keys(F.col("c"), forum.CONFIDENCE_KEYS), forum.review_text(F.col("c")), forum.review_text(F.map_filter(F.col("c"), lambda k, v: k != "review"))).first()
    assert tuple(row) == (8.0, "Accept", "4", "good", "## Notes\nlong words\n\n## Overall_Score\n8: Accept")
    urls = spark.createDataFrame([("https://a/b",), ("/p?id=1",), ("p.pdf",), ("",), (None,)], "u string").select(forum.pdf_url(F.col("u"), "https://h")).collect()
    assert [r[0] for r in urls] == ["https://a/b", "https://h/p?id=1", "https://h/p.pdf", None, None]
    lines_ = spark.createDataFrame([("Accept (poster)\nbecause",), ("Comment\nfirst",), (None,)], "d string").select(forum.decision_line(F.col("d"))).collect()
    assert [r[0] for r in lines_] == ["Accept (poster)", "Comment\nfirst", None]


def test_section_index(spark):
    spans = [("p", i, 10.0, "body text " * 5, 1) for i in range(4)] + [("p", 5, 14.2, "Introduction", 1), ("p", 6, 14.2, "introduction", 2), ("p", 7, 12.0, "Main Results", 3), ("p", 8, 12.0, "3.1 Results of all", 3), ("p", 9, 18.0, "Colours", 3), ("p", 10, 9.0, "long text in small type " * 40, 4), ("p", 11, 14.2, " ", 4)]
    got = forum.section_index(spark.createDataFrame(spans, "paper string, no int, size double, text string, page int")).orderBy("section_id").collect()
    assert [tuple(r) for r in got] == [("p", "s1", "Introduction", 1), ("p", "s2", "3.1 Results of all", 3)]


def test_stream_skips_what_is_done(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "id string, v int"
    run = lambda: resume.process_new(spark, spark.readStream.schema(kind).parquet(source), target, "id", lambda df: df.withColumn("w", F.col("v") * 2), tmp_path.name).awaitTermination(120)
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], kind).write.parquet(source)
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], kind).write.mode("append").parquet(source)
    run()
    assert sorted((r["id"], r["w"]) for r in spark.read.parquet(target).collect()) == [("a", 2), ("b", 4), ("c", 6)]


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 05:00:00", "y")]
    df = spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "e"))
    q = resume.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "k").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["k"], r["n"]) for r in spark.sql("select * from w").collect()] == [("x", 2)]
