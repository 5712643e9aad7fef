"""Enhanced reviews from their table and from raw JSON lines, brought to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.runtime import latest, table

REVIEW = ["claim", "evidence", "severity"]
SUGGESTION = ["what", "where", "how", "expected_outcome", "priority"]
SECTION = ["section_id", "name", "page"]
CATEGORY = ["l1_id", "l1_name", "l2_id", "l2_name", "confidence", "reasoning"]


def whole_json(raw: Column) -> Column:
    """The variant of a text that is one complete JSON value, else null.

    The parser stops after the first value, so the text is also parsed as the only entry of a list and as the only field
    of an object: no text with anything after its value passes both.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).cast("array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}"))).cast("map<string,variant>")
    return F.when((F.size(in_list) == 1) & (F.size(in_object) == 1), in_list[0])


def kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def opened(v: Column) -> Column:
    """A value stored as JSON text, read; any other value as it is."""
    return F.when((kind(v) == "STRING") & _text(v).rlike(r"^\s*[\[{]"), F.coalesce(F.try_parse_json(_text(v)), v)).otherwise(v)


def as_object(v: Column) -> Column:
    o = opened(v)
    one = F.when(kind(o) == "ARRAY", F.when(F.size(o.cast("array<variant>")) == 1, o.cast("array<variant>")[0])).otherwise(o)
    return F.when(kind(one) == "OBJECT", one)


def as_list(v: Column) -> Column:
    o = opened(v)
    return F.when(kind(o) == "ARRAY", o.cast("array<variant>")).when(kind(o) != "VOID", F.array(o))


def _field(o: Column, name: str) -> Column:
    return F.variant_get(o, f"$.{name}", "variant")


def _struct(o: Column, names: list[str]) -> Column:
    return F.when(o.isNotNull(), F.struct(*[_text(_field(o, n)).alias(n) for n in names]))


def _entry(v: Column, names: list[str]) -> Column:
    """A list entry as a struct; a plain value goes to the first field."""
    o = as_object(v)
    plain = F.struct(_text(v).alias(names[0]), *[F.lit(None).cast("string").alias(n) for n in names[1:]])
    return F.when(o.isNotNull(), _struct(o, names)).when(_text(v).isNotNull(), plain)


def from_raw(lines: DataFrame) -> DataFrame:
    """lines (line_no, raw) to (weakness_id, enhanced_review, paper_context, weakness_category); the highest sound line_no of a weakness_id is valid.

    Lines that are null, empty, damaged or no object are no records, nor are objects without a weakness_id.
    """
    parsed = lines.select("line_no", whole_json(F.col("raw")).alias("v"))
    sound = parsed.where(kind(F.col("v")) == "OBJECT").select("line_no", F.to_json("v").alias("json"), _text(_field(F.col("v"), "weakness_id")).alias("weakness_id"))
    valid = latest(sound.where("weakness_id is not null"), ["weakness_id"], "line_no", ["weakness_id", "json"])
    v = F.parse_json("json")
    parts = valid.select("weakness_id", as_object(_field(v, "enhanced_review")).alias("r"), as_object(_field(v, "paper_context")).alias("p"), as_object(_field(v, "weakness_category")).alias("c"))
    lists = parts.select(
        "weakness_id", "r", "p", "c", as_list(_field(F.col("r"), "actionable_suggestions")).alias("s"), as_list(_field(F.col("r"), "citations")).alias("q"),
        as_list(_field(F.col("p"), "keywords")).alias("k"), as_list(_field(F.col("p"), "sections_index")).alias("x"),
    )
    many = lambda c, names: F.transform(c, lambda e: _entry(e, names))
    texts = lambda c: F.transform(c, _text)
    review = F.struct(*[_text(_field(F.col("r"), n)).alias(n) for n in REVIEW], many("s", SUGGESTION).alias("actionable_suggestions"), texts("q").alias("citations"))
    context = F.struct(*[_text(_field(F.col("p"), n)).alias(n) for n in ("title", "abstract")], texts("k").alias("keywords"), many("x", SECTION).alias("sections_index"))
    return lists.select("weakness_id", F.when(F.col("r").isNotNull(), review).alias("enhanced_review"), F.when(F.col("p").isNotNull(), context).alias("paper_context"), _struct(F.col("c"), CATEGORY).alias("weakness_category"))


def from_table(rows: DataFrame) -> DataFrame:
    """The same shape from enhanced_reviews; of a weakness_id the row with the latest enhanced_at is valid."""
    as_text = lambda c, names: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{n}").cast("string").alias(n) for n in names]))
    many = lambda c, names: F.transform(c, lambda e: F.when(e.isNotNull(), F.struct(*[e[n].cast("string").alias(n) for n in names])))
    r, p = F.col("enhanced_review"), F.col("paper_context")
    review = F.struct(*[r[n].alias(n) for n in REVIEW], many("enhanced_review.actionable_suggestions", SUGGESTION).alias("actionable_suggestions"), r["citations"].alias("citations"))
    context = F.struct(*[p[n].alias(n) for n in ("title", "abstract")], p["keywords"].alias("keywords"), many("paper_context.sections_index", SECTION).alias("sections_index"))
    shaped = rows.select("weakness_id", "enhanced_at", F.when(r.isNotNull(), review).alias("enhanced_review"), F.when(p.isNotNull(), context).alias("paper_context"), as_text("weakness_category", CATEGORY).alias("weakness_category"))
    return latest(shaped, ["weakness_id"], "enhanced_at", ["weakness_id", "enhanced_review", "paper_context", "weakness_category"])


def valid_records(spark: SparkSession, d: str) -> DataFrame:
    return from_table(table(spark, d, "enhanced_reviews")).union(from_raw(table(spark, d, "enhanced_raw")))


def filled(*columns: str) -> Column:
    """True where one of the columns is not blank."""
    any_ = F.lit(False)
    for c in columns:
        any_ = any_ | ~X.blank(F.col(f"`{c}`"))
    return any_
