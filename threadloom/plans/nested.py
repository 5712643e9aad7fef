"""Queries of problem 4: flat tables of the nested review records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import shred
from threadloom.plans import sql as S
from threadloom.runtime import cut, table
from threadloom.sources import enhanced as E

#: List paths and the item kinds they hold.
KINDS = {
    "suggestion": ("enhanced_review.actionable_suggestions", E.SUGGESTION),
    "citation": ("enhanced_review.citations", ["value"]),
    "keyword": ("paper_context.keywords", ["value"]),
    "section": ("paper_context.sections_index", E.SECTION),
}
NESTED = ["enhanced_review", "paper_context", "weakness_category"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = cut(E.valid_records(spark, d), "records")
    flat = shred.tables(records, ["weakness_id"], NESTED)
    out = records.select(F.lit("review").alias("item_kind"), "weakness_id", F.lit(0).alias("item_no"))
    out = out.union(records.where("weakness_category is not null").select(F.lit("category"), "weakness_id", F.lit(0)))
    for kind, (path, fields) in KINDS.items():
        out = out.union(flat[path].where(E.filled(*fields)).select(F.lit(kind), "weakness_id", "item_no"))
    return out


def p4_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The suggestions of all valid records with all their fields."""
    flat = shred.tables(cut(E.valid_records(spark, d), "records"), ["weakness_id"], ["enhanced_review"])["enhanced_review.actionable_suggestions"]
    return flat.where(E.filled(*E.SUGGESTION)).select("weakness_id", "item_no", *E.SUGGESTION)


def p4_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of all valid records."""
    flat = shred.tables(cut(E.valid_records(spark, d), "records"), ["weakness_id"], ["paper_context"])["paper_context.sections_index"]
    return flat.where(E.filled(*E.SECTION)).select("weakness_id", "item_no", "section_id", "name", F.col("page").try_cast("int").alias("page"))


QUERIES = {"p4_found": p4_found, "p4_suggestions": p4_suggestions, "p4_sections": p4_sections}

#: Blank in DuckDB's regex dialect.
_BLANK = r"^[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]*$"
def _list(x: str) -> str:
    o = f"({S.json_opened(x)})"
    return f"CASE json_type({o}) WHEN 'ARRAY' THEN json_extract({o}, '$[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN {x} IS NULL THEN [] ELSE [{o}] END END"


def _item(fields: list[str]) -> str:
    """True where a JSON entry has a field, or is a text, that isn't blank."""
    own = " OR ".join(f"NOT regexp_matches(coalesce(e->>'{n}', ''), '{_BLANK}')" for n in fields if n != "value") or "false"
    return f"CASE json_type(e) WHEN 'OBJECT' THEN {own} WHEN 'NULL' THEN false ELSE NOT regexp_matches(coalesce(e->>'$', ''), '{_BLANK}') END"


_PACK = "r := to_json(enhanced_review), p := to_json(paper_context), c := to_json(weakness_category)"
_RECORDS = f"""
    WITH t AS (SELECT weakness_id, arg_max(struct_pack({_PACK}), enhanced_at) AS v FROM enhanced_reviews WHERE weakness_id IS NOT NULL GROUP BY 1),
    j AS (SELECT line_no, CAST(raw AS JSON) AS j FROM enhanced_raw WHERE json_valid(raw)),
    l AS (SELECT j->>'weakness_id' AS weakness_id, arg_max(j, line_no) AS j FROM j WHERE json_type(j) = 'OBJECT' AND j->>'weakness_id' IS NOT NULL GROUP BY 1),
    a AS (SELECT weakness_id, v.r AS r, v.p AS p, v.c AS c FROM t UNION ALL SELECT weakness_id, {S.json_object("(j->'enhanced_review')")}, {S.json_object("(j->'paper_context')")}, {S.json_object("(j->'weakness_category')")} FROM l),
    k AS (SELECT weakness_id, CAST(c AS JSON) AS c, {_list("(r->'actionable_suggestions')")} AS suggestion, {_list("(r->'citations')")} AS citation, {_list("(p->'keywords')")} AS keyword, {_list("(p->'sections_index')")} AS section FROM a)"""


def _found_sql() -> str:
    whole = f"{_RECORDS} SELECT 'review' AS item_kind, weakness_id, 0 AS item_no FROM k UNION ALL SELECT 'category', weakness_id, 0 FROM k WHERE c IS NOT NULL AND json_type(c) <> 'NULL'"
    for kind, (_, fields) in KINDS.items():
        whole += f" UNION ALL SELECT '{kind}', weakness_id, CAST(i AS INTEGER) FROM (SELECT weakness_id, unnest({kind}) AS e, generate_subscripts({kind}, 1) AS i FROM k) WHERE {_item(fields)}"
    return whole


def _rows_sql(kind: str, fields: list[str], out: dict[str, str]) -> str:
    """All items of a kind with their fields; a plain value is the first one."""
    each = ", ".join(f"o->>'{n}' AS \"{n}\"" if i else f"CASE WHEN o IS NULL THEN e->>'$' ELSE o->>'{n}' END AS \"{n}\"" for i, n in enumerate(fields))
    some = " OR ".join(f"NOT regexp_matches(coalesce(\"{n}\", ''), '{_BLANK}')" for n in fields)
    names = ", ".join(out.get(n, f'"{n}"') + f' AS "{n}"' for n in fields)
    return f"""{_RECORDS}, e AS (SELECT weakness_id, unnest({kind}) AS e, generate_subscripts({kind}, 1) AS i FROM k), o AS (SELECT weakness_id, i, e, {S.json_object("e")} AS o FROM e WHERE json_type(e) <> 'NULL'),
        f AS (SELECT weakness_id, CAST(i AS INTEGER) AS item_no, {each} FROM o) SELECT weakness_id, item_no, {names} FROM f WHERE {some}"""


SQL = {"p4_found": _found_sql(), "p4_suggestions": _rows_sql("suggestion", E.SUGGESTION, {}), "p4_sections": _rows_sql("section", E.SECTION, {"page": "TRY_CAST(page AS INTEGER)"})}
