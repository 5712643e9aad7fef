"""Forum exports landed as files: notes of both API versions in one shape, and what is read out of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X

#: Keys of ratings in order of preference, then generic ones; keys of confidence and of text. Fixed values.
RATING_KEYS = ["overall_rating", "rating", "recommendation", "reviewer_rating", "overall_assessment", "overall", "score", "assessment"]
CONFIDENCE_KEYS = ["confidence", "reviewer_confidence", "confidence_rating"]
TEXT_KEYS = ["comment", "response", "text", "message", "rebuttal", "discussion"]
NUMBER = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[:：]?\s*(.*)"
#: How headings begin that a section index keeps. Fixed values.
HEADINGS = [
    "Introduction", r"Related\s+Work", "Background", "Method", "Approach", "Model", "Experiments?", "Results?", "Evaluation", "Discussion", "Conclusion", "Acknowledgements?", "References", "Appendix", "Limitations",
    "Abstract", "Supplementary", "Analysis", "Setup", "Ablation", "Implementation", "Training", "Dataset",
]
HEADING = r"(?i)^(?:\d+(?:\.\d+)*\s+)?(?:" + "|".join(HEADINGS) + ")"


def unwrap(value: Column, bare: Column) -> Column:
    """The x of {"value": x}, or x itself."""
    return F.coalesce(value, bare)


def safe_text(c: Column) -> Column:
    return F.when(~X.blank(c), X.strip(c))


def safe_list(c: Column) -> Column:
    """Trimmed entries that aren't blank; null if none."""
    kept = F.filter(F.transform(c, lambda x: X.strip(x)), lambda x: ~X.blank(x))
    return F.when(F.size(kept) > 0, kept)


def number(c: Column) -> Column:
    return F.regexp_extract(c, NUMBER, 1).try_cast("double")


def label(c: Column) -> Column:
    return safe_text(F.regexp_extract(c, NUMBER, 2))


def by_keys(content: Column, keys: list[str], contains: bool = False) -> Column:
    """First value of a map by preferred keys; contains: a key that has the preferred one inside."""
    if not contains:
        return F.coalesce(*[safe_text(content[k]) for k in keys])
    names = F.array_sort(F.map_keys(content))
    return F.coalesce(*[content[F.try_element_at(F.filter(names, lambda n: F.contains(F.lower(n), F.lit(k))), F.lit(1))] for k in keys])


def review_text(content: Column) -> Column:
    """The review field, else all longer text fields under their names."""
    parts = F.filter(F.map_entries(content), lambda e: (F.length(X.strip(e["value"])) >= 3) & ~e["value"].rlike(r"^\s*[0-9.]+\s*$"))
    return F.coalesce(safe_text(content["review"]), F.array_join(F.transform(F.array_sort(parts), lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n"), X.strip(e["value"]))), "\n\n"))


def pdf_url(c: Column, base: str) -> Column:
    return F.when(X.blank(c), None).when(c.rlike("^https?://"), c).when(F.startswith(c, F.lit("/")), F.concat(F.lit(base), c)).otherwise(F.concat(F.lit(base + "/"), c))


def pdf_candidates(url: Column, web: Column) -> Column:
    """URLs to try in order, each once, and the page's id as a last resort."""
    id_ = F.regexp_extract(web, r"[?&]id=([^&#]+)", 1)
    host = F.regexp_extract(web, r"^(https?://[^/]+)", 1)
    built = F.when((id_ != "") & (host != ""), F.concat(host, F.lit("/pdf?id="), id_))
    return F.array_distinct(F.array_compact(F.array(url, F.regexp_replace(url, "^http:", "https:"), built)))


def decision_line(c: Column) -> Column:
    """The first line where it has the decision, else the whole."""
    head = F.split(X.strip(c), "\n")[0]
    return F.when(head.rlike("(?i)accept|reject"), X.strip(head)).otherwise(X.strip(c))


def decision_name(c: Column) -> Column:
    s = F.lower(decision_line(c))
    return F.when(s.rlike("reject"), "reject").when(s.rlike("withdraw"), "withdrawn").when(s.rlike("accept|poster|oral|spotlight"), "accept")


def canonical_notes(v2: DataFrame, v1: DataFrame) -> DataFrame:
    """v2 (id, forum, replyto, invitations, signatures, tcdate) and v1 (..., invitation): one shape; root notes left out."""
    one = v1.withColumn("invitations", F.when(F.col("invitation").isNotNull(), F.array("invitation")))
    columns = ["id", "forum", "replyto", "invitations", "signatures", "tcdate"]
    return v2.select(*columns).unionByName(one.select(*columns)).where("id is not null and not (id <=> forum)")


def first_source(candidates: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first candidate that has any for their key."""
    numbered = [c.withColumn("__s", F.lit(i)) for i, c in enumerate(candidates)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    best = rows.groupBy(key).agg(F.min("__s").alias("__best"))
    return rows.join(best, key).where("__s = __best").drop("__s", "__best")


def best_source(candidates: dict[str, DataFrame], replies: str) -> str | None:
    """The candidate with most non-empty reply lists among 50 probed rows, ties: more rows, then name."""
    probes = [c.limit(50).agg(F.lit(name).alias("name"), F.count_if(F.size(replies) > 0).alias("filled"), F.count("*").alias("rows")) for name, c in candidates.items()]
    if not probes:
        return None
    row = reduce(DataFrame.union, probes).orderBy(F.desc("filled"), F.desc("rows"), "name").first()
    return row["name"] if row["rows"] else None


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows, or an error where there are none."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def section_index(spans: DataFrame) -> DataFrame:
    """spans (paper, no, size, text, page): headings set larger than the size of most spans (of equal ones the first), each name once: (paper, section_id, name, page)."""
    named = spans.select("paper", "no", F.round("size", 1).alias("__size"), X.strip(F.col("text")).alias("name"), "page").where("name != ''")
    counts = named.groupBy("paper", "__size").agg(F.count("*").alias("n"), F.min("no").alias("first"))
    body = counts.groupBy("paper").agg(F.max_by("__size", F.struct("n", -F.col("first"))).alias("__body"))
    heads = named.join(body, "paper").where(F.col("__size") > F.col("__body")).where(F.length("name").between(3, 80) & F.col("name").rlike(HEADING))
    once = heads.groupBy("paper", F.lower("name").alias("__k")).agg(F.min(F.struct("no", "name", "page")).alias("f")).select("paper", "f.*")
    place = F.row_number().over(Window.partitionBy("paper").orderBy("no"))
    return once.select("paper", F.concat(F.lit("s"), place.cast("string")).alias("section_id"), "name", "page")


def page_text(c: Column) -> Column:
    """Trailing blanks of lines gone, no more than one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
